"""The registered queries of the page operators and the DuckDB SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geom, text as tx
from ..functions.geom import box
from ..operators import folds, learning, marks, repair, sequences, spatial, votes
from .relations import relation, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


INTER = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
UNION = f"(a.w * a.h + b.w * b.h - {INTER})"
SMALLER = "least(greatest(1, a.w * a.h), greatest(1, b.w * b.h))"
PAIRS = f"boxes a JOIN boxes b ON a.page = b.page AND {INTER} > 0"


def boxes(spark, sf_dir, where: str | None = None) -> DataFrame:
    df = relation(spark, sf_dir, "boxes")
    return df.where(where) if where else df


@query(f"{with_('boxes')} SELECT a.page, a.id AS a_id, b.id AS b_id, {INTER} / greatest(1e-6, CAST({UNION} AS DOUBLE)) AS iou FROM {PAIRS} AND a.id <> b.id")
def iou_pairs(spark, sf_dir):
    pairs = spatial.touching(boxes(spark, sf_dir), boxes(spark, sf_dir)).where("a_id <> b_id")
    return pairs.select(F.col("a_page").alias("page"), "a_id", "b_id", geom.iou(box("a_"), box("b_")).alias("iou"))


@query(f"""{with_('boxes')} SELECT a.page, a.id AS a_id, b.id AS b_id, {INTER} / ({UNION} + CAST(1e-6 AS DOUBLE)) AS iou_plus, {INTER} / greatest(1, {UNION}) AS iou_pixel, {INTER} / {SMALLER} AS overlap_smaller,
  {INTER} / greatest(1, a.w * a.h) AS inside FROM {PAIRS} AND a.id < b.id""")
def overlap_measures(spark, sf_dir):
    pairs = spatial.touching(boxes(spark, sf_dir), boxes(spark, sf_dir)).where("a_id < b_id")
    a, b = box("a_"), box("b_")
    return pairs.select(F.col("a_page").alias("page"), "a_id", "b_id", geom.iou_plus(a, b).alias("iou_plus"), geom.iou_pixel(a, b).alias("iou_pixel"), geom.overlap_smaller(a, b).alias("overlap_smaller"), geom.inside(a, b).alias("inside"))


@query(f"""{with_('boxes')} SELECT page, id, match_id, iou FROM (SELECT a.page, a.id, b.id AS match_id, {INTER} / greatest(1e-6, CAST({UNION} AS DOUBLE)) AS iou,
  row_number() OVER (PARTITION BY a.id ORDER BY {INTER} / greatest(1e-6, CAST({UNION} AS DOUBLE)) DESC, b.id) AS r FROM {PAIRS} AND a.id % 2 = 0 AND b.id % 2 = 1) WHERE r = 1 AND iou > 0.3""")
def iou_best_match(spark, sf_dir):
    return spatial.best_match(boxes(spark, sf_dir, "id % 2 = 0"), boxes(spark, sf_dir, "id % 2 = 1"), 0.3)


@query(f"{with_('boxes')} SELECT * FROM boxes a WHERE id % 2 = 0 AND EXISTS (SELECT 1 FROM boxes b WHERE b.page = a.page AND b.id % 2 = 1 AND {INTER} / {SMALLER} >= 0.25)")
def iou_semi(spark, sf_dir):
    return spatial.with_overlap(boxes(spark, sf_dir, "id % 2 = 0"), boxes(spark, sf_dir, "id % 2 = 1"), 0.25)


@query(f"{with_('boxes')} SELECT * FROM boxes a WHERE id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.page = a.page AND b.id % 2 = 1 AND {INTER} / {SMALLER} >= 0.25)")
def iou_anti(spark, sf_dir):
    return spatial.with_overlap(boxes(spark, sf_dir, "id % 2 = 0"), boxes(spark, sf_dir, "id % 2 = 1"), 0.25, anti=True)


@query(f"""{with_('boxes')} SELECT a.page, a.id AS a_id, b.id AS b_id FROM boxes a JOIN boxes b ON a.page = b.page AND a.id <> b.id AND a.x + a.w / 2 BETWEEN b.x AND b.x + b.w AND a.y + a.h / 2 BETWEEN b.y AND b.y + b.h""")
def center_in_box(spark, sf_dir):
    pairs = spatial.touching(boxes(spark, sf_dir), boxes(spark, sf_dir)).where("a_id <> b_id").where(geom.center_in(box("a_"), box("b_")))
    return pairs.select(F.col("a_page").alias("page"), "a_id", "b_id")


@query(f"""{with_('boxes')} SELECT page, id, glyph_id, share FROM (SELECT a.page, a.id, b.id AS glyph_id, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) / greatest(1, least(a.w, b.w)) AS share,
  row_number() OVER (PARTITION BY a.id ORDER BY greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) / greatest(1, least(a.w, b.w)) DESC, b.id DESC) AS r
  FROM {PAIRS} AND a.id % 3 = 0 AND b.id % 3 <> 0 AND greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / greatest(1, least(a.h, b.h)) >= 0.30
  AND greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) / greatest(1, least(a.w, b.w)) >= 0.35) WHERE r = 1""")
def interval_overlap(spark, sf_dir):
    return spatial.covered_glyph(boxes(spark, sf_dir, "id % 3 = 0"), boxes(spark, sf_dir, "id % 3 <> 0"))


@query(f"""{with_('boxes')} SELECT * FROM boxes a WHERE EXISTS (SELECT 1 FROM boxes b WHERE b.page = a.page AND b.id <> a.id AND a.y - (b.y + b.h) >= -0.3 * b.h AND a.y - (b.y + b.h) <= 40 AND b.x < a.x + a.w AND b.x + b.w > a.x)""")
def icon_above(spark, sf_dir):
    return spatial.neighbour_above(boxes(spark, sf_dir), boxes(spark, sf_dir), 400.0)


@query(f"""{with_('boxes')} SELECT a.page, a.id, arg_max(b.id, (b.y + b.h) * 1000000 - b.id) AS prev_id FROM boxes a JOIN boxes b ON a.page = b.page AND a.y + a.h - b.y - b.h > 0 AND a.y + a.h - b.y - b.h < CAST(2.2 AS DOUBLE) * a.h AND abs(a.x - b.x) < CAST(0.8 AS DOUBLE) * a.h GROUP BY a.page, a.id""")
def prev_line_asof(spark, sf_dir):
    lines = boxes(spark, sf_dir).select("page", "id", "x", (F.col("y") + F.col("h")).alias("baseline"), F.col("h").alias("size"))
    return spatial.previous_line(lines)


_SEQ = "SELECT *, row_number() OVER (PARTITION BY page ORDER BY id) AS k FROM boxes"


@query(f"""{with_('boxes')}, s AS MATERIALIZED ({_SEQ}), f AS (
  SELECT page, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(page BIGINT, id BIGINT, x BIGINT, y BIGINT, w BIGINT, h BIGINT)[]) AS kept FROM (SELECT DISTINCT page FROM s)
  UNION ALL
  SELECT f.page, s.k, CASE WHEN len(list_filter(f.kept, lambda b: {INTER.replace('a.', 's.')} / {SMALLER.replace('a.', 's.')} >= 0.65)) > 0 THEN f.kept
    ELSE list_append(f.kept, {{'page': s.page, 'id': s.id, 'x': s.x, 'y': s.y, 'w': s.w, 'h': s.h}}) END FROM f JOIN s ON s.page = f.page AND s.k = f.k + 1)
SELECT page, u.id FROM (SELECT page, unnest(kept) AS u FROM (SELECT page, kept, row_number() OVER (PARTITION BY page ORDER BY k DESC) AS r FROM f) WHERE r = 1)""")
def nms_greedy(spark, sf_dir):
    return folds.greedy_dedupe(boxes(spark, sf_dir))


@query(f"""{with_('boxes')}, s AS MATERIALIZED (SELECT *, w * 7 % 100 AS score, row_number() OVER (PARTITION BY page ORDER BY id) AS k FROM boxes), f AS (
  SELECT page, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id BIGINT, x BIGINT, y BIGINT, w BIGINT, h BIGINT, score BIGINT)[]) AS kept FROM (SELECT DISTINCT page FROM s)
  UNION ALL
  SELECT page, k, CASE WHEN pos IS NULL OR pos = 0 THEN list_append(kept, own) WHEN own.score > kept[pos].score THEN list_concat(list_concat(kept[1 : pos - 1], [own]), kept[pos + 1 : len(kept)]) ELSE kept END FROM (
    SELECT f.page, s.k, f.kept, {{'id': s.id, 'x': s.x, 'y': s.y, 'w': s.w, 'h': s.h, 'score': s.score}} AS own,
      list_position(list_transform(f.kept, lambda b: {INTER.replace('a.', 's.')} / greatest(1, {UNION.replace('a.', 's.')}) >= 0.3), true) AS pos FROM f JOIN s ON s.page = f.page AND s.k = f.k + 1))
SELECT page, u.id FROM (SELECT page, unnest(kept) AS u FROM (SELECT page, kept, row_number() OVER (PARTITION BY page ORDER BY k DESC) AS r FROM f) WHERE r = 1)""")
def keep_better(spark, sf_dir):
    return folds.keep_better(boxes(spark, sf_dir).withColumn("score", F.col("w") * 7 % 100), 0.3)


@query(f"""{with_('boxes')}, s AS MATERIALIZED (SELECT page, id, CAST(h + (id % 7) / 10.0 AS DOUBLE) AS size, row_number() OVER (PARTITION BY page ORDER BY CAST(h + (id % 7) / 10.0 AS DOUBLE), id) AS k FROM boxes), f AS (
  SELECT page, id, size, k, 0 AS g, size AS first FROM s WHERE k = 1
  UNION ALL SELECT s.page, s.id, s.size, s.k, CASE WHEN s.size <= f.first * (1 + 1.6 * CAST(0.085 AS DOUBLE)) AND s.size <= f.size * (1 + CAST(0.085 AS DOUBLE)) THEN f.g ELSE f.g + 1 END,
    CASE WHEN s.size <= f.first * (1 + 1.6 * CAST(0.085 AS DOUBLE)) AND s.size <= f.size * (1 + CAST(0.085 AS DOUBLE)) THEN f.first ELSE s.size END FROM f JOIN s ON s.page = f.page AND s.k = f.k + 1)
SELECT page, id, size, median(size) OVER (PARTITION BY page, g) AS target FROM f""")
def unify_sizes(spark, sf_dir):
    lines = boxes(spark, sf_dir).select("page", "id", (F.col("h") + (F.col("id") % 7) / F.lit(10.0)).alias("size"))
    return folds.size_groups(lines)


_SIDES = "abs(z.x - s.x) < CAST(0.6 AS DOUBLE) * s.h"
_MIDDLES = "abs((z.x + z.r) - (s.x + s.x + s.w)) / 2 < CAST(0.6 AS DOUBLE) * s.h"
_GOES_ON = f"""abs(z.h - s.h) < CAST(0.15 AS DOUBLE) * greatest(z.h, s.h) AND 23 * abs(z.tone - s.id % 5) < 90 AND s.y + s.h - z.base > CAST(0.9 AS DOUBLE) * s.h AND s.y + s.h - z.base < CAST(2.2 AS DOUBLE) * s.h AND ({_SIDES} OR {_MIDDLES}) AND s.id % 17 <> 0 AND NOT z.badge"""


@query(f"""{with_('boxes')}, s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, id) AS k FROM boxes),
  f AS (SELECT page, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS line_no, CAST([] AS STRUCT(x BIGINT, r BIGINT, h BIGINT, base BIGINT, tone BIGINT, badge BOOLEAN, n BIGINT, align VARCHAR)[]) AS blocks FROM (SELECT DISTINCT page FROM s)
    UNION ALL SELECT page, k, id, at_ - 1, coalesce(blocks[at_].n, 0), list_concat(list_concat(blocks[1 : at_ - 1], [{{'x': own.x, 'r': own.r, 'h': own.h, 'base': own.base, 'tone': own.tone, 'badge': own.badge, 'n': coalesce(blocks[at_].n, 0) + 1, 'align': CASE WHEN blocks[at_] IS NULL THEN 'left' WHEN NOT side AND middle THEN 'center' ELSE blocks[at_].align END}}]), blocks[at_ + 1 : len(blocks)])
    FROM (SELECT *, abs(blocks[at_].x - own.x) < CAST(0.6 AS DOUBLE) * own.h AS side, abs((blocks[at_].x + blocks[at_].r) - (own.x + own.r)) / 2 < CAST(0.6 AS DOUBLE) * own.h AS middle
    FROM (SELECT f.page, s.k, s.id, f.blocks, {{'x': s.x, 'r': s.x + s.w, 'h': s.h, 'base': s.y + s.h, 'tone': s.id % 5, 'badge': s.id % 17 = 0}} AS own, coalesce(nullif(list_position(list_transform(f.blocks, lambda z: {_GOES_ON}), true), 0), len(f.blocks) + 1) AS at_ FROM f JOIN s ON s.page = f.page AND s.k = f.k + 1))),
  e AS (SELECT page, blocks FROM f QUALIFY row_number() OVER (PARTITION BY page ORDER BY k DESC) = 1)
SELECT f.page, CAST(f.block AS INT) AS block, CAST(f.line_no AS INT) AS line_no, f.id, e.blocks[f.block + 1].align AS align FROM f JOIN e ON e.page = f.page WHERE f.k > 0""")
def group_lines(spark, sf_dir):
    b = box("")
    lines = boxes(spark, sf_dir).select("page", "id", "x", "y", b.right.alias("right"), b.bottom.alias("baseline"), b.h.cast("double").alias("size"), F.lit(False).alias("bold"), (F.col("id") % 17 == 0).alias("badge"), *[((F.col("id") % 5) * k).alias(c) for c, k in zip("rgb", (5, 7, 11), strict=True)])
    return folds.paragraphs(lines)


_UNITED = "greatest(bs[i].r, bs[j].r) - least(bs[i].x, bs[j].x)", "greatest(bs[i].b, bs[j].b) - least(bs[i].y, bs[j].y)"
_NEAR = f"({_UNITED[0]}) - (bs[i].r - bs[i].x) - (bs[j].r - bs[j].x) <= 4 AND ({_UNITED[1]}) - (bs[i].b - bs[i].y) - (bs[j].b - bs[j].y) <= 4 AND greatest({_UNITED[0]}, {_UNITED[1]}) <= 200"


# Every turn of f unites the first pair of a page that is near enough, by the first box and then by the second.
@query(f"""{with_('boxes')}, f AS (SELECT page, 0 AS k, list({{'x': x, 'y': y, 'r': x + w, 'b': y + h}} ORDER BY id) AS bs FROM boxes GROUP BY page
    UNION ALL SELECT page, k + 1, list_concat(list_concat(bs[1 : i - 1], [{{'x': least(bs[i].x, bs[j].x), 'y': least(bs[i].y, bs[j].y), 'r': greatest(bs[i].r, bs[j].r), 'b': greatest(bs[i].b, bs[j].b)}}]), list_concat(bs[i + 1 : j - 1], bs[j + 1 : len(bs)]))
    FROM (SELECT *, pair // 10000 AS i, pair % 10000 AS j FROM (SELECT *, list_min(flatten(list_transform(range(1, len(bs)), lambda i: list_transform(list_filter(range(i + 1, len(bs) + 1), lambda j: {_NEAR}), lambda j: i * 10000 + j)))) AS pair FROM f)) WHERE pair IS NOT NULL)
SELECT page, CAST(n - 1 AS INT) AS seq, b.x AS x, b.y AS y, b.r - b.x AS w, b.b - b.y AS h FROM (SELECT page, unnest(bs) AS b, unnest(range(1, len(bs) + 1)) AS n FROM (SELECT page, bs FROM f QUALIFY row_number() OVER (PARTITION BY page ORDER BY k DESC) = 1))""")
def merge_close(spark, sf_dir):
    return folds.merged_close(boxes(spark, sf_dir), 4, 200)


@query(f"""{with_('boxes')} SELECT page, id, CAST(sum(j) OVER (PARTITION BY page ORDER BY y + h / 2, id ROWS UNBOUNDED PRECEDING) AS INT) AS row_no FROM
  (SELECT *, CASE WHEN y + h / 2 - lag(y + h / 2) OVER (PARTITION BY page ORDER BY y + h / 2, id) > 6 THEN 1 ELSE 0 END AS j FROM boxes)""")
def tolerance_rows(spark, sf_dir):
    return sequences.tolerance_rows(boxes(spark, sf_dir), F.col("y") + F.col("h") / 2, 6).select("page", "id", "row_no")


@query(f"""{with_('turns')} SELECT conv_id, coalesce(max(CASE WHEN flag THEN n END), 0) AS longest FROM (SELECT conv_id, flag, g, count(*) AS n FROM
  (SELECT conv_id, flag, turn - row_number() OVER (PARTITION BY conv_id, flag ORDER BY turn) AS g FROM turns) GROUP BY conv_id, flag, g) GROUP BY conv_id""")
def longest_run(spark, sf_dir):
    return sequences.longest_run(relation(spark, sf_dir, "turns"), "conv_id", "turn", "flag")


@query(f"""{with_('boxes')} SELECT page, run, min(x) AS start, max(x) AS stop, count(*) AS n FROM (SELECT page, x, CAST(sum(j) OVER (PARTITION BY page ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS INT) AS run FROM
  (SELECT page, id, x, CASE WHEN x - lag(x) OVER (PARTITION BY page ORDER BY x, id) > 12 THEN 1 ELSE 0 END AS j FROM boxes)) GROUP BY page, run""")
def gap_tolerant_run(spark, sf_dir):
    return sequences.gap_runs(boxes(spark, sf_dir), "page", "x", 12)


@query(f"""{with_('boxes')}, s AS (SELECT page, id % 50 AS pos, w % 3 = 0 AS gap FROM boxes), i AS (SELECT page, gap, min(pos) AS a, max(pos) AS b, count(*) AS n FROM
  (SELECT *, pos - row_number() OVER (PARTITION BY page, gap ORDER BY pos) AS g FROM s) GROUP BY page, gap, g),
  c AS (SELECT i.*, gap AND (n >= 2 OR a = low OR b = high) AS cut FROM i JOIN (SELECT page, min(pos) AS low, max(pos) AS high FROM s GROUP BY page) USING (page)),
  p AS (SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY page ORDER BY a) AS part FROM c)
SELECT page, min(a) AS start, max(b) + 1 AS stop FROM p WHERE NOT cut GROUP BY page, part HAVING max(b) + 1 - min(a) >= 2""")
def sheet_segments(spark, sf_dir):
    df = boxes(spark, sf_dir).select("page", (F.col("id") % 50).alias("pos"), (F.col("w") % 3 == 0).alias("gap"))
    return sequences.segments(df, "page", "pos", "gap", 2, 2)


@query(f"""{with_('turns')}, c AS (SELECT conv_id, role, count(*) AS n FROM turns WHERE role IS NOT NULL GROUP BY ALL), m AS (SELECT conv_id, role AS seed FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, role) AS r FROM c) WHERE r = 1)
SELECT t.conv_id, turn, coalesce(last_value(role IGNORE NULLS) OVER (PARTITION BY t.conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), seed) AS filled FROM turns t LEFT JOIN m ON t.conv_id = m.conv_id""")
def ffill_runs(spark, sf_dir):
    return sequences.forward_fill(relation(spark, sf_dir, "turns"), "conv_id", "turn", "role").select("conv_id", "turn", "filled")


@query(f"""{with_('turns')}, s AS MATERIALIZED (SELECT conv_id, bit, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, lead(bit) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM turns), f AS (
  SELECT conv_id, pos, bit AS value FROM s WHERE pos = 0
  UNION ALL SELECT s.conv_id, s.pos, CASE WHEN s.nxt IS NOT NULL AND f.value = s.nxt AND s.bit <> f.value THEN f.value ELSE s.bit END FROM f JOIN s ON s.conv_id = f.conv_id AND s.pos = f.pos + 1)
SELECT conv_id, CAST(pos AS INT) AS pos, value FROM f""")
def smooth_isolated(spark, sf_dir):
    return folds.smoothed(relation(spark, sf_dir, "turns"), "conv_id", "turn", "bit")


@query(f"""{with_('turns')} SELECT conv_id, turn, CAST(avg(CAST(bit AS DOUBLE)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) > 0.5 AS INT) AS smooth FROM turns""")
def moving_majority(spark, sf_dir):
    return sequences.moving_majority(relation(spark, sf_dir, "turns"), "conv_id", "turn", "bit", 1).select("conv_id", "turn", "smooth")


@query(f"""{with_('boxes')} SELECT id, CASE WHEN w >= 80 THEN 'picture' ELSE 'icon' END AS kind, CAST(row_number() OVER (PARTITION BY page, w >= 80 ORDER BY id) AS INT) AS number, CAST(row_number() OVER (PARTITION BY page ORDER BY w < 80, id) AS INT) AS place FROM boxes""")
def kind_numbers(spark, sf_dir):
    """Elements in drawing order, pictures before icons, each named by its kind and its number among the page's of that kind."""
    df = boxes(spark, sf_dir).withColumn("kind", F.when(F.col("w") >= 80, "picture").otherwise("icon")).withColumn("small", F.col("w") < 80)
    placed = sequences.numbered(df, ["page"], ["small", "id"]).withColumnRenamed("number", "place")
    return sequences.numbered(placed, ["page", "kind"], ["id"]).select("id", "kind", "number", "place")


_IN_COLUMN = "abs(r.x - a.x) <= CAST(0.8 AS DOUBLE) * a.h AND r.h / greatest(1, a.h) > 0.75 AND r.h / greatest(1, a.h) < 1.33"


@query(f"""{with_('labels2')}, c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page ORDER BY id) AS k FROM labels2 WHERE regexp_matches(text, '^[0-9Oo]{{2}}$')),
  f AS (SELECT page, CAST(0 AS BIGINT) AS k, list({{'id': id, 'x': x, 'h': h, 'text': text, 'used': false}} ORDER BY y, id) AS rows FROM c GROUP BY page
    UNION ALL SELECT page, k, CASE WHEN a.used OR len(col) < 3 THEN rows ELSE list_transform(rows, lambda r: CASE WHEN {_IN_COLUMN} THEN {{'id': r.id, 'x': r.x, 'h': r.h, 'text': CASE WHEN -best.n >= CAST(0.6 AS DOUBLE) * len(col) AND best.s + list_position(ids, r.id) - 1 BETWEEN 0 AND 99
        THEN lpad(CAST(best.s + list_position(ids, r.id) - 1 AS VARCHAR), 2, '0') ELSE r.text END, 'used': true}} ELSE r END) END
      FROM (SELECT *, list_transform(col, lambda r: r.id) AS ids, list_sort(list_transform(list_distinct(starts), lambda s: {{'n': -len(list_filter(starts, lambda t: t = s)), 's': s}}))[1] AS best
      FROM (SELECT *, list_transform(range(1, len(col) + 1), lambda i: CAST(translate(col[i].text, 'Oo', '00') AS BIGINT) - i + 1) AS starts FROM (SELECT *, list_filter(rows, lambda r: {_IN_COLUMN}) AS col
      FROM (SELECT f.page, c.k, f.rows, list_filter(f.rows, lambda r: r.id = c.id)[1] AS a FROM f JOIN c ON c.page = f.page AND c.k = f.k + 1))))),
  d AS (SELECT r.id, r.text AS fixed FROM (SELECT unnest(rows) AS r FROM (SELECT rows FROM f QUALIFY row_number() OVER (PARTITION BY page ORDER BY k DESC) = 1)))
SELECT l.page, l.id, text, coalesce(fixed, text) AS fixed FROM labels2 l LEFT JOIN d ON d.id = l.id""")
def fix_numbering(spark, sf_dir):
    return sequences.repaired_numbers(relation(spark, sf_dir, "labels2"))


@query(f"""{with_('ticks')}, p AS (SELECT a.grp, a.seq AS i, b.seq AS j, (b.p - a.p) / (b.v - a.v) AS k, a.p AS ap, a.v AS av, abs(b.p - a.p) AS far FROM ticks a JOIN ticks b ON a.grp = b.grp AND a.seq < b.seq AND a.v <> b.v AND abs(b.p - a.p) >= 8),
  s AS (SELECT p.grp, i, j, k, ap, av, count(*) AS n, list_sort(list(DISTINCT c.v)) AS vals FROM p JOIN ticks c ON c.grp = p.grp AND abs(ap + (c.v - av) * k - c.p) <= greatest(4.0, 0.12 * far) GROUP BY ALL),
  d AS (SELECT *, list_transform(range(2, len(vals) + 1), lambda x: vals[x] - vals[x - 1]) AS steps FROM s WHERE len(vals) >= 4),
  e AS (SELECT *, list_min(steps) AS step FROM d),
  o AS (SELECT * FROM e WHERE step > 0 AND list_max(list_transform(steps, lambda x: abs(x / step - round_even(x / step, 0)))) <= 0.05 AND list_max(list_transform(steps, lambda x: x / step)) <= 2.5 AND vals[1] <= 2 * step AND vals[len(vals)] > 0)
SELECT grp, n, k, ap - av * k AS zero FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, i, j) AS r FROM o) WHERE r = 1""")
def tick_chain(spark, sf_dir):
    return sequences.tick_chains(relation(spark, sf_dir, "ticks"))


@query("""SELECT CAST(floor(l_quantity / 8) * 64 + floor(l_discount * 100 / 4) * 8 + floor(l_tax * 100 / 4) AS BIGINT) AS code, count(*) AS n FROM lineitem GROUP BY 1""")
def color_histogram(spark, sf_dir):
    return votes.histogram(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), _code())


def _code():
    return F.floor(F.col("l_quantity") / 8) * 64 + F.floor(F.col("l_discount") * 100 / 4) * 8 + F.floor(F.col("l_tax") * 100 / 4)


_CODES = "SELECT l_returnflag, CAST(floor(l_quantity / 8) * 64 + floor(l_discount * 100 / 4) * 8 + floor(l_tax * 100 / 4) AS BIGINT) AS code, count(*) AS n FROM lineitem GROUP BY 1, 2"


@query(f"SELECT l_returnflag, CAST(place AS INT) AS place, code, n FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, code) AS place FROM ({_CODES})) WHERE place <= 3")
def top3_codes(spark, sf_dir):
    return votes.top_codes(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_returnflag", _code())


@query(f"SELECT l_returnflag, code, n FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, code) AS place FROM ({_CODES})) WHERE place = 1")
def mode_code(spark, sf_dir):
    return votes.mode(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_returnflag", _code())


@query("""SELECT l_returnflag, round(median(CAST(l_extendedprice AS DOUBLE)), 6) AS median, """ + ", ".join(f"round(quantile_cont(CAST(l_extendedprice AS DOUBLE), {p}), 6) AS p{round(p * 100)}" for p in (0.3, 0.6, 0.8, 0.9, 0.97, 0.99)) + " FROM lineitem GROUP BY 1")
def percentiles(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v"))
    return votes.percentiles(df, "l_returnflag", "v")


@query("""SELECT l_linestatus, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(l_quantity AS DOUBLE)), 6) AS sd, round(covar_samp(CAST(l_discount AS DOUBLE), CAST(l_quantity AS DOUBLE)) / var_pop(CAST(l_quantity AS DOUBLE)), 6) AS slope FROM lineitem GROUP BY 1""")
def feature_stats(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linestatus", F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("d"))
    return votes.moments(df, "l_linestatus", "q", "d")


@query(f"""{with_('votes')}, s AS (SELECT grp, choice, CAST(sum(1 + seq % 5) AS BIGINT) AS weight FROM votes GROUP BY ALL)
SELECT grp, choice, weight, round(weight / total, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY weight DESC, choice) AS r, sum(weight) OVER (PARTITION BY grp) AS total FROM s) WHERE r = 1""")
def weighted_vote(spark, sf_dir):
    return votes.weighted_vote(relation(spark, sf_dir, "votes"), "grp", "choice", 1 + F.col("seq") % 5)


@query(f"""{with_('votes')}, s AS (SELECT grp, choice, count(*) AS n, round(sum(score), 4) AS total FROM votes GROUP BY ALL)
SELECT grp, choice, n, total FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, total DESC, choice) AS r FROM s) WHERE r = 1 AND n >= 2""")
def vote_twice(spark, sf_dir):
    return votes.vote_twice(relation(spark, sf_dir, "votes"), "grp", "choice", "score")


@query(f"""{with_('votes')}, s AS (SELECT grp, choice, max(score) AS score FROM votes GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, choice) AS r FROM s)
SELECT a.grp, a.choice, a.score FROM r a LEFT JOIN r b ON a.grp = b.grp AND b.r = 2 WHERE a.r = 1 AND a.score >= 0.72 AND a.score - coalesce(b.score, 0.0) >= 0.08""")
def best_with_lead(spark, sf_dir):
    best = relation(spark, sf_dir, "votes").groupBy("grp", "choice").agg(F.max("score").alias("score"))
    return votes.best_with_lead(best, "grp", "choice", "score", 0.72, 0.08)


@query(f"""{with_('history')}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY t, seq) AS up, row_number() OVER (PARTITION BY kind ORDER BY t DESC, seq DESC) AS down FROM history)
SELECT kind, count(*) AS n, round_even(1 - sum(changed) / sum(total), 3) AS rate, round_even(1 - sum(changed) FILTER (up <= 10) / sum(total) FILTER (up <= 10), 3) AS first_rate, round_even(1 - sum(changed) FILTER (down <= 10) / sum(total) FILTER (down <= 10), 3) AS recent_rate FROM r GROUP BY kind""")
def acceptance_rates(spark, sf_dir):
    return votes.acceptance(relation(spark, sf_dir, "history"))


@query(f"""{with_('history', 'samples', 'jobs', 'boxes')}, h AS (SELECT * FROM history WHERE kind = (SELECT min(kind) FROM history)),
  r AS (SELECT *, row_number() OVER (ORDER BY t, seq) AS up, row_number() OVER (ORDER BY t DESC, seq DESC) AS down FROM h)
SELECT (SELECT count(*) FROM samples) AS samples, (SELECT count(*) FROM history) AS corrections, (SELECT count(DISTINCT stage) FROM jobs) AS text_fixes, (SELECT count(DISTINCT page) FROM boxes WHERE page % 3 = 0) AS implicit_pages,
  (SELECT count(DISTINCT job) FROM jobs) AS pages, (SELECT count(*) FROM samples WHERE keep = 1) AS n_keep, (SELECT count(*) FROM samples WHERE keep = 0) AS n_drop,
  (SELECT round_even(1 - sum(changed) / sum(total), 3) FROM r WHERE up <= 10) AS first_rate, (SELECT round_even(1 - sum(changed) / sum(total), 3) FROM r WHERE down <= 10) AS recent_rate""")
def learning_stats(spark, sf_dir):
    history, jobs = relation(spark, sf_dir, "history"), relation(spark, sf_dir, "jobs")
    seen = boxes(spark, sf_dir, "page % 3 = 0").select("page").distinct()
    kind = history.agg(F.min("kind")).first()[0]
    return votes.learning_stats(history, relation(spark, sf_dir, "samples"), jobs.select("stage").distinct(), seen, jobs.select("job").distinct(), kind)


@query(f"""{with_('jobs')} SELECT job, state, touched FROM (SELECT job, arg_max(state, t * 100000000 + seq) AS state, max(t) AS touched FROM jobs GROUP BY job) WHERE touched < 7900 - 100 AND state NOT IN ('queued', 'running')""")
def idle_jobs(spark, sf_dir):
    return votes.idle(relation(spark, sf_dir, "jobs"), 7900.0, 100.0)


@query(f"""{with_('jobs')} SELECT shard, job, arrived, CAST(row_number() OVER (PARTITION BY shard ORDER BY arrived, job) - 1 AS INT) AS ahead FROM (SELECT shard, job, min(t) AS arrived FROM jobs WHERE state = 'queued' GROUP BY ALL)""")
def queue_positions(spark, sf_dir):
    return votes.queue_position(relation(spark, sf_dir, "jobs"))


@query(f"""{with_('jobs')} SELECT job, stage, arg_max(data, t * 100000000 + seq) AS data FROM jobs GROUP BY ALL""")
def latest_stage(spark, sf_dir):
    return votes.latest_stage(relation(spark, sf_dir, "jobs"))


@query(f"""{with_('samples')} SELECT seq, keep, w, round(CASE WHEN keep > 0.5 THEN 0.5 / (SELECT sum(w * keep) FROM samples) ELSE 0.5 / (SELECT sum(w * (1 - keep)) FROM samples) END * w * (SELECT count(*) FROM samples), 9) AS cw FROM samples""")
def class_weights(spark, sf_dir):
    return learning.class_weights(relation(spark, sf_dir, "samples")).select("seq", "keep", "w", F.round("cw", 9).alias("cw"))


def samples(spark, sf_dir) -> DataFrame:
    """Samples with an embedding's numbers as features."""
    f = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("seq"), F.transform("embedding", lambda v: v.cast("double")).alias("f"))
    return relation(spark, sf_dir, "samples").join(f, "seq")


@query(f"""{with_('samples')}, e AS (SELECT seq, row_number() OVER (ORDER BY t DESC, seq) AS r, count(*) OVER () AS n FROM samples WHERE src = 'edit')
SELECT s.seq, coalesce(e.n >= 10 AND r <= least(200, greatest(6, CAST(floor(0.3 * n) AS BIGINT))), false) AS exam FROM samples s LEFT JOIN e ON s.seq = e.seq""")
def exam_split(spark, sf_dir):
    return learning.exam_rows(relation(spark, sf_dir, "samples")).select("seq", "exam")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS f, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS keep FROM embeddings),
  d AS (SELECT q.vec_id AS id, s.vec_id AS seq, s.keep, sqrt(list_sum(list_transform(range(1, len(q.f) + 1), lambda i: power((q.f[i] - s.f[i]) / 0.5, 2)))) AS d FROM e q, e s WHERE q.vec_id % 100 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, seq) AS r FROM d)
SELECT id, round(sum(keep / (d + 0.3)) / sum(1 / (d + 0.3)), 9) AS vote, round(min(d), 9) AS nearest FROM r WHERE r <= 7 GROUP BY id""")
def knn_vote(spark, sf_dir):
    s = samples(spark, sf_dir)
    found = learning.nearest_votes(s.where("seq % 100 = 0").select(F.col("seq").alias("id"), "f"), s, [0.5] * 64)
    return found.select("id", F.round("vote", 9).alias("vote"), F.round("nearest", 9).alias("nearest"))


_ELEMENTS = """SELECT id, page, CASE WHEN w >= 80 THEN 'picture' ELSE 'icon' END AS kind, CASE WHEN id % 5 = 0 THEN 'rejected' ELSE 'kept' END AS state, (x % 100) / 100.0 AS model, (y % 100) / 100.0 AS vote,
  CASE WHEN h % 4 = 0 THEN NULL ELSE h / 10.0 END AS nearest, w % 101 AS score, (id % 100) / 100.0 AS pk FROM boxes"""


@query(f"""{with_('boxes')}, e AS ({_ELEMENTS.replace('100.0', 'CAST(100 AS DOUBLE)').replace('10.0', 'CAST(10 AS DOUBLE)')}),
  p AS (SELECT *, CASE WHEN nearest < 3.0 THEN 0.5 * model + 0.5 * vote WHEN nearest IS NOT NULL THEN 0.5 * model + 0.5 * score / 100.0 ELSE model END AS p, CASE WHEN kind = 'icon' AND pk > 0.8 THEN 'picture' WHEN kind = 'picture' AND pk < 0.2 THEN 'icon' ELSE kind END AS new_kind FROM e)
SELECT id, round(p, 9) AS p, new_kind, CASE WHEN state = 'rejected' THEN CASE WHEN p >= 0.65 THEN 'add' ELSE 'none' END WHEN p < 0.4 THEN 'drop' WHEN new_kind <> kind THEN 'swap' ELSE 'keep' END AS decision FROM p""")
def decide_blend(spark, sf_dir):
    b = boxes(spark, sf_dir).select(
        "id", F.when(F.col("w") >= 80, "picture").otherwise("icon").alias("kind"), F.when(F.col("id") % 5 == 0, "rejected").otherwise("kept").alias("state"), ((F.col("x") % 100) / 100).alias("model"), ((F.col("y") % 100) / 100).alias("vote"),
        F.when(F.col("h") % 4 != 0, F.col("h") / 10).alias("nearest"), (F.col("w") % 101).alias("score"), ((F.col("id") % 100) / 100).alias("pk"),
    )
    return learning.decisions(b).select("id", F.round("p", 9).alias("p"), "new_kind", "decision")


# The fit step by step: each turn of g adds the pull of all samples to every coefficient; the bias is number 65 and bears no penalty.
_FIT = f"""{with_('samples')}, x AS MATERIALIZED (SELECT s.seq, s.keep, CAST(s.keep AS DOUBLE) AS y, s.w, list_transform(e.embedding, lambda v: CAST(v AS DOUBLE)) AS f FROM samples s JOIN embeddings e ON e.vec_id = s.seq),
  u AS (SELECT seq, unnest(f) AS v, unnest(range(1, len(f) + 1)) AS j FROM x), m AS MATERIALIZED (SELECT list(mu ORDER BY j) AS mu, list(sd ORDER BY j) AS sd FROM (SELECT j, avg(v) AS mu, stddev_pop(v) + CAST(1e-6 AS DOUBLE) AS sd FROM u GROUP BY j)),
  z AS MATERIALIZED (SELECT seq, keep, y, list_append(list_transform(range(1, len(f) + 1), lambda i: (f[i] - mu[i]) / sd[i]), CAST(1 AS DOUBLE)) AS z, w / 2 / CASE WHEN y > 0.5 THEN (SELECT sum(w) FROM x WHERE y > 0.5) ELSE (SELECT sum(w) FROM x WHERE y <= 0.5) END AS share FROM x, m),
  c AS MATERIALIZED (SELECT seq, unnest(range(1, len(z) + 1)) AS j, unnest(z) AS v FROM z),
  g AS (SELECT 0 AS step, list_transform(range(0, 65), lambda i: CAST(0 AS DOUBLE)) AS beta
    UNION ALL SELECT step + 1, list(b ORDER BY j) FROM (SELECT r.step, c.j, any_value(r.beta)[c.j] * CASE WHEN c.j < 65 THEN CAST(0.975 AS DOUBLE) ELSE 1 END + sum(CAST(0.5 AS DOUBLE) * c.v * r.pull) AS b
      FROM (SELECT g.step, g.beta, z.seq, z.share * (z.y - 1 / (1 + exp(-list_dot_product(z.z, g.beta)))) AS pull FROM g, z WHERE g.step < 600) r JOIN c ON c.seq = r.seq GROUP BY r.step, c.j) GROUP BY step)
SELECT seq, keep, round(1 / (1 + exp(-list_dot_product(z, beta))), 6) AS p FROM z, g WHERE step = 600"""


@query(_FIT)
def logreg_fit(spark, sf_dir):
    model = learning.fitted(samples(spark, sf_dir))
    return samples(spark, sf_dir).select("seq", "keep", F.round(learning.probability(model, F.col("f")), 6).alias("p"))


@query()
def train_adopt(spark, sf_dir):
    return learning.model_row(spark, learning.trained(samples(spark, sf_dir)))


_KIND = "CASE WHEN w >= 80 THEN 'picture' ELSE 'icon' END"
# Every match is made anew by comparing all boxes of a page; a drawn box that decides for none is a row of its own.
_EDITS = f"""{with_('boxes')}, auto AS (SELECT *, {_KIND} AS kind, id % 5 = 0 AS rejected, id % 3 = 0 AND id % 5 <> 0 AS same FROM boxes),
  drawn AS (SELECT page, id, x + 3 AS x, y + 2 AS y, w, h, CASE WHEN id % 8 = 1 THEN 'picture' ELSE 'icon' END AS kind FROM boxes WHERE id % 4 = 1
    UNION ALL SELECT page, 1000000 + id, x + 500, y, w, h, 'icon' FROM boxes WHERE id % 10 = 2),
  pair AS (SELECT a.id, b.id AS d, b.kind AS dk, {INTER} / greatest(1e-6, CAST({UNION} AS DOUBLE)) AS iou FROM auto a JOIN drawn b ON a.page = b.page AND {INTER} > 0),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY iou DESC, d) AS r FROM pair) WHERE r = 1),
  j AS (SELECT a.*, d, dk, NOT same AND coalesce(iou, 0) > CASE WHEN rejected THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS met FROM auto a LEFT JOIN best ON a.id = best.id),
  missed AS (SELECT * FROM drawn WHERE id NOT IN (SELECT d FROM j WHERE met))"""


def _edited(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = boxes(spark, sf_dir)
    auto = b.withColumn("kind", F.when(F.col("w") >= 80, "picture").otherwise("icon")).withColumn("state", F.when(F.col("id") % 5 == 0, "rejected").otherwise("kept"))
    drawn = b.where("id % 4 = 1").withColumns({"x": F.col("x") + 3, "y": F.col("y") + 2, "kind": F.when(F.col("id") % 8 == 1, "picture").otherwise("icon")})
    apart = b.where("id % 10 = 2").withColumns({"x": F.col("x") + 500, "id": F.col("id") + 1_000_000, "kind": F.lit("icon")})
    return auto, b.where("id % 3 = 0"), drawn.unionByName(apart)


@query(f"""{_EDITS} SELECT page, id, 'auto' AS src, CASE WHEN met THEN dk WHEN rejected THEN 'icon' ELSE kind END AS kind, CAST(same OR met AS INT) AS keep,
  CASE WHEN rejected AND NOT met THEN CAST(0.4 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS weight FROM j UNION ALL SELECT page, id, 'drawn', kind, 1, CAST(1.0 AS DOUBLE) FROM missed""")
def explicit_feedback(spark, sf_dir):
    return learning.explicit_samples(*_edited(spark, sf_dir))


@query(f"""{_EDITS} SELECT page, CAST(sum(t) AS BIGINT) AS total, CAST(sum(c) AS BIGINT) AS changed FROM (SELECT page, CAST(NOT rejected AS INT) AS t, CASE WHEN rejected THEN CAST(met AS INT) ELSE CAST(NOT same AS INT) END AS c FROM j
  UNION ALL SELECT page, 1, 1 FROM missed) GROUP BY page""")
def edit_history(spark, sf_dir):
    return learning.edit_history(*_edited(spark, sf_dir))


@query(f"""{with_('boxes')} SELECT page AS key, id, CAST(id % 5 <> 0 AS INT) AS keep, CASE WHEN id % 5 = 0 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS weight FROM boxes WHERE page % 3 <> 0 AND page % 7 <> 1""")
def implicit_once(spark, sf_dir):
    b = boxes(spark, sf_dir).select(F.col("page").alias("key"), "id", F.when(F.col("id") % 5 == 0, "rejected").otherwise("kept").alias("state"))
    return learning.implicit_samples(b, b.where("key % 3 = 0"), b.where("key % 7 = 1")).select("key", "id", "keep", "weight")


@query(f"""{with_('jobs')} SELECT job AS key, data AS value FROM (SELECT job, arg_max(state, t * 100000000 + seq) AS op, arg_max(data, t * 100000000 + seq) AS data FROM jobs GROUP BY job) WHERE op <> 'error'""")
def page_memo(spark, sf_dir):
    log = relation(spark, sf_dir, "jobs").select(F.col("job").alias("key"), "t", "seq", F.when(F.col("state") == "error", "forget").otherwise("put").alias("op"), F.col("data").alias("value"))
    return learning.pages_remembered(log)


_TICK_TEXT = "CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS {0}) || ',000' WHEN 1 THEN CAST(p_size AS {0}) || '%' WHEN 2 THEN '−' || CAST(p_size AS {0}) || '.5' WHEN 3 THEN CAST(p_size AS {0}) || '年' WHEN 4 THEN ' 1 ' || CAST(p_size AS {0}) ELSE '+' || CAST(p_size AS {0}) END"


@query(f"""SELECT p_partkey, text, CASE WHEN regexp_matches(t, '^-?\\d{{1,3}}(,\\d{{3}})*(\\.\\d+)?%?$|^-?\\d+(\\.\\d+)?%?$') THEN CAST(regexp_replace(t, '[%,]', '', 'g') AS DOUBLE) END AS value
FROM (SELECT p_partkey, text, translate(replace(trim(text), ' ', ''), '，−–', ',--') AS t FROM (SELECT p_partkey, {_TICK_TEXT.format('VARCHAR')} AS text FROM part))""")
def tick_parse(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(_TICK_TEXT.format("STRING")).alias("text"))
    return df.withColumn("value", tx.tick_value(F.col("text")))


@query(r"""SELECT doc_id, CASE WHEN length(b) < length(f) AND length(b) > 1 THEN b ELSE f END AS cleaned FROM (SELECT doc_id, f, regexp_replace(f, '^[：:，,）)·.、;；]+', '') AS b FROM
  (SELECT doc_id, replace(replace(replace(CASE doc_id % 3 WHEN 0 THEN '：' WHEN 1 THEN '·)' ELSE '°°' END || text, '°℃', '℃'), '°°', '°'), '℃C', '℃') AS f FROM documents))""")
def clean_text(spark, sf_dir):
    lead = F.when(F.col("doc_id") % 3 == 0, "：").when(F.col("doc_id") % 3 == 1, "·)").otherwise("°°")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tx.clean(F.concat(lead, F.col("text"))).alias("cleaned"))


@query(r"""SELECT p_partkey, regexp_matches(p_name, array_to_string(list_transform(string_split(substr(p_brand, 1, 4), ''), lambda c: regexp_escape(c)), '.*')) AS sub FROM part""")
def subsequence(spark, sf_dir):
    """The needle is a brand's first four characters, as whole ones are in no name; the names are read whole."""
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    return df.select("p_partkey", tx.is_subsequence(F.substring("p_brand", 1, 4), F.col("p_name")).alias("sub"))


@query("""SELECT a.p_partkey, CAST((SELECT max(k) FROM range(0, 40) t(k) WHERE k <= least(length(a.p_name), length(b.p_name)) AND left(a.p_name, k) = left(b.p_name, k)) AS INT) AS n FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def common_prefix(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    other = df.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return df.join(other, "p_partkey").select("p_partkey", tx.common_prefix(F.col("p_name"), F.col("other")).alias("n"))


@query("""WITH c AS (SELECT p_partkey, unnest(string_split(p_brand, '')) AS ch, 1 AS n FROM part UNION ALL SELECT p_partkey, unnest(string_split(p_type, '')), -1 FROM part)
SELECT p.p_partkey, coalesce(string_agg(repeat(ch, greatest(0, CAST(n AS INT))), '' ORDER BY ch), '') AS rest FROM (SELECT DISTINCT p_partkey FROM part) p LEFT JOIN (SELECT p_partkey, ch, sum(n) AS n FROM c GROUP BY ALL) x ON p.p_partkey = x.p_partkey GROUP BY ALL""")
def multiset_rest(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", tx.multiset_difference(F.col("p_brand"), F.col("p_type")).alias("rest"))


@query("""WITH w AS (SELECT DISTINCT substr(p_name, 1, 3) AS word, length(p_name) AS freq FROM part), f AS (SELECT word, max(freq) AS freq FROM w GROUP BY word),
  s AS (SELECT c_custkey, substr(c_name, a + 1, k) AS part FROM customer, range(2, 5) t(k), range(0, 30) u(a) WHERE a + k <= length(c_name)),
  p AS (SELECT p_partkey, substr(p_name, a + 1, k) AS part FROM part, range(2, 5) t(k), range(0, 60) u(a) WHERE a + k <= length(p_name))
SELECT p_partkey, CAST(max(coalesce(f.freq, 0)) AS INT) AS best FROM p LEFT JOIN f ON p.part = f.word GROUP BY p_partkey""")
def word_freq(spark, sf_dir):
    """The word list is made of the names' first three letters, as the tables have no list of words; the names are read whole."""
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    words = df.groupBy(F.substring("p_name", 1, 3).alias("word")).agg(F.max(F.length("p_name")).alias("freq"))
    parts = df.select("p_partkey", F.explode(tx.word_windows(F.col("p_name"))).alias("s")).select("p_partkey", "s.part")
    return parts.join(words, F.col("part") == F.col("word"), "left").groupBy("p_partkey").agg(F.max(F.coalesce("freq", F.lit(0))).cast("int").alias("best"))


@query("""SELECT doc_id, replace(replace(text, 'thation', 'nation'), 'th ', 'the ') AS fixed FROM documents""")
def text_fix_apply(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (F.lit(False)).alias("has_chars"))
    return folds.fixes_applied(lines, [("th ", "the ", 3), ("thation", "nation", 1), ("xq", "qx", 1)], ["nation", "at"]).select("doc_id", "fixed")


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query, regexp_extract(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '([^/]*)$', 1) AS base FROM pages""")
def url_route(spark, sf_dir):
    url = F.col("url")
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.try_parse_url(url, F.lit("HOST")).alias("host"), path.alias("path"), F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")).alias("query"), F.regexp_extract(path, "([^/]*)$", 1).alias("base"))


@query("""SELECT l.toxic = 1 OR (l.quality = 0 AND d.n_chars < 2000) AS dropped, d.lang, count(*) AS n, CAST(sum(d.n_chars) AS BIGINT) AS chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL""")
def keep_drop_filter(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    dropped = (F.col("toxic") == 1) | ((F.col("quality") == 0) & (F.col("n_chars") < 2000))
    return docs.join(labels, "doc_id").groupBy(dropped.alias("dropped"), "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""WITH s AS (SELECT p_partkey, 600 + p_size * 40 AS width, 400 + p_size * 20 AS height FROM part), t AS (SELECT *, least(width, 1000) AS tw, least(height, 700) AS th FROM s),
  x AS (SELECT DISTINCT p_partkey, x FROM (SELECT p_partkey, unnest(range(0, width - tw + 1, greatest(1, CAST(floor(tw * CAST(0.7 AS DOUBLE)) AS BIGINT)))) AS x FROM t UNION ALL SELECT p_partkey, width - tw FROM t)),
  y AS (SELECT DISTINCT p_partkey, y FROM (SELECT p_partkey, unnest(range(0, height - th + 1, greatest(1, CAST(floor(th * CAST(0.7 AS DOUBLE)) AS BIGINT)))) AS y FROM t UNION ALL SELECT p_partkey, height - th FROM t))
SELECT t.p_partkey, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(tw AS INT) AS w, CAST(th AS INT) AS h FROM t JOIN x ON t.p_partkey = x.p_partkey JOIN y ON t.p_partkey = y.p_partkey""")
def tile_grid(spark, sf_dir):
    from ..sources.ocr import tiles

    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (600 + F.col("p_size") * 40).cast("int").alias("width"), (400 + F.col("p_size") * 20).cast("int").alias("height"))
    return tiles(sizes, 1000, 700, 0.3)


@query("""WITH c AS (SELECT p_partkey, i, p_name, CASE WHEN ch = ' ' THEN 28 WHEN regexp_matches(ch, '^[a-zA-Z0-9]$') THEN 55 ELSE 48 END AS wt FROM (SELECT p_partkey, p_name, i, substr(p_name, i + 1, 1) AS ch FROM part, LATERAL (SELECT unnest(range(0, length(p_name))) AS i)))
SELECT p_partkey, CAST(i AS INT) AS i, CAST(round_even(300 * (sum(wt) OVER (PARTITION BY p_partkey ORDER BY i) / CAST(sum(wt) OVER (PARTITION BY p_partkey) AS DOUBLE)), 0) AS BIGINT) AS stop FROM c""")
def char_spans(spark, sf_dir):
    from ..sources.ocr import character_spans

    return character_spans(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name"), "p_partkey", "p_name", 300)


@query(f"""{with_('boxes')} SELECT id, CAST(floor(x * (12192000 / 400)) AS BIGINT) AS left_emu, CAST(floor(w * (12192000 / 400)) AS BIGINT) AS width_emu, greatest(6.0, round_even(h * (12192000 / 400) / 12700 * 2, 0) / 2) AS size_pt FROM boxes""")
def layout_units(spark, sf_dir):
    emu = F.lit(12192000 / 400)
    return boxes(spark, sf_dir).select("id", F.floor(F.col("x") * emu).alias("left_emu"), F.floor(F.col("w") * emu).alias("width_emu"), F.greatest(F.lit(6.0), F.bround(F.col("h") * emu / 12700 * 2, 0) / 2).alias("size_pt"))


@query(f"""{with_('cards')}, f AS (SELECT *, sum(has_text) OVER (PARTITION BY page) AS texts, sum(has_icon) OVER (PARTITION BY page) AS icons, count(*) OVER (PARTITION BY page) AS n FROM cards),
  r AS (SELECT page, x, y, w, h, 'text' AS reason FROM f WHERE n >= 3 AND texts > 0 AND texts < n AND (has_text = 1) <> (2 * texts >= n)
    UNION ALL SELECT page, x, y, w, h, 'icon' FROM f WHERE n >= 3 AND icons >= 2 AND icons >= 0.6 * n AND icons < n AND has_icon = 0)
SELECT page, x, y, w, h, max(reason) AS reason FROM r GROUP BY ALL""")
def find_inconsistent(spark, sf_dir):
    from ..operators.consistency import inconsistent

    cards = relation(spark, sf_dir, "cards")
    place = lambda dx, dy, w, h: {"x": F.col("x") + dx, "y": F.col("y") + dy, "w": F.lit(w).cast("long"), "h": F.lit(h).cast("long")}
    columns = ["page", "id", "x", "y", "w", "h"]
    texts = cards.where("has_text = 1").withColumns(place(30, 14, 110, 28)).select(*columns, F.lit("title").alias("text"))
    marks = cards.where("has_icon = 1").withColumns(place(40, -70, 50, 50)).withColumn("id", -1 - F.col("id")).select(*columns)
    return inconsistent(texts, cards.select(*columns).unionByName(marks), 1672.0)


@query(f"""{with_('turns')}, i AS (SELECT conv_id, turn, coalesce(role, '-') AS role, CASE WHEN coalesce(role, '-') IS DISTINCT FROM lag(coalesce(role, '-')) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS ch FROM turns)
SELECT conv_id, run, min(turn) AS first, max(turn) AS last, any_value(role) AS value, count(*) AS n FROM (SELECT *, CAST(sum(ch) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS INT) AS run FROM i) GROUP BY conv_id, run""")
def role_runs(spark, sf_dir):
    return sequences.islands(relation(spark, sf_dir, "turns").withColumn("role", F.coalesce("role", F.lit("-"))), "conv_id", "turn", "role")


@query(f"""{with_('boxes')}, s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page ORDER BY w * h DESC, id) AS k FROM boxes), f AS (
  SELECT page, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(page BIGINT, id BIGINT, x BIGINT, y BIGINT, w BIGINT, h BIGINT)[]) AS kept FROM (SELECT DISTINCT page FROM s)
  UNION ALL
  SELECT f.page, s.k, CASE WHEN len(list_filter(f.kept, lambda b: {INTER.replace('a.', 's.')} / {SMALLER.replace('a.', 's.')} > 0.6)) > 0 THEN f.kept
    ELSE list_append(f.kept, {{'page': s.page, 'id': s.id, 'x': s.x, 'y': s.y, 'w': s.w, 'h': s.h}}) END FROM f JOIN s ON s.page = f.page AND s.k = f.k + 1)
SELECT page, u.id FROM (SELECT page, unnest(kept) AS u FROM (SELECT page, kept, row_number() OVER (PARTITION BY page ORDER BY k DESC) AS r FROM f) WHERE r = 1)""")
def rect_dedupe(spark, sf_dir):
    return folds.greedy_dedupe(boxes(spark, sf_dir), 0.6, largest_first=True)


@query(f"""{with_('boxes')} SELECT a.page, a.id AS disc_id, b.id AS line_id, round(sqrt(power(b.x + b.w / 2 - a.x - a.w / 2, 2) + power(b.y + b.h / 2 - a.y - a.h / 2, 2)), 6) AS distance FROM boxes a JOIN boxes b ON a.page = b.page AND a.id % 3 = 0 AND b.id % 3 <> 0
  AND sqrt(power(b.x + b.w / 2 - a.x - a.w / 2, 2) + power(b.y + b.h / 2 - a.y - a.h / 2, 2)) < 0.7 * a.w""")
def disc_texts(spark, sf_dir):
    discs = boxes(spark, sf_dir, "id % 3 = 0").select("page", "id", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"), F.col("w").cast("double").alias("r"))
    found = marks.texts_in_discs(discs, boxes(spark, sf_dir, "id % 3 <> 0"))
    return found.withColumn("distance", F.round("distance", 6))


@query(f"""{with_('boxes')}, e AS (SELECT page, id, x + w // 2 AS m, y, y + h * 6 AS low FROM boxes)
SELECT a.page, a.id AS left_id, b.id AS right_id, a.m AS x, greatest(a.y, b.y) AS y, b.m - a.m AS w, least(a.low, b.low) - greatest(a.y, b.y) AS h FROM e a JOIN e b ON a.page = b.page AND b.m - a.m >= 60 AND least(a.low, b.low) - greatest(a.y, b.y) >= 60""")
def edge_pairs(spark, sf_dir):
    return marks.edge_pairs(boxes(spark, sf_dir).withColumn("h", F.col("h") * 6), 60)


_FONT_TEXT = "CASE WHEN id % 6 = 0 THEN 'ascii ' || id ELSE repeat('字', CAST(w AS INT)) END"
_FONT_LINES = f"SELECT page, id, CASE WHEN id % 31 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(10 + h / 2.0 AS DOUBLE) END AS size, id % 5 * 20 AS r, id % 3 * 15 AS g, 0 AS b, CASE WHEN id % 4 = 0 THEN 'serif' ELSE 'sans' END AS family, {_FONT_TEXT} AS text, w AS n FROM boxes"


def _peer_round(name: str, source: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT page, id, size, r, g, b, n, CASE WHEN peers >= 3 AND family = 'serif' AND serif < CAST(0.45 AS DOUBLE) * total THEN 'sans' WHEN peers >= 3 AND family = 'sans' AND serif > CAST(0.55 AS DOUBLE) * total THEN 'serif' ELSE family END AS family FROM (
    SELECT p.page, p.id, p.size, p.r, p.g, p.b, p.n, p.family, count(q.id) AS peers, sum(q.n) AS total, sum(CASE WHEN q.family = 'serif' THEN q.n ELSE 0 END) AS serif FROM {source} p LEFT JOIN {source} q ON p.page = q.page AND abs(q.size - p.size) < CAST(0.06 AS DOUBLE) * p.size
      AND abs(p.r - q.r) + abs(p.g - q.g) + abs(p.b - q.b) < 90 GROUP BY ALL))"""


@query(f"""{with_('boxes')}, a AS MATERIALIZED (SELECT * FROM ({_FONT_LINES})), l AS MATERIALIZED (SELECT * FROM a WHERE size < 28 AND id % 6 <> 0), {_peer_round('one', 'l')}, {_peer_round('two', 'one')} SELECT a.page, a.id, coalesce(two.family, a.family) AS family FROM a LEFT JOIN two ON two.id = a.id""")
def peer_family(spark, sf_dir):
    b = boxes(spark, sf_dir)
    size = F.when(F.col("id") % 31 == 0, 0.0).otherwise(10 + F.col("h") / 2)
    lines = b.select("page", "id", size.alias("size"), (F.col("id") % 5 * 20).alias("r"), (F.col("id") % 3 * 15).alias("g"), F.lit(0).alias("b"), F.when(F.col("id") % 4 == 0, "serif").otherwise("sans").alias("family"), F.expr(_FONT_TEXT).alias("text"))
    return marks.family_of_peers(lines)


@query(f"""{with_('boxes')} SELECT page, id % 10 AS block, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, CAST(round_even(min((w % 100) / CAST(100 AS DOUBLE)) * 100, 0) AS BIGINT) AS score, string_agg('line ' || id, chr(10) ORDER BY id) AS text FROM boxes GROUP BY page, id % 10""")
def wire_blocks(spark, sf_dir):
    lines = boxes(spark, sf_dir).select("page", (F.col("id") % 10).alias("block"), F.col("id").alias("line_no"), "x", "y", "w", "h", ((F.col("w") % 100) / 100).alias("score"), F.concat(F.lit("line "), F.col("id")).alias("text"))
    return marks.wire_blocks(lines)


@query(f"""{with_('turns')} SELECT conv_id, bool_or(flag) AS "any", bool_and(flag) AS "all" FROM turns GROUP BY conv_id""")
def any_all(spark, sf_dir):
    return marks.any_all(relation(spark, sf_dir, "turns"), "conv_id", F.col("flag"))


@query("""WITH c AS (SELECT p_partkey, p_name, p_size * 6.0 AS ink, 10.0 + p_size % 9 AS size, unnest(string_split(p_name, '')) AS ch FROM part), s AS (
  SELECT p_partkey, CAST(ink AS DOUBLE) AS ink, CAST(size AS DOUBLE) AS size, length(p_name) AS n, sum(CAST(CASE WHEN ch = ' ' THEN 0.28 WHEN ch BETWEEN 'a' AND 'z' THEN 0.5 ELSE 1.0 END AS DOUBLE)) AS units FROM c GROUP BY ALL),
  d AS (SELECT *, (ink * CAST(0.985 AS DOUBLE) - units * size) / n / size AS need FROM s), f AS (SELECT *, greatest(CAST(-0.06 AS DOUBLE), least(need, CASE WHEN need > CAST(0.1 AS DOUBLE) THEN CAST(1.6 AS DOUBLE) ELSE CAST(0.03 AS DOUBLE) END)) AS fit FROM d)
SELECT 1 AS page, p_partkey AS id, round(fit, 9) AS fit, round(CASE WHEN need < CAST(-0.06 AS DOUBLE) THEN size * greatest(CAST(0.86 AS DOUBLE), least(CAST(1 AS DOUBLE), ink * CAST(0.985 AS DOUBLE) / (units * size + fit * n * size))) ELSE size END, 9) AS size FROM f""")
def width_refit(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    lines = parts.select(F.lit(1).alias("page"), F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), (F.col("p_size") * 6.0).alias("ink"), (10.0 + F.col("p_size") % 9).alias("size"))
    letters = [(chr(k), 0.5) for k in range(ord("a"), ord("z") + 1)]
    widths = spark.createDataFrame([(" ", 0.28), *letters], "ch string, width double")
    return marks.refitted(lines, widths).select("page", "id", F.round("fit", 9).alias("fit"), F.round("size", 9).alias("size"))


@query(f"""{with_('boxes')}, p AS (SELECT page, CAST(x AS DOUBLE) AS u, CAST(y AS DOUBLE) AS v, CAST(w + h * 3 AS DOUBLE) AS z FROM boxes),
  k AS (SELECT page, regr_slope(u, v) AS uv, avg(u) - regr_slope(u, v) * avg(v) AS u0, regr_slope(z, v) AS zv, avg(z) - regr_slope(z, v) * avg(v) AS z0 FROM p GROUP BY page),
  c AS (SELECT page, regr_slope(z - z0 - zv * v, u - u0 - uv * v) AS cu, avg(z) AS mz, avg(u) AS mu, avg(v) AS mv, any_value(zv) AS zv, any_value(uv) AS uv FROM p JOIN k USING (page) GROUP BY page HAVING count(*) >= 3)
SELECT page, round(mz - cu * mu - (zv - cu * uv) * mv, 4) AS c0, round(cu, 6) AS cu, round(zv - cu * uv, 6) AS cv FROM c""")
def plane_fit(spark, sf_dir):
    points = boxes(spark, sf_dir).select("page", F.col("x").cast("double").alias("u"), F.col("y").cast("double").alias("v"), (F.col("w") + F.col("h") * 3).cast("double").alias("z"))
    return marks.fitted_planes(points, "page").where("cu is not null").select("page", F.round("c0", 4).alias("c0"), F.round("cu", 6).alias("cu"), F.round("cv", 6).alias("cv"))


_GLYPHS = "CASE p_partkey % 5 WHEN 0 THEN '高' WHEN 1 THEN 'a高' WHEN 2 THEN ' Ab ' WHEN 3 THEN 'abcd' ELSE '数据' END"


@query(f"""SELECT p_partkey, length(trim(t)) BETWEEN 1 AND 3 AND h > w * CAST(1.2 AS DOUBLE) AND h > 60 AND regexp_matches(trim(t), '[A-Za-z]') AS mixed, length(trim(t)) = 1 AND trim(t) BETWEEN chr(13312) AND chr(40959) AND h > w * CAST(1.2 AS DOUBLE) AND h > 60 AND s < CAST(0.9 AS DOUBLE) AS icon
FROM (SELECT p_partkey, {_GLYPHS} AS t, 20 + p_size AS w, 40 + p_size * 2 AS h, (p_partkey % 100) / CAST(100 AS DOUBLE) AS s FROM part)""")
def glyph_tests(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(_GLYPHS).alias("t"), (20 + F.col("p_size")).alias("w"), (40 + F.col("p_size") * 2).alias("h"), ((F.col("p_partkey") % 100) / 100).alias("s"))
    c = F.col
    return df.select("p_partkey", tx.short_tall_mixed(c("t"), c("w"), c("h")).alias("mixed"), tx.icon_like_character(c("t"), c("w"), c("h"), c("s")).alias("icon"))


# Names with some letters o read as e, and words: pieces of three and four letters of all names, and the long words of documents, with their counts.
_READ = "CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, 'o', 'e') ELSE p_name END"
_BEST = "list_max(list_concat([0], list_transform(spans, lambda w: coalesce(m[substr({0}, w[1] + 1, w[2] - w[1])], 0))))"


@query(f"""WITH RECURSIVE g AS (SELECT p_name, unnest(range(0, length(p_name))) AS a FROM part), f AS (SELECT substr(p_name, a + 1, k) AS word, count(*) AS freq FROM g, (VALUES (3), (4)) t(k) WHERE a + k <= length(p_name) GROUP BY ALL HAVING count(*) >= 10),
  d AS (SELECT map(list(word), list(freq)) AS m FROM f), long AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{{5,}}')) AS word FROM documents), enough AS (SELECT (SELECT count(*) FROM f) + (SELECT count(*) FROM long) >= 1000 AS ok), l AS (SELECT p_partkey AS id, {_READ} AS text FROM part),
  r AS (SELECT id, text, 0 AS i, text AS s FROM l UNION ALL
    SELECT id, text, i + 1, CASE WHEN alt IS NULL OR {_BEST.format('s')} > 0 THEN s WHEN {_BEST.format('s2')} >= 50 THEN s2 ELSE s END FROM (
      SELECT *, left(s, i) || alt || substr(s, i + 2) AS s2, list_filter(flatten(list_transform(range(greatest(0, i - 3), i + 1), lambda a: list_transform(range(a + 2, a + 5), lambda b: [a, b]))), lambda w: w[2] > i AND w[2] <= length(s)) AS spans
      FROM (SELECT r.*, d.m, CASE substr(text, i + 1, 1) WHEN 'e' THEN 'o' WHEN 'o' THEN 'e' END AS alt FROM r, d WHERE i < length(text))))
SELECT id, text, CASE WHEN ok THEN s ELSE text END AS fixed FROM r, enough WHERE i = length(text)""")
def confusable_repair(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    starts = parts.where(F.length("p_name") > 0).select("p_name", F.explode(F.sequence(F.lit(0), F.length("p_name") - 1)).alias("a"))
    sized = starts.select("p_name", "a", F.explode(F.array(F.lit(3), F.lit(4))).alias("k")).where(F.col("a") + F.col("k") <= F.length("p_name"))
    words = sized.groupBy(F.substr("p_name", F.col("a") + 1, F.col("k")).alias("word")).agg(F.count("*").alias("freq")).where("freq >= 10")
    long = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{5,}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    return repair.confusables_repaired(parts.select(F.col("p_partkey").alias("id"), F.expr(_READ).alias("text")), words.unionByName(long), {"o": "e", "e": "o"})


_HAN = "CASE id % 4 WHEN 0 THEN '高' WHEN 1 THEN '风险程度' WHEN 2 THEN '数据' ELSE 'text' END"


@query(f"""{with_('boxes')}, l AS (SELECT page, id, x, y, w, h, {_HAN} AS text, (id % 10) / CAST(10 AS DOUBLE) + CAST(0.05 AS DOUBLE) AS score FROM boxes)
SELECT page, id, text FROM l a WHERE NOT (length(text) = 1 AND score < CAST(0.9 AS DOUBLE) AND NOT EXISTS (SELECT 1 FROM l b WHERE b.page = a.page AND b.id <> a.id AND abs(b.y + b.h / 2 - a.y - a.h / 2) < CAST(0.6 AS DOUBLE) * a.h
  AND least(abs(b.x - a.x - a.w), abs(a.x - b.x - b.w)) < CAST(1.5 AS DOUBLE) * a.h))""")
def lone_glyphs(spark, sf_dir):
    lines = boxes(spark, sf_dir).select("page", "id", "x", "y", "w", "h", F.expr(_HAN).alias("text"), ((F.col("id") % 10) / 10 + 0.05).alias("score"))
    return marks.without_lone_glyphs(lines).select("page", "id", "text")


@query(f"""{with_('boxes')}, l AS (SELECT page, id, x, y, w // 2 AS w, h * 4 AS h, {_HAN} AS text FROM boxes), u AS (SELECT *, length(text) AS n, id % 4 < 3 AND length(text) >= 2 AND h >= CAST(2.2 AS DOUBLE) * w AND h >= CAST(0.8 AS DOUBLE) * length(text) * w AS upright FROM l),
  e AS (SELECT *, unnest(range(0, CASE WHEN upright THEN n ELSE 1 END)) AS i FROM u)
SELECT page, id, CAST(i AS INT) AS i, CASE WHEN upright THEN substr(text, i + 1, 1) ELSE text END AS text, x, CASE WHEN upright THEN CAST(round_even(y + i * (h / CAST(n AS DOUBLE)), 0) AS BIGINT) ELSE y END AS y, w, CASE WHEN upright THEN CAST(round_even(h / CAST(n AS DOUBLE), 0) AS BIGINT) ELSE h END AS h FROM e""")
def vertical_split(spark, sf_dir):
    lines = boxes(spark, sf_dir).select("page", "id", "x", "y", F.floor(F.col("w") / 2).alias("w"), (F.col("h") * 4).alias("h"), F.expr(_HAN).alias("text"))
    return marks.vertical_split(lines)


_EDITED = "CASE WHEN id % 4 = 0 THEN NULL WHEN id % 8 = 1 THEN ' ' WHEN id % 8 = 5 THEN chr(9) || chr(10) || ' ' ELSE ' new ' || chr(10) || id || chr(9) END"


@query(f"""{with_('boxes')}, e AS (SELECT page, id, x + 2 AS x, y + 1 AS y, w, h, regexp_replace(replace(coalesce({_EDITED}, ''), chr(10), ''), '^\\s+|\\s+$', '', 'g') AS text FROM boxes WHERE id % 3 <> 0),
  p AS (SELECT a.page, a.id AS edit, a.text, b.id AS line, {INTER} / greatest(1e-6, CAST({UNION} AS DOUBLE)) AS iou FROM e a JOIN boxes b ON a.page = b.page AND {INTER} / greatest(1e-6, CAST({UNION} AS DOUBLE)) >= CAST(0.4 AS DOUBLE)),
  c AS MATERIALIZED (SELECT page, edit, text, list(line ORDER BY iou DESC, line) AS lines, row_number() OVER (PARTITION BY page ORDER BY edit) AS k FROM p GROUP BY page, edit, text),
  f AS (SELECT page, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone, CAST([] AS STRUCT(line BIGINT, text VARCHAR, k BIGINT)[]) AS done FROM (SELECT DISTINCT page FROM c)
    UNION ALL SELECT page, k, CASE WHEN line IS NOT NULL AND text = '' THEN list_append(gone, line) ELSE gone END, CASE WHEN line IS NULL THEN done ELSE list_append(done, {{'line': line, 'text': text, 'k': k}}) END
    FROM (SELECT f.page, c.k, c.text, f.gone, f.done, list_filter(c.lines, lambda l: NOT list_contains(f.gone, l))[1] AS line FROM f JOIN c ON c.page = f.page AND c.k = f.k + 1)),
  d AS (SELECT page, d.line AS id, arg_max(d.text, d.k) AS new FROM (SELECT page, unnest(done) AS d FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY k DESC) AS r FROM f) WHERE r = 1) GROUP BY ALL)
SELECT b.page, b.id, coalesce(new, 'line ' || b.id) AS text FROM boxes b LEFT JOIN d ON b.page = d.page AND b.id = d.id WHERE new IS NULL OR new <> ''""")
def lines_edited(spark, sf_dir):
    b = boxes(spark, sf_dir)
    edits = b.where("id % 3 <> 0").withColumns({"x": F.col("x") + 2, "y": F.col("y") + 1, "text": F.expr(_EDITED)})
    return repair.lines_edited(b.withColumn("text", F.concat(F.lit("line "), F.col("id"))), edits)


@query("""WITH r AS (SELECT p_partkey, string_split(p_name, ' ') AS w, CASE WHEN p_partkey % 2 = 0 THEN upper(replace(p_name, ' ', '')) ELSE p_type END AS text FROM part),
  l AS (SELECT *, list_transform(w, lambda x: length(x)) AS n FROM r)
SELECT p_partkey, CASE WHEN len(w) > 1 AND list_sum(n) = length(text) THEN array_to_string(list_transform(range(1, len(w) + 1), lambda i: substr(text, CAST(coalesce(list_sum(n[1 : i - 1]), 0) AS BIGINT) + 1, n[i]) || ':' || i), ' ')
  ELSE text || ':' || list_position(n, list_max(n)) END AS runs FROM l""")
def runs_kept(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.split("p_name", " ").alias("w"), F.when(F.col("p_partkey") % 2 == 0, F.upper(F.replace("p_name", F.lit(" "), F.lit("")))).otherwise(F.col("p_type")).alias("text"))
    runs = repair.runs_with_text(F.transform("w", lambda x, i: F.struct(x.alias("text"), (i + 1).alias("style"))), F.col("text"))
    return parts.select("p_partkey", F.array_join(F.transform(runs, lambda r: F.concat(r["text"], F.lit(":"), r["style"])), " ").alias("runs"))


from . import arrow_queries, attach_queries, layout_queries, style_queries, text_queries  # noqa: E402, F401  they register their queries here
