"""Queries of layout decisions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout, marks
from .queries import INTER, query
from .relations import relation, with_

_GAP = " + ".join(f"(b.{c} - a.rest_{c}) * (b.{c} - a.rest_{c})" for c in "rgb")


@query(f"""{with_('icons')}, p AS (SELECT a.page, a.id AS turn, b.id, b.light AND NOT a.light AS band, a.rest < 20 AS bare, {_GAP} < 4900 AS same, b.fill < CAST(0.86 AS DOUBLE) * b.w * b.h OR b.light AS shaped
    FROM icons a JOIN icons b ON a.page = b.page AND a.id <> b.id AND a.score >= 55 AND NOT b.pale AND {INTER} / (b.w * b.h) > 0.4 AND b.w * b.h <= CAST(0.6 AS DOUBLE) * (a.w * a.h)),
  o AS (SELECT turn, bool_or(band) AS band, bool_or(bare) AS bare, bool_and(same) AS all_same, bool_or(same) AS some_same, bool_or(shaped) AS shaped FROM p GROUP BY turn),
  s AS (SELECT turn, turn AS id, CASE WHEN band THEN '{layout.BAND}' ELSE '{layout.CONTAINER}' END AS why FROM o WHERE band OR (NOT bare AND NOT some_same AND shaped)
    UNION ALL SELECT p.turn, p.id, CASE WHEN o.bare OR o.all_same THEN '{layout.PART}' ELSE '{layout.HOLE}' END FROM p JOIN o ON o.turn = p.turn WHERE NOT o.band AND (o.bare OR o.all_same OR (NOT o.some_same AND NOT o.shaped))),
  l AS (SELECT id, arg_max(why, turn) AS why FROM s GROUP BY id)
SELECT i.page, i.id, CASE WHEN why IS NULL THEN score ELSE least(score, 40) END AS score, why, why IS NULL AND score >= 55 AS kept FROM icons i LEFT JOIN l ON l.id = i.id""")
def icon_demotion(spark, sf_dir):
    return layout.contained_icons(relation(spark, sf_dir, "icons"))


@query(f"""{with_('icons')}, h AS (SELECT DISTINCT a.id FROM icons a JOIN icons b ON a.page = b.page AND a.id <> b.id AND {INTER} > CAST(0.9 AS DOUBLE) * (b.w * b.h) AND b.w * b.h < CAST(0.8 AS DOUBLE) * (a.w * a.h)),
  k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page ORDER BY w * h DESC, id) AS k FROM icons WHERE id NOT IN (SELECT id FROM h) OR CASE WHEN free < CAST(0.15 AS DOUBLE) THEN coalesce(drawn >= 0.5, false) ELSE plain <= CAST(0.45 AS DOUBLE) END),
  f AS (SELECT page, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id BIGINT, x BIGINT, y BIGINT, w BIGINT, h BIGINT)[]) AS kept FROM (SELECT DISTINCT page FROM k)
    UNION ALL SELECT f.page, a.k, CASE WHEN len(list_filter(f.kept, lambda o: {INTER.replace('b.', 'o.')} / least(a.w * a.h, o.w * o.h) > 0.6)) > 0 THEN f.kept ELSE list_append(f.kept, {{'id': a.id, 'x': a.x, 'y': a.y, 'w': a.w, 'h': a.h}}) END FROM f JOIN k a ON a.page = f.page AND a.k = f.k + 1)
SELECT page, u.id FROM (SELECT page, unnest(kept) AS u FROM (SELECT page, kept FROM f QUALIFY row_number() OVER (PARTITION BY page ORDER BY k DESC) = 1))""")
def photo_cards(spark, sf_dir):
    return layout.without_photo_cards(relation(spark, sf_dir, "icons"))


_GAPS = "CASE WHEN (id + i * i) % 7 = 0 THEN 25 + (id + i) % 20 ELSE (id * 7 + i * 13) % (3 + id % 9) END"


@query(rf"""{with_('gap_lines')}, c AS MATERIALIZED (SELECT l.*, length(text) AS n, i, substr(text, i + 1, 1) AS ch, substr(text, i + 2, 1) AS nx, x + i * 22 AS x0, x + i * 22 + 18 + (id + i) % 3 AS x1, CASE WHEN i < length(text) - 1 THEN CAST({_GAPS} AS DOUBLE) END AS g, (id * 3 + i * 29) % 200 AS apart FROM gap_lines l, LATERAL (SELECT unnest(range(0, length(text))) AS i)),
  e AS (SELECT id, CASE WHEN count(*) FILTER (ch BETWEEN '一' AND '鿿') >= 3 THEN least(CAST(0.8 AS DOUBLE) * any_value(h), median(CAST(x1 - x0 AS DOUBLE)) FILTER (ch BETWEEN '一' AND '鿿')) ELSE CAST(0.8 AS DOUBLE) * any_value(h) END AS em FROM c GROUP BY id),
  o AS (SELECT *, contains('{layout.OPEN_AFTER}', ch) OR contains('{layout.OPEN_BEFORE}', nx) AS open FROM c),
  b AS (SELECT id, coalesce(median(g) FILTER (NOT open), 0) AS base, count(*) FILTER (NOT open) AS normal, quantile_cont(g, 0.3) FILTER (NOT open) AS low FROM o WHERE g IS NOT NULL GROUP BY id),
  k AS (SELECT o.*, CASE WHEN g IS NULL OR normal >= 4 AND low >= CAST(0.35 AS DOUBLE) * em OR open OR ch = ' ' OR nx = ' ' THEN 0 WHEN g - base >= CAST(0.9 AS DOUBLE) * em AND g >= 3 * greatest(base, 1) OR em >= 36 AND regexp_matches(ch || nx, '^[\p{{L}}\p{{N}}]{{2}}$') AND g >= greatest(CAST(0.3 AS DOUBLE) * em, CAST(2.5 AS DOUBLE) * greatest(base, 1)) AND apart > 90 THEN 2
    WHEN g - base >= CAST(0.45 AS DOUBLE) * em AND g >= 3 * greatest(base, 1) AND NOT (ord(ch) < 128 AND ord(nx) < 128) THEN 1 ELSE 0 END AS kind FROM o JOIN e ON e.id = o.id LEFT JOIN b ON b.id = o.id),
  p AS (SELECT *, lag(kind, 1, 0) OVER w AS before, lag(x1) OVER w AS end_, coalesce(sum(CAST(kind = 2 AS INT)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part, max(kind) OVER (PARTITION BY id) AS changed FROM k WINDOW w AS (PARTITION BY id ORDER BY i))
SELECT page, id, CAST(part AS INT) AS part, string_agg(CASE WHEN before = 1 THEN ' ' ELSE '' END || ch, '' ORDER BY i) AS text, CASE WHEN any_value(changed) > 0 THEN min(x0) ELSE any_value(x) END AS x, CASE WHEN any_value(changed) > 0 THEN max(x1) - min(x0) ELSE any_value(w) END AS w,
  string_agg(CASE WHEN before = 1 THEN end_ || '-' || x0 || ' ' ELSE '' END || x0 || '-' || x1, ' ' ORDER BY i) AS spans FROM p GROUP BY page, id, part""")
def wide_gaps(spark, sf_dir):
    lines = relation(spark, sf_dir, "gap_lines")
    places = "transform(sequence(0, length(text) - 1), i -> named_struct('x0', x + i * 22, 'x1', x + i * 22 + 18 + (id + i) % 3))"
    between = lambda what: F.expr(f"transform(sequence(0, length(text) - 2), i -> cast({what} as double))")
    out = layout.split_at_gaps(lines.withColumns({"chars": F.expr(places), "gaps": between(_GAPS), "apart": between("(id * 3 + i * 29) % 200")}))
    return out.select("page", "id", "part", "text", "x", "w", F.array_join(F.transform("chars", lambda s: F.concat(s["x0"], F.lit("-"), s["x1"])), " ").alias("spans"))


_GRADE = "CASE WHEN trim(text) IN ('低', 'Low') THEN 0 WHEN trim(text) IN ('中', 'Medium') THEN 1 WHEN trim(text) IN ('高', 'High') THEN 2 END"


def _axes(key: str, pos: str, order: str) -> str:
    return f"""(SELECT page, of[1].id AS head, arg_min(of, seed) AS of FROM (SELECT a.page, a.id AS seed, a.h AS tall, list({{'id': b.id, 'g': b.g, 'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h, 'p': b.{pos}}} ORDER BY b.{pos}, b.id) AS of FROM m a JOIN m b ON a.page = b.page AND abs(a.{key} - b.{key}) <= greatest(8, CAST(0.6 AS DOUBLE) * a.h) GROUP BY a.page, a.id, a.h)
    WHERE len(of) = 3 AND list_transform(of, lambda z: z.g) = {order} AND least(of[2].p - of[1].p, of[3].p - of[2].p) >= 2 * tall AND greatest(of[2].p - of[1].p, of[3].p - of[2].p) <= CAST(1.5 AS DOUBLE) * least(of[2].p - of[1].p, of[3].p - of[2].p) GROUP BY page, of[1].id)"""


@query(f"""{with_('grade_lines')}, m AS MATERIALIZED (SELECT *, {_GRADE} AS g, x + w / 2 AS cx, y + h / 2 AS cy FROM grade_lines WHERE {_GRADE} IS NOT NULL AND h > 0),
  j AS (SELECT c.page, c.head AS column_id, r.head AS row_id, c.of AS col, r.of AS "row", list_sort(list_transform(list_concat(c.of, r.of), lambda z: z.h)) AS hs FROM {_axes('cx', 'cy', '[2, 1, 0]')} c JOIN {_axes('cy', 'cx', '[0, 1, 2]')} r ON c.page = r.page),
  k AS (SELECT *, (hs[3] + hs[4]) / 2 AS tall, list_max(list_transform(col, lambda z: z.x + z.w)) AS cr, list_max(list_transform(col, lambda z: z.y + z.h)) AS cl, list_min(list_transform("row", lambda z: z.x)) AS rl, list_min(list_transform("row", lambda z: z.y)) AS rt, list_min(list_transform(col, lambda z: z.x)) AS x, list_min(list_transform(col, lambda z: z.y)) AS y FROM j)
SELECT page, column_id, row_id, x, y, list_max(list_transform("row", lambda z: z.x + z.w)) - x AS w, list_max(list_transform("row", lambda z: z.y + z.h)) - y AS h FROM k WHERE cl <= rt + tall AND rt - cl < 5 * tall AND cr <= rl + tall AND rl - cr < 6 * tall""")
def axis_corners(spark, sf_dir):
    return layout.axis_corners(relation(spark, sf_dir, "grade_lines"))


# Every number of panels is tried for each band; of those whose cuts all fall on empty columns the largest counts.
@query(f"""{with_('sheet_cells')}, sz AS (SELECT page, max(r) + 1 AS hh, max(c) + 1 AS ww FROM sheet_cells GROUP BY page),
  rw AS (SELECT page, r, avg(CAST(pure AS INT)) >= 0.995 AS gap FROM sheet_cells GROUP BY page, r),
  i AS (SELECT page, gap, min(r) AS a, max(r) AS b, count(*) AS n FROM (SELECT *, r - row_number() OVER (PARTITION BY page, gap ORDER BY r) AS g FROM rw) GROUP BY page, gap, g),
  p AS (SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY page ORDER BY a) AS part FROM (SELECT i.*, gap AND (n >= 3 OR a = low OR b = high) AS cut FROM i JOIN (SELECT page, min(r) AS low, max(r) AS high FROM rw GROUP BY page) USING (page))),
  bd AS MATERIALIZED (SELECT * FROM (SELECT p.page, min(a) AS y0, max(b) + 1 AS y1, any_value(hh) AS hh FROM p JOIN sz ON sz.page = p.page WHERE NOT cut GROUP BY p.page, part) WHERE y1 - y0 >= floor(CAST(0.08 AS DOUBLE) * hh) QUALIFY count(*) OVER (PARTITION BY page) >= 2),
  cs AS MATERIALIZED (SELECT s.page, y0, y1, c, avg(CAST(pure AS INT)) AS s FROM sheet_cells s JOIN bd ON bd.page = s.page AND r >= y0 AND r < y1 GROUP BY ALL),
  ab AS (SELECT page, y0, y1, min(c) AS a, max(c) + 1 AS b FROM cs WHERE s < 0.995 GROUP BY page, y0, y1),
  kk AS (SELECT *, (b - a) / CAST(k AS DOUBLE) AS wide FROM ab, (SELECT unnest(range(1, 9)) AS k)),
  ct AS (SELECT *, CAST(floor(a + i * wide) AS INT) AS at_, greatest(3, CAST(floor(CAST(0.04 AS DOUBLE) * wide) AS INT)) AS win FROM kk, LATERAL (SELECT unnest(range(1, k)) AS i) WHERE wide / (y1 - y0) BETWEEN 1.15 AND 2.2),
  sm AS (SELECT ct.page, ct.y0, k, i, arg_max(c, s * 1000000 - c) AS cut, max(s) AS s FROM ct JOIN cs ON cs.page = ct.page AND cs.y0 = ct.y0 AND c >= greatest(a, at_ - win) AND c < least(b, at_ + win) GROUP BY ALL),
  ok AS (SELECT page, y0, max(k) AS k FROM (SELECT kk.page, kk.y0, kk.k FROM kk LEFT JOIN sm ON sm.page = kk.page AND sm.y0 = kk.y0 AND sm.k = kk.k AND sm.s >= 0.55 WHERE wide / (kk.y1 - kk.y0) BETWEEN 1.15 AND 2.2 GROUP BY ALL HAVING count(sm.i) = kk.k - 1) GROUP BY ALL),
  pt AS (SELECT page, y0, cut AS x0, lead(cut) OVER (PARTITION BY page, y0 ORDER BY cut) AS x1 FROM (SELECT ab.page, ab.y0, a AS cut FROM ab JOIN ok ON ok.page = ab.page AND ok.y0 = ab.y0 UNION ALL SELECT ab.page, ab.y0, b FROM ab JOIN ok ON ok.page = ab.page AND ok.y0 = ab.y0 UNION ALL SELECT sm.page, sm.y0, cut FROM sm JOIN ok ON ok.page = sm.page AND ok.y0 = sm.y0 AND ok.k = sm.k)),
  hd AS MATERIALIZED (SELECT s.page, bd.y0, x0, r, c, pure FROM sheet_cells s JOIN bd ON bd.page = s.page AND r >= bd.y0 AND r < bd.y1 JOIN pt ON pt.page = s.page AND pt.y0 = bd.y0 AND c >= x0 AND c < x1),
  bx AS MATERIALIZED (SELECT page, y0, x0, x, y, x2 - x + 1 AS w, y2 - y + 1 AS h FROM (SELECT page, y0, x0, min(c) AS x, max(c) AS x2 FROM (SELECT page, y0, x0, c FROM hd GROUP BY ALL HAVING avg(CAST(pure AS INT)) < 0.995) GROUP BY ALL) JOIN (SELECT page, y0, x0, min(r) AS y, max(r) AS y2 FROM (SELECT page, y0, x0, r FROM hd GROUP BY ALL HAVING avg(CAST(pure AS INT)) < 0.995) GROUP BY ALL) USING (page, y0, x0)),
  rl AS (SELECT bx.page FROM bx JOIN sz ON sz.page = bx.page GROUP BY bx.page HAVING count(*) >= 2 AND max(w / h) <= CAST(1.25 AS DOUBLE) * min(w / h) AND sum(w * h) >= CAST(0.4 AS DOUBLE) * any_value(ww) * any_value(hh))
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY y0, x0) AS INT) AS panel, x, y, w, h FROM bx WHERE page IN (SELECT page FROM rl)""")
def contact_sheets(spark, sf_dir):
    return layout.sheet_panels(relation(spark, sf_dir, "sheet_cells"))


_POINTS = "SELECT page, (x - 200) / CAST(200 AS DOUBLE) AS u, (y - 150) / CAST(150 AS DOUBLE) AS v, CAST(w + h * 3 AS DOUBLE) AS z FROM boxes"
_MATRIX = "[" + ", ".join("[" + ", ".join(f"sum(pow(u, {a + c}) * pow(v, {b + d}))" for c, d in marks.TERMS) + f", sum(pow(u, {a}) * pow(v, {b}) * z)]" for a, b in marks.TERMS) + "]"


# Elimination: turn k brings the row with the largest entry of column k up, and clears that column in all others.
@query(f"""{with_('boxes')}, e AS (SELECT page, 1 AS k, {_MATRIX} AS m FROM ({_POINTS}) GROUP BY page HAVING count(*) >= 6
    UNION ALL SELECT page, k + 1, list_transform(range(1, 7), lambda r: CASE WHEN r = k THEN list_transform(s[k], lambda v: v / s[k][k]) ELSE list_transform(range(1, 8), lambda c: s[r][c] - s[r][k] * (s[k][c] / s[k][k])) END)
    FROM (SELECT *, list_transform(range(1, 7), lambda r: CASE WHEN r = k THEN m[p] WHEN r = p THEN m[k] ELSE m[r] END) AS s FROM (SELECT *, list_reverse_sort(list_transform(range(k, 7), lambda r: {{'size': abs(m[r][k]), 'less': -r}}))[1].less * -1 AS p FROM e WHERE k <= 6)))
SELECT page, {", ".join(f"round(m[{i + 1}][7], 4) AS c{i}" for i in range(6))} FROM e WHERE k = 7""")
def surface_fit(spark, sf_dir):
    points = relation(spark, sf_dir, "boxes").select("page", ((F.col("x") - 200) / 200).alias("u"), ((F.col("y") - 150) / 150).alias("v"), (F.col("w") + F.col("h") * 3).cast("double").alias("z"))
    found = marks.fitted_surfaces(points, "page").where("c is not null")
    return found.select("page", *[F.round(F.get("c", F.lit(i)), 4).alias(f"c{i}") for i in range(6)])
