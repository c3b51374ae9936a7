"""Queries of what belongs to a line and was not read with it, or was read and is no text, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geom
from ..operators import attach
from ..operators.spatial import touching
from .queries import INTER, SMALLER, boxes, query
from .relations import relation, with_

#: Right edge of the pages of these lines.
WIDTH = 1560

_COLOUR = "(l.r - s.r) * (l.r - s.r) + (l.g - s.g) * (l.g - s.g) + (l.b - s.b) * (l.b - s.b)"


@query(f"""{with_('mark_lines', 'strokes')}, l AS (SELECT *, CAST(floor(y0 + 0.25 * (y1 - y0)) AS BIGINT) AS ya, CAST(floor(y0 + CAST(0.8 AS DOUBLE) * (y1 - y0)) AS BIGINT) AS yb FROM mark_lines WHERE NOT badge AND size >= 10 AND regexp_matches(text, '[一-鿿]') AND x0 IS NOT NULL),
  v AS (SELECT *, 'left' AS side, greatest(0, CAST(floor(x0 - 5.5 * size) AS BIGINT)) AS xa, greatest(0, x0 - 2) AS xb FROM l UNION ALL SELECT *, 'right', least({WIDTH}, x1 + 2), least({WIDTH}, CAST(floor(x1 + 5.5 * size) AS BIGINT)) FROM l),
  p AS (SELECT l.page, l.id, l.text, l.size, side, xa, xb, greatest(xa, s.x) AS lo, least(xb, s.x + s.w) AS hi, greatest(ya, s.y) AS top, least(yb, s.y + s.h) AS low, taken, alone, s.id AS sid FROM v l JOIN strokes s ON s.page = l.page AND s.x < xb AND s.x + s.w > xa AND s.y < yb AND s.y + s.h > ya AND {_COLOUR} < 3600 WHERE xb - xa >= CAST(0.8 AS DOUBLE) * size AND yb - ya >= 3),
  t AS (SELECT * FROM p WHERE low - top <= greatest(3, CAST(0.16 AS DOUBLE) * size)),
  o AS (SELECT id FROM t WHERE hi - lo >= CAST(0.8 AS DOUBLE) * size GROUP BY id HAVING count(DISTINCT side) = 2),
  c AS (SELECT *, (top + low) / 2 AS mid, row_number() OVER (PARTITION BY id, side ORDER BY CASE side WHEN 'left' THEN -hi ELSE lo END, sid) AS r FROM t WHERE NOT taken AND hi - lo >= CAST(0.45 AS DOUBLE) * size AND (side = 'left' OR NOT contains('{attach.CLOSING}', right(text, 1))) AND id NOT IN (SELECT id FROM o)),
  g AS (SELECT c.id, c.side, any_value(c.size) AS size, any_value(c.xa) AS xa, any_value(c.xb) AS xb, min(c.lo) AS lo, max(c.hi) AS hi, sum(c.hi - c.lo) AS total, bool_and(c.alone) AS alone FROM c JOIN c n ON n.id = c.id AND n.side = c.side AND n.r = 1 AND abs(c.mid - n.mid) <= 2 GROUP BY c.id, c.side),
  d AS (SELECT *, repeat('—', CAST(greatest(1, least(4, round_even((hi - lo) / size, 0))) AS BIGINT)) AS dash FROM g WHERE alone AND CASE side WHEN 'left' THEN xb - hi ELSE lo - xa END <= CAST(0.8 AS DOUBLE) * size AND NOT CASE side WHEN 'left' THEN lo - xa <= 1 ELSE hi >= xb - 1 END AND total BETWEEN CAST(0.8 AS DOUBLE) * size AND CAST(4.6 AS DOUBLE) * size)
SELECT m.page, m.id, CASE WHEN a.dash IS NOT NULL AND starts_with(a.dash || m.text, '—一') THEN '——' || substr(a.dash || m.text, 3) ELSE coalesce(a.dash, '') || m.text END || coalesce(z.dash, '') AS text, coalesce(a.lo, m.x0) AS x0, coalesce(z.hi, m.x1) AS x1 FROM mark_lines m LEFT JOIN d a ON a.id = m.id AND a.side = 'left' LEFT JOIN d z ON z.id = m.id AND z.side = 'right'""")
def dashes(spark, sf_dir):
    return attach.dashes_attached(relation(spark, sf_dir, "mark_lines"), relation(spark, sf_dir, "strokes"), WIDTH)


_OPEN = "length(text) - length(replace(text, '“', '')) > length(text) - length(replace(text, '”', ''))"


@query(f"""{with_('mark_lines', 'spots')}, l AS (SELECT *, least({WIDTH}, x1 + 1) AS xa, least({WIDTH}, CAST(floor(x1 + CASE WHEN open THEN 0.75 ELSE CAST(0.9 AS DOUBLE) END * size) AS BIGINT)) AS xb, greatest(0, CAST(floor(CASE WHEN open THEN y0 - CAST(0.1 AS DOUBLE) * size ELSE y0 + CAST(0.35 AS DOUBLE) * (y1 - y0) END) AS BIGINT)) AS ya, CAST(floor(CASE WHEN open THEN y0 + 0.5 * (y1 - y0) ELSE y1 + CAST(0.3 AS DOUBLE) * size END) AS BIGINT) AS yb
    FROM (SELECT *, {_OPEN} AS open FROM mark_lines) WHERE NOT badge AND size >= 14 AND regexp_matches(text, '[一-鿿]') AND NOT contains('{attach.ENDING}', right(text, 1)) AND x1 IS NOT NULL),
  p AS (SELECT l.id, l.open, l.size, xa, ya, s.x, s.y, s.w, s.h, s.area, s.stem, s.id AS sid FROM l JOIN spots s ON s.page = l.page AND s.x >= xa AND s.x < xb AND s.y < yb AND s.y + s.h > ya AND s.x + s.w < xb - 1 AND {_COLOUR} < 4900 AND NOT taken AND greatest(s.w, s.h) BETWEEN CAST(0.08 AS DOUBLE) * size AND CAST(0.45 AS DOUBLE) * size AND area >= 6 WHERE xb - xa >= 4 AND yb - ya >= 4),
  f AS (SELECT id, '”' AS mark, max(x + w) AS far FROM p WHERE open AND x - xa <= 0.5 * size GROUP BY id HAVING count(*) <= 2
    UNION ALL SELECT id, CASE WHEN area < CAST(0.6 AS DOUBLE) * (w * h) AND abs(w - h) <= 0.25 * greatest(w, h) THEN '。' ELSE '，' END, x + w FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x, y, sid) AS r FROM p WHERE NOT open AND y > ya AND x - xa <= CAST(0.55 AS DOUBLE) * size AND h <= CAST(3.2 AS DOUBLE) * greatest(1, w) AND NOT stem) WHERE r = 1)
SELECT m.page, m.id, m.text || coalesce(mark, '') AS text, coalesce(far, x1) AS x1 FROM mark_lines m LEFT JOIN f ON f.id = m.id""")
def end_marks(spark, sf_dir):
    return attach.end_marks_attached(relation(spark, sf_dir, "mark_lines"), relation(spark, sf_dir, "spots"), WIDTH)


@query(f"""{with_('glyph_lines')}, m AS (SELECT *, CASE WHEN a2 - b1 >= CAST(0.15 AS DOUBLE) * h THEN b1 WHEN a3 - b2 >= CAST(0.15 AS DOUBLE) * h THEN b2 END AS stop, CASE WHEN a2 - b1 >= CAST(0.15 AS DOUBLE) * h THEN a2 WHEN a3 - b2 >= CAST(0.15 AS DOUBLE) * h THEN a3 END AS nxt FROM glyph_lines),
  g AS (SELECT *, NOT manual AND contains('{attach.ICON_GLYPHS}', substr(text, 1, 1)) AND substr(text, 2, 1) = ' ' AND length(text) >= 4 AND length(ltrim(substr(text, 2))) >= 2 AND coalesce(stop - a1 BETWEEN 0.5 * h AND CAST(1.3 AS DOUBLE) * h AND nxt - stop >= CAST(0.3 AS DOUBLE) * h, false) AS goes FROM m)
SELECT page, id, CASE WHEN goes THEN ltrim(substr(text, 2)) ELSE text END AS text, CASE WHEN goes THEN x + nxt ELSE x END AS x, CASE WHEN goes THEN w - nxt ELSE w END AS w FROM g""")
def leading_glyphs(spark, sf_dir):
    lines = relation(spark, sf_dir, "glyph_lines").withColumn("ink", F.expr("array(named_struct('a', a1, 'b', b1), named_struct('a', a2, 'b', b2), named_struct('a', a3, 'b', a3 + 200))"))
    return attach.without_leading_glyph(lines).select("page", "id", "text", "x", "w")


@query(f"""{with_('bar_lines')}, c AS (SELECT *, substr(text, i + 1, 1) AS ch, CASE WHEN i > 0 THEN substr(text, i, 1) ELSE '' END AS l, substr(text, i + 2, 1) AS r, x + i * 20 AS px, 3 + (id + i) % 4 AS sw, 14 + (id * 3 + i) % 8 AS sh, (3 + (id + i) % 4) * (14 + (id * 3 + i) % 8) - (id + i) % 3 * 5 AS area FROM bar_lines, LATERAL (SELECT unnest(range(0, length(text))) AS i)),
  k AS (SELECT *, contains('{attach.BAR_GLYPHS}', ch) AND NOT (contains('{attach.BAR_LETTERS}', ch) AND (regexp_matches(l, '^[A-Za-z0-9]$') OR regexp_matches(r, '^[A-Za-z0-9]$'))) AND sh >= CAST(0.6 AS DOUBLE) * h AND sw BETWEEN CAST(0.12 AS DOUBLE) * sh AND CAST(0.4 AS DOUBLE) * sh AND area >= CAST(0.85 AS DOUBLE) * (sw * sh) AS bar FROM c),
  g AS (SELECT page, id, any_value(text) AS text, any_value(x) AS x, any_value(w) AS w, trim(string_agg(ch, '' ORDER BY i) FILTER (NOT bar)) AS kept, min(px) FILTER (NOT bar) AS first, bool_or(bar) AS drops, bool_or(bar AND i = 0) AS head, count(*) FILTER (NOT bar) AS n FROM k GROUP BY page, id)
SELECT page, id, CASE WHEN drops THEN kept ELSE text END AS text, CASE WHEN head THEN first ELSE x END AS x, CASE WHEN head THEN x + w - first ELSE w END AS w, CAST(n AS INT) AS n_chars FROM g""")
def side_bars(spark, sf_dir):
    each = lambda what: F.expr(f"transform(sequence(0, length(text) - 1), i -> {what})")
    lines = relation(spark, sf_dir, "bar_lines").withColumns({"chars": each("named_struct('x0', x + i * 20, 'x1', x + i * 20 + 12)"), "shapes": each("named_struct('w', 3 + (id + i) % 4, 'h', 14 + (id * 3 + i) % 8, 'area', (3 + (id + i) % 4) * (14 + (id * 3 + i) % 8) - (id + i) % 3 * 5)")})
    return attach.without_side_bars(lines).select("page", "id", "text", "x", "w", F.size("chars").alias("n_chars"))


@query(f"""{with_('tall_lines', 'strip_reads')}, t AS (SELECT page, line AS id, text AS read, count(DISTINCT band) AS bands, list(DISTINCT band) AS which FROM strip_reads GROUP BY ALL),
  best AS (SELECT * FROM strip_reads QUALIFY row_number() OVER (PARTITION BY line, text ORDER BY score DESC, seq) = 1),
  n AS (SELECT id, count(*) AS texts, len(list_distinct(flatten(list(which)))) AS bands FROM t GROUP BY id),
  l AS (SELECT *, length(trim(text)) BETWEEN 1 AND 3 AND h > w * CAST(1.2 AS DOUBLE) AND h > 60 AND regexp_matches(text, '[A-Za-z]') AS mixed, regexp_matches(trim(text), '^[A-Za-z]$') AS letter, regexp_matches(trim(text), '^[㐀-鿿]$') AND h > w * CAST(1.2 AS DOUBLE) AND h > 60 AND score < CAST(0.9 AS DOUBLE) AS doubtful FROM tall_lines),
  f AS (SELECT l.page, l.id, t.read FROM l JOIN t ON t.id = l.id JOIN n ON n.id = l.id WHERE mixed AND CASE WHEN letter THEN t.bands >= 2 AND regexp_matches(t.read, '[㐀-鿿]') WHEN n.texts >= 2 THEN n.bands >= 2 ELSE t.bands >= 2 AND contains(l.text, t.read) END),
  a AS (SELECT f.page, f.id, b.seq, b.text, b.x, b.y, b.w, b.h FROM f JOIN best b ON b.line = f.id AND b.text = f.read)
SELECT page, id, CAST(NULL AS BIGINT) AS seq, text FROM l WHERE CASE WHEN doubtful THEN EXISTS (SELECT 1 FROM t WHERE t.id = l.id AND t.bands >= 2 AND t.read = l.text) WHEN mixed AND id IN (SELECT id FROM f) THEN letter ELSE true END
UNION ALL SELECT page, id, seq, text FROM a WHERE NOT EXISTS (SELECT 1 FROM tall_lines b WHERE b.page = a.page AND b.id <> a.id AND {INTER} / {SMALLER} >= CAST(0.65 AS DOUBLE))""")
def strip_recovery(spark, sf_dir):
    return attach.mixed_lines(relation(spark, sf_dir, "tall_lines"), relation(spark, sf_dir, "strip_reads"))


@query(f"""{with_('boxes')} SELECT a.page, a.id, b.id AS around FROM boxes a JOIN boxes b ON a.page = b.page AND a.id <> b.id AND b.w * b.h >= 3 * a.w * a.h AND b.x + 2 <= a.x AND b.y + 2 <= a.y AND a.x + a.w <= b.x + b.w - 2 AND a.y + a.h <= b.y + b.h - 2""")
def text_fits_box(spark, sf_dir):
    pairs = touching(boxes(spark, sf_dir), boxes(spark, sf_dir)).where("a_id <> b_id").where(attach.text_fits(geom.box("a_"), geom.box("b_")))
    return pairs.select(F.col("a_page").alias("page"), F.col("a_id").alias("id"), F.col("b_id").alias("around"))


#: Size of the pages of icons.
_PAGE = (520, 400)
_WHY = "CASE WHEN id % 17 = 0 THEN 'manual' WHEN id % 19 = 0 THEN 'learned' WHEN id % 4 = 0 THEN 'arrow' ELSE 'shape' END"
_KIND = "CASE WHEN id % 9 = 0 THEN 'picture' ELSE 'icon' END"


@query(f"""{with_('icons')}, i AS (SELECT *, {_WHY} AS found, {_KIND} AS kind, greatest(w, h) AS long, least(w, h) AS short, w * h AS area FROM icons),
  s AS (SELECT *, CASE WHEN kind <> 'icon' OR found IN ('manual', 'learned') THEN NULL
    WHEN found = 'arrow' THEN CASE WHEN area > CAST(0.012 AS DOUBLE) * 208000 AND score < 90 OR short < CAST(0.012 AS DOUBLE) * 520 AND score < 60 THEN 'line of a picture' END
    WHEN short < CAST(0.02 AS DOUBLE) * 520 THEN 'small part' WHEN free >= CAST(0.42 AS DOUBLE) OR free >= CAST(0.3 AS DOUBLE) AND score < 95 THEN 'within a scene'
    WHEN long > 3 * short AND score < 90 AND area > CAST(0.004 AS DOUBLE) * 208000 THEN 'strip of a picture' WHEN area > CAST(0.04 AS DOUBLE) * 208000 AND score < 70 OR area > CAST(0.015 AS DOUBLE) * 208000 AND score < 60 THEN 'background' END AS why FROM i)
SELECT page, id, s.why, CASE WHEN s.why IS NULL THEN score ELSE least(score, 45) END AS score, long BETWEEN 12 AND 62 AND short >= CAST(7.2 AS DOUBLE) AND long <= 4 * short AND x > 1 AND y > 1 AND x + w < 519 AND y + h < 399 AS sized FROM s""")
def scene_fragments(spark, sf_dir):
    icons = relation(spark, sf_dir, "icons").withColumns({"found": F.expr(_WHY), "kind": F.expr(_KIND)})
    out = icons.withColumns({"why": attach.scene_fragment(geom.box(), F.col("score"), F.col("kind"), F.col("found"), F.col("free"), *_PAGE), "sized": attach.icon_sized(geom.box(), *_PAGE)})
    return out.select("page", "id", "why", F.when(F.col("why").isNull(), F.col("score")).otherwise(F.least("score", F.lit(45))).cast("long").alias("score"), "sized")
