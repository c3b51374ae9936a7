"""Queries of what a person's corrections of text teach, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits
from .queries import INTER, UNION, query
from .relations import relation, with_

# Blocks of p (id, old, new) in SQL: every pair of places of a stretch is tried, and the longest common run, the first in old and
# then in new, is coded as one number.
_RUN = "len(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda n: substr(old, i + 1, n) = substr(new, j + 1, n)))"
_BEST = f"list_max(list_concat([0], flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j: CASE WHEN substr(old, i + 1, 1) = substr(new, j + 1, 1) THEN {_RUN} * 1000000 - i * 1000 - j ELSE 0 END)))))"
_SCRIPT = f"""q AS MATERIALIZED (SELECT DISTINCT old, new FROM p),
  s AS (SELECT old, new, alo, ahi, blo, bhi, {_BEST} AS m FROM (SELECT *, 0 AS alo, length(old) AS ahi, 0 AS blo, length(new) AS bhi FROM q)
    UNION ALL SELECT old, new, alo, ahi, blo, bhi, {_BEST} AS m FROM (
      SELECT old, new, CASE side WHEN 0 THEN alo ELSE i + k END AS alo, CASE side WHEN 0 THEN i ELSE ahi END AS ahi, CASE side WHEN 0 THEN blo ELSE j + k END AS blo, CASE side WHEN 0 THEN j ELSE bhi END AS bhi
      FROM (SELECT *, (k * 1000000 - m) // 1000 AS i, (k * 1000000 - m) % 1000 AS j FROM (SELECT *, (m + 999999) // 1000000 AS k FROM s WHERE m > 0)), (VALUES (0), (1)) v(side)) WHERE alo < ahi AND blo < bhi),
  b AS (SELECT old, new, (k * 1000000 - m) // 1000 AS i, (k * 1000000 - m) % 1000 AS j, k FROM (SELECT *, (m + 999999) // 1000000 AS k FROM s WHERE m > 0) UNION ALL SELECT old, new, length(old), length(new), 0 FROM q),
  g AS MATERIALIZED (SELECT *, lag(i + k, 1, 0) OVER w AS pi, lag(j + k, 1, 0) OVER w AS pj FROM b WINDOW w AS (PARTITION BY old, new ORDER BY i, j)),
  ops AS MATERIALIZED (SELECT old, new, CASE WHEN pi < i AND pj < j THEN 'replace' WHEN pi < i THEN 'delete' ELSE 'insert' END AS tag, pi AS i1, i AS i2, pj AS j1, j AS j2 FROM g WHERE pi < i OR pj < j
    UNION ALL SELECT old, new, 'equal', min(i), max(i + k), min(j), max(j + k) FROM (SELECT *, sum(CASE WHEN pi = i AND pj = j THEN 0 ELSE 1 END) OVER (PARTITION BY old, new ORDER BY i) AS run FROM g WHERE k > 0) GROUP BY old, new, run)"""


@query(f"""{with_('written')}, p AS (SELECT id, text AS old, new FROM written WHERE new IS NOT NULL), {_SCRIPT}
SELECT id, tag, CAST(i1 AS INT) AS i1, CAST(i2 AS INT) AS i2, CAST(j1 AS INT) AS j1, CAST(j2 AS INT) AS j2 FROM p JOIN ops ON p.old = ops.old AND p.new = ops.new""")
def edit_script(spark, sf_dir):
    pairs = relation(spark, sf_dir, "written").where("new is not null").select("id", F.col("text").alias("old"), "new")
    return edits.edit_scripts(pairs).select("id", F.explode("ops").alias("o")).select("id", "o.*")


def written_edits(spark, sf_dir):
    """Edits of two thirds of the lines, with the line's own box, a box near it, a box far from it, or none."""
    rows = relation(spark, sf_dir, "written").where("id % 3 <> 0")
    moved = lambda c, near, far: F.when(F.col("id") % 4 == 0, F.col(c)).when(F.col("id") % 4 == 1, F.col(c) + near).when(F.col("id") % 4 == 2, F.col(c) + far)
    return rows.withColumns({"x": moved("x", 2, 500), "y": moved("y", 1, 0)}).select("page", "id", "x", "y", "w", "h", F.col("new").alias("text"))


_MOVED = "CASE id % 4 WHEN 0 THEN {0} WHEN 1 THEN {0} + {1} WHEN 2 THEN {0} + {2} END"
_LEARNED = f"""{with_('written')}, e AS (SELECT * FROM (SELECT page, id, {_MOVED.format('x', 2, 500)} AS x, {_MOVED.format('y', 1, 0)} AS y, w, h, trim(new) AS new FROM written WHERE id % 3 <> 0) WHERE x IS NOT NULL AND new IS NOT NULL),
  own AS (SELECT a.id, any_value(a.new) AS new, max(b.id) AS line FROM e a JOIN written b ON a.page = b.page AND a.x = b.x AND a.y = b.y AND a.w = b.w AND a.h = b.h GROUP BY a.id),
  near AS (SELECT id, new, line FROM (SELECT a.id, a.new, b.id AS line, row_number() OVER (PARTITION BY a.id ORDER BY {INTER} / greatest(1e-6, CAST({UNION} AS DOUBLE)) DESC, b.id) AS r FROM e a JOIN written b ON a.page = b.page AND {INTER} / greatest(1e-6, CAST({UNION} AS DOUBLE)) >= 0.5 WHERE a.id NOT IN (SELECT id FROM own)) WHERE r = 1),
  p AS MATERIALIZED (SELECT m.id, m.line, b.text AS old, m.new FROM (SELECT id, new, line FROM own UNION ALL SELECT id, new, line FROM near) m JOIN written b ON b.id = m.line WHERE b.text <> m.new), {_SCRIPT},
  few AS (SELECT old, new FROM ops WHERE tag <> 'equal' GROUP BY old, new HAVING count(*) <= 3),
  fix AS (SELECT p.id, substr(p.old, CAST(lo AS BIGINT) + 1, CAST(hi - lo AS BIGINT)) AS wrong, substr(p.old, CAST(lo AS BIGINT) + 1, CAST(i1 - lo AS BIGINT)) || substr(p.new, CAST(j1 AS BIGINT) + 1, CAST(j2 - j1 AS BIGINT)) || substr(p.old, CAST(i2 AS BIGINT) + 1, CAST(hi - i2 AS BIGINT)) AS "right"
    FROM p JOIN few ON p.old = few.old AND p.new = few.new JOIN (SELECT *, greatest(0, i1 - 1) AS lo, least(length(old), i2 + 1) AS hi FROM ops WHERE tag = 'replace' AND i2 - i1 <= 4 AND j2 - j1 <= 6) o ON o.old = p.old AND o.new = p.new),
  learned AS MATERIALIZED (SELECT wrong, "right", count(*) AS n FROM fix WHERE length(wrong) >= 2 GROUP BY ALL)"""


def _learned(spark, sf_dir):
    lines = relation(spark, sf_dir, "written")
    return edits.counted(edits.short_fixes(edits.edited_lines(lines, written_edits(spark, sf_dir))))


@query(f"""{_LEARNED} SELECT wrong, "right", n FROM learned""")
def learned_fixes(spark, sf_dir):
    """The fixes that all edits teach, with their counts."""
    return _learned(spark, sf_dir)


@query(f"""{_LEARNED}, words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY length(wrong) DESC, wrong, "right") AS k FROM learned WHERE n >= 2 OR EXISTS (SELECT 1 FROM words WHERE length(word) >= 2 AND contains("right", word))),
  f AS (SELECT id, text, CAST(0 AS BIGINT) AS k FROM written UNION ALL SELECT f.id, CASE WHEN length(wrong) = length("right") OR f.id % 2 <> 0 THEN replace(text, wrong, "right") ELSE text END, k.k FROM f JOIN k ON k.k = f.k + 1)
SELECT id, text AS fixed FROM f WHERE k = (SELECT count(*) FROM k)""")
def learned_fixes_applied(spark, sf_dir):
    """All lines with the trusted ones of the fixes that all edits teach."""
    words = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(F.split("p_name", " ")).alias("word"))
    lines = relation(spark, sf_dir, "written").select("id", "text", (F.col("id") % 2 == 0).alias("has_chars"))
    return edits.with_fixes(lines, _learned(spark, sf_dir), words).select("id", "fixed")
