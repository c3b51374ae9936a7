"""Queries of drawn arrows against recognised glyphs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrows
from .queries import INTER, query
from .relations import relation, with_

_ROWS = "greatest(0, least(a.y + a.h, g.y + g.h) - greatest(a.y, g.y)) / greatest(1, least(a.h, g.h))"
_WIDE = "greatest(0, least(ax + aw, spans[i].x1) - greatest(ax, spans[i].x0))"
_GLYPHS = rf"""{with_('arrow_lines', 'arrow_regions')}, c AS (SELECT *, string_split(text, '') AS letters, length(text) AS n FROM arrow_lines),
  t AS (SELECT *, list_transform(letters, lambda ch: CAST(CASE WHEN ord(ch) > 255 THEN 1.0 WHEN ch = ' ' THEN 0.28 WHEN regexp_matches(ch, '^[\p{{L}}\p{{N}}]$') THEN 0.55 ELSE 0.48 END AS DOUBLE)) AS ws FROM c),
  u AS (SELECT *, list_reduce(list_prepend(CAST(0 AS DOUBLE), ws), lambda p, q: p + q) AS total FROM t),
  v AS (SELECT *, list_transform(range(0, n + 1), lambda i: CAST(round_even(list_reduce(list_prepend(CAST(x AS DOUBLE), list_transform(ws[1 : i], lambda q: w * q / total)), lambda p, q: p + q), 0) AS BIGINT)) AS cuts FROM u),
  g AS MATERIALIZED (SELECT page, id, x, y, w, h, text, letters, n, has_chars, CASE WHEN has_chars THEN list_transform(range(0, n), lambda i: {{'x0': x + i * w // n, 'x1': x + (i + 1) * w // n}}) ELSE list_transform(range(1, n + 1), lambda i: {{'x0': cuts[i], 'x1': cuts[i + 1]}}) END AS spans FROM v),
  m AS (SELECT a.page, a.id AS region, a.x AS ax, a.w AS aw, a.h AS ah, g.id, g.letters, g.n, g.spans FROM arrow_regions a JOIN g ON a.page = g.page AND {INTER.replace('b.', 'g.')} > 0 AND {_ROWS} >= CAST(0.3 AS DOUBLE)),
  k AS (SELECT *, list_reverse_sort(list_filter(list_transform(range(1, n + 1), lambda i: {{'s': {_WIDE} / greatest(1, least(aw, spans[i].x1 - spans[i].x0)), 'i': i}}), lambda z: z.s >= CAST(0.35 AS DOUBLE)))[1] AS hit,
    len(list_filter(range(2, n), lambda i: contains('{arrows.ARROWS}', letters[i]) AND {_WIDE} >= CAST(0.35 AS DOUBLE) * least(aw, spans[i].x1 - spans[i].x0))) > 0 AS inside FROM m),
  e AS (SELECT *, CASE WHEN hit.i IN (1, n) AND (contains('{arrows.ARROWS}', letters[hit.i]) OR contains('{arrows.DASHES}', letters[hit.i]) AND hit.s >= CAST(0.72 AS DOUBLE) OR letters[hit.i] = '个' AND ah >= CAST(1.4 AS DOUBLE) * aw AND hit.s >= CAST(0.85 AS DOUBLE)) THEN hit.i END AS edge FROM k),
  met AS MATERIALIZED (SELECT page, region, id, edge, inside OR (hit IS NOT NULL AND edge IS NULL) AS blocked FROM e),
  taken AS MATERIALIZED (SELECT * FROM met WHERE edge IS NOT NULL AND region NOT IN (SELECT region FROM met WHERE blocked)),
  cut AS MATERIALIZED (SELECT g.*, CASE WHEN x.gone IS NULL THEN 0 WHEN list_contains(gone, 1) AND list_contains(gone, n) AND n <= 2 THEN n WHEN list_contains(gone, 1) THEN 1 ELSE 0 END AS a, CASE WHEN x.gone IS NOT NULL AND list_contains(gone, n) THEN n - 1 ELSE n END AS z, x.gone IS NOT NULL AS changed FROM g LEFT JOIN (SELECT id, list(DISTINCT edge) AS gone FROM taken GROUP BY id) x ON x.id = g.id)"""


def arrow_page(spark, sf_dir):
    """Lines, some with a place for each character, and drawn regions."""
    lines = relation(spark, sf_dir, "arrow_lines")
    places = F.expr("transform(sequence(0, length(text) - 1), i -> named_struct('x0', x + i * w div length(text), 'x1', x + (i + 1) * w div length(text)))")
    return lines.withColumn("chars", F.when(F.col("has_chars"), places)), relation(spark, sf_dir, "arrow_regions")


@query(f"""{_GLYPHS} SELECT page, id, CASE WHEN changed THEN array_to_string(letters[a + 1 : z], '') ELSE text END AS text, CASE WHEN a > 0 THEN spans[a].x1 ELSE x END AS x,
  CASE WHEN changed THEN greatest(1, CASE WHEN z < n THEN spans[z + 1].x0 ELSE x + w END - CASE WHEN a > 0 THEN spans[a].x1 ELSE x END) ELSE w END AS w, CASE WHEN has_chars THEN array_to_string(list_transform(spans[a + 1 : z], lambda s: s.x0 || '-' || s.x1), ' ') END AS spans FROM cut WHERE a < z""")
def arrow_trims(spark, sf_dir):
    out = arrows.lines_without_arrows(*arrow_page(spark, sf_dir))
    return out.select("page", "id", "text", "x", "w", F.array_join(F.transform("chars", lambda s: F.concat(s["x0"], F.lit("-"), s["x1"])), " ").alias("spans"))


@query(f"""{_GLYPHS} SELECT t.page, t.region, t.id, array_to_string(list_concat(letters[1 : a], letters[z + 1 : n]), '') AS removed, array_to_string(letters[a + 1 : z], '') AS kept FROM taken t JOIN cut ON cut.id = t.id WHERE a < z""")
def arrow_changes(spark, sf_dir):
    return arrows.arrow_text_changes(*arrow_page(spark, sf_dir))
