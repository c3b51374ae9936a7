"""The registered queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontam, divergence, exactdedup, htmltext, importance, langid, licenses, neardup, pieces, setjoin, suffix, toxicity, vacodes
from .common import table

#: Vocabulary file of op3; a name in the folder of public tokenizers.
PIECE_MODEL = "piece_bpe_32k.model"


def piece_model_path(name: str = PIECE_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), piece_model_path(), digests=True, kept=pieces.ALONE)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("item_ids", "near_ids")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents")).drop("detections")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(table(spark, sf_dir, "pages"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identified(docs, langid.fit(docs))


def op8_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_dedup(table(spark, sf_dir, "documents")).drop("locator", "keep_locator")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed(table(spark, sf_dir, "documents"))


def op11_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.joined(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vacodes.compressed(table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module's operators; beside the package, and removed with it

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_near_dedup": op2_near_dedup,
    "op3_pieces": op3_pieces,
    "op4_decontamination": op4_decontamination,
    "op5_licenses": op5_licenses,
    "op6_html": op6_html,
    "op7_langid": op7_langid,
    "op8_importance": op8_importance,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_set_join": op11_set_join,
    "op12_vector_codes": op12_vector_codes,
    "op13_divergence": op13_divergence,
    "pipeline": pipeline,
}

_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: One round of op12: parts go to their nearest entry, and used entries become the floor of the mean.
_ROUND = """
a{n} AS MATERIALIZED (SELECT x.vec_id, x.p, x.x, min(64 * list_sum(list_transform(list_zip(x.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + b.e) % 64 AS e FROM x JOIN b{b} b ON b.p = x.p GROUP BY 1, 2, 3),
m{n} AS MATERIALIZED (SELECT p, e, list(m ORDER BY j) AS c FROM (SELECT p, e, j, CAST(floor(sum(y) / count(*)) AS BIGINT) AS m FROM (SELECT p, e, unnest(x) AS y, unnest(range(len(x))) AS j FROM a{n}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{n} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{b} b LEFT JOIN m{n} m ON m.p = b.p AND m.e = b.e),"""

ORACLE: dict[str, str] = {
    "op4_decontamination": f"""
WITH dw AS MATERIALIZED (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
iw AS MATERIALIZED (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS phrase, least(len(w), 13) AS n
  FROM iw, LATERAL (SELECT unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
cand AS MATERIALIZED (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM dw, lens, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n),
occ AS MATERIALIZED (SELECT c.doc_id, c.i, c.n, x.item_id FROM cand c JOIN win x ON c.phrase = x.phrase AND c.n = x.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM occ), LATERAL (SELECT unnest(range(i, i + n)) AS p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY doc_id),
pos AS MATERIALIZED (SELECT doc_id, w, i, w[i] AS term FROM dw, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
freq AS MATERIALIZED (SELECT term, count(*) AS n FROM pos GROUP BY term),
wt AS MATERIALIZED (SELECT phrase, min(n) AS n, list_distinct(string_split(phrase, ' ')) AS terms FROM win GROUP BY phrase),
rare AS MATERIALIZED (SELECT phrase, terms, arg_min(t, f.n) AS term FROM (SELECT phrase, terms, unnest(terms) AS t FROM wt) x LEFT JOIN freq f ON f.term = x.t GROUP BY phrase, terms HAVING count(f.n) = count(*)),
around AS (SELECT p.doc_id, r.phrase, r.terms, p.w, p.i FROM pos p JOIN rare r ON p.term = r.term WHERE list_has_all(p.w[greatest(p.i - 25, 1) : p.i + 25], r.terms)),
close AS (SELECT DISTINCT doc_id, phrase FROM around WHERE len(list_filter(range(greatest(i - 25, 1), i + 1), lambda s: list_has_all(w[s : s + 25], terms))) > 0),
nears AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT c.doc_id, CAST(x.item_id AS VARCHAR) AS id FROM close c JOIN win x ON c.phrase = x.phrase) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(s.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated, CAST(coalesce(r.n, 0) AS BIGINT) AS n_near_items, sha256(coalesce(r.ids, '')) AS near_sha256
FROM dw d LEFT JOIN hit h USING (doc_id) LEFT JOIN its s USING (doc_id) LEFT JOIN nears r USING (doc_id)""",
    "op9_exact_dedup": r"""
WITH n AS (SELECT doc_id, text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(coalesce(text, '')) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(coalesce(text, '')) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kept,
  sha256(norm) AS text_sha256
FROM n""",
    "op11_set_join": r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i) WHERE len(w) > 0),
sz AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM met JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 100 * met.n >= 90 * (x.n + y.n - met.n)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS to_id FROM sz UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON r.to_id = e.a)
SELECT w.doc_id, CAST(coalesce(sz.n, 0) AS BIGINT) AS n_shingles, coalesce(c.id, w.doc_id) AS component_id
FROM w LEFT JOIN sz USING (doc_id) LEFT JOIN (SELECT doc_id, min(to_id) AS id FROM reach GROUP BY doc_id) c USING (doc_id)""",
    "op12_vector_codes": """
WITH q AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM q, LATERAL (SELECT unnest(range(16)) AS p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM x WHERE vec_id IN (SELECT vec_id FROM q ORDER BY vec_id LIMIT 64)),
""" + "".join(_ROUND.format(n=n, b=n - 1) for n in (1, 2)) + """
a3 AS MATERIALIZED (SELECT x.vec_id, x.label, x.p, min(64 * list_sum(list_transform(list_zip(x.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + b.e) AS k FROM x JOIN b2 b ON b.p = x.p GROUP BY 1, 2, 3),
coded AS MATERIALIZED (SELECT vec_id, label, string_agg(printf('%02x', CAST(k % 64 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(k // 64) AS BIGINT) AS error FROM a3 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM coded""",
    "op13_divergence": r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT row_id, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT row_id) >= 30),
voc AS MATERIALIZED (SELECT lang, CAST(count(*) AS BIGINT) AS v, CAST(sum(n) AS BIGINT) AS total FROM kept GROUP BY lang),
grp AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
cnt AS MATERIALIZED (SELECT lang, source, term, CAST(count(*) AS BIGINT) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
tot AS MATERIALIZED (SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM cnt GROUP BY 1, 2),
share AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(o.total, 0) + 5 * v.v) AS p, 1 + (1000000000 * (k.n + 5)) // (v.total + 5 * v.v) AS q
  FROM grp g JOIN kept k ON g.lang = k.lang JOIN voc v ON v.lang = g.lang LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN tot o ON o.lang = g.lang AND o.source = g.source),
apart AS MATERIALIZED (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, term AS item, p - q AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS INTEGER) AS rank FROM share WHERE n > 0 AND p > q) WHERE rank <= 50""",
}
