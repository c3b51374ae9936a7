"""Toxicity scores by a counterfactually regularised linear classifier.

Features of a text are its distinct words and their prefixes, hashed. The classifier is a logistic regression over the
features that best tell the labels apart and over all identity terms seen. For every labelled text with identity terms, a
counterfactual swaps each term for another of its kind (women for men, one faith for another); the loss adds the squared
change of the score between a text and its counterfactual, so weights can't rest on which group a text names.

Only the fit uses labels, on a sample of at most `max_rows` labelled rows that are not held out, chosen by a hash of the
identifier. Scores read the text alone, whole.

Defined results: null and empty texts get the score of a text without features; without labelled rows of both kinds,
each text gets the share of toxic rows, kept from 0 and 1 by a billionth; repeated rows are scored each and teach once, by
the first of their texts in order; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held_out, stored, where_rows
from .words import Prefix, Words, mix, slices

#: Labelled rows that a fit reads at most, and features that it keeps at most.
MAX_ROWS, MAX_FEATURES = 6000, 8192
#: Weight of the squared change under swapped identity terms, and of the squared weights.
COUNTERFACTUAL, L2 = 4.0, 2e-4
#: Standard errors by which a feature's share must differ between the labels.
TELLING = 4.0
#: Bytes of the prefixes that are features beside the whole word.
PREFIXES = (4, 5, 6)
#: Terms of one kind are swapped for one another, in this order.
IDENTITY = (
    "women men girls boys trans",
    "woman man girl boy",
    "female male",
    "gay lesbian straight bisexual queer",
    "muslim christian jewish hindu buddhist atheist",
    "muslims christians jews hindus buddhists atheists",
    "black white asian latino native",
    "african european american arab indian",
    "immigrants refugees citizens natives",
    "old young elderly",
    "disabled deaf blind",
    "frauen männer", "femmes hommes", "mujeres hombres",
    "muslime christen juden", "musulmans chrétiens juifs", "musulmanes cristianos judíos",
)


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each word and each of its longer prefixes; not yet distinct."""
    rows, out, row = [words.row], [words.hash], words.row
    size = words.ends - words.starts
    for k in PREFIXES:
        longer = size > k
        start = words.starts[longer]
        out.append(mix(words.prefix.hash(start, start + k) + np.uint64(k)))
        rows.append(row[longer])
    return np.concatenate(rows), np.concatenate(out)


def _term_features(term: str) -> np.ndarray:
    return np.unique(word_features(Words(pa.array([term])))[1])


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def logits(self, words: Words) -> np.ndarray:
        n = len(words.counts)
        out = np.full(n, self.bias)
        if len(self.features) and len(words.hash):
            row, feature = word_features(words)
            at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
            known = self.features[at] == feature
            pair = np.unique(row[known] * len(self.features) + at[known])
            out += np.bincount(pair // len(self.features), weights=self.weights[pair % len(self.features)], minlength=n)
        return out


def _sparse(features: np.ndarray, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    value = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    at = np.minimum(np.searchsorted(features, value), len(features) - 1)
    known = features[at] == value
    return row[known], at[known]


def swapped(features: np.ndarray, terms: list[list[np.ndarray]]) -> np.ndarray | None:
    """The features with every identity term exchanged for the next of its kind; None if there is none."""
    have, out, found = set(features.tolist()), set(features.tolist()), False
    for kind in terms:
        for i, term in enumerate(kind):
            if term[0] in have and have.issuperset(term.tolist()):
                out.difference_update(term.tolist())
                out.update(kind[(i + 1) % len(kind)].tolist())
                found = True
    return np.array(sorted(out), np.uint64) if found else None


TERMS = [[_term_features(t) for t in kind.split()] for kind in IDENTITY]


def fit_rows(texts: list[np.ndarray], labels: np.ndarray, features: np.ndarray, steps: int = 400, rate: float = 0.1) -> Model:
    """Fit on each text's sorted distinct features; `features` are those that get a weight, sorted."""
    n1, n0, terms = int(labels.sum()), int((1 - labels).sum()), TERMS
    if not n1 or not n0:
        share = n1 / max(1, n1 + n0)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    row, at = _sparse(features, texts)
    pairs = [(t, s) for t in texts if (s := swapped(t, terms)) is not None]
    old_row, old_at = _sparse(features, [p[0] for p in pairs])
    new_row, new_at = _sparse(features, [p[1] for p in pairs])
    w, b, n, m = np.zeros(len(features)), np.log(n1 / n0), len(texts), max(1, len(pairs))
    mean, var = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(b + np.bincount(row, weights=w[at], minlength=n))))
        off = p - labels
        grad = np.bincount(at, weights=off[row], minlength=len(w)) / n + L2 * w
        if pairs:
            change = np.bincount(old_row, weights=w[old_at], minlength=m) - np.bincount(new_row, weights=w[new_at], minlength=m)
            grad += COUNTERFACTUAL * 2 / m * (np.bincount(old_at, weights=change[old_row], minlength=len(w)) - np.bincount(new_at, weights=change[new_row], minlength=len(w)))
        full = np.append(grad, off.mean())
        mean = 0.9 * mean + 0.1 * full
        var = 0.99 * var + 0.01 * full**2
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8) * (1 - step / (steps + 1))
        w, b = w - move[:-1], b - move[-1]
    return Model(features, w, float(b))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most max_rows labelled documents that are not held out; a repeated doc_id is one row."""
    chosen = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows rows of two numbers
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Learn from the training rows."""
    texts = training_rows(docs, labels, max_rows)

    def features(batches):
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                row, feature = word_features(words)
                order = np.lexsort((feature, row))
                row, feature = row[order], feature[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
                row, feature = row[new], feature[new]
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(feature.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic").cast(pa.int32()), lists], ["doc_id", "toxic", "features"])

    rows = texts.select(F.xxhash64("doc_id").alias("doc_id"), "text", "toxic").mapInArrow(features, "doc_id long, toxic int, features array<long>")
    rows = stored(docs.sparkSession, rows.withColumn("toxic", F.greatest(F.lit(0), F.least(F.lit(1), "toxic"))), "toxicity")
    n, n1 = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    chosen = np.unique(np.concatenate([t for kind in TERMS for t in kind]))
    if 0 < n1 < n:
        share = F.col("df") / F.lit(float(n))
        z = F.abs(F.col("df1") / F.lit(float(n1)) - (F.col("df") - F.col("df1")) / F.lit(float(n - n1))) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * F.lit(1 / n1 + 1 / (n - n1)))
        counts = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("df"), F.sum("toxic").alias("df1")).where("df >= 3")
        telling = counts.withColumn("z", z).where(F.col("z") >= TELLING).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).select("feature").collect()
        chosen = np.unique(np.concatenate([chosen, np.array([r.feature for r in telling], np.int64).view(np.uint64)]))

    def filtered(batches):
        for batch in batches:
            own = [np.asarray(f, np.int64).view(np.uint64) for f in batch.column("features").to_numpy(zero_copy_only=False)]
            own = [np.sort(f[np.isin(f, chosen)]).view(np.int64) for f in own]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(own, pa.list_(pa.int64()))], ["doc_id", "toxic", "features"])

    got = rows.mapInArrow(filtered, "doc_id long, toxic int, features array<long>").toPandas().sort_values("doc_id", kind="stable")
    return fit_rows([np.asarray(f, np.int64).view(np.uint64) for f in got.features], got.toxic.to_numpy(float), chosen)


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    id_type = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES and the identity terms' features

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                score = 1 / (1 + np.exp(-shared.value.logits(Words(part.column("text")))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    out = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, f"doc_id {id_type}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic, with all their columns; each row is judged by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # at most MAX_FEATURES and the identity terms' features
    return where_rows(docs, "text", lambda texts: pa.array(1 / (1 + np.exp(-shared.value.logits(Words(texts)))) < 0.5))
