"""Quality selection by importance resampling.

Two generative models of hashed n-grams (single tokens and pairs of neighbours; a token is a run of word characters or of
marks) are estimated: one of target text, the rows labelled good, and one of raw text, all rows. A document's log
importance is the sum over its n-grams of log target / raw probability. Gumbel noise, drawn from a hash of the identifier, is
added, and the k rows of largest sum are a sample without replacement in proportion to importance.

The raw model counts all rows, the target model all rows labelled good. The k-th largest key is found by counting keys in ever finer bins, so no task sorts all rows.

Defined results: null and wordless texts have log importance 0; without good rows the models are equal and all log
importances 0; exactly k rows are selected if there are so many: equal keys are taken by smaller doc_id, rows without one
last and with noise drawn from their text, then in stored order; repeated rows are sampled each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .words import IS_WORD, Prefix, mix, slices, text_bytes

BUCKETS = 10_000
SEED = 1729
#: Good rows whose identifiers are broadcast at most to pick out their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bins of one count, and keys that are few enough to be sorted by the driver.
BINS, FEW = 1024, 4096
KIND = np.where(IS_WORD, 1, 2).astype(np.int8)
KIND[65:91] = 1
KIND[[9, 10, 11, 12, 13, 32]] = 0


def buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram."""
    data, offsets = text_bytes(column)
    kind = KIND[data]
    new, last = np.ones(len(kind), bool), np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < len(kind)]] = True
    last[:-1] = new[1:]
    starts, ends = np.flatnonzero(new & (kind > 0)), np.flatnonzero(last & (kind > 0)) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    one = Prefix(data).hash(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    same = row[1:] == row[:-1]
    two = mix(one[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + one[1:])[same] if len(one) else one
    return np.concatenate([row, row[:-1][same]]), (np.concatenate([one, two]) % np.uint64(BUCKETS)).astype(np.int64)


def _counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the texts; BUCKETS numbers reach the driver."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch):
                total += np.bincount(buckets(part.column("text"))[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS)
    for r in docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log target / raw probability of each bucket, add-one smoothed."""
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


#: Order of rows with one key: by identifier, rows without one last, then by place in the stored table.
TIES = ("unnamed", "doc_id", "row")


def kth_largest(keys: DataFrame, k: int):
    """(key, unnamed, doc_id, row) of the k-th row by key, largest first, then by TIES; None if k is no row's rank."""
    n = keys.count()
    if not 0 < k <= n:
        return None
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0  # rows with larger keys than high
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        width = (high - low) / BINS
        if not width or not low < low + width < high:
            break
        bin_ = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1))
        counts = sorted(inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect(), key=lambda r: -r.bin)
        for r in counts:
            if above + r.n >= k:
                break
            above += r.n
        low, high = r.low, r.high
        if r.n <= FEW:
            break
    inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
    # A few rows, or rows of one key; in either case those up to the wanted one are taken in order.
    return inside.select("key", *TIES).orderBy(F.desc("key"), *TIES).offset(k - above - 1).limit(1).first()


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, log_importance, n_grams, key, score and selected.

    k defaults to the share of good rows among the labelled ones, of all rows. The score maps the mean log ratio of an
    n-gram to 0..1.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    known = labels.where(F.col("quality").isNotNull())
    good = known.where("quality = 1").select("doc_id").distinct()
    few = good.count() <= BROADCAST_IDS
    target = _counts(docs.join(F.broadcast(good) if few else good, "doc_id", "left_semi"))
    ratio = spark.sparkContext.broadcast(log_ratio(target, _counts(docs)))

    def weigh(batches):
        for batch in batches:
            for part in slices(batch):
                row, bucket = buckets(part.column("text"))
                sums = np.bincount(row, weights=ratio.value[bucket], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("salt"), pa.array(sums), pa.array(np.bincount(row, minlength=part.num_rows).astype(np.int64))], ["doc_id", "salt", "log_importance", "n_grams"])

    salted = docs.select("doc_id", F.xxhash64("text").alias("salt"), "text")
    weighed = salted.mapInArrow(weigh, f"doc_id {id_type}, salt long, log_importance double, n_grams long")
    drawn = F.when(F.col("doc_id").isNull(), F.xxhash64("salt", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    uniform = (F.shiftrightunsigned(drawn, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    weighed = weighed.withColumns({"key": F.col("log_importance") - F.log(-F.log(uniform)), "unnamed": F.col("doc_id").isNull(), "row": F.monotonically_increasing_id()})
    keyed = stored(spark, weighed.drop("salt"), "importance")
    if k is None:
        share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
        k = round(keyed.count() * (1.0 if share is None else share))
    limit = kth_largest(keyed, k)
    if limit is None:
        selected = F.lit(k > 0)
    else:  # up to the k-th row, in order of key and TIES
        same = F.col("doc_id").eqNullSafe(F.lit(limit.doc_id)) & (F.col("row") <= limit.row)
        before = F.coalesce(F.col("doc_id") < F.lit(limit.doc_id), F.lit(False)) | same
        tied = (F.col("unnamed") < F.lit(limit.unnamed)) | ((F.col("unnamed") == F.lit(limit.unnamed)) & before)
        selected = (F.col("key") > limit.key) | ((F.col("key") == limit.key) & tied)
    score = 1 / (1 + F.exp(-4 * F.col("log_importance") / F.greatest("n_grams", F.lit(1))))
    return keyed.select("doc_id", "log_importance", "n_grams", "key", score.alias("score"), selected.alias("selected"))
