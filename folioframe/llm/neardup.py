"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its runs of five words: count in the text times a damped inverse document frequency.
Document frequencies are counted over all documents, in `BUCKETS` hashed cells. `SAMPLES` consistent weighted samples are
drawn from each set; two documents agree in one with the probability of their weighted Jaccard similarity. As many samples
again are drawn without weights, for the plain Jaccard similarity. Bands of `ROWS` samples of either kind are bucket keys.
Documents with the same words in the same order are folded into one before banding.

1. Every document of a bucket is held against the smallest identifier, its leader, and in buckets of up to `FEW` documents
   against all others. Only pairs whose sizes exclude a link, or whose signatures agree in fewer than `AGREE` samples of
   both kinds, are passed over; at the threshold that loses 1 pair in 80 million. The rest are judged by whole texts.
2. In larger buckets that still hold several classes, every document is held against all others by its whole set of
   shingles, but for pairs of one class, as a further link can't change the classes. Buckets of over `BLOCK` shingles or
   `BLOCK_DOCS` documents are dealt out as pairs of blocks.

A pair is a link if the exact weighted Jaccard similarity of its whole texts is at least the threshold, or their plain
Jaccard similarity over distinct shingles is, so that weighting doesn't lose copies by the plain measure. Classes are
connected components of the links.

Defined results: texts without words (null, empty) and rows without doc_id are each a class of their own; texts of fewer
than five words are one shingle; equal texts are of one class; repeated rows get equal rows; if a doc_id stands for several
texts, what is alike to any of them is of one class if this doc_id leads it; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import dropped, stored
from .components import components
from .words import BASE, Words, counted, mix, powers, shingles, slices

WORDS, THRESHOLD = 5, 0.8
BUCKETS = 1 << 18
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
#: A signature is that of the weighted set and that of the plain one.
KINDS = 2
#: How much of the inverse document frequency's logarithm goes into a weight.
DAMPING = 0.1
#: Identifiers that are broadcast at most to pick out candidates' texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Documents of a bucket that are all held against each other at once.
FEW = 6
#: Shingles and documents of one side of a block pair, about; larger buckets are dealt out as pairs of blocks.
BLOCK, BLOCK_DOCS = 1 << 19, 1024
#: Samples in which the signatures of a pair must agree for its texts to be compared.
AGREE = 14
#: Text scanned at a time; the samples of its shingles take many times as much.
SLICE = 1 << 19
#: Where a document of a bucket is dealt to.
DEALT = "array<struct<i:int,j:int,first:boolean,second:boolean>>"
U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
#: Draws of the sampling scheme, looked up by slices of a shingle's hash: gamma(2, 1), log gamma(2, 1) and uniform.
R = _rng.gamma(2.0, size=1 << 16).astype(np.float32)
LOG_C = np.log(_rng.gamma(2.0, size=1 << 16)).astype(np.float32)
BETA = _rng.random(1 << 16).astype(np.float32)
ODD = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * U64(2) + U64(1)


def weights(hashes: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return tf.astype(np.float32) * idf[(hashes % U64(BUCKETS)).astype(np.int64)]


def frequencies(docs: DataFrame) -> np.ndarray:
    """The damped inverse document frequency of each cell; BUCKETS numbers reach the driver, however many documents."""

    def count(batches):
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part in slices(batch, most=SLICE):
                rows += part.num_rows
                _, value, _ = counted(*shingles(Words(part.column("text")), WORDS))
                total += np.bincount((value % U64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], ["cell", "n"])

    got = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    n = int(got.n[got.cell == -1].sum())
    df = np.zeros(BUCKETS)
    real = got[got.cell >= 0]
    df[real.cell.to_numpy()] = real.n.to_numpy()
    return (1 + DAMPING * np.log((n + 1) / (np.minimum(df, n) + 1))).astype(np.float32)


def samples(first: np.ndarray, hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(rows x SAMPLES) the sample of each row's weighted set; first holds where each row's elements begin, all not empty."""
    out = np.empty((len(first), SAMPLES), np.int32)
    log_w = np.log(weight)
    for k in range(SAMPLES):
        x = hashes * ODD[k]
        x ^= x >> U64(32)
        x *= U64(0xD6E8FEB86659FD93)
        x ^= x >> U64(32)
        r = R[(x >> U64(48)).astype(np.int64)]
        beta = BETA[((x >> U64(32)) & U64(0xFFFF)).astype(np.int64)]
        t = np.floor(log_w / r + beta)
        log_a = LOG_C[((x >> U64(16)) & U64(0xFFFF)).astype(np.int64)] - r * (t - beta) - r
        bits = log_a.view(np.uint32)
        ordered = np.where(bits >> 31, ~bits, bits | np.uint32(0x80000000))
        low = (x ^ (t.astype(np.int64).view(np.uint64) * U64(0x9E3779B1))) & U64(0xFFFFFFFF)
        least = np.minimum.reduceat((ordered.astype(np.uint64) << U64(32)) | low, first)
        out[:, k] = (least & U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    return out


def plain_samples(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """(rows x SAMPLES) the sample of each row's set without weights; first as in samples()."""
    out = np.empty((len(first), SAMPLES), np.int32)
    for k in range(SAMPLES):
        x = hashes * ODD[k]
        x ^= x >> U64(32)
        x *= U64(0xD6E8FEB86659FD93)
        out[:, k] = (np.minimum.reduceat(x, first) & U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    return out


def signatures(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, d1, d2, signature, size, weight) of every row: two hashes of its words in order, null without words, its distinct shingles and their weights' sum."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=SLICE):
                words = Words(part.column("text"))
                some = np.flatnonzero(words.counts)
                sums, sig = np.zeros((2, part.num_rows), np.int64), np.zeros((0, KINDS * SAMPLES), np.int32)
                size, weight = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
                if len(some):
                    place = np.arange(len(words.hash)) - np.repeat(words.first[:-1], words.counts)
                    begin = words.first[:-1][some]
                    for j in (0, 1):
                        sums[j, some] = mix(np.add.reduceat(mix(words.hash + U64(j)) * powers(BASE + 2 * j, int(place.max()) + 1)[place], begin)).view(np.int64)
                    row, value, tf = counted(*shingles(words, WORDS))
                    each = weights(value, tf, idf.value)
                    starts = np.searchsorted(row, some)
                    sig = np.hstack([samples(starts, value, each), plain_samples(starts, value)])
                    size, weight = np.bincount(row, minlength=part.num_rows), np.bincount(row, weights=each, minlength=part.num_rows)
                bare = words.counts == 0
                bounds = np.concatenate([[0], np.cumsum(~bare)]) * (KINDS * SAMPLES)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), mask=np.append(bare, False)), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sums[0]), pa.array(sums[1]), lists, pa.array(size), pa.array(weight)], ["doc_id", "d1", "d2", "signature", "size", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, d1 long, d2 long, signature array<int>, size long, weight double")


def similarities(texts_a: pa.Array, texts_b: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted and plain Jaccard similarity of the shingles of each pair of texts."""
    n = len(texts_a)
    sides = [counted(*shingles(Words(t), WORDS)) for t in (texts_a, texts_b)]
    row, value = (np.concatenate([s[i] for s in sides]) for i in (0, 1))
    weight = np.concatenate([weights(s[1], s[2], idf).astype(float) for s in sides])
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    row, value, weight = row[order], value[order], weight[order]
    same = np.flatnonzero((row[1:] == row[:-1]) & (value[1:] == value[:-1]))
    least = np.bincount(row[same], weights=np.minimum(weight[same], weight[same + 1]), minlength=n)
    most = np.bincount(row, weights=weight, minlength=n) - least
    both = np.bincount(row[same], minlength=n)
    either = np.bincount(row, minlength=n) - both
    return least / np.maximum(most, 1e-12), both / np.maximum(either, 1)


def verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """(doc, leader) of the stored pairs that are links, judged by whole texts; only the texts of pairs are shuffled."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    few = pairs.count() <= BROADCAST_IDS

    def side(column: str, text: str) -> DataFrame:
        ids = pairs.select(F.col(column).alias("doc_id")).distinct()
        return texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select(F.col("doc_id").alias(column), F.col("text").alias(text))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text_a", SLICE):
                weighted, plain = similarities(part.column("text_a"), part.column("text_b"), idf.value)
                linked = pa.array(np.maximum(weighted, plain) >= threshold - 1e-9)
                yield pa.RecordBatch.from_arrays([part.column("doc").filter(linked), part.column("leader").filter(linked)], ["doc", "leader"])

    rows = pairs.join(side("doc", "text_a"), "doc").join(side("leader", "text_b"), "leader").select("doc", "leader", "text_a", "text_b")
    return rows.mapInArrow(run, f"doc {kind}, leader {kind}")


def alike(pairs: DataFrame, folded: DataFrame, threshold: float) -> DataFrame:
    """The pairs (doc, leader) whose sizes allow a link and whose signatures agree in enough samples."""
    kind = lambda i, doc: folded.select(F.col("doc").alias(doc), F.struct("signature", "size", "weight").alias(i))
    rows = pairs.join(kind("s", "doc"), "doc").join(kind("t", "leader"), "leader")
    part = lambda side, k: F.slice(f"{side}.signature", k * SAMPLES + 1, SAMPLES)
    same = [F.aggregate(F.zip_with(part("s", k), part("t", k), lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) for k in range(KINDS)]
    near = [F.least(f"s.{c}", f"t.{c}") >= (threshold - 1e-6) * F.greatest(f"s.{c}", f"t.{c}") for c in ("size", "weight")]
    return rows.where((near[0] | near[1]) & (F.greatest(*same) >= AGREE)).select("doc", "leader")


def groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The groups of rows that agree in the columns, each whole; rows of a group follow each other."""
    rest = []
    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in columns]
        same = functools.reduce(np.logical_and, [k[1:] == k[:-1] for k in keys])
        bounds = [0, *(np.flatnonzero(~same) + 1).tolist(), batch.num_rows]
        for start, end in zip(bounds, bounds[1:]):
            part = batch.slice(start, end - start)
            if rest and any(rest[0].column(c)[0] != part.column(c)[0] for c in columns):
                yield pa.concat_batches(rest)
                rest = []
            if part.num_rows:
                rest.append(part)
    if rest:
        yield pa.concat_batches(rest)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc, hashes, counts) of every row with words: its distinct shingles in order of hash, packed."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=SLICE):
                row, value, tf = counted(*shingles(Words(part.column("text")), WORDS))
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1)).tolist()
                pack = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pack(value), pack(tf.astype(np.int32))], ["doc", "hashes", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc {kind}, hashes binary, counts binary")


def joining(group: pa.RecordBatch, idf: np.ndarray, threshold: float) -> tuple[list[int], list[int]]:
    """Rows (high, low) of links between the classes of a bucket's rows, found by exact similarities; as many as join classes.

    Rows are in order of doc, have a root each, and take part as first or second of a pair. Of two rows that both are
    `other` only the higher is first, as such pairs come twice.
    """
    n = group.num_rows
    first, second, other = (group.column(c).to_numpy(zero_copy_only=False) for c in ("first", "second", "other"))
    label = np.asarray(group.column("root").dictionary_encode().indices).astype(np.int64)
    values = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
    size = np.array([len(v) for v in values])
    value, count = np.concatenate(values), np.frombuffer(b"".join(group.column("counts").to_pylist()), np.int32).astype(float)
    each = idf[(value % U64(BUCKETS)).astype(np.int64)].astype(float)
    begin = np.cumsum(size) - size
    weight = np.add.reduceat(count * each, begin)
    element = np.unique(value, return_inverse=True)[1]
    mine = np.zeros(int(element.max()) + 1)
    high, low = [], []
    for i in np.flatnonzero(first).tolist():
        near = np.minimum(size[i], size) >= (threshold - 1e-6) * np.maximum(size[i], size)
        near |= np.minimum(weight[i], weight) >= (threshold - 1e-6) * np.maximum(weight[i], weight)
        held = np.flatnonzero(second & (label != label[i]) & near & (~other | (np.arange(n) < i)))
        if not len(held):
            continue
        own = slice(begin[i], begin[i] + size[i])
        mine[element[own]] = count[own]
        many = size[held]
        starts = np.cumsum(many) - many
        at = np.repeat(begin[held] - starts, many) + np.arange(many.sum())
        met = mine[element[at]]
        both = np.add.reduceat((met > 0).astype(np.int64), starts)
        least = np.add.reduceat(np.minimum(met, count[at]) * each[at], starts)
        mine[element[own]] = 0
        linked = held[np.maximum(both / (size[i] + many - both), least / (weight[i] + weight[held] - least)) >= threshold - 1e-9]
        if len(linked):
            labels, at = np.unique(label[linked], return_index=True)
            for j in linked[at].tolist():
                high.append(max(i, j))
                low.append(min(i, j))
            label[np.isin(label, labels)] = label[i]
    return high, low


def links_across(held: DataFrame, roots: DataFrame, docs: DataFrame, idf, threshold: float) -> DataFrame:
    """(doc, leader), doc the larger, of links between classes that share a large bucket; see joining()."""
    kind = held.schema["doc"].dataType.simpleString()
    of_doc = roots.select(F.col("node").alias("doc"), "root")
    members = held.where(F.col("n") > FEW).select("doc", "band", "key", "size").join(of_doc, "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    # Documents of the bucket's most frequent class need no test against each other, the others one against all.
    of_root = members.groupBy("band", "key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    sized = of_root.groupBy("band", "key").agg(F.sum("n").alias("n"), F.sum("size").alias("all"), F.max(F.struct("n", "size", "root")).alias("most")).where("n > most.n")
    placed = members.join(sized, ["band", "key"]).withColumn("other", F.col("root") != F.col("most.root"))
    # Every block of the others meets every block of all, so no task holds more than two blocks of a bucket at once.
    blocks = lambda size, n: F.ceil(F.greatest(size / BLOCK, n / BLOCK_DOCS)).cast("int")
    many, few = blocks(F.col("all"), F.col("n")), blocks(F.col("all") - F.col("most.size"), F.col("n") - F.col("most.n"))
    part = lambda salt, n: F.pmod(F.xxhash64("doc", F.lit(salt)), n).cast("int")
    at = lambda i, j, first, second: F.struct(i.alias("i"), j.alias("j"), F.lit(first).alias("first"), F.lit(second).alias("second"))
    as_second = F.transform(F.sequence(F.lit(0), few - 1), lambda i: at(i, part(0, many), False, True))
    as_first = F.when(F.col("other"), F.transform(F.sequence(F.lit(0), many - 1), lambda j: at(part(1, few), j, True, False))).otherwise(F.array().cast(DEALT))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("other").alias("first"), F.lit(True).alias("second")))
    placed = placed.select("doc", "root", "band", "key", "other", F.explode(F.when(many == 1, whole).otherwise(F.concat(as_second, as_first))).alias("at")).select("doc", "root", "band", "key", "other", "at.*")
    placed = stored(docs.sparkSession, placed, "placed")
    sets = shingle_sets(docs.join(placed.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    group = ["band", "key", "i", "j"]
    rows = placed.join(sets, "doc").repartition(*group).sortWithinPartitions(*group, "doc")

    def run(batches):
        for each in groups(batches, group):
            taken = [each.column("doc").take(pa.array(x, pa.int64())) for x in joining(each, idf.value, threshold)]
            if len(taken[0]):
                yield pa.RecordBatch.from_arrays(taken, ["doc", "leader"])

    return rows.mapInArrow(run, f"doc {kind}, leader {kind}")


def classed(docs: DataFrame, folded: DataFrame, idf, threshold: float) -> DataFrame:
    """(node, root) of the folded documents (doc, signature, size, weight) that have links to other texts."""
    spark = docs.sparkSession
    at = lambda i: F.get("signature", F.lit(i))
    keys = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), *[at(b * ROWS + i) for i in range(ROWS)]).alias("key")) for b in range(KINDS * BANDS)])
    members = folded.select("doc", "size", F.explode(keys).alias("k")).select("doc", "size", "k.*")
    sized = members.groupBy("band", "key").agg(F.min("doc").alias("leader"), F.count("*").alias("n")).where("n > 1")
    held = stored(spark, members.join(sized, ["band", "key"]), "held")
    star = held.where("doc <> leader").select("doc", "leader")
    small = held.where((F.col("n") > 2) & (F.col("n") <= FEW)).groupBy("band", "key").agg(F.sort_array(F.collect_list("doc")).alias("docs"))  # of FEW documents
    small = small.select("docs", F.posexplode("docs").alias("i", "leader")).select("leader", F.explode(F.expr("slice(docs, i + 2, size(docs))")).alias("doc"))
    pairs = star.unionByName(small).distinct()
    pairs = stored(spark, alike(pairs, folded, threshold), "pairs")
    found = stored(spark, verified(pairs, docs, idf, threshold), "linked").select(F.col("doc").alias("a"), F.col("leader").alias("b"))
    roots = components(found)
    more = stored(spark, links_across(held, roots, docs, idf, threshold), "linked").select(F.col("doc").alias("a"), F.col("leader").alias("b"))
    if more.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the class's smallest doc_id), class_size and kept (is that one)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    idf = spark.sparkContext.broadcast(frequencies(docs))
    known = stored(spark, signatures(docs, idf), "signatures")
    some = known.where("signature is not null and doc_id is not null")
    folded = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc"), F.min_by("signature", "doc_id").alias("signature"), F.max("size").alias("size"), F.max("weight").alias("weight"))
    folded = stored(spark, folded, "folded")
    roots = classed(docs.where("doc_id is not null"), folded.drop("d1", "d2"), idf, threshold)
    of_text = folded.join(roots, folded.doc == roots.node, "left").select("d1", "d2", F.coalesce("root", "doc").alias("root"))
    # Rows without words or identifier get keys that no text has, spread over all partitions.
    lone = F.col("signature").isNull() | F.col("doc_id").isNull()
    key = lambda c, salt: F.when(F.col("lone"), F.xxhash64("doc_id", "row", F.lit(salt))).otherwise(F.col(c)).alias(c)
    member = known.select("doc_id", "d1", "d2", lone.alias("lone"), F.monotonically_increasing_id().alias("row"))
    member = member.select("doc_id", "lone", key("d1", 1), key("d2", 2)).join(of_text, ["d1", "d2"], "left")
    member = stored(spark, member.select("doc_id", F.when(~F.col("lone"), F.col("root")).alias("class_of")), "member")
    sizes = member.where("class_of is not null").groupBy(F.col("class_of").alias("of")).agg(F.count("*").alias("class_size"))
    out = member.join(sizes, F.col("class_of") == F.col("of"), "left")
    return out.select("doc_id", F.coalesce("class_of", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), F.coalesce(F.col("class_of") == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, with all its columns; rows without doc_id stay, as each is a class of its own."""
    gone = classes(docs, threshold).groupBy("doc_id").agg(F.max("kept").alias("stays")).where("not stays")
    return dropped(docs, gone, "doc_id")
