"""Jaccard join of documents' word n-grams by partition of the universe, exact, as connected components.

A document is the set of its runs of three words. If two sets of s and l elements link, they differ in at most
(s + l) * (1 - t) / (1 + t) elements, t the threshold: (s + l) / 19 at 0.9. Sizes fall in bands, and each band deals the
universe of shingles into H + 1 + E segments, H the most that two linked sets of the band can differ by. By the pigeonhole
principle linked sets agree in the subsets of 1 + E segments at least, so subsets are index keys. Empty subsets are none: all
unlike sets that leave a segment empty would meet there, and their families would grow with the input. If a set has at most E of
them, it agrees with any partner in another subset, too; the few sets that have more keep theirs. A set is indexed in its own
band, and in the next one if a larger partner can be there; a bucket counts only if it holds a set of the key's own band.

Segments have levels, one each at first. Level 2 also indexes the one-deletion neighbourhood of the subset: sets that meet
there by none of these keys differ by 2 in the segment; level 0 leaves the segment out. Links are found as long as the
levels of a band add up to H + 1 + E. The cost of a segment is what its buckets really hold: where a segment's buckets cost more
than the neighbourhoods of another one would, the first goes to level 0 and the other to level 2, where empty subsets are keys.

1. Equal sets are folded into one, that of the smallest doc_id.
2. Each set of a bucket is held against the bucket's smallest doc_id of its own band, by the whole sets.
3. Sets that share buckets which still hold several components are dealt out as pairs of blocks, each pair of sets in one
   block pair only, however many buckets they share. In a block, pairs of one component are passed over, as are pairs of
   whose parity sketches more bits differ than the sets may (each element flips one bit, so these are no links). The rest are
   held against each other by whole sets. No rows are made for pairs; links that join components are handed on. Work is
   quadratic in such a family of texts that share subsets without being linked, as every pair has to be looked at.

Results are exact but for equal 64-bit hashes of shingles. Defined results: texts without words (null, empty) have no
shingles and link with nothing; texts of fewer than three words are one shingle; rows without doc_id link with nothing and
have no component_id; repeated rows get equal rows; if a doc_id stands for several texts, what links to any of them is of one
component if this doc_id leads it; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import marked, stored
from .components import components
from .neardup import groups
from .words import NO_BLANK, Words, counted, mix, shingles, slices

WORDS = 3
#: Sets link if OF * intersection >= PART * union.
PART, OF = 90, 100
#: Text scanned at a time.
SLICE = 1 << 19
#: How many times as many pairs a segment's buckets hold, about, once one deletion is allowed.
MORE_PAIRS = 3
#: Identifiers that are broadcast at most to pick out texts; more are joined by a shuffle, after a bitmap has left out most others.
BROADCAST_IDS = 50_000
#: A band has one segment to spare, and one more for each so many elements in which its sets may differ.
SPARE = 64
#: Shingles and documents of one side of a block pair, about.
BLOCK, BLOCK_DOCS = 1 << 20, 4096
#: Bits of a sketch for each element in which linked sets of a block may differ.
SKETCH_BITS = 8
DEALT = "array<struct<i:int,j:int,first:boolean,second:boolean>>"
U64 = np.uint64


class Bands(NamedTuple):
    """low: each band's smallest size; segments: how many it has; first: the number of its first segment among all bands'; spare: E."""

    low: np.ndarray
    segments: np.ndarray
    first: np.ndarray
    spare: np.ndarray


@functools.cache
def _bands(largest: int) -> Bands:
    low, segments, spare = [1], [1], [0]
    high = (OF + PART) // (2 * (OF - PART))  # up to here sets link only if they are equal
    while low[-1] <= largest:
        low.append(high + 1)
        high = max(low[-1], low[-1] * 5 // 4)
        differ = 2 * high * (OF - PART) // (OF + PART)
        spare.append(1 + differ // SPARE)
        segments.append(differ + 1 + spare[-1])
    return Bands(np.array(low), np.array(segments), np.cumsum(segments) - segments, np.array(spare))


def bands(largest: int) -> Bands:
    """The bands of sizes up to largest and of their partners; a pair's smaller size is in the larger one's band or the one before."""
    return _bands(1 << int(largest).bit_length())


def scanned(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, in order."""
    row, value, _ = counted(*shingles(Words(text, NO_BLANK), WORDS))
    return row, value


def subsets(value: np.ndarray, begin: np.ndarray, size: np.ndarray, band: np.ndarray, of: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sets that lie at begin in value: where each one's segments start, the segments' sums, and each element's set and segment."""
    many = of.segments[band]
    starts = np.cumsum(many) - many
    element = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    which = np.repeat(np.arange(len(size)), size)
    hashes = value[element]
    segment = (mix(hashes ^ mix(band.astype(np.uint64) + U64(1))[which]) % many[which].astype(np.uint64)).astype(np.int64)
    sums = np.zeros(int(many.sum()), np.uint64)
    np.add.at(sums, starts[which] + segment, mix(hashes))
    return starts, sums, which, segment


def keyed(sums: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The key of a subset's sum in the segment with this number among all bands'."""
    return mix(sums ^ mix(number.astype(np.uint64) + U64(0x51ED27))).view(np.int64)


def left_out(sums: np.ndarray, starts: np.ndarray, band: np.ndarray, of: Bands) -> np.ndarray:
    """True for the empty subsets of sets that have no more of them than their bands have segments to spare."""
    empty = sums == 0
    many = of.segments[band]
    which = np.repeat(np.arange(len(starts)), many)
    return empty & (np.bincount(which, empty, len(starts)) <= of.spare[band])[which]


def _packed(bounds: np.ndarray, values: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, mask=null))


def indexed(docs: DataFrame) -> DataFrame:
    """(doc_id, d1, d2, size, band, own, next) of every row: two hashes of its set, its size, its band, and its keys there and in the next band.

    Of a subset that is left out the key is null.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=SLICE):
                n = part.num_rows
                row, value = scanned(part.column("text"))
                size = np.bincount(row, minlength=n)
                begin = np.cumsum(size) - size
                digest = np.zeros((2, n), np.uint64)
                for j in (0, 1):
                    np.add.at(digest[j], row, mix(value + U64(j)))
                of = bands(size.max(initial=1))
                band = np.maximum(np.searchsorted(of.low, size, "right") - 1, 0)
                # The smallest partner of the next band's smallest size.
                reach = (band + 1 < len(of.low)) & (size > 0) & (OF * size >= PART * of.low[np.minimum(band + 1, len(of.low) - 1)])
                lists = []
                for here, at in ((np.flatnonzero(size), band), (np.flatnonzero(reach), band + 1)):
                    starts, sums, _, _ = subsets(value, begin[here], size[here], at[here], of)
                    many = np.zeros(n, np.int64)
                    many[here] = of.segments[at[here]]
                    which = np.repeat(np.arange(n), many)
                    segment = np.arange(len(which)) - (np.cumsum(many) - many)[which]
                    lists.append(_packed(np.concatenate([[0], np.cumsum(many)]), keyed(sums, of.first[at[which]] + segment), left_out(sums, starts, at[here], of)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(d.view(np.int64)) for d in digest), pa.array(size), pa.array(band.astype(np.int32)), *lists], ["doc_id", "d1", "d2", "size", "band", "own", "next"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, d1 long, d2 long, size long, band int, own array<long>, next array<long>")


def members(folded: DataFrame, of: Bands) -> DataFrame:
    """(doc, key, at) of every key; at is twice the segment's number among all bands', and 1 if the band is the set's own."""
    first = F.expr(f"array({', '.join(map(str, of.first.tolist()))})")
    place = lambda keys, band, own: F.struct(F.col(keys).alias("keys"), (2 * F.get(first, F.col("band") + band) + own).alias("from"))
    each = folded.select("doc", F.explode(F.array(place("own", 0, 1), place("next", 1, 0))).alias("x"))
    keys = each.select("doc", "x.from", F.posexplode("x.keys").alias("segment", "key")).where("key is not null")
    return keys.select("doc", "key", (F.col("from") + 2 * F.col("segment")).cast("int").alias("at"))


def buckets(rows: DataFrame) -> DataFrame:
    """The rows (doc, key, at) of keys that several sets have, one of them in its own band, with n and the leader, the smallest such.

    Nearly all keys are of one set only, so their narrow rows are shuffled once, and counted where they arrive;
    by repartition(), as the window's own shuffle would take the column for its minimum along.
    """
    same = Window.partitionBy("key")
    sized = rows.repartition("key").select("key", "doc", "at", F.count("*").over(same).alias("n"), F.min(F.when(F.col("at") % 2 == 1, F.col("doc"))).over(same).alias("leader"))
    return sized.where("n > 1 and leader is not null")


def allocation(cost: dict[int, float], docs: dict[int, int], of: Bands, more_pairs: float = MORE_PAIRS) -> tuple[list[int], list[int]]:
    """The segments that go to level 0 and as many that go to level 2, by the pairs that buckets of each segment hold.

    A segment at level 2 costs a row for each set and element of the subset, and more pairs than before.
    """
    gone, raised = [], []
    for b in sorted({int(np.searchsorted(of.first, s, "right")) - 1 for s in cost}):
        here = range(int(of.first[b]), int(of.first[b] + of.segments[b]))
        order = sorted(here, key=lambda s: (cost.get(s, 0), s))
        per_set = 1 + 1.2 * of.low[b] / of.segments[b]
        for cheap, dear in zip(order[: len(order) // 2], reversed(order)):
            if cost.get(dear, 0) <= more_pairs * cost.get(cheap, 0) + docs.get(b, 0) * per_set:
                break
            gone.append(dear)
            raised.append(cheap)
    return gone, raised


def neighbourhoods(docs: DataFrame, folded: DataFrame, raised: list[int], of: Bands) -> DataFrame:
    """(doc, key, at) of the subsets less one element, and of the empty subsets, of the segments raised to level 2."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    in_band = sorted({int(np.searchsorted(of.first, s, "right")) - 1 for s in raised})
    up = np.zeros(int(of.first[-1] + of.segments[-1]), bool)
    up[raised] = True
    rows = folded.where(F.col("band").isin(in_band + [b - 1 for b in in_band])).select(F.col("doc").alias("doc_id"))
    texts = docs.join(rows, "doc_id", "left_semi").select("doc_id", "text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=SLICE):
                row, value = scanned(part.column("text"))
                size = np.bincount(row, minlength=part.num_rows)
                begin = np.cumsum(size) - size
                band = np.maximum(np.searchsorted(of.low, size, "right") - 1, 0)
                for more in (0, 1):
                    at = band + more
                    here = np.flatnonzero((size > 0) & np.isin(at, in_band) & (OF * size >= PART * of.low[np.minimum(at, len(of.low) - 1)]))
                    starts, sums, which, segment = subsets(value, begin[here], size[here], at[here], of)
                    number = of.first[at[here]][which] + segment
                    hashes = value[np.repeat(begin[here] - (np.cumsum(size[here]) - size[here]), size[here]) + np.arange(len(which))]
                    keys = keyed(sums[starts[which] + segment] - mix(hashes), number)
                    empty = np.flatnonzero(sums == 0)
                    of_empty = np.searchsorted(starts, empty, "right") - 1
                    of_number = of.first[at[here]][of_empty] + empty - starts[of_empty]
                    which, number, keys = np.append(which, of_empty), np.append(number, of_number), np.append(keys, keyed(sums[empty], of_number))
                    ok = up[number]
                    doc = part.column("doc_id").take(pa.array(here[which[ok]]))
                    yield pa.RecordBatch.from_arrays([doc, pa.array(keys[ok]), pa.array((2 * number[ok] + 1 - more).astype(np.int32))], ["doc", "key", "at"])

    return texts.mapInArrow(run, f"doc {kind}, key long, at int")


def allocated(docs: DataFrame, folded: DataFrame, every: DataFrame, of: Bands, more_pairs: float) -> DataFrame:
    """The buckets that are left once levels are allocated by cost; see allocation()."""
    spark = docs.sparkSession
    held = stored(spark, buckets(every), "held", tidy=True)
    segment = F.shiftright("at", 1).alias("segment")
    dear = held.groupBy(segment).agg(F.sum("n").alias("cost")).collect()  # a row for each segment: in proportion to the largest set
    docs_of = dict(folded.groupBy("band").count().collect())
    gone, raised = allocation({s: c / 2 for s, c in dear}, docs_of, of, more_pairs)
    if not gone:
        return held
    changed = F.broadcast(spark.createDataFrame([(s, s in set(raised)) for s in gone + raised], "segment int, raised boolean"))
    kept = held.withColumn("segment", F.shiftright("at", 1)).join(changed, "segment", "left_anti").select(*held.columns)
    level_2 = every.withColumn("segment", F.shiftright("at", 1)).join(changed.where("raised"), "segment", "left_semi").select(*every.columns)
    level_2 = level_2.unionByName(neighbourhoods(docs, folded, raised, of)).groupBy("key", "doc").agg(F.max("at").alias("at"))
    return stored(spark, kept.unionByName(buckets(level_2).select(*held.columns)), "held", tidy=True)


def sets_of(docs: DataFrame, ids: DataFrame, repeats: bool) -> DataFrame:
    """(doc, hashes) of the documents in ids: their shingles in order of hash, packed; one row for each text of a doc_id.

    Further columns of ids, whose doc_id is unique, follow. repeats: whether a doc_id may stand for several rows of docs.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = [c for c in ids.columns if c != "doc_id"]
    many = ids.count()
    few = many <= BROADCAST_IDS

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=SLICE):
                row, value = scanned(part.column("text"))
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1)).tolist()
                packed = pa.array([value[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), packed, *(part.column(c) for c in more)], ["doc", "hashes", *more])

    texts = docs.select("doc_id", "text")
    if few:
        texts = texts.join(F.broadcast(ids), "doc_id")
    else:
        texts = marked(texts, "doc_id", ids, "doc_id", many).where("marked").drop("marked").join(ids.hint("merge"), "doc_id")
    columns = [f"doc {kind}", "hashes binary", *(f"{c} {ids.schema[c].dataType.simpleString()}" for c in more)]
    sets = texts.mapInArrow(run, ", ".join(columns)).where("length(hashes) > 0")
    return sets.dropDuplicates(["doc", "hashes"]) if repeats else sets


def intersections(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The size of the intersection and of the union of each pair of packed sets."""
    sides = [np.frombuffer(b"".join(x.to_pylist()), np.uint64) for x in (a, b)]
    sizes = [np.asarray(pc.binary_length(x)).astype(np.int64) // 8 for x in (a, b)]
    row = np.concatenate([np.repeat(np.arange(len(s)), s) for s in sizes])
    value = np.concatenate(sides)
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    row, value = row[order], value[order]
    both = np.bincount(row[1:][(row[1:] == row[:-1]) & (value[1:] == value[:-1])], minlength=len(a))
    return both, sizes[0] + sizes[1] - both


def verified(docs: DataFrame, pairs: DataFrame, repeats: bool) -> DataFrame:
    """(a, b) of the stored pairs (doc, leader) that link, judged by whole sets.

    Sets of either side go straight to the leader's partition, and there is no other copy of them.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    to = stored(spark, pairs.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("leader").alias("leaders")), "ids", tidy=True)
    leaders = stored(spark, pairs.select(F.col("leader").alias("doc_id")).distinct(), "ids", tidy=True)

    def run(batches):
        for batch in batches:
            for part in slices_of(batch):
                both, either = intersections(part.column("x"), part.column("y"))
                linked = pa.array(OF * both >= PART * either)
                yield pa.RecordBatch.from_arrays([part.column("doc").filter(linked), part.column("leader").filter(linked)], ["a", "b"])

    x = sets_of(docs, to, repeats).select("doc", F.explode("leaders").alias("leader"), F.col("hashes").alias("x"))
    y = sets_of(docs, leaders, repeats).select(F.col("doc").alias("leader"), F.col("hashes").alias("y"))
    return x.join(y, "leader").select("doc", "leader", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def slices_of(batch: pa.RecordBatch, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Row slices of about so many bytes of the packed sets x and y; a larger pair is a slice alone."""
    ends = np.cumsum(np.asarray(pc.add(pc.binary_length(batch.column("x")), pc.binary_length(batch.column("y")))).astype(np.int64))
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + most, "right")))
        yield batch.slice(row, stop - row)
        row = stop


def sketches(value: np.ndarray, which: np.ndarray, n: int, words: int) -> np.ndarray:
    """(sets x words) a bit for each cell of hashes, 1 if an odd number of the set's elements fall into it."""
    cell = mix(value ^ U64(0xA5A5)) % U64(64 * words)
    out = np.zeros((n, words), np.uint64)
    np.bitwise_xor.at(out, (which, (cell >> U64(6)).astype(np.int64)), U64(1) << (cell & U64(63)))
    return out


def joining(group: pa.RecordBatch) -> tuple[list[int], list[int]]:
    """Rows (high, low) of links between the components of a block pair's rows; as many as join components.

    Rows are in order of doc, have a root each, and take part as first or second of a pair. Of two rows that both are
    `other` only the higher is first, as such pairs come twice.
    """
    n = group.num_rows
    first, second, other = (group.column(c).to_numpy(zero_copy_only=False) for c in ("first", "second", "other"))
    label = np.asarray(group.column("root").dictionary_encode().indices).astype(np.int64)
    values = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
    size = np.array([len(v) for v in values])
    begin, value = np.cumsum(size) - size, np.concatenate(values)
    words = 1 + SKETCH_BITS * 2 * int(size.max()) * (OF - PART) // (OF + PART) // 64
    bits = sketches(value, np.repeat(np.arange(n), size), n, max(4, words))
    element = np.unique(value, return_inverse=True)[1]
    mine = np.zeros(int(element.max()) + 1, bool)
    high, low = [], []
    for i in np.flatnonzero(first).tolist():
        near = OF * np.minimum(size, size[i]) >= PART * np.maximum(size, size[i])
        held = np.flatnonzero(second & (label != label[i]) & near & (~other | (np.arange(n) < i)))
        differ = np.bitwise_count(bits[held] ^ bits[i]).sum(axis=1, dtype=np.int64)
        held = held[(OF + PART) * differ <= (OF - PART) * (size[held] + size[i])]
        if not len(held):
            continue
        own = slice(begin[i], begin[i] + size[i])
        mine[element[own]] = True
        many = size[held]
        starts = np.cumsum(many) - many
        both = np.add.reduceat(mine[element[np.repeat(begin[held] - starts, many) + np.arange(many.sum())]].astype(np.int64), starts)
        mine[element[own]] = False
        linked = held[OF * both >= PART * (size[i] + many - both)]
        if len(linked):
            labels, at = np.unique(label[linked], return_index=True)
            for j in linked[at].tolist():
                high.append(max(i, j))
                low.append(min(i, j))
            label[np.isin(label, labels)] = label[i]
    return high, low


def links_across(docs: DataFrame, held: DataFrame, folded: DataFrame, roots: DataFrame, repeats: bool) -> DataFrame | None:
    """(a, b) of links between components whose sets share buckets, if any do: see step 3 of the module's text."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    of_doc = roots.select(F.col("node").alias("doc"), "root").hint("merge")
    rooted = held.where("n > 2").select("key", "doc", "leader").join(of_doc, "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    shared = stored(spark, rooted.join(mixed, "key").select(F.col("doc").alias("a"), F.col("leader").alias("b")).distinct(), "shared", tidy=True)
    if shared.isEmpty():
        return None
    family = components(shared).select(F.col("node").alias("doc"), F.xxhash64("root").alias("family"))
    rows = stored(spark, family.join(of_doc, "doc", "left").withColumn("root", F.coalesce("root", "doc")).join(folded.select("doc", "size").groupBy("doc").agg(F.max("size").alias("size")), "doc"), "families", tidy=True)
    # Sets of the family's most frequent component need no test against each other, the others one against all.
    of_root = rows.groupBy("family", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    sized = of_root.groupBy("family").agg(F.sum("n").alias("n"), F.sum("size").alias("all"), F.max(F.struct("n", "size", "root")).alias("most")).where("n > most.n")
    placed = rows.join(sized, "family").withColumn("other", F.col("root") != F.col("most.root"))
    blocks = lambda size, n: F.ceil(F.greatest(size / BLOCK, n / BLOCK_DOCS)).cast("int")
    many, few = blocks(F.col("all"), F.col("n")), blocks(F.col("all") - F.col("most.size"), F.col("n") - F.col("most.n"))
    part = lambda salt, n: F.pmod(F.xxhash64("doc", F.lit(salt)), n).cast("int")
    at = lambda i, j, first, second: F.struct(i.alias("i"), j.alias("j"), F.lit(first).alias("first"), F.lit(second).alias("second"))
    as_second = F.transform(F.sequence(F.lit(0), few - 1), lambda i: at(i, part(0, many), False, True))
    as_first = F.when(F.col("other"), F.transform(F.sequence(F.lit(0), many - 1), lambda j: at(part(1, few), j, True, False))).otherwise(F.array().cast(DEALT))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("other").alias("first"), F.lit(True).alias("second")))
    placed = placed.select("doc", "root", "family", "other", F.explode(F.when(many == 1, whole).otherwise(F.concat(as_second, as_first))).alias("at")).select("doc", "root", "family", "other", "at.*")
    placed = stored(spark, placed, "placed", tidy=True)
    sets = sets_of(docs, stored(spark, placed.select(F.col("doc").alias("doc_id")).distinct(), "ids", tidy=True), repeats)
    group = ["family", "i", "j"]
    rows = placed.join(sets, "doc").repartition(*group).sortWithinPartitions(*group, "doc")

    def run(batches):
        for each in groups(batches, group):
            taken = [each.column("doc").take(pa.array(x, pa.int64())) for x in joining(each)]
            if len(taken[0]):
                yield pa.RecordBatch.from_arrays(taken, ["a", "b"])

    return rows.mapInArrow(run, f"a {kind}, b {kind}")


def first_rows(some: DataFrame, folded: DataFrame) -> DataFrame:
    """The rows of some that folded names by row, of which it has one for each set. Nearly all keys stay where they are."""
    rows = folded.select("row")
    copies = stored(some.sparkSession, some.select("row").join(rows, "row", "left_anti"), "copies", tidy=True)
    many = some.count() - folded.count()
    if many <= BROADCAST_IDS:
        return some.join(F.broadcast(copies), "row", "left_anti")
    told = marked(some, "row", copies, "row", many)
    first = told.where("marked").join(copies.hint("merge"), "row", "left_anti")
    return told.where("not marked").unionByName(first).drop("marked")


def joined(docs: DataFrame, more_pairs: float = MORE_PAIRS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles and component_id."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    known = stored(spark, indexed(docs).withColumn("row", F.monotonically_increasing_id()), "indexed")
    some = known.where("size > 0 and doc_id is not null")
    # Sets are folded by their digests alone; keys are not moved for it.
    folded = some.groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc_id").alias("doc"), "row", "size", "band")).alias("x")).select("d1", "d2", "x.*")
    folded = stored(spark, folded, "folded", tidy=True)
    repeats = not some.groupBy("doc_id").count().where("count > 1").isEmpty()
    of = bands(folded.agg(F.max("size")).first()[0] or 1)
    docs = docs.where("doc_id is not null")
    keyed_rows = first_rows(some, folded).withColumnRenamed("doc_id", "doc")
    held = allocated(docs, folded, members(keyed_rows, of), of, more_pairs)
    pairs = stored(spark, held.where("doc <> leader").select("doc", "leader").distinct(), "pairs", tidy=True)
    links = stored(spark, verified(docs, pairs, repeats), "links", tidy=True)
    roots = stored(spark, components(links), "roots", tidy=True)
    across = links_across(docs, held, folded, roots, repeats)
    if across is not None:
        more = stored(spark, across, "links", tidy=True)
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    # By the size of compressed files Spark would broadcast the nodes, so joins with them say that they go by shuffle.
    of_text = folded.select("d1", "d2", "doc").join(roots.hint("merge"), folded.doc == roots.node, "left").select("d1", "d2", F.coalesce("root", "doc").alias("component_id"))
    # Rows without words or identifier get keys that no set has, spread over all partitions.
    lone = (F.col("size") == 0) | F.col("doc_id").isNull()
    key = lambda c, salt: F.when(F.col("lone"), F.xxhash64("doc_id", "row", F.lit(salt))).otherwise(F.col(c)).alias(c)
    rows = known.select("doc_id", "d1", "d2", "size", lone.alias("lone"), "row")
    rows = rows.select("doc_id", "size", "lone", key("d1", 1), key("d2", 2)).join(of_text, ["d1", "d2"], "left")
    return rows.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("lone"), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
