"""How the sources of a language diverge: distances of all pairs of sources, and each source's most typical terms.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. Each language keeps the terms of at least
`MIN_DOCS` of its documents. Every group (lang, source), and every language, gives each kept term a smoothed share of
1 + floor(SCALE * (count + 5) / (N + 5 * V)); all arithmetic is in integers.

* `pair`: the sum of |p - q| over all kept terms, for each other source of the language. A group gives all terms it lacks the
  same share, its baseline. V times the difference of two baselines is corrected only for terms that either group has:
  one-sided terms on each side, less what is counted twice for terms of both. Terms are dealt out by hash in chunks; each
  chunk brings the baselines of the language's sources along, and hands on one partial sum a pair.
* `term`: the `TOP` terms with the largest p - q above 0, q the language's share. Ranking is by radix selection: histograms over
  the high bits of the values, then over the rest in the bucket where the last rank falls, give each group's threshold.
  If many terms tie at the threshold, histograms over prefixes of their UTF-8 bytes narrow them down. Only then are the few
  rows left of a group ordered.

Texts are counted within each task first, so a source or term of any share of the rows is no hot key. Within a task terms of
a group are equal if their 64-bit hashes are.

Defined results: null text, lang and source are ''; each row is a document, so repeated rows count again; groups without
terms have pairs but no terms; with no kept terms all pairs have the value 0; a language of one source has no pairs; ties
go by UTF-8 bytes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored
from .words import IS_LETTER, U64, Words, mix, slices

MIN_DOCS, TOP, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000
#: Terms of groups that a task holds, about, before it hands them on.
HELD = 1_000_000
#: Low bits of a value that the second histogram is over; values have 31 bits at most.
LOW_BITS = 15
#: Tied rows of a group that may be ordered at the end; more are narrowed down by prefixes first.
TIED = 1000
#: (term, source) rows of a chunk, about.
CHUNK = 100_000
#: Sources of a language whose pairs' sums are kept in a task from chunk to chunk.
ACCUMULATED = 1500
#: Groups that are broadcast at most; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000
#: Parts that one side of the pairs of a language's sources is dealt into.
SALTS = 16
GROUP = ["lang", "source"]


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings data[start:end]."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    octets = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(octets))


class Tally(NamedTuple):
    """Distinct terms of groups: a hash of group and term, the group's number, the term, occurrences and documents."""

    key: np.ndarray
    group: np.ndarray
    term: pa.Array
    n: np.ndarray
    docs: np.ndarray


def tallied(text: pa.Array, group: np.ndarray) -> Tally:
    """The terms of texts, each of the group with that number."""
    words = Words(text, IS_LETTER)
    row = words.row
    key = mix(words.hash + mix(group.astype(np.uint64) + U64(1))[row])
    order = np.argsort(key, kind="stable")  # of equal keys, in order of row
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    other = new.copy()
    other[1:] |= row[1:] != row[:-1]
    docs = np.add.reduceat(other.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    at = order[first]
    return Tally(key[first], group[row[first]], _strings(words.low, words.starts[at], words.ends[at]), np.diff(np.append(first, len(key))), docs)


def merged(parts: list[Tally]) -> Tally:
    key = np.concatenate([p.key for p in parts])
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    total = lambda name: np.add.reduceat(np.concatenate([getattr(p, name) for p in parts])[order], first) if len(first) else np.zeros(0, np.int64)
    at = order[first]
    return Tally(key[first], np.concatenate([p.group for p in parts])[at], pa.concat_arrays([p.term for p in parts]).take(pa.array(at)), total("n"), total("docs"))


def _told(names: list[tuple[str, str]], t: Tally) -> pa.RecordBatch:
    own = [pa.array([name[i] for name in names], pa.string()).take(pa.array(t.group)) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*own, t.term.cast(pa.string()), pa.array(t.n), pa.array(t.docs)], [*GROUP, "term", "n", "docs"])


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents that have it.

    Each task counts its texts before anything is shuffled; it hands on what it holds whenever that are over HELD terms.
    """

    def run(batches):
        numbers: dict[tuple[str, str], int] = {}
        parts: list[Tally] = []
        for batch in batches:
            for part in slices(batch):
                named = zip(*(part.column(c).to_pylist() for c in GROUP))
                parts.append(tallied(part.column("text"), np.array([numbers.setdefault(x, len(numbers)) for x in named], np.int64)))
                if sum(len(p.key) for p in parts) > 2 * HELD:
                    parts = [merged(parts)]
                    if len(parts[0].key) > HELD:
                        yield _told(list(numbers), parts.pop())
                        numbers.clear()
        if parts:
            yield _told(list(numbers), merged(parts))

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP]
    rows = docs.select(*named, "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * kept)), exact for counts of any size."""
    return F.expr(f"1 + (cast({SCALE} as decimal(20,0)) * cast({count} + {SMOOTH} as decimal(18,0))) div cast({total} + {SMOOTH} * {kept} as decimal(20,0))")


def audited(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """The groups (lang, source, kept, base, place) and the cells (lang, source, term, p, q) of kept terms that occur in them."""
    spark = docs.sparkSession
    found = stored(spark, counts(docs), "counts")
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    cells = stored(spark, found.drop("docs").join(kept, ["lang", "term"]), "cells")
    vocabulary = cells.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    totals = cells.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP]).distinct()
    groups = every.join(totals, GROUP, "left").join(vocabulary, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    base = F.when(F.col("kept") > 0, share("0L", "total", "kept")).otherwise(F.lit(0).cast("long"))
    groups = stored(spark, groups.select(*GROUP, "total", "kept", "lang_total", base.alias("base"), place.alias("place")), "groups")
    of = groups.select(*GROUP, "total", "kept", "lang_total", "place")
    cells = cells.join(F.broadcast(of) if groups.count() <= BROADCAST_GROUPS else of, GROUP)
    cells = cells.select(*GROUP, "term", "place", share("n", "total", "kept").alias("p"), share("lang_n", "lang_total", "kept").alias("q"))
    return groups, stored(spark, cells, "shares")


def _cut(histogram: DataFrame, key: Column, group: list[str], wanted: Column) -> DataFrame:
    """The bucket of each group in which the wanted-th row falls in order of key, with the rows before it; none if there are fewer rows."""
    to = F.sum("rows").over(Window.partitionBy(*group).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return histogram.withColumn("to", to).where((F.col("to") >= wanted) & (F.col("to") - F.col("rows") < wanted)).withColumn("before", F.col("to") - F.col("rows"))


def top_terms(cells: DataFrame, top: int = TOP, tied: int = TIED) -> DataFrame:
    """(lang, source, item, value, rank) of the top terms of each group by value = p - q > 0, ties by UTF-8 bytes."""
    spark = cells.sparkSession
    rows = cells.where("p > q").select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    high = F.shiftright("value", LOW_BITS)
    first = _cut(rows.groupBy(*GROUP, high.alias("high")).agg(F.count("*").alias("rows")), F.desc("high"), GROUP, F.lit(top))
    first = first.select(*GROUP, "high", (F.lit(top) - F.col("before")).alias("wanted"))
    inside = rows.withColumn("high", high).join(first, [*GROUP, "high"])
    cuts = _cut(inside.groupBy(*GROUP, "wanted", "value").agg(F.count("*").alias("rows")), F.desc("value"), GROUP, F.col("wanted"))
    cuts = cuts.select(*GROUP, F.col("value").alias("least"), (F.col("wanted") - F.col("before")).alias("wanted"), "rows", F.lit(None).cast("binary").alias("prefix"))
    cuts = stored(spark, cuts, "cuts", files=1)
    octets, width = F.col("item").cast("binary"), 2
    begins = lambda with_: F.col("prefix").isNull() | with_(F.expr("substring(cast(item as binary), 1, length(prefix))"), F.col("prefix"))
    while not (many := cuts.where(F.col("rows") > tied)).isEmpty():
        ties = rows.join(many, GROUP).where((F.col("value") == F.col("least")) & begins(lambda x, y: x == y))
        narrowed = _cut(ties.groupBy(*GROUP, "least", "wanted", F.substring(octets, 1, width).alias("prefix")).agg(F.count("*").alias("rows")), F.asc("prefix"), GROUP, F.col("wanted"))
        narrowed = narrowed.select(*GROUP, "least", (F.col("wanted") - F.col("before")).alias("wanted"), "rows", "prefix")
        cuts = stored(spark, cuts.where(F.col("rows") <= tied).unionByName(narrowed), "cuts", files=1)
        width *= 2
    held = rows.join(cuts, GROUP, "left")
    held = held.where(F.col("least").isNull() | (F.col("value") > F.col("least")) | ((F.col("value") == F.col("least")) & begins(lambda x, y: x <= y)))
    ranked = held.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")))
    return ranked.where(F.col("rank") <= top).select(*GROUP, "item", "value", "rank")


def corrections(base: np.ndarray, term: np.ndarray, place: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(sources x sources) what the terms, numbered from 0, add to V * |base - base| of each pair of sources."""
    n, m = len(base), int(term.max(initial=-1)) + 1
    out, apart = np.zeros((n, n), np.int64), np.abs(base[:, None] - base)
    step = max(1, (1 << 22) // max(n, 1))
    for start in range(0, m, step):
        here = (term >= start) & (term < start + step)
        row, at, own = term[here] - start, place[here], p[here]
        shares = np.tile(base, (min(step, m - start), 1))
        has = np.zeros(shares.shape, bool)
        shares[row, at], has[row, at] = own, True
        for g in np.unique(at):
            mine = np.flatnonzero(has[:, g])
            more = np.abs(shares[mine, g][:, None] - shares[mine]) - apart[g]
            one = more.sum(axis=0)
            out[g] += one
            out[:, g] += one
            out[g] -= (more * has[mine]).sum(axis=0)  # terms of both are in twice: once as g, once as the other source
    return out


def _sums(batches):
    """One row (lang, first, second, value) for each language of the rows and pair of its sources; see source_pairs()."""
    lang, total, chunk, rest = None, None, None, []

    def gathered(rows: pa.Table, total: np.ndarray | None) -> np.ndarray:
        term = rows.column("term").combine_chunks()
        head = np.asarray(term.is_null())
        place, p = rows.column("place").to_numpy(), rows.column("p").to_numpy()
        base = np.zeros(int(head.sum()), np.int64)
        base[place[head]] = p[head]
        number = np.asarray(term.filter(pa.array(~head)).dictionary_encode().indices).astype(np.int64)
        found = corrections(base, number, place[~head].astype(np.int64), p[~head])
        return found if total is None else total + found

    def told(lang: str, total: np.ndarray):
        first, second = np.nonzero(np.triu(total, 1))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), pa.array(total[first, second])], ["lang", "first", "second", "value"])

    for batch in batches:
        langs, chunks = batch.column("lang").to_pylist(), batch.column("chunk").to_numpy()
        starts = [0, *(i for i in range(1, batch.num_rows) if langs[i] != langs[i - 1] or chunks[i] != chunks[i - 1]), batch.num_rows]
        for start, end in zip(starts, starts[1:]):
            if start == end:
                continue
            if rest and (langs[start], chunks[start]) != (lang, chunk):
                total, rest = gathered(pa.Table.from_batches(rest), total), []
                if langs[start] != lang or len(total) > ACCUMULATED:
                    yield from told(lang, total)
                    total = None
            lang, chunk = langs[start], chunks[start]
            rest.append(batch.slice(start, end - start))
    if rest:
        yield from told(lang, gathered(pa.Table.from_batches(rest), total))


def source_pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank) of every source and every other source of its language."""
    per_lang = cells.groupBy("lang").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk")
    rows = cells.join(per_lang, "lang").select("lang", chunk, "term", "place", "p")
    heads = groups.join(per_lang, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("string").alias("term"), "place", F.col("base").alias("p"))
    dealt = rows.unionByName(heads).repartition("lang", "chunk").sortWithinPartitions("lang", "chunk", "term")
    sums = dealt.mapInArrow(_sums, "lang string, first int, second int, value long").groupBy("lang", "first", "second").agg(F.sum("value").alias("more"))
    salt = F.pmod(F.col("place"), F.lit(SALTS)).alias("salt")
    left = groups.select("lang", "source", "kept", F.col("base").alias("own"), F.col("place").alias("at"), salt)
    right = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other"), F.col("place").alias("to"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = left.join(right, ["lang", "salt"]).where("at <> to").withColumns({"first": F.least("at", "to"), "second": F.greatest("at", "to")})
    pairs = pairs.join(sums, ["lang", "first", "second"], "left")
    value = F.col("kept") * F.abs(F.col("own") - F.col("other")) + F.coalesce("more", F.lit(0))
    pairs = pairs.select("lang", "source", "item", value.alias("value"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    groups, cells = audited(docs, min_docs)
    parts = [source_pairs(groups, cells).withColumn("part", F.lit("pair")), top_terms(cells, top).withColumn("part", F.lit("term"))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
