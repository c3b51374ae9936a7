"""Benchmark decontamination by a positional inverted index that is stored and distributed by document.

`index` inverts all tokens of the training texts: each shard (a slice of documents within a Spark task) becomes one stored
row with its terms in order of hash and, for each term, the list of its word positions. The index knows nothing of a test
set, so one index serves many. `search` reads the stored lists: a test window is looked up by intersecting offset-adjusted
lists. The positions of its rarest term in the shard, less that term's offset, are the candidate starts, and each further
term, rarest first, strikes those starts at which its own list, less its offset, has no posting. What is left is the exact
phrase. Proximity matches are found alike: stretches of `SPAN` words that hold every term of a window, in any order, around
the places of its rarest term. Documents are never shuffled.

The test set is broadcast in blocks of at most `block_bytes` of text; a larger one takes several passes over the index, whose
findings are joined by shard and row.

Defined results: words are equal if their 64-bit hashes are, so a false match has a chance of under 1 in 10 million for a
million test terms in a trillion words; null or wordless texts have no words, no hits and are clean; items without words
make no window; an item of fewer words than a window is one window of its own length; equal items each count; repeated rows
are judged each alone; empty tables give no rows (documents) or no hits (benchmark).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOCATOR, dropped, located, sha256_hex, stored
from .words import Words, slices

#: Words of a window.
WINDOW = 13
#: A document is contaminated if hits are at least one in this many of its words.
SHARE = 20
#: Words of a stretch in which a proximity match has all terms of a window.
SPAN = 26
#: Test text that one pass broadcasts at most, in bytes.
BLOCK_BYTES = 16 << 20
#: Text of a shard of the index, about.
SHARD_BYTES = 1 << 20
#: Candidate starts held at a time.
CANDIDATES = 1 << 19
U64 = np.uint64


class Windows:
    """Distinct windows of a block of items, as term numbers, and the items of each."""

    def __init__(self, ids: list, texts: list, size: int = WINDOW):
        words = Words(pa.array(texts, pa.string()))
        self.ids = ids
        self.terms, numbers = np.unique(words.hash, return_inverse=True)
        found: dict[tuple, list[int]] = {}
        for item in range(len(ids)):
            own = numbers[words.first[item] : words.first[item + 1]].tolist()
            for at in range(max(1, len(own) - size + 1) if own else 0):
                items = found.setdefault(tuple(own[at : at + size]), [])
                if not items or items[-1] != item:
                    items.append(item)
        self.length = np.array([len(w) for w in found], np.int64)
        self.grid = np.full((len(found), size), -1, np.int64)
        for i, w in enumerate(found):
            self.grid[i, : len(w)] = w
        self.n_items = np.array([len(v) for v in found.values()], np.int64)
        self.first_item = np.cumsum(self.n_items) - self.n_items
        self.items = np.array([x for v in found.values() for x in v], np.int64)

    def pairs(self, row: np.ndarray, window: np.ndarray) -> np.ndarray:
        """row * items + item, distinct, for windows found in rows."""
        many = self.n_items[window]
        into = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.unique(np.repeat(row, many) * max(1, len(self.ids)) + self.items[np.repeat(self.first_item[window], many) + into])


INDEX = "terms binary, counts binary, postings binary, words binary"


def index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The stored index: for each shard the rows' identifiers, its terms, how many postings each has, and the postings."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def invert(batches):
        for batch in batches:
            for part in slices(batch, most=SHARD_BYTES):
                words = Words(part.column("text"))
                order = np.argsort(words.hash, kind="stable")
                terms, first = np.unique(words.hash[order], return_index=True)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                # Differences of neighbouring postings compress far better than places.
                cells = [terms, np.diff(np.append(first, len(order))).astype(np.int32), np.diff(order, prepend=0).astype(np.int32), words.counts.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([_packed(c)], pa.binary()) for c in cells)], ["ids", "terms", "counts", "postings", "words"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return stored(docs.sparkSession, rows.mapInArrow(invert, f"ids array<{id_type}>, {INDEX}"), "postings")


def _packed(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(cell: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(cell[8:], int.from_bytes(cell[:8], "little"), codec="zstd", asbytes=True), kind)


class Shard:
    """The posting lists of the test set's terms in one shard of the index, as (term number, position) in order."""

    def __init__(self, cell: dict, windows: Windows):
        self.windows = windows
        terms, sizes = _unpacked(cell["terms"], np.uint64), _unpacked(cell["counts"], np.int32).astype(np.int64)
        postings = np.cumsum(_unpacked(cell["postings"], np.int32).astype(np.int64))
        self.words = _unpacked(cell["words"], np.int32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.words)])
        at = np.searchsorted(terms, windows.terms)
        inside = at < len(terms)
        inside[inside] = terms[at[inside]] == windows.terms[inside]
        self.count = np.zeros(len(windows.terms), np.int64)
        self.count[inside] = sizes[at[inside]]
        begin = np.zeros(len(windows.terms), np.int64)
        begin[inside] = (np.cumsum(sizes) - sizes)[at[inside]]
        number = np.repeat(np.arange(len(begin)), self.count)
        self.begin = np.cumsum(self.count) - self.count
        position = postings[np.arange(len(number)) - self.begin[number] + begin[number]]
        self.lists = number.astype(np.uint64) << U64(32) | position.astype(np.uint64)

    def has(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """True where the term's list has a posting from low to high."""
        key = term.astype(np.uint64) << U64(32)
        at = np.searchsorted(self.lists, key | low.astype(np.uint64))
        ok = at < len(self.lists)
        ok[ok] = self.lists[at[ok]] <= (key | high.astype(np.uint64))[ok]
        return ok

    def matches(self, span: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, start, window) of every exact occurrence, in blocks; with span, (row, place, window) of places of a window's
        rarest term that lie in a stretch of so many words with all its terms."""
        w = self.windows
        if not len(w.length) or not len(self.lists):
            return
        sizes = np.where(w.grid >= 0, self.count[np.maximum(w.grid, 0)], np.iinfo(np.int64).max)
        live = np.flatnonzero(sizes.min(axis=1) > 0)
        if not len(live):
            return
        order = np.argsort(sizes[live], axis=1, kind="stable")
        rarest = w.grid[live, order[:, 0]]
        many = self.count[rarest]
        for block in np.split(np.arange(len(live)), np.flatnonzero(np.diff(np.cumsum(many) // CANDIDATES)) + 1):
            repeat = many[block]
            window = np.repeat(block, repeat)
            into = np.arange(len(window)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
            at = (self.lists[self.begin[rarest[window]] + into] & U64(0xFFFFFFFF)).astype(np.int64)
            row = np.searchsorted(self.first, at, "right") - 1
            reach = 0 if span is None else span - 1
            if span is None:
                at = at - order[window, 0]
                ok = (at >= self.first[row]) & (at + w.length[live[window]] <= self.first[row + 1])
                at, row, window = at[ok], row[ok], window[ok]
            for rank in range(1, w.grid.shape[1]):
                offset = order[window, rank]
                ok = self._all(row, at + (offset if span is None else 0), reach, reach, w.grid[live[window], offset])
                at, row, window = at[ok], row[ok], window[ok]
            if span is not None and len(at):
                held = np.zeros(len(at), bool)
                for before in range(span):
                    ok = ~held
                    for rank in range(1, w.grid.shape[1]):
                        some = np.flatnonzero(ok)
                        ok[some] = self._all(row[some], at[some], before, span - 1 - before, w.grid[live[window[some]], order[window[some], rank]])
                    held |= ok
                at, row, window = at[held], row[held], window[held]
            yield row, at, live[window]

    def _all(self, row: np.ndarray, at: np.ndarray, before: int, after: int, term: np.ndarray) -> np.ndarray:
        """True where the term has a posting in the row from `before` words before a place to `after` behind it, or is none."""
        ok = np.ones(len(term), bool)
        some = np.flatnonzero(term >= 0)
        low, high = np.maximum(at[some] - before, self.first[row[some]]), np.minimum(at[some] + after, self.first[row[some] + 1] - 1)
        ok[some] = self.has(term[some], low, high)
        return ok


def _item_blocks(benchmark: DataFrame, id_column: str, text_column: str, block_bytes: int) -> list[DataFrame]:
    total = benchmark.agg(F.sum(F.octet_length(text_column)).alias("n")).first()["n"] or 0
    n = 1 + int(total) // block_bytes
    items = benchmark.select(F.col(id_column).alias("item_id"), F.col(text_column).alias("item_text"))
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64(F.col("item_id")), F.lit(n)) == b) for b in range(n)]


def search(found_in: DataFrame, benchmark: DataFrame, item_column: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, span: int = SPAN) -> DataFrame:
    """One row per indexed row: id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, n_near_items, near_sha256 and near_ids.

    Identifiers of items are given as strings, sorted; near_ids are those of items with a proximity match.
    """
    spark = found_in.sparkSession
    id_type = found_in.schema["ids"].dataType.elementType.simpleString()
    blocks = _item_blocks(benchmark, item_column, item_text, block_bytes)
    last = f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, n_near_items long, near_sha256 string, near_ids array<string>"
    partial = f"shard long, row int, doc_id {id_type}, n_words long, hits array<int>, item_ids array<string>, near_ids array<string>"
    found_in = found_in.withColumn("shard", F.monotonically_increasing_id())  # stored files give the same each time
    parts = []
    for block in blocks:
        items = block.collect()  # bounded by block_bytes
        shared = spark.sparkContext.broadcast(([str(r.item_id) for r in items], [r.item_text for r in items]))

        def run(batches, shared=shared, whole=len(blocks) == 1):
            windows = Windows(*shared.value)
            for batch in batches:
                for i in range(batch.num_rows):
                    yield _judged(batch.slice(i, 1), windows, span, whole)

        parts.append(found_in.mapInArrow(run, last if len(blocks) == 1 else partial))
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    of = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))  # noqa: E731  a list for each block
    found = every.groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.size(of("hits")).cast("long").alias("n_hit"), of("item_ids").alias("item_ids"), of("near_ids").alias("near_ids"))
    digest = lambda c: F.sha2(F.array_join(c, ",").cast("binary"), 256)
    size = lambda c: F.size(c).cast("long")
    bad = (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))
    return found.select("doc_id", "n_words", "n_hit", size("item_ids").alias("n_items"), digest("item_ids").alias("items_sha256"), bad.alias("contaminated"), "item_ids", size("near_ids").alias("n_near_items"), digest("near_ids").alias("near_sha256"), "near_ids")


def _judged(cell: pa.RecordBatch, windows: Windows, span: int, whole: bool) -> pa.RecordBatch:
    ids = cell.column("ids").flatten()
    shard = Shard({c: cell.column(c)[0].as_py() for c in ("terms", "counts", "postings", "words")}, windows)
    n, size = len(ids), max(1, len(windows.ids))
    cover = np.zeros(int(shard.first[-1]) + 1, np.int64)
    exact, near = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row, start, window in shard.matches():
        np.add.at(cover, start, 1)
        np.add.at(cover, start + windows.length[window], -1)
        exact.append(windows.pairs(row, window))
    for row, _, window in shard.matches(span):
        near.append(windows.pairs(row, window))
    hit = np.cumsum(cover)[:-1] > 0
    names: list[list[list[str]]] = []
    for pairs in (exact, near):
        sets: list[set] = [set() for _ in range(n)]
        for pair in np.unique(np.concatenate(pairs)).tolist():
            sets[pair // size].add(windows.ids[pair % size])
        names.append([sorted(x) for x in sets])
    lists = [pa.array(x, pa.list_(pa.string())) for x in names]
    if not whole:
        found = [np.flatnonzero(hit[shard.first[r] : shard.first[r + 1]]).tolist() for r in range(n)]
        columns = [pa.array([cell.column("shard")[0].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), ids, pa.array(shard.words), pa.array(found, pa.list_(pa.int32())), *lists]
        return pa.RecordBatch.from_arrays(columns, ["shard", "row", "doc_id", "n_words", "hits", "item_ids", "near_ids"])
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[shard.first[1:]] - total[shard.first[:-1]]
    columns = {"doc_id": ids, "n_words": pa.array(shard.words), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(x) for x in names[0]], pa.int64())}
    columns |= {"items_sha256": pa.array(sha256_hex([",".join(x).encode() for x in names[0]]), pa.string()), "contaminated": pa.array((n_hit > 0) & (SHARE * n_hit >= shard.words)), "item_ids": lists[0]}
    columns |= {"n_near_items": pa.array([len(x) for x in names[1]], pa.int64()), "near_sha256": pa.array(sha256_hex([",".join(x).encode() for x in names[1]]), pa.string()), "near_ids": lists[1]}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES, span: int = SPAN) -> DataFrame:
    """search() over an index made of docs: one row per row of docs."""
    return search(index(docs, id_column, text_column), benchmark, block_bytes=block_bytes, span=span)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns; each row is judged by its own text."""
    docs = located(docs)
    bad = contamination(docs, benchmark, LOCATOR).where("contaminated").select(F.col("doc_id").alias(LOCATOR))
    return dropped(docs, bad, LOCATOR).drop(LOCATOR)
