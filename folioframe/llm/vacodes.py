"""Vector codes by parts, with nearest entries found through a vector-approximation file.

Components become integers, floor(256 * x); vectors are cut into `PARTS` equal parts, and each part position has a codebook
of at most `ENTRIES` entries. A codebook's coordinates are quantised into 2 ** `BITS` cells of about equally many entries.
For a part to be coded, a table for each coordinate and cell holds the least and the greatest squared difference that any
entry of the cell can have; their sums over coordinates are bounds of the distance to each entry. Only entries whose lower
bound is not above the least upper bound are refined, with integer distances, so results are exact.

Entries start as the parts of the rows with the smallest identifiers. Each round sums the parts of every entry within a task,
then over tasks: a few thousand numbers reach the driver, however many rows there are.

Defined results: rows whose vector is null or holds a null or non-finite component are left out. An empty vector is kept.
Vectors shorter than the longest are filled up with zeros at the end, as is a length that 16 does not divide. Integers are
held within +-2**27, so that no sum overflows. Rows without vec_id are coded but start no entry; if a vec_id repeats, its
smallest vector starts one entry. Repeated rows get equal rows; fewer than 64 identifiers make smaller codebooks; an empty
table gives no rows. Columns other than vec_id, label and the vector are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Cells of a coordinate are numbered with so many bits.
BITS = 4
#: Integers are held within this bound.
MOST = 1 << 27
#: Vectors that are coded at a time.
BLOCK = 2048
#: Labels whose sums are broadcast at most; more are joined by a shuffle, dealt out over so many parts.
BROADCAST_LABELS, SALTS = 100_000, 16


class Book:
    """The entries of one part position and the cells of their coordinates."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # entries x coordinates
        n, width = entries.shape
        cells = min(1 << BITS, n)
        self.cell, self.low, self.high = [], [], []
        for values in entries.T:
            cell = np.empty(n, np.int64)
            cell[np.argsort(values, kind="stable")] = np.arange(n) * cells // n
            low, high = np.full(cells, MOST + 1), np.full(cells, -MOST - 1)
            np.minimum.at(low, cell, values)
            np.maximum.at(high, cell, values)
            self.cell.append(cell)
            self.low.append(low)
            self.high.append(high)

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries x parts) lower and upper bounds of the squared distances."""
        least = np.zeros((len(self.entries), len(parts)), parts.dtype)
        most = np.zeros_like(least)
        for x, cell, low, high in zip(parts.T, self.cell, self.low, self.high):
            low, high = low.astype(x.dtype)[:, None], high.astype(x.dtype)[:, None]
            outside = np.maximum(np.maximum(low - x, x - high), 0)
            across = np.maximum(np.abs(low - x), np.abs(x - high))
            least += (outside * outside)[cell]
            most += (across * across)[cell]
        return least, most

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry of each part, ties to the lower one, and its squared distance."""
        largest = int(max(np.abs(parts).max(initial=0), np.abs(self.entries).max(initial=0), 1))
        small = parts.shape[1] * (2 * largest) ** 2 < 1 << 31
        least, most = self.bounds(parts.astype(np.int32 if small else np.int64))
        entry, row = np.nonzero(least <= most.min(axis=0))  # in order of entry
        distance = ((parts[row] - self.entries[entry]) ** 2).sum(axis=1)
        best = np.full(len(parts), np.iinfo(np.int64).max)
        np.minimum.at(best, row, distance)
        code = np.full(len(parts), ENTRIES)
        won = distance == best[row]
        np.minimum.at(code, row[won], entry[won])
        return code, best


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are kept, the lengths of those, and their integers end to end."""
    lists = column.cast(pa.large_list(pa.float64()))
    there = ~np.asarray(lists.is_null())
    lengths = np.where(there, np.asarray(lists.value_lengths().fill_null(0)), 0)
    values = np.asarray(lists.flatten().fill_null(np.nan), dtype=float)
    row = np.repeat(np.arange(len(lists)), lengths)
    bad = np.bincount(row[~np.isfinite(values)], minlength=len(lists)) > 0
    keep = there & ~bad
    scaled = np.clip(np.floor(np.clip(values[keep[row]], -MOST, MOST) * SCALE), -MOST, MOST).astype(np.int32)
    return keep, lengths[keep], scaled


def quantised(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, label, v) of the rows that are kept, v the integers."""
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def run(batches):
        for batch in batches:
            keep, lengths, values = integers(batch.column(2))
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            kept = [batch.column(i).filter(pa.array(keep)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["vec_id", "label", "v"])

    return vectors.select("vec_id", "label", column).mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<int>")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """(rows x width) integers, filled up with zeros."""
    lengths = np.asarray(column.value_lengths())
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.asarray(column.flatten())
    return out


def blocks(batch: pa.RecordBatch, width: int):
    """(rows of the batch, their parts as rows x PARTS x coordinates), BLOCK rows at a time."""
    for start in range(0, batch.num_rows, BLOCK):
        rows = batch.slice(start, BLOCK)
        yield rows, matrix(rows.column(rows.schema.get_field_index("v")), width).reshape(rows.num_rows, PARTS, width // PARTS)


def first_entries(whole: DataFrame, width: int) -> np.ndarray:
    """(PARTS x entries x coordinates) the parts of the rows with the smallest identifiers."""
    ids = whole.select("vec_id").where("vec_id is not null").distinct().orderBy("vec_id").limit(ENTRIES)
    rows = whole.join(F.broadcast(ids), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").select("v").toArrow()
    vectors = matrix(rows.column("v").combine_chunks(), width)
    return vectors.reshape(len(vectors), PARTS, width // PARTS).swapaxes(0, 1)


def improved(whole: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The entries after one round: the floor of the mean of their parts; unused entries stay."""
    parts, n, across = entries.shape

    def sums(batches):
        books = [Book(e) for e in entries]
        total = np.zeros((parts, n, 1 + across), np.int64)
        for batch in batches:
            for _, rows in blocks(batch, parts * across):
                for p, book in enumerate(books):
                    code, _ = book.nearest(rows[:, p])
                    total[p, :, 0] += np.bincount(code, minlength=n)
                    np.add.at(total[p, :, 1:], code, rows[:, p])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "total"])

    got = whole.select("v").mapInArrow(sums, "at long, total long").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    total = np.zeros(parts * n * (1 + across), object)
    for at, value in got:
        total[at] = int(value)
    total = total.reshape(parts, n, 1 + across)
    out = entries.copy()
    for p, e in zip(*np.nonzero(total[:, :, 0])):
        out[p, e] = [x // total[p, e, 0] for x in total[p, e, 1:]]
    return out


def coded(whole: DataFrame, entries: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every row."""
    parts, _, across = entries.shape
    kinds = {c: whole.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def run(batches):
        books = [Book(e) for e in entries]
        for batch in batches:
            for rows, values in blocks(batch, parts * across):
                codes, error = np.empty((len(values), parts), np.uint8), np.zeros(len(values), np.int64)
                for p, book in enumerate(books):
                    codes[:, p], distance = book.nearest(values[:, p])
                    error += distance
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return whole.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows with the error summed over equal labels; a label may have any share of the rows."""
    spark = rows.sparkSession
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    sums = stored(spark, sums, "label-error")
    if sums.count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    sums = sums.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("part"))).drop("of", "salt", "part")


def codebooks(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """The stored integer vectors, and the entries (part x entry x coordinate) after all rounds."""
    spark = vectors.sparkSession
    small_batches(spark)
    whole = stored(spark, quantised(vectors, column), "integers")
    longest = whole.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    entries = first_entries(whole, width)
    for _ in range(ROUNDS if entries.shape[1] else 0):
        entries = improved(whole, entries)
    return whole, entries


def digest(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row that is kept."""
    whole, entries = codebooks(vectors, column)
    if not entries.shape[1]:  # no row has an identifier, so there are no entries
        return whole.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    rows = stored(whole.sparkSession, coded(whole, entries), "codes")
    return with_label_error(rows).select("vec_id", "code", "error", "label_error", F.lit(digest(entries)).alias("codebooks_sha256"))
