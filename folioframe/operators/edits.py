"""What a person's corrections of text teach: edit scripts, short fixes with a character of context, and their counts."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geom
from .spatial import by_shuffle, spread, touching

#: A line is the one that was edited if their boxes are equal, or else if none has a larger IoU, of this at least.
SAME_LINE = 0.5
#: A correction of more changed stretches is new writing. A fix replaces up to WRONG characters by up to RIGHT.
STRETCHES, WRONG, RIGHT = 3, 4, 6
#: Fixes that one row may hold.
MOST_FIXES = 20_000
_OPS = "array<struct<tag:string,i1:int,i2:int,j1:int,j2:int>>"


def _span(a: Column, b: Column) -> Column:
    """a, .., b - 1; nothing if there are none."""
    return F.when(b > a, F.sequence(a, b - 1)).otherwise(F.expr("cast(array() as array<int>)"))


@lru_cache(20_000)
def _script(old: str, new: str) -> list[tuple[str, int, int, int, int]]:
    return SequenceMatcher(None, old, new).get_opcodes()


def _opcodes(old: pa.Array, new: pa.Array) -> pa.Array:
    """The edit scripts of a batch of pairs, by the standard library."""
    offsets, parts = [], ([], [], [], [], [])
    for a, b in zip(old.to_pylist(), new.to_pylist(), strict=True):
        known = a is not None and b is not None
        offsets.append(len(parts[0]) if known else None)
        for op in _script(a, b) if known else ():
            for values, value in zip(parts, op, strict=True):
                values.append(value)
    fields = [pa.field("tag", pa.string()), *[pa.field(n, pa.int32()) for n in ("i1", "i2", "j1", "j2")]]
    ops = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(parts, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array([*offsets, len(parts[0])], pa.int32()), ops)


def edit_scripts(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Adds ops, [(tag, i1, i2, j1, j2)]: old[i1:i2] is equal to, replaced by, or lost against new[j1:j2], or that is inserted.

    The script is made of the longest common block, the first on a tie, and so on either side of it; a popular character of a
    text of 200 or more starts no block. Null for a null text. The pairs are dealt out evenly and
    each is worked on in its row; a worker remembers the last pairs, as the same correction is often made again.
    """
    # Not deterministic, or a filter on the script would work it out a second time.
    script = F.arrow_udf(_opcodes, _OPS).asNondeterministic()
    return spread(pairs).withColumn("ops", script(F.col(old), F.col(new)))


def edited_lines(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """(page, id, line, old, new) of each edit that changes a line: the line with its very box, the last by id of several, else that of largest IoU.

    lines: page, id, box, text. edits: page, id, box (where the line stood) and text; without box or text they say nothing.
    """
    told = edits.where("x is not null and text is not null and text <> ''").select("page", "id", "x", "y", "w", "h", F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("new"))
    at = ["page", "x", "y", "w", "h"]
    exact = told.join(by_shuffle(lines.groupBy(*at).agg(F.max("id").alias("line"))), at).select("page", "id", "line", "new")
    others = told.join(by_shuffle(exact.select("page", "id")), ["page", "id"], "left_anti")
    near = touching(others, lines.select("page", "id", "x", "y", "w", "h")).withColumn("iou", geom.iou(geom.box("a_"), geom.box("b_"))).where(F.col("iou") >= SAME_LINE)
    best = near.groupBy(F.col("a_page").alias("page"), F.col("a_id").alias("id")).agg(F.max_by("b_id", F.struct("iou", -F.col("b_id"))).alias("line"), F.first("a_new").alias("new"))
    both = exact.unionByName(best).join(by_shuffle(lines.select("page", F.col("id").alias("line"), F.col("text").alias("old"))), ["page", "line"])
    return both.where("old <> new").select("page", "id", "line", "old", "new")


def short_fixes(changed: DataFrame) -> DataFrame:
    """(wrong, right): of each row's old and new text, the replaced stretches with a character of context on either side.

    Texts with more than STRETCHES changed stretches teach nothing, nor do insertions, deletions and long replacements.
    """
    rows = edit_scripts(changed).withColumn("ops", F.filter("ops", lambda o: o["tag"] != "equal")).where(F.size("ops").between(1, STRETCHES))
    rows = rows.select("old", "new", F.explode("ops").alias("o")).select("old", "new", "o.*")
    rows = rows.where((F.col("tag") == "replace") & (F.col("i2") - F.col("i1") <= WRONG) & (F.col("j2") - F.col("j1") <= RIGHT))
    low, high = F.greatest(F.lit(0), F.col("i1") - 1), F.least(F.length("old"), F.col("i2") + 1)
    cut = lambda text, a, b: F.substr(F.col(text), a + 1, b - a)
    right = F.concat(cut("old", low, F.col("i1")), cut("new", F.col("j1"), F.col("j2")), cut("old", F.col("i2"), high))
    return rows.select(cut("old", low, high).alias("wrong"), right.alias("right")).where(F.length("wrong") >= 2)


def place_fixes(repaired: DataFrame) -> DataFrame:
    """(wrong, right): each place in which old and new, as far as both go, differ, with its neighbours in either text."""
    n = F.least(F.length("old"), F.length("new"))
    at = F.filter(_span(F.lit(0), n), lambda i: F.substr("old", i + 1, F.lit(1)) != F.substr("new", i + 1, F.lit(1)))
    rows = repaired.select("old", "new", F.explode(at).alias("i"))
    low = F.greatest(F.lit(0), F.col("i") - 1)
    around = lambda text: F.substr(F.col(text), low + 1, F.least(F.length(F.col(text)), F.col("i") + 2) - low)
    return rows.select(around("old").alias("wrong"), around("new").alias("right"))


def counted(fixes: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(wrong, right, n): how often each fix was made, added to what a table says already."""
    rows = fixes.select("wrong", "right", F.lit(1).cast("long").alias("n"))
    rows = rows if table is None else rows.unionByName(table.select("wrong", "right", F.col("n").cast("long").alias("n")))
    return rows.groupBy("wrong", "right").agg(F.sum("n").alias("n"))


def trusted(table: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """The fixes of a table that were made twice, or whose right form holds a known word of two characters or more."""
    if words is None:
        return table.where("n >= 2")
    n, part = F.length("right"), lambda a, b: F.substr(F.col("right"), a + 1, b - a)
    parts = F.flatten(F.transform(_span(F.lit(0), n - 1), lambda a: F.transform(_span(a + 2, n + 1), lambda b: part(a, b))))
    held = table.select("wrong", "right", "n", F.explode_outer(F.when(F.col("n") < 2, parts)).alias("word"))
    told = held.join(by_shuffle(words.select("word", F.lit(True).alias("known")).distinct()), "word", "left")
    rows = told.groupBy("wrong", "right", "n").agg(F.coalesce(F.bool_or("known"), F.lit(False)).alias("known"))
    return rows.where("n >= 2 or known").select("wrong", "right", "n")


def with_fixes(lines: DataFrame, table: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Adds fixed: the text of each line (text, has_chars) with the trusted fixes, the longest wrong form first, then by wrong and right form.

    The result of a replacement feeds the next. A fix that changes the length is passed over on lines with character places.
    All trusted fixes reach each task in one row; more than MOST_FIXES are an error, as none may be left out.
    """
    order = F.struct((-F.length("wrong")).alias("less"), "wrong", "right", (F.length("wrong") == F.length("right")).alias("same"))
    rows = trusted(table, words).agg(F.array_sort(F.collect_list(order)).alias("fixes_"))
    n = F.size("fixes_")
    too_many = F.raise_error(F.concat(n.cast("string"), F.lit(f" trusted fixes; {MOST_FIXES} can be applied")))
    rows = rows.select(F.when(n <= MOST_FIXES, F.col("fixes_")).otherwise(too_many).alias("fixes_"))
    allowed = lambda f: f["same"] | ~F.col("has_chars")
    step = lambda t, f: F.when(allowed(f), F.replace(t, f["wrong"], f["right"])).otherwise(t)
    return spread(lines).crossJoin(F.broadcast(rows)).withColumn("fixed", F.aggregate("fixes_", F.col("text"), step)).drop("fixes_")  # rows is one row
