"""Window operators: gaps and islands, forward fill, runs, tolerance rows, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import let


def tolerance_rows(items: DataFrame, position: Column, tol: float, key: str = "page") -> DataFrame:
    """Adds row_no: items in order of position start a new row when more than tol from the item before."""
    w = Window.partitionBy(key).orderBy(position, "id")
    jump = (position - F.lag(position).over(w) > tol).cast("int")
    return items.withColumn("row_no", F.sum(F.coalesce(jump, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def islands(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, run, first, last, value, n): maximal stretches of equal values in order."""
    w = Window.partitionBy(key).orderBy(order)
    change = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    marked = df.withColumn("change_", change).withColumn("run", F.sum("change_").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return marked.groupBy(key, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.first(value).alias("value"), F.count("*").alias("n"))


def longest_run(df: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """(key, longest): the longest stretch of rows with the flag, 0 if none has it."""
    runs = islands(df, key, order, flag)
    return runs.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("value"), F.col("n"))), F.lit(0)).cast("long").alias("longest"))


def gap_runs(df: DataFrame, key: str, position: str, gap: int) -> DataFrame:
    """(key, run, start, stop, n): positions in order break where the next is more than gap away."""
    w = Window.partitionBy(key).orderBy(position)
    jump = F.coalesce((F.col(position) - F.lag(position).over(w) > gap).cast("int"), F.lit(0))
    marked = df.withColumn("jump_", jump).withColumn("run", F.sum("jump_").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return marked.groupBy(key, "run").agg(F.min(position).alias("start"), F.max(position).alias("stop"), F.count("*").alias("n"))


def segments(df: DataFrame, key: str, order: str, flag: str, min_gap: int, min_len: int) -> DataFrame:
    """(key, start, stop): stretches between gaps; only gaps of min_gap, or at an end, cut; stretches of min_len stay. stop is exclusive."""
    runs = islands(df, key, order, flag)
    ends = df.groupBy(key).agg(F.min(order).alias("low"), F.max(order).alias("high"))
    real = runs.join(ends, key).withColumn("is_cut", F.col("value") & ((F.col("n") >= min_gap) | (F.col("first") == F.col("low")) | (F.col("last") == F.col("high"))))
    merged = real.withColumn("part_", F.sum(F.col("is_cut").cast("int")).over(Window.partitionBy(key).orderBy("run").rowsBetween(Window.unboundedPreceding, 0)))
    parts = merged.where(~F.col("is_cut")).groupBy(key, "part_").agg(F.min("first").alias("start"), (F.max("last") + 1).alias("stop"))
    return parts.where(F.col("stop") - F.col("start") >= min_len).select(key, "start", "stop")


def forward_fill(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds filled: the value, or the last one before it, or the key's most frequent one (the smallest on a tie)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n_"))
    mode = counts.groupBy(key).agg(F.min(F.struct((-F.col("n_")).alias("less"), F.col(value).alias("v"))).alias("m_")).select(key, F.col("m_.v").alias("seed_"))
    return df.join(mode, key, "left").withColumn("filled", F.coalesce(F.last(value, ignorenulls=True).over(w), "seed_")).drop("seed_")


def moving_majority(df: DataFrame, key: str, order: str, value: str, reach: int) -> DataFrame:
    """Adds smooth: 1 where the mean of a 0/1 value over `reach` rows on either side is above a half."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-reach, reach)
    return df.withColumn("smooth", (F.avg(F.col(value).cast("double")).over(w) > 0.5).cast("int"))


def numbered(df: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """Adds number: 1, 2, ... within the partition, as of a page's elements of one kind."""
    return df.withColumn("number", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("int"))


def repaired_numbers(labels: DataFrame) -> DataFrame:
    """(page, id, text, fixed): columns of two-digit numbers follow the start that most of their labels agree on.

    labels: page, id, x, y, h, text. Only texts of two characters, ASCII digits or O for 0, take part. In order of id each
    label that is in no column yet gathers its column: the labels within 0.8 of its height in x, and between 0.75 and 1.33 of
    its height. Of three or more, the label at place i by y with value v votes for start v - i. With 60 % of the votes all
    labels become start + i, if that is from 0 to 99; the smallest start wins ties. Labels of a column lead none themselves,
    but may be in another one, with the text that they have by then.
    """
    part = labels.where(F.col("text").rlike("^[0-9Oo]{2}$"))
    pages = part.groupBy("page").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.array_sort(F.collect_list(F.struct("y", "id", "x", "h", "text", F.lit(False).alias("used")))).alias("rows"))

    def near(r: Column, a: Column) -> Column:
        tall = r["h"] / F.greatest(F.lit(1), a["h"])
        return (F.abs(r["x"] - a["x"]) <= 0.8 * a["h"]) & (tall > 0.75) & (tall < 1.33)

    def start(column: Column) -> Column:
        """(votes, -start) of the start with most votes."""
        starts = F.transform(column, lambda r, i: F.translate(r["text"], "Oo", "00").cast("int") - i)
        return let(starts, lambda all_: F.array_max(F.transform(F.array_distinct(all_), lambda s: F.struct(F.size(F.filter(all_, lambda t: t == s)).alias("votes"), (-s).alias("less")))))

    def numbered_by(acc: Column, a: Column, column: Column, best: Column) -> Column:
        ids = F.transform(column, lambda r: r["id"])
        want = lambda r: F.array_position(ids, r["id"]).cast("int") - 1 - best["less"]
        agreed = best["votes"] >= 0.6 * F.size(column)
        text = lambda r: F.when(agreed & want(r).between(0, 99), F.lpad(want(r).cast("string"), 2, "0")).otherwise(r["text"])
        return F.transform(acc, lambda r: F.when(near(r, a), r.withField("used", F.lit(True)).withField("text", text(r))).otherwise(r))

    def gathered(acc: Column, a: Column) -> Column:
        column = F.filter(acc, lambda r: near(r, a))
        return let(column, lambda c: F.when(F.size(c) < 3, acc).otherwise(let(start(c), lambda best: numbered_by(acc, a, c, best))))

    def step(acc: Column, i: Column) -> Column:
        return let(F.get(F.filter(acc, lambda r: r["id"] == i), F.lit(0)), lambda a: F.when(a["used"], acc).otherwise(gathered(acc, a)))

    done = pages.select("page", F.explode(F.aggregate("ids", F.col("rows"), step)).alias("r")).select("page", "r.id", F.col("r.text").alias("fixed"))
    return labels.join(done, ["page", "id"], "left").select("page", "id", "text", F.coalesce("fixed", "text").alias("fixed"))


def tick_chains(ticks: DataFrame, key: str = "grp") -> DataFrame:
    """(key, n, k, zero): of each group of axis labels (v at place p), the largest set on one line.

    Every two labels 8 or more apart propose a scale; labels within max(4, 12 %) of it agree. Their distinct values must be
    at least four, evenly stepped (one may be missing), and start near or cross 0. The first pair wins ties.
    """
    one, two, it = (ticks.select(F.col(key).alias(f"{p}_key"), F.col("seq").alias(f"{p}_seq"), F.col("v").alias(f"{p}_v"), F.col("p").alias(f"{p}_p")) for p in ("a", "b", "c"))
    pairs = one.join(two, (F.col("a_key") == F.col("b_key")) & (F.col("a_seq") < F.col("b_seq"))).where((F.col("a_v") != F.col("b_v")) & (F.abs(F.col("b_p") - F.col("a_p")) >= 8))
    pairs = pairs.withColumn("k", F.try_divide(F.col("b_p") - F.col("a_p"), F.col("b_v") - F.col("a_v")))
    off = F.abs(F.col("a_p") + (F.col("c_v") - F.col("a_v")) * F.col("k") - F.col("c_p"))
    agree = pairs.join(it, F.col("a_key") == F.col("c_key")).where(off <= F.greatest(F.lit(4.0), 0.12 * F.abs(F.col("b_p") - F.col("a_p"))))
    sets = agree.groupBy("a_key", "a_seq", "b_seq", "k", "a_p", "a_v").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("c_v")).alias("vals"))
    sets = sets.where(F.size("vals") >= 4).withColumn("steps", F.transform(F.sequence(F.lit(1), F.size("vals") - 1), lambda i: F.get("vals", i) - F.get("vals", i - 1)))
    sets = sets.withColumn("step", F.array_min("steps")).withColumn("parts", F.transform("steps", lambda s: F.try_divide(s, F.col("step"))))
    even = (F.array_max(F.transform("parts", lambda q: F.abs(q - F.bround(q)))) <= 0.05) & (F.array_max("parts") <= 2.5)
    real = sets.where((F.col("step") > 0) & even & (F.get("vals", F.lit(0)) <= 2 * F.col("step")) & (F.element_at("vals", -1) > 0))
    best = real.groupBy("a_key").agg(F.max_by(F.struct("n", "k", (F.col("a_p") - F.col("a_v") * F.col("k")).alias("zero")), F.struct("n", -F.col("a_seq"), -F.col("b_seq"))).alias("m"))
    return best.select(F.col("a_key").alias(key), "m.n", "m.k", "m.zero")
