"""Aggregates: robust statistics, modes, votes, histograms and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Bins by which a key's values are cut, so that no task sorts them all.
BINS = 1024


def percentiles(df: DataFrame, key: str, value: str, shares: tuple[float, ...] = (0.3, 0.6, 0.8, 0.9, 0.97, 0.99)) -> DataFrame:
    """Exact percentiles with linear interpolation, and the median; null values are passed over.

    Equal values are counted first. A key's values are cut into bins of equal width, and counts by bin tell in which bins
    the wanted ranks lie; only those are put in order, each for itself.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ends = counts.groupBy(key).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("all"))
    bin_ = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("long")
    binned = counts.join(ends, key).withColumn("bin", bin_)
    before = F.sum("m").over(Window.partitionBy(key).orderBy("bin")) - F.col("m")  # at most BINS rows of a key
    starts = binned.groupBy(key, "bin").agg(F.sum("n").alias("m")).withColumn("start", before)
    named = [("median", 0.5), *((f"p{round(p * 100)}", p) for p in shares)]
    wanted = ends.select(key, F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("all") - 1)).alias("at")) for name, p in named])).alias("w")).select(key, "w.*")
    ranks = wanted.select(key, "name", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    hit = starts.join(ranks, key).where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("m"))).select(key, "bin", "start", "name", "at", "rank")
    inside = binned.join(hit.select(key, "bin").distinct(), [key, "bin"], "left_semi")
    inside = inside.withColumn("upto", F.sum("n").over(Window.partitionBy(key, "bin").orderBy("v"))).select(key, "bin", "v", "upto", (F.col("upto") - F.col("n")).alias("from"))
    place = F.col("rank") - F.col("start")
    found = hit.join(inside, [key, "bin"]).where((place >= F.col("from")) & (place < F.col("upto")))
    low, high = (F.max_by("v", which) for which in (-F.col("rank"), F.col("rank")))
    each = found.groupBy(key, "name").agg(F.round(low + (F.first("at") - F.floor(F.first("at"))) * (high - low), 6).alias("q"))
    return each.groupBy(key).agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name, _ in named])


def moments(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Mean and population deviation of x, and the slope of y on x as sample covariance over population variance."""
    return df.groupBy(key).agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("sd"), F.round(F.try_divide(F.covar_samp(x, y), F.var_pop(x)), 6).alias("slope"))


def histogram(df: DataFrame, code: Column) -> DataFrame:
    return df.groupBy(code.cast("long").alias("code")).agg(F.count("*").alias("n"))


def top_codes(df: DataFrame, key: str, code: Column, k: int = 3) -> DataFrame:
    """(key, place, code, n): the k most frequent codes, the smaller code first on a tie."""
    counts = df.groupBy(key, code.cast("long").alias("code")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "code")
    return counts.withColumn("place", F.row_number().over(w).cast("int")).where(F.col("place") <= k).select(key, "place", "code", "n")


def mode(df: DataFrame, key: str, code: Column) -> DataFrame:
    """(key, code, n): the most frequent code, the smallest on a tie."""
    counts = df.groupBy(key, code.cast("long").alias("code")).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.max_by(F.struct("code", "n"), F.struct("n", -F.col("code"))).alias("m"))
    return best.select(key, "m.code", "m.n")


def weighted_vote(df: DataFrame, key: str, choice: str, weight: Column) -> DataFrame:
    """(key, choice, weight, share): the choice of most weight, the first by name on a tie, and its share of all."""
    sums = df.groupBy(key, choice).agg(F.sum(weight).cast("long").alias("weight"))
    best = sums.groupBy(key).agg(F.min(F.struct((-F.col("weight")).alias("less"), F.col(choice).alias("c"))).alias("m"), F.sum("weight").alias("all"))
    return best.select(key, F.col("m.c").alias(choice), (-F.col("m.less")).alias("weight"), F.round(F.try_divide(-F.col("m.less"), F.col("all")), 6).alias("share"))


def vote_twice(df: DataFrame, key: str, choice: str, score: str, least: int = 2) -> DataFrame:
    """(key, choice, n, total): most votes, then the larger sum of scores, then the first by name; at least `least` votes."""
    sums = df.groupBy(key, choice).agg(F.count("*").alias("n"), F.round(F.sum(score), 4).alias("total"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), F.desc("total"), choice)
    return sums.withColumn("r_", F.row_number().over(w)).where((F.col("r_") == 1) & (F.col("n") >= least)).drop("r_")


def best_with_lead(df: DataFrame, key: str, choice: str, score: str, least: float, lead: float) -> DataFrame:
    """(key, choice, score): the best choice if it reaches `least` and leads the second by `lead`."""
    w = Window.partitionBy(key).orderBy(F.desc(score), choice)
    two = df.withColumn("r_", F.row_number().over(w)).where("r_ <= 2")
    flat = two.groupBy(key).agg(F.max(F.when(F.col("r_") == 1, F.col(choice))).alias(choice), F.max(F.when(F.col("r_") == 1, F.col(score))).alias(score), F.max(F.when(F.col("r_") == 2, F.col(score))).alias("second_"))
    return flat.where((F.col(score) >= least) & (F.col(score) - F.coalesce("second_", F.lit(0.0)) >= lead)).drop("second_")


#: Entries at either end of the history that have a rate of their own.
ENDS = 10


def acceptance(history: DataFrame) -> DataFrame:
    """One row per kind: n, and the rate of unchanged items over all, the first ten and the last ten entries, by time."""
    rate = lambda total, changed: F.bround(1 - F.try_divide(changed, total), 3)
    sums = history.groupBy("kind").agg(F.count("*").alias("n"), rate(F.sum("total"), F.sum("changed")).alias("rate"))
    for name, order in (("first_rate", ("t", "seq")), ("recent_rate", (F.desc("t"), F.desc("seq")))):
        # Each task keeps its first ten entries of a kind before any are shuffled.
        some = history.withColumn("r_", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).where(F.col("r_") <= ENDS)
        sums = sums.join(some.groupBy("kind").agg(rate(F.sum("total"), F.sum("changed")).alias(name)), "kind")
    return sums


def learning_stats(history: DataFrame, samples: DataFrame, fixes: DataFrame, seen: DataFrame, pages: DataFrame, kind: str) -> DataFrame:
    """One row: how much was learned and how many of a kind's elements needed no change, first and of late."""
    rates = acceptance(history.where(F.col("kind") == kind)).select("first_rate", "recent_rate")
    n = lambda df, name: df.agg(F.count("*").alias(name))  # noqa: E731  one row each
    out = n(samples, "samples")
    for df, name in ((history, "corrections"), (fixes, "text_fixes"), (seen, "implicit_pages"), (pages, "pages")):
        out = out.crossJoin(n(df, name))
    labels = samples.agg(F.count_if(F.col("keep") == 1).alias("n_keep"), F.count_if(F.col("keep") == 0).alias("n_drop"))
    return out.crossJoin(labels).join(rates, F.lit(True), "left")


#: Jobs in these states are not idle, however old their last event is.
ACTIVE = ("queued", "running")


def idle(jobs: DataFrame, now: float, limit: float = 3600.0) -> DataFrame:
    """Jobs whose last event is older than the limit and whose last state is neither queued nor running."""
    last = jobs.groupBy("job").agg(F.max_by("state", F.struct("t", "seq")).alias("state"), F.max("t").alias("touched"))
    return last.where((F.col("touched") < now - limit) & ~F.col("state").isin(*ACTIVE))


def queue_position(jobs: DataFrame) -> DataFrame:
    """(job, ahead): waiting jobs in order of arrival, and how many stand before each."""
    waiting = jobs.where("state = 'queued'").groupBy("shard", "job").agg(F.min("t").alias("arrived"))
    return waiting.withColumn("ahead", (F.row_number().over(Window.partitionBy("shard").orderBy("arrived", "job")) - 1).cast("int"))


def latest_stage(events: DataFrame) -> DataFrame:
    """(job, stage, data): the last value of each stage."""
    return events.groupBy("job", "stage").agg(F.max_by("data", F.struct("t", "seq")).alias("data"))
