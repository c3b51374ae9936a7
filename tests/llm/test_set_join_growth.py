"""What op11 holds as the number of unlike texts grows: no buckets of empty subsets, no broadcast that grows with the input."""

import random

from folioframe.llm import setjoin


def linked(rng, n, sizes):
    """Pairs of texts with as many different shingles at their ends as may be, all of words of their own."""
    rows = []
    for i in range(n):
        size = rng.choice(sizes)
        words = [f"p{i}w{k}" for k in range(size + 2)]
        cut = size - -(-9 * size // 10)  # a set of so many elements less links still
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: size + 2 - cut] if i % 2 else words[cut:]))]
    return rows


def test_unlike_texts_meet_in_no_bucket(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(f"t{i}w{k}" for k in range(rng.randint(15, 60)))) for i in range(3000)]
    sets = setjoin.indexed(spark.createDataFrame(rows, "doc_id long, text string")).withColumnRenamed("doc_id", "doc")
    assert setjoin.buckets(setjoin.members(sets, setjoin.bands(60))).count() == 0  # were those of empty subsets


def test_linked_texts_with_empty_subsets(spark):
    rows = linked(random.Random(12), 1500, [10, 11, 13, 16, 17, 20, 21, 27, 30, 46])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for more_pairs in (setjoin.MORE_PAIRS, -100.0):  # the second: every band changes half of its segments
        got = {r.doc_id: r.component_id for r in setjoin.joined(df, more_pairs).collect()}
        assert got == {i: i - i % 2 for i in range(3000)}


def test_few_empty_subsets_are_keys(spark):
    """Of sets so small that segments stay empty, and of some that leave more of them empty than there are to spare."""
    of = setjoin.bands(64)
    import numpy as np

    rng = np.random.default_rng(13)
    many = kept = 0
    for size in (10, 12, 13, 16):
        value = rng.integers(0, 1 << 63, size * 20_000).astype(np.uint64)
        begin, sizes = np.arange(20_000) * size, np.full(20_000, size)
        band = np.searchsorted(of.low, sizes, "right") - 1
        starts, sums, _, _ = setjoin.subsets(value, begin, sizes, band, of)
        out = setjoin.left_out(sums, starts, band, of)
        empty = np.add.reduceat((sums == 0).astype(int), starts)
        gone = np.add.reduceat(out.astype(int), starts)
        assert ((gone == empty) | (gone == 0)).all() and (gone <= of.spare[band]).all() and not (out & (sums != 0)).any()
        many, kept = many + int(gone.sum()), kept + int((empty > of.spare[band]).sum())
    assert many > 100 and kept < many


def test_bitmap_instead_of_broadcast(spark, monkeypatch):
    """Beyond so many identifiers texts are joined by shuffle, after a bitmap; results stay the same."""
    rng = random.Random(14)
    rows = linked(rng, 60, [30, 80, 200]) + [(1000 + i, " ".join(f"u{i}w{k}" for k in range(40))) for i in range(40)]
    rows += [(2000 + i, t) for i, (_, t) in enumerate(rows[::5])] + [(7, "a b c d"), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, setjoin.joined(df).collect()), key=str)
    monkeypatch.setattr(setjoin, "BROADCAST_IDS", 1)
    assert sorted(map(tuple, setjoin.joined(df).collect()), key=str) == want
    ids = spark.createDataFrame([(i, [i]) for i in range(5)], "doc_id long, leaders array<long>")
    plan = setjoin.sets_of(df, ids, False)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "bitmap_construct_agg" in plan  # was a broadcast of up to 1,000,000 lists, then a shuffle of all texts


def test_nodes_are_not_broadcast(spark, monkeypatch):
    """Beyond so many links the nodes of a step are joined by shuffle, whatever the size of their files; hot ones are broadcast."""
    from pyspark.sql import functions as F

    from folioframe.llm import components

    links = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(100, 160)] + [(3, 200), (200, 100)]
    df = spark.createDataFrame(links, "a long, b long")
    want = {tuple(r) for r in components.components(df).collect()}
    monkeypatch.setattr(components, "LEAST", 10)
    monkeypatch.setattr(components, "BY_SHUFFLE", 50)
    edges = df.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
    joins = lambda many: components._with_low(both, low, many)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in joins(len(links)) and "strategy=broadcast" in joins(len(links))  # were left to the size of files
    assert "strategy=merge" not in joins(40)
    assert {tuple(r) for r in components.components(df).collect()} == want
