"""What op11 moves: keys once and without the sets' arrays, whole sets once for each side of a pair."""

import random
import re

from folioframe.llm import setjoin


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if re.search(r"[^a-zA-Z]Exchange ", line)]


def test_buckets_move_keys_once(spark):
    rows = [(d, k, 2 * s + own) for d, k, s, own in ((1, 7, 0, 1), (2, 7, 0, 1), (3, 7, 0, 0), (4, 8, 0, 1), (5, 9, 1, 0), (6, 9, 1, 0), (7, 5, 2, 0), (8, 5, 2, 1))]
    found = setjoin.buckets(spark.createDataFrame(rows, "doc long, key long, at int"))
    assert len(exchanges(found)) == 1  # was two: one to count keys and one to join the counts
    assert sorted((r.key, r.doc, r.n, r.leader) for r in found.collect()) == [(5, 7, 2, 8), (5, 8, 2, 8), (7, 1, 3, 1), (7, 2, 3, 1), (7, 3, 3, 1)]


def test_verified_moves_each_side_once(spark):
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base), " ".join([*base, "tail"]), " ".join(base[:30]), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (2, 1)], "doc long, leader long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = setjoin.verified(docs, pairs, False)
        assert len(exchanges(found)) == 2  # was four, after one more to store the sets
        assert [tuple(r) for r in found.collect()] == [(1, 0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_rows_by_either_join(spark, monkeypatch):
    some = spark.createDataFrame([(r, r % 3, [r]) for r in range(9)], "row long, doc_id long, own array<long>")
    folded = spark.createDataFrame([(0,), (4,), (8,)], "row long")
    for most in (1_000_000, 2):
        monkeypatch.setattr(setjoin, "BROADCAST_IDS", most)
        assert sorted(r.row for r in setjoin.first_rows(some, folded).collect()) == [0, 4, 8]


def test_set_join_of_repeated_rows(spark):
    """Identifiers that repeat, with equal texts and with others, beside many equal texts of other identifiers."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(80)]
    near = [" ".join(base[:k] + [f"x{rng.randrange(9)}"] + base[k + 1 :]) for k in range(0, 80, 8)]
    rows = [(7, " ".join(base))] * 5 + [(8, near[0])] * 3 + [(8, "quite another text of its own here")] + [(20 + i, t) for i, t in enumerate(near)] + [(40 + i, near[1]) for i in range(30)]
    got = setjoin.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got} == {7}  # 8 leads its other text, too
