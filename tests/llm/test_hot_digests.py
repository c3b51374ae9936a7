"""A digest with most of the rows is dealt out before its texts move, and results stay the same."""

from pyspark.sql import functions as F

from folioframe.llm import exactdedup


def test_hot_digest(spark):
    rows = [(i, "the same text" if i % 10 else f"text {i}") for i in range(3000)] + [(5000, None), (5001, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exactdedup.exact_dedup(docs).collect()}
    assert len(got) == len(rows)
    for i, text in rows[:3000]:
        assert got[i] == ((1, 2700, i == 1) if i % 10 else (i, 1, True))
    assert got[5000] == (5001, 2, False) and got[5001] == (5001, 2, True)


def test_rows_of_a_hot_digest_have_many_keys(spark):
    state = spark.createDataFrame([("a", 9000), ("b", 1), ("c", 2)], "digest string, group_size long")
    hot = exactdedup.hot_digests(state)
    assert [r.digest for r in hot.collect()] == ["a"]
    rows = spark.range(9000).select(F.when(F.col("id") == 0, "b").when(F.col("id") < 3, "c").otherwise("a").alias("digest"), "id", F.col("id").alias("locator"))
    out = exactdedup.with_entry(rows, state, hot)
    assert out.count() == 9000 and out.where("digest = 'a' and group_size = 9000").count() == 8997
    assert exactdedup.with_entry(rows.where("false"), state, hot).count() == 0 and exactdedup.hot_digests(state.where("false")).count() == 0
    dealt = rows.where("digest = 'a'").select(F.pmod(F.xxhash64("locator"), F.lit(exactdedup.SALTS)).alias("part")).groupBy("part").count()
    assert dealt.count() == exactdedup.SALTS and dealt.agg(F.max("count")).first()[0] < 100
