"""Exact deduplication by a stateful stream.

Documents arrive as a stream of (digest, identifier, length, locator); a locator is a row's file and place in it. The
stream's keyed state, one entry for a digest, lives in RocksDB on the executors' disks and in the query's checkpoint; it has
no watermark and no expiry, so a digest seen once is known for good. An entry retains the digest, the stable identifier and
locator of the row that stays, and the number of equal rows. Rows of one key are combined before they are shuffled, so a
digest that holds a third of all rows sends one row a task. A later call that names the same `state_dir` goes on with the
state of the calls before it.

Every hit is held against the full bytes of the row that stays, which is read through its locator; the rows of a large group
are spread over many tasks, each with a copy of that one row. Rows whose digest agrees and whose bytes do not are grouped
again by their full text, among the rows of the call.

Defined results: null text counts as empty; of rows equal in length and identifier the first by locator stays; a row without
doc_id stays only if no equal row of the greatest length has one; rows that repeat a doc_id count in the group's size;
`kept` is true for every row of the identifier that stays, while keep_first() leaves one row of a group; an empty table
gives no rows; other columns are never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import LOCATOR, dropped, located, shared_dir, stored

#: Code points that normalisation deletes: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
#: Keyed state on the executors' disks; space isn't set aside beforehand, as many partitions may have little state each,
#: all partitions of an executor share one bounded cache and small write buffers, and those of an ended stream are closed
#: soon.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
}
#: Rows of a group that are held against one copy of the row that stays.
SPREAD = 500
#: A digest is hot if it has over one in so many of all rows, so fewer digests than that are; its rows meet its entry by
#: digest and salt.
HOT_PART, SALTS = 1000, 256
#: Groups whose keys are broadcast at most to pick out their texts; more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANK, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def stream_state(spark: SparkSession, where: str, call: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Run the stateful stream over the arrivals in a state folder that it hasn't seen; one row for each digest of this call."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # Least of (shorter, no identifier, identifier, locator), so identifiers may be of any type that has an order.
    best = F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "locator")
    seen = reader.parquet(f"{where}/arrivals").groupBy("digest").agg(F.min(best).alias("best"), F.count("*").alias("group_size"))

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{where}/out/{call}/part={number}")

    old = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = seen.writeStream.outputMode("update").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).foreachBatch(append).start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.createDataFrame([], f"digest string, best {seen.schema['best'].dataType.simpleString()}, group_size long, batch int")
    if _exists(spark, f"{where}/out/{call}"):
        out = spark.read.schema(out.schema).parquet(f"{where}/out/{call}")
    # A digest is given again by each batch that changed it; the last one holds.
    last = out.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("last"))
    return last.select("digest", F.col("last.best.doc_id").alias("keep_id"), F.col("last.best.locator").alias("keep_locator"), "last.group_size")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def hot_digests(state: DataFrame) -> DataFrame:
    """(digest, hot) of digests with over one in HOT_PART of all rows, under HOT_PART of them; read from the stored state."""
    total = state.agg(F.sum("group_size").alias("n")).first().n or 0
    return state.where(F.col("group_size") > total / HOT_PART).select("digest", F.lit(True).alias("hot"))


def with_entry(rows: DataFrame, entries: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows, which have a locator, with the entry of their digest; a hot digest's rows are dealt out over SALTS keys, each with a copy of its one entry."""
    part = F.pmod(F.xxhash64("locator"), F.lit(SALTS)).cast("int")
    dealt = rows.join(F.broadcast(hot), "digest", "left").withColumn("part", F.when(F.col("hot"), part).otherwise(0)).drop("hot")
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(entries.join(F.broadcast(hot), "digest", "left").withColumn("part", F.explode(parts)).drop("hot"), ["digest", "part"]).drop("part")


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest=sha256, files_per_batch: int | None = None, state_dir: str | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, and locators of the row and of the one that stays.

    `digest` makes a key of the normalised text; equal keys are only candidates, so a weak one changes no result.
    `state_dir`, in a shared folder, is where state lasts; calls that name the same one see the rows of all calls so far.
    Rows of earlier calls are then read again where their locators say, from Parquet files that have the text column.
    """
    spark = docs.sparkSession
    where, call = state_dir or f"{shared_dir(spark)}/seen-{uuid.uuid4().hex}", uuid.uuid4().hex
    rows = located(docs).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text_"), F.col(LOCATOR).alias("locator"))
    norm = rows.withColumn("norm", normalised(F.col("text_"))).withColumn("digest", digest(F.col("norm")))
    entries = norm.select("digest", "doc_id", F.length(F.coalesce("text_", F.lit(""))).alias("n_chars"), "locator", *([] if digest is sha256 else [sha256(F.col("norm")).alias("text_sha256")]))
    schema = entries.schema
    entries.write.parquet(f"{where}/arrivals/call={call}")
    entries = spark.read.schema(schema).parquet(f"{where}/arrivals/call={call}")
    if digest is sha256:
        entries = entries.withColumn("text_sha256", F.col("digest"))
    state = stored(spark, stream_state(spark, where, call, schema, files_per_batch), "state")
    result = lambda df: df.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "locator", "keep_locator")
    hot = hot_digests(state)
    wrong = stored(spark, _unlike(norm, state, hot, None if state_dir is None else text_column), "wrong")
    if wrong.isEmpty():
        return result(with_entry(entries, state, hot))
    apart = norm.join(wrong, "digest", "left_semi").withColumn("text_sha256", sha256(F.col("norm")))
    best = F.struct((-F.length(F.coalesce("text_", F.lit("")))).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "locator")
    again = apart.groupBy("norm").agg(F.min(best).alias("best"), F.count("*").alias("group_size")).select("norm", F.col("best.doc_id").alias("keep_id"), F.col("best.locator").alias("keep_locator"), "group_size")
    return result(with_entry(entries.join(wrong, "digest", "left_anti"), state, hot)).unionByName(result(apart.join(again, "norm")))


def _unlike(norm: DataFrame, state: DataFrame, hot: DataFrame, text_column: str | None) -> DataFrame:
    """(digest) of groups of which a row's bytes are not those of the row that stays; text_column if earlier calls have rows."""
    spark = norm.sparkSession
    hits = state.where("group_size > 1").select("digest", "keep_locator", F.ceil(F.col("group_size") / SPREAD).cast("int").alias("copies"))
    keys = hits.select(F.xxhash64("digest").alias("key"))
    few = hits.count() <= BROADCAST_KEYS
    texts = norm.withColumn("key", F.xxhash64("digest")).join(F.broadcast(keys) if few else keys, "key", "left_semi")
    texts = stored(spark, with_entry(texts.select("digest", "locator", "norm"), hits, hot), "hits")  # read twice
    others = texts.where("locator <> keep_locator").select("digest", F.pmod(F.xxhash64("locator"), "copies").cast("int").alias("salt"), "norm")
    keepers = texts.where("locator = keep_locator").select("digest", "copies", F.col("norm").alias("keep_norm"))
    if text_column:
        own = norm.select(F.col("locator.file").alias("file")).distinct()
        old = hits.join(own, F.col("keep_locator.file") == F.col("file"), "left_anti")
        files = [r.file for r in old.select("keep_locator.file").distinct().collect()]  # names of files
        if files:  # kept since an earlier call
            earlier = spark.read.parquet(*files).select(normalised(F.col(text_column)).alias("keep_norm"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"))
            keepers = keepers.unionByName(old.join(earlier, F.col("keep_locator") == F.col("at")).select("digest", "copies", "keep_norm"))
    keepers = keepers.select("digest", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), "keep_norm")
    return others.join(keepers, ["digest", "salt"]).where("norm <> keep_norm").select("digest").distinct()


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, one row of each group, with all their columns."""
    docs = located(docs)
    gone = exact_dedup(docs).where("locator <> keep_locator").select(F.col("locator").alias(LOCATOR))
    return dropped(docs, gone, LOCATOR).drop(LOCATOR)
