"""What the corpus operators share: tables, the held-out rule, and shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: One document in this many is held out of training.
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; such rows never train a model."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


#: Rows of an Arrow batch. Whole texts are long, so Spark's 10,000 rows fill some hundred megabytes of both JVM and Python.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
DEFAULT_ROWS, TEXT_ROWS = "10000", "1000"


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it has a setting of its own."""
    if spark.conf.get(ARROW_ROWS) == DEFAULT_ROWS:
        spark.conf.set(ARROW_ROWS, TEXT_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Without one only a local session may go on."""
    small_batches(spark)
    jsc, context = spark.sparkContext._jsc.sc(), spark.sparkContext
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(where)
    return jsc.getCheckpointDir().get()


#: Whether a query's shuffle files go once it has ended; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(spark: SparkSession, df: DataFrame, label: str, files: int | None = None, tidy: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage.

    The files outlive a lost executor, and a reader sees the same rows each time. A table known to be small goes to a few
    files: writing hundreds of nearly empty ones costs more than the rows. tidy: nothing reads what was shuffled for it again,
    so that room is given back at once.
    """
    where = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    if tidy:
        spark.conf.set(CLEANUP, "true")
    try:
        (df.coalesce(files) if files else df).write.parquet(where)
    finally:
        if tidy:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(where)


#: Bits of a bitmap of keys at most, bits for each key, and those of one of its rows.
MARK_BITS, BITS_A_KEY, ROW_BITS = 1 << 25, 16, 1 << 15


def marked(rows: DataFrame, column: str, keys: DataFrame, key: str, many: int) -> DataFrame:
    """rows with a column `marked`: true where keys (about so many) hold the row's value, and for a few others by chance.

    Only a bitmap of the keys' hashes is broadcast, of 4 MB at most, so that few rows have to be shuffled for an exact join.
    """
    bits = min(MARK_BITS, max(ROW_BITS, 1 << (BITS_A_KEY * many).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    of_row, at = lambda p: F.shiftright(p, 15), lambda p: F.pmod(p, F.lit(ROW_BITS))
    # Dealt out before they are gathered, as each task would else hold a bitmap of its own.
    places = keys.select(place(key).alias("place_")).withColumn("bucket_", of_row("place_")).repartition("bucket_")
    bitmap = places.groupBy("bucket_").agg(F.bitmap_construct_agg(at("place_")).alias("bits_"))
    placed = rows.withColumn("place_", place(column))
    byte = F.conv(F.hex(F.substr("bits_", F.shiftright(at(F.col("place_")), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, F.pmod("place_", F.lit(8)).cast("int"))
    joined = placed.join(F.broadcast(bitmap), of_row(F.col("place_")) == F.col("bucket_"), "left")
    return joined.select(*[F.col(c) for c in rows.columns], F.coalesce(bit == 1, F.lit(False)).alias("marked"))


#: The column that located() adds, and its type.
LOCATOR, LOCATOR_TYPE = "_locator", "struct<file:string,row:bigint>"


def located(docs: DataFrame) -> DataFrame:
    """docs with a column `_locator` (file, row): where a row lies, its identity even if identifiers are null or repeat.

    Rows that don't come straight from Parquet files are written to the shared folder first.
    """
    from pyspark.errors import AnalysisException

    if LOCATOR in docs.columns and docs.schema[LOCATOR].dataType.simpleString() == LOCATOR_TYPE:
        return docs
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    if not {"_metadata", LOCATOR} & set(docs.columns):
        try:
            return docs.withColumn(LOCATOR, place)
        except AnalysisException:
            pass
    docs = docs.drop(LOCATOR, "_metadata")
    return stored(docs.sparkSession, docs, "located").withColumn(LOCATOR, place)


#: Keys that are broadcast at most to take rows out; more are joined by a shuffle.
BROADCAST_GONE = 100_000


def dropped(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """docs without the rows whose key is in gone; a null key is never in it."""
    gone = stored(docs.sparkSession, gone.select(F.col(key).alias("gone_")).distinct(), "gone")
    few = gone.count() <= BROADCAST_GONE
    return docs.join(F.broadcast(gone) if few else gone, docs[key] == gone["gone_"], "left_anti")


def where_rows(docs: DataFrame, column: str, keep) -> DataFrame:
    """The rows of docs of which keep(Arrow column) is true, with all their columns; nothing is shuffled."""
    from .words import slices

    at = docs.columns.index(column)

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(keep(part.column(at)))

    return docs.mapInArrow(run, docs.schema)


def sha256_hex(values: list[bytes]) -> list[str]:
    import hashlib

    return [hashlib.sha256(v).hexdigest() for v in values]
