"""Readers and writers of the page store: images, append-only JSON logs, word lists, documents with defaults."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

SAMPLES = "f array<double>, keep int, kind string, auto_kind string, w double, src string, t double, key string"
HISTORY = "t double, key string, kind string, total int, changed int"
EVOLUTION = "t double, version int, adopted boolean, n int, exam_size int, rules_only double, new double, current double"
SUFFIXES = ("png", "jpg", "jpeg", "webp", "bmp")
MOST_BYTES = 40 << 20


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images (BGR) with page_id in order of path; undecodable files are dropped."""
    df = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return df.select(F.xxhash64("origin").alias("page_id"), "origin", "height", "width", F.col("nChannels").alias("channels"), "data")


def inputs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) files by suffix and size, with the reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    reason = F.when(~suffix.isin(*SUFFIXES), "suffix").when(F.col("length") > MOST_BYTES, "size")
    judged = files.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason").orderBy("path"), judged.where("reason is not null")


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only JSON log; a missing one is empty, blank and broken lines are skipped."""
    try:
        rows = spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return rows.dropna("all")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def words(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq) of a list with a word and its count on each line; others are skipped."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 2)
    return parts.select(F.get("p", F.lit(0)).alias("word"), F.expr("try_cast(p[1] as int)").alias("freq")).where("freq is not null")


def upsert(spark: SparkSession, old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new doesn't have."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)
