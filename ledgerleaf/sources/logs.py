"""Extraction logs: one JSON object a line, read with a fixed schema; broken lines are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import LOG


def read_log(spark: SparkSession, path: str | list[str], schema: str = LOG) -> DataFrame:
    """Rows of well-formed lines with their file and place in it; a missing path gives none when it is a pattern without matches."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"))
    parsed = lines.where(F.trim("value") != "").withColumn("row", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("row._bad IS NULL AND row IS NOT NULL").select("file", "seq", "row.*").drop("_bad")


def log_totals(log: DataFrame, by: list[str], benign_error: str = "non-listing") -> DataFrame:
    """Of entries with an image: count, token sums, ids, and errors other than ``benign_error``."""
    bad = ~F.coalesce(F.col("success"), F.lit(False)) & (F.coalesce(F.col("error"), F.lit("")) != benign_error)
    return log.where("image IS NOT NULL").groupBy(*by).agg(
        F.count("*").alias("entries"),
        *[F.sum(F.coalesce(F.col(f"usage.{c}"), F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")],
        F.sort_array(F.collect_set("id")).alias("ids"),
        F.sum(bad.cast("int")).alias("errors"),
    )


def newest(files: DataFrame, n: int, when: str = "modificationTime", name: str = "path") -> DataFrame:
    """The ``n`` newest files: a top-k, which Spark takes per partition first."""
    return files.orderBy(F.desc(when), name).limit(n)


def last_lines(log: DataFrame, group: list[str], order: str, n: int) -> DataFrame:
    return log.withColumn("_p", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(order)))).where(F.col("_p") <= n).drop("_p")


def instant(text: Column) -> Column:
    """A timestamp of ISO text, null if it is none."""
    return F.try_to_timestamp(text)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Measures appended over time under a growing set of columns: missing ones are null."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def layered(shipped: DataFrame, coded: DataFrame, user: DataFrame, key: str, fixed: tuple[str, ...] = ()) -> DataFrame:
    """One row per name: shipped before coded (but for ``fixed`` names, which stay coded), user ones only under new names."""
    rank = lambda df, n: df.withColumn("_rank", n)
    every = rank(shipped, F.when(F.col(key).isin(*fixed), 9).otherwise(0) if fixed else F.lit(0)).unionByName(rank(coded, F.lit(1))).unionByName(rank(user, F.lit(5)))
    return every.withColumn("_p", F.row_number().over(Window.partitionBy(key).orderBy("_rank"))).where("_p = 1").drop("_p", "_rank")


def route(path: Column) -> Column:
    """Which reader a file goes to, by its ending."""
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(end == "pdf", "pdf").when(end.isin("jsonl", "ndjson"), "log").when(end == "docx", "word").when(end == "xlsx", "workbook").when(end.isin("png", "jpg", "jpeg", "tif", "tiff"), "image").when(end == "", "folder").otherwise("unknown")
