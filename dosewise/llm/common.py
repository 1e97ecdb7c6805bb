"""Helpers shared by the corpus operators: tables, shared folders, row identity, checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewise.session import ensure_checkpoint_dir, pinned

# The white space of the contracts, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

# A list of keys is broadcast up to this many rows (counted first); a longer one is joined by shuffle.
BROADCAST_ROWS = 400_000
HOT_KEYS = 2_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def filed(df: DataFrame) -> DataFrame:
    """The table as read from files, so that each row has a place; a table that comes from no file is written first."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
        return df
    except AnalysisException:
        path = shared_folder(df.sparkSession, "table")
        df.write.parquet(path)
        return df.sparkSession.read.parquet(path)


def locator() -> Column:
    """Where the content of a row of a `filed` table is."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has at most `rows` rows. Give a checkpointed table, it is counted."""
    return F.broadcast(df) if df.count() <= rows else df


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of `rows` with a checkpointed table of one row per key, whose column `n` counts the key's rows.

    Keys with more than 1/HOT_KEYS of all rows, so fewer than HOT_KEYS of them, are broadcast; their rows don't move.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) > total / HOT_KEYS
    hot = F.broadcast(keyed.where(is_hot))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(keyed.where(~is_hot), key))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The filed table less the rows whose locator is in column `at` of `gone`; only the list moves while it is small."""
    gone = pinned(gone.select(F.col("at").alias("_gone_at")))
    placed = docs.withColumn("_row_at", locator())
    return placed.join(checked(gone), F.col("_row_at") == F.col("_gone_at"), "left_anti").select(*docs.columns)


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
