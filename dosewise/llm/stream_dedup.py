"""Exact deduplication as a stream over keyed state that never expires.

Arriving rows are written to a ledger (identifier, digest, length, locator; no text), and a Structured Streaming job
folds the ledger into state keyed by digest: number of rows, the row to keep, and the locator of the content first
claimed for the digest. The state is kept by RocksDB on the executors' disks and checkpointed in the shared folder, so a
later run over the same folder goes on where the last one stopped. Rows whose digest was hit more than once are compared
byte by byte with the content at the locator. Everything runs as DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewise.llm.common import SPACES, checked, filed, join_hot, locator, shared_folder, without
from dosewise.session import pinned

# Session settings of the stateful query; put back afterwards.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition reserves 4 MB of disk
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
FILES_PER_BATCH = 10_000
# Rows of one digest that are compared with their content in one task.
ROWS_PER_PART = 256


def normalised(text: Column) -> Column:
    """The text without the white space [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def write_ledger(docs: DataFrame, path: str, id_col: str, text_col: str, digest: Callable[[Column], Column], run: int = 0) -> None:
    text = F.col(text_col)
    docs.select(
        F.lit(run).alias("run"),
        F.col(id_col).alias("doc_id"), digest(normalised(text)).alias("digest"),
        F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("chars"), locator().alias("at"),
    ).write.mode("append").parquet(path)


def ingest(spark: SparkSession, ledger: str, state: str) -> DataFrame:
    """Fold the ledger files not seen before into the state; returns the state as a table.

    (digest, n, best, claim): best is the row to keep as (chars, ~doc_id, at, run), claim the run and locator of the
    content to compare with, which a later run doesn't change. ~id falls as the id grows and cannot overflow; a null id
    loses against any other.
    """
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        schema = spark.read.parquet(ledger).schema
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(ledger)
        keyed = arriving.groupBy("digest").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.struct("chars", F.bitwise_not("doc_id").alias("back"), "at", "run")).alias("best"), F.min(F.struct("run", "at")).alias("claim"),
        )
        job = keyed.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        job.awaitTermination()
        seen = spark.read.format("statestore").load(state)
        return pinned(seen.select("key.digest", F.col("value.count").alias("n"), F.col("value.max").alias("best"), F.col("value.min").alias("claim")))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _at(rows: DataFrame, text_col: str) -> DataFrame:
    return rows.select(locator().alias("at"), normalised(F.col(text_col)).alias("text"))


def unequal(docs: DataFrame, state: DataFrame, text_col: str, digest: Callable[[Column], Column], run: int = 0) -> DataFrame:
    """(run, at, text) of this run's rows whose normalised bytes differ from the content at their digest's locator.

    Content that an earlier run claimed is read from that run's files, which have to be still there.
    """
    hit = pinned(state.where("n > 1").select("digest", "claim", F.ceil(F.col("n") / ROWS_PER_PART).alias("parts")))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")  # the content of a large group is copied
    rows = _at(docs, text_col).withColumn("digest", digest(F.col("text"))).join(checked(hit), "digest")
    claimed = rows.where((F.col("claim.run") == run) & (F.col("at") == F.col("claim.at"))).select("digest", F.col("text").alias("content"), part)
    earlier = pinned(hit.where(F.col("claim.run") < run))
    files = [unquote(r.file) for r in earlier.select("claim.at.file").distinct().collect()] if run else []
    if files:
        old = _at(docs.sparkSession.read.parquet(*files), text_col).join(checked(earlier), F.col("at") == F.col("claim.at"))
        claimed = claimed.unionByName(old.select("digest", F.col("text").alias("content"), part))
    others = rows.where((F.col("claim.run") != run) | (F.col("at") != F.col("claim.at"))).withColumn("part", F.pmod(F.xxhash64("at"), F.col("parts")))
    return others.join(claimed, ["digest", "part"]).where("text != content").select(F.lit(run).alias("run"), "at", "text")


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """(doc_id, at, digest, keep_id, group_size, kept) of every row.

    Rows are equal when their texts are, white space left out. The row with the most code points stays, then the
    smallest id (a null id last), then the last locator, so that exactly one row of repeated rows stays. `folder` holds
    ledger, state and the rows that their digest does not tell apart; give the same folder again to add rows to an
    earlier run's (rows of both runs are returned; both must name their columns alike and keep their files). Ids are
    longs. An empty table gives an empty result.
    """
    docs, spark = filed(docs), docs.sparkSession
    again = folder is not None and _runs(spark, folder)
    folder, run = folder or shared_folder(spark, "dedup"), int(again or 0)
    write_ledger(docs, f"{folder}/ledger", id_col, text_col, digest, run)
    state = ingest(spark, f"{folder}/ledger", f"{folder}/state")
    rows = spark.read.parquet(f"{folder}/ledger")
    unequal(docs, state, text_col, digest, run).write.mode("append").parquet(f"{folder}/unequal")
    odd = spark.read.parquet(f"{folder}/unequal")
    if not odd.isEmpty():  # digests that different texts share: these are told apart by the text itself
        rows = rows.join(odd, ["run", "at"], "left")
        best = rows.groupBy(F.col("digest").alias("of_digest"), F.col("text").alias("of_text")).agg(
            F.count(F.lit(1)).alias("n"), F.max(F.struct("chars", F.bitwise_not("doc_id").alias("back"), "at", "run")).alias("best"))
        on = (F.col("digest") == F.col("of_digest")) & F.col("text").eqNullSafe(F.col("of_text"))
        joined = rows.join(best, on)
    else:
        joined = join_hot(rows, state.select("digest", "n", "best"), "digest", "n")
    stays = (F.col("at") == F.col("best.at")) & (F.col("run") == F.col("best.run"))
    return joined.select("doc_id", "at", "digest", F.bitwise_not("best.back").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"))


def _runs(spark: SparkSession, folder: str) -> int:
    """Runs that have written to the folder."""
    try:
        return int((spark.read.parquet(f"{folder}/ledger").agg(F.max("run")).first()[0] or 0) + 1)
    except AnalysisException:  # no ledger yet
        return 0


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns as they are. Cases as in `deduplicate`."""
    docs = filed(docs)
    return without(docs, deduplicate(docs, id_col, text_col).where("not kept"))
