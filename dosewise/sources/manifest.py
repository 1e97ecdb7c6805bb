"""File manifests: bytes, SHA-256, row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dosewise.operators import composition
from dosewise.operators import contracts as C
from dosewise.session import pinned

# Bytes up to which a file is hashed as one value; Spark can't hold a larger one in a row.
LARGEST_FILE = 1_000_000_000
# Hashes that are joined into one, level by level.
FANOUT = 4_096
# Splits of all large files up to which their line counts are broadcast.
BROADCAST_SPLITS = 100_000


def file_manifest(spark: SparkSession, glob: str, sizes: DataFrame | None = None, largest: int = LARGEST_FILE) -> DataFrame:
    """(path, bytes, sha256, parts_sha256 [, row_count, vector_length]) of every matching file.

    Files of at most `largest` bytes have their SHA-256. Larger ones are read in parts and have `parts_sha256` instead
    (see `parts_digests`). `sizes` carries row facts keyed by path.
    """
    found = spark.read.format("binaryFile").load(glob)
    small = found.where(F.col("length") <= largest).select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.lit(None).cast("string").alias("parts_sha256"))
    large = found.where(F.col("length") > largest).select("path", F.col("length").alias("bytes"))
    paths = [r["path"] for r in large.collect()]  # names only; Spark has listed them on the driver anyway
    if paths:
        digests = parts_digests(spark, paths)
        small = small.unionByName(large.join(digests, "path", "left").select(
            "path", "bytes", F.lit(None).cast("string").alias("sha256"),
            F.sha2(F.concat_ws("|", F.col("bytes").cast("string"), F.coalesce("digest", F.lit(""))), 256).alias("parts_sha256")))
    return small if sizes is None else small.join(sizes, "path", "left")


def parts_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, digest) of files of any size, read in splits by all tasks.

    A file is cut at its line feeds; each piece is hashed, and FANOUT hashes in order are hashed into one (a single one
    stays as it is), level by level up to the file's digest. It doesn't depend on how the file was split among tasks. A byte order mark at the
    start is skipped, and a file is read uncompressed if its name ends like a compressed one's.
    """
    pieces = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.sha2(F.col("value").cast("binary"), 256).alias("hash"))
    pieces = pinned(pieces)
    blocks = pieces.groupBy("path", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    starts = blocks.select("path", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start"))
    level = pieces.join(F.broadcast(starts) if starts.count() <= BROADCAST_SPLITS else starts, ["path", "block"]).select("path", (F.col("start") + F.col("at")).alias("number"), "hash")
    while True:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("number", "hash"))), lambda e: e["hash"])
        joined = F.when(F.count(F.lit(1)) == 1, F.max("hash")).otherwise(F.sha2(F.array_join(ordered, ""), 256))
        level = pinned(level.groupBy("path", F.floor(F.col("number") / FANOUT).alias("part")).agg(joined.alias("hash")))
        level = level.select("path", F.col("part").alias("number"), "hash")
        if level.where("number > 0").isEmpty():
            plain = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))  # as binaryFile writes it
            return level.select(F.regexp_replace(plain, "^file:/+", "file:/").alias("path"), F.col("hash").alias("digest"))


def row_facts(df: DataFrame, vector: str | None = None) -> DataFrame:
    """Rows (and vector length) per physical file of a Parquet read."""
    length = F.max(F.size(vector)) if vector else F.lit(None).cast("int")
    path = F.regexp_replace(F.input_file_name(), "^file:/+", "file:/")  # as binaryFile writes it
    return df.groupBy(path.alias("path")).agg(
        F.count(F.lit(1)).alias("row_count"), length.cast("bigint").alias("vector_length")
    )


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Re-written paths replace their rows; the rest stay."""
    return composition.replace_by_key(stored, new, ["path"])


def verify(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """Violations per manifest rule: missing file, bytes, digest, rows."""
    found = scanned.select("path", *[F.col(c).alias(f"_{c}") for c in scanned.columns if c != "path"])
    joined = stored.join(found, "path", "left")
    facts = [C.all_true(joined, F.col("_bytes").isNotNull(), "file_exists")]
    for c in ("bytes", "sha256", "parts_sha256", "row_count"):
        if c in stored.columns and c in scanned.columns:
            facts.append(C.all_true(joined, F.col(c).eqNullSafe(F.col(f"_{c}")), c))
    return C.report(facts)
