"""Fixity audit of record archives by Merkle trees over ordered offset ranges.

Every record of a file is hashed; the hashes of the records that start in one range of bytes, in order of offset, give the
range's hash, and `fanout` neighbouring ranges give a hash one level up. Two replicas are compared from the top; at each
level only the children of ranges that differ are looked at, down to the records that are altered, missing or added.
A range holds a bounded number of offsets, so no group grows with the archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosewise.session import pinned

RANGE_BYTES = 65_536
FANOUT = 16
LEVELS = 4


def leaves(records: DataFrame) -> DataFrame:
    """(file, at, record, hash): one row per offset, from records (file, at, record, hash), with missing values named.

    A null file is the file '', a null offset is -1. Records that repeat an offset are one leaf: its hash covers their
    number, their smallest, largest and summed hashes, in no order, so repeated rows gather nowhere.
    """
    rows = records.select(F.coalesce("file", F.lit("")).alias("file"), F.coalesce("at", F.lit(-1)).cast("long").alias("at"), "record", F.coalesce("hash", F.lit("")).alias("hash"))
    part = F.conv(F.substring("hash", 1, 15), 16, 10).cast("decimal(38,0)")
    one = rows.groupBy("file", "at").agg(
        F.min("record").alias("record"), F.count(F.lit(1)).alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"), F.sum(part).cast("string").alias("sum"))
    many = F.sha2(F.concat_ws("|", F.col("n").cast("string"), "low", "high", F.coalesce("sum", F.lit(""))), 256)
    return one.select("file", "at", "record", F.when(F.col("n") == 1, F.col("low")).otherwise(many).alias("hash"))


def tree(records: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """Tables from the records (level 0) up to the top: (file, node, hash, records) at each level over the records.

    The top has one node per file if the file is shorter than range_bytes x fanout ** (levels - 1), else several, all of
    which are compared.
    """
    bottom = pinned(leaves(records))
    node = F.floor(F.col("at") / range_bytes).alias("node")
    below = bottom.select("file", node, F.col("at").alias("child"), "hash", F.lit(1).cast("long").alias("records"))
    tables = [bottom]
    for level in range(levels):
        parts = F.array_sort(F.collect_list(F.struct("child", "hash")))
        text = F.concat_ws(",", F.transform(parts, lambda p: F.concat_ws(":", p["child"].cast("string"), p["hash"])))
        table = pinned(below.groupBy("file", "node").agg(F.sha2(text, 256).alias("hash"), F.sum("records").alias("records")))
        tables.append(table)
        below = table.select("file", F.floor(F.col("node") / fanout).alias("node"), F.col("node").alias("child"), "hash", "records")
    return tables


def _differ(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(file, key, hash, other) where the two hashes differ or one is missing."""
    other = right.select(F.col("file").alias("file_b"), F.col(key).alias("key_b"), F.col("hash").alias("other"), *([F.col("record").alias("record_b")] if "record" in right.columns else []))
    both = left.join(other, (F.col("file") == F.col("file_b")) & (F.col(key) == F.col("key_b")), "full").where(~F.col("hash").eqNullSafe(F.col("other")))
    record = [F.coalesce("record", "record_b").alias("record")] if "record" in left.columns else []
    return both.select(F.coalesce("file", "file_b").alias("file"), F.coalesce(key, "key_b").alias(key), *record, "hash", "other")


def audit(
    left: DataFrame, right: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT, levels: int = LEVELS,
) -> DataFrame:
    """(kind, file, at, record, verdict, hash, other, records): every file's top nodes, then every record that differs.

    left, right: replicas as (file, at, record, hash) rows. For kind `root`, `at` is the first byte of the node's span
    and `verdict` equal, altered, missing or added; for kind `record` it is the record's offset, found by descending
    from the roots. An empty replica makes everything missing or added.
    """
    a, b = tree(left, range_bytes, fanout, levels), tree(right, range_bytes, fanout, levels)
    verdict = F.when(F.col("other").isNull(), "missing").when(F.col("hash").isNull(), "added").when(F.col("hash") != F.col("other"), "altered").otherwise("equal")
    top = b[-1].select(F.col("file").alias("file_b"), F.col("node").alias("node_b"), F.col("hash").alias("other"), F.col("records").alias("records_b"))
    span = range_bytes * fanout ** (levels - 1)
    roots = a[-1].join(top, (F.col("file") == F.col("file_b")) & (F.col("node") == F.col("node_b")), "full").select(
        F.lit("root").alias("kind"), F.coalesce("file", "file_b").alias("file"), (F.coalesce("node", "node_b") * span).alias("at"),
        F.lit(None).cast("string").alias("record"), verdict.alias("verdict"), "hash", "other", F.coalesce("records", "records_b").alias("records"))
    suspects = pinned(_differ(a[-1], b[-1], "node").select("file", "node"))
    for level in range(levels - 1, 0, -1):
        up = [t.withColumn("up", F.floor(F.col("node") / fanout)) for t in (a[level], b[level])]
        suspects = pinned(_differ(*[_under(t, "up", suspects) for t in up], "node").select("file", "node"))
    ends = [t.withColumn("up", F.floor(F.col("at") / range_bytes)) for t in (a[0], b[0])]
    found = _differ(*[_under(t, "up", suspects) for t in ends], "at")
    records = found.select(
        F.lit("record").alias("kind"), "file", "at", F.col("record").cast("string").alias("record"), verdict.alias("verdict"), "hash", "other", F.lit(1).cast("long").alias("records"))
    return roots.unionByName(records)


def _under(nodes: DataFrame, parent: str, suspects: DataFrame) -> DataFrame:
    """Nodes whose parent is suspected."""
    named = suspects.select(F.col("file").alias("file_s"), F.col("node").alias("node_s"))
    return nodes.join(named, (F.col("file") == F.col("file_s")) & (F.col(parent) == F.col("node_s")), "left_semi")


def record_hash(head: Column, body: Column) -> Column:
    """SHA-256 of a record's header line and content; null counts as empty."""
    return F.sha2(F.concat_ws("\n", F.coalesce(head, F.lit("")), F.coalesce(body, F.lit(""))), 256)


def page_records(pages: DataFrame, per_file: int = 512, head: str = "url", body: str = "html", change: Column | None = None) -> DataFrame:
    """Pages as archive records (file, at, record, hash): `per_file` consecutive ids to a file, one after the other.

    A record is its header, a line break and its content. `change` replaces the content that is hashed (for a replica);
    offsets are those of the archive as it was written. Records of a file are in order of id (nulls first), those of one
    id in order of what was written, so that offsets do not depend on the order of rows. Equal records lie side by side
    and are counted before the shuffle; a file's others are summed in buckets of (id, hash), so no file or id is in one
    task. Only lengths and hashes are moved to place the records.
    """
    content = F.concat_ws("\n", F.coalesce(F.col(head), F.lit("")), F.coalesce(F.col(body), F.lit("")))
    written = record_hash(F.col(head), F.col(body))
    rows = pages.select(
        F.concat(F.lit("part-"), F.floor(F.col("page_id") / per_file).cast("string")).alias("file"), F.col("page_id").alias("record"),
        F.octet_length(content).cast("long").alias("size"), written.alias("written"), (written if change is None else record_hash(F.col(head), change)).alias("hash"))
    bucket = ["file", "record", "bucket"]
    equal = rows.groupBy("file", "record", F.substring("written", 1, 3).alias("bucket"), "written", "hash").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n"))
    equal = pinned(equal)
    sums = equal.groupBy(*bucket).agg(F.sum(F.col("size") * F.col("n")).alias("bytes"))
    upto = Window.partitionBy("file").orderBy("record", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"{k}_s") for k in bucket], F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*bucket).orderBy("written", "hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = equal.withColumn("own", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
    same = F.col("file").eqNullSafe(F.col("file_s")) & F.col("record").eqNullSafe(F.col("record_s")) & (F.col("bucket") == F.col("bucket_s"))
    at = F.col("start") + F.col("own") + F.col("k") * F.col("size")
    copies = placed.join(starts, same).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return copies.select("file", at.alias("at"), "record", "hash")
