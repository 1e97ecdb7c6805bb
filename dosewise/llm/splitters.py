"""Range sharding by sampled splitters.

Rows are ordered by a key (here: a hash of the text, so that equal texts are neighbours). A sample weighted by size gives
quantile boundaries; every boundary key is a range of its own and so is each gap between two of them, so a key that holds
many bytes never shares its range. Exact sizes of the ranges are counted, ranges over the limit are subdivided by a hash
of the id, and the ranges go to the shards in order, by the middle of each range's bytes. Shard sizes so differ by about one
range, and equal keys stay in one shard unless they are too large for that.

Only the sample (its expected size is a parameter) and one row per range are ever handled in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosewise.session import pinned

RANGES_PER_SHARD = 64
# More ranges are made for tables of over RANGES_PER_SHARD times as many rows a shard, so that a range stays one task's work.
ROWS_PER_RANGE = 1_000_000
# Expected number of sampled rows for each boundary.
SAMPLES_PER_RANGE = 12
# A range is subdivided above this many times its fair share of bytes.
LARGEST = 4
# Steps of a sampled row's number, and hexadecimal digits that address the boundaries.
DRAW_DIGITS = 12
CELL_DIGITS = 3


def _hex(c: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(c, start, digits), 16, 10).cast("long")


def text_key(text: Column) -> Column:
    """Order key: 32 hexadecimal digits of the text's MD5; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")))


def text_size(text: Column, overhead: int = 8) -> Column:
    """UTF-8 bytes of the text (null: none) plus a fixed overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def boundaries(rows: DataFrame, ranges: int) -> DataFrame:
    """(key, position): distinct keys at the quantiles of a size-weighted sample; position from 0 in key order.

    A row is drawn with probability size x (sample size) / (all bytes), 1 at most, by a hash of its id and key. A row
    drawn for sure stands for its size, any other for the bytes of one draw.
    """
    wanted = ranges * SAMPLES_PER_RANGE
    total = rows.agg(F.sum("size")).first()[0] or 0
    step = max(1.0, total / wanted)  # bytes that a drawn row stands for
    draw = _hex(F.md5(F.concat_ws("|", F.lit("draw"), F.coalesce(F.col("id").cast("string"), F.lit("")), "key")), 1, DRAW_DIGITS)
    sample = rows.where(draw < F.least(F.col("size") / step, F.lit(1.0)) * float(16**DRAW_DIGITS))
    stands = F.greatest(F.col("size"), F.lit(math.ceil(step)).cast("long"))
    upto = Window.orderBy("key", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = pinned(sample.select("key", "id", stands.alias("w"))).withColumn("upto", F.sum("w").over(upto))
    share = (F.sum("w").over(Window.partitionBy()) / ranges)
    at = placed.withColumn("share", share).where(F.floor(F.col("upto") / F.col("share")) > F.floor((F.col("upto") - F.col("w")) / F.col("share")))
    return at.select("key").distinct().withColumn("position", (F.row_number().over(Window.orderBy("key")) - 1).cast("long"))


def ranged(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """`rows` with column `piece`: 2 x (boundaries below the key), plus 1 if the key is a boundary.

    The boundaries are looked up by the first digits of the key; there are at most as many as ranges were asked for, and
    these are one for a million rows in a large table.
    """
    cell = F.substring("key", 1, CELL_DIGITS)
    cells = bounds.groupBy(cell.alias("cell")).agg(F.min("position").alias("first"), F.sort_array(F.collect_list("key")).alias("keys"))
    every = rows.sparkSession.range(16**CELL_DIGITS).select(F.lpad(F.lower(F.hex("id")), CELL_DIGITS, "0").alias("cell"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.size("keys"), F.lit(0))
    cells = every.join(cells, "cell", "left").select("cell", F.coalesce(F.sum(n).over(before), F.lit(0)).alias("below"), F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))
    found = rows.withColumn("cell", cell).join(F.broadcast(pinned(cells)), "cell")
    under = F.col("below") + F.size(F.filter("keys", lambda k: k < F.col("key")))
    return found.withColumn("piece", 2 * under + F.array_contains("keys", F.col("key")).cast("long")).drop("cell", "below", "keys")


def shards(rows: DataFrame, n: int, ranges_per_shard: int | None = None) -> DataFrame:
    """`rows` (id, key, size and any others) with `shard` from 0 to n - 1 and `slot` from 0 inside it, without gaps.

    Rows are numbered by (range, part, key, id, size). Rows that agree in all of these are interchangeable. An empty
    table gives an empty result.
    """
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    per = ranges_per_shard or max(RANGES_PER_SHARD, -(-count // (n * ROWS_PER_RANGE)))
    part_hash = _hex(F.md5(F.concat_ws("|", F.lit("part"), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, DRAW_DIGITS)
    placed = ranged(rows, boundaries(rows, n * per))
    limit = max(1.0, total / (n * per) * LARGEST)
    whole = placed.groupBy("piece").agg(F.sum("size").alias("bytes"))
    parts = pinned(whole.where(F.col("bytes") > limit).select("piece", F.ceil(F.col("bytes") / limit).cast("long").alias("parts")))
    # fewer than n x per / LARGEST ranges can be over the limit
    placed = placed.join(F.broadcast(parts), "piece", "left").withColumn("part", F.coalesce(part_hash % F.col("parts"), F.lit(0)))
    placed = pinned(placed.drop("parts"))
    counted = placed.groupBy("piece", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("piece", "part").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.coalesce(F.sum("bytes").over(before), F.lit(0)) + F.col("bytes") / 2
    given = counted.withColumn("shard", F.least(F.floor(middle * n / max(1, total)), F.lit(n - 1)).cast("int"))
    inside = Window.partitionBy("shard").orderBy("piece", "part").rowsBetween(Window.unboundedPreceding, -1)
    given = given.select("piece", "part", "shard", F.coalesce(F.sum("rows").over(inside), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("piece", "part").orderBy("key", "id", "size")) - 1
    numbered = placed.withColumn("own", own.cast("long")).join(given, ["piece", "part"])
    return numbered.withColumn("slot", F.col("offset") + F.col("own")).drop("piece", "part", "own", "offset")


def shard_documents(docs: DataFrame, n: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; shards get near equal numbers of bytes.

    A null text has size 8 and checksum 0. Equal texts are in one shard unless they hold more than 1/16 of it.
    Repeated rows and rows without an id are placed like any other. Other columns are ignored, whatever their names.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text_key(text).alias("key"), text_size(text).alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"))
    return shards(pinned(rows), n).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
