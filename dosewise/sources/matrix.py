"""Coordinate count matrices, dictionaries and cell tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dosewise.operators import contracts as C
from dosewise.session import pinned

COUNT_SCHEMA = "gene_idx int, cell_idx int, x double"


def matrix_shape(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(features, cells, nonzeros) from the dimension line."""
    line = spark.read.text(path).where(~F.col("value").startswith("%")).first()[0]
    g, c, n = (int(v) for v in line.split())
    return g, c, n


def read_matrix(
    spark: SparkSession, path: str, source: str, check: bool = True, header: str | None = None
) -> DataFrame:
    """Coordinate file -> (source, gene_idx, cell_idx, x), 1-based indices.

    The dimension line comes back from the CSV reader as a data row; it is the
    only row whose indices equal the shape and whose value equals the count.
    A matrix split over many files keeps its comment and dimension lines in a
    file of their own, named by `header`.
    """
    shape = matrix_shape(spark, header or path)
    raw = spark.read.csv(path, sep=" ", comment="%", schema=COUNT_SCHEMA)
    if header is not None:
        return checked_counts(raw, shape, source, check)
    size_line = (F.col("gene_idx") == shape[0]) & (F.col("cell_idx") == shape[1]) & (F.col("x") == shape[2])
    # a real entry could carry the same three numbers, so one match is the header and any other is data
    repeats = raw.where(size_line).count()
    rows = raw.where(~size_line)
    if repeats > 1:
        rows = rows.unionByName(raw.where(size_line).limit(repeats - 1))
    return checked_counts(rows, shape, source, check)


def checked_counts(rows: DataFrame, shape: tuple[int, int, int], source: str, check: bool) -> DataFrame:
    if check:
        C.require(C.report([
            C.expected_count(rows, shape[2], "nonzero_count"),
            C.all_true(rows, (F.col("x") >= 0) & (F.col("x") == F.rint("x")), "integer_counts"),
            C.all_true(rows, F.col("gene_idx").between(1, shape[0]) & F.col("cell_idx").between(1, shape[1]), "in_shape"),
        ]))
    return rows.select(F.lit(source).alias("source"), "gene_idx", "cell_idx", F.col("x").cast("bigint").alias("x"))


def numbered_lines(spark: SparkSession, path: str, index: str) -> DataFrame:
    """(index, line): lines with their 1-based number, files in the order of their paths.

    Lines are numbered inside the blocks that tasks read, and the counts of the blocks before are added.
    """
    lines = pinned(spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at")))
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    offsets = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    number = F.col("before") + F.col("at") - F.col("first") + 1
    return lines.join(offsets, ["file", "block"]).select(number.alias(index), "line")


def read_indexed_lines(spark: SparkSession, path: str, names: list[str], sep: str = "\t", index: str = "idx") -> DataFrame:
    """Headerless text table with its 1-based line number (file order is the key); CSV lines may quote their fields."""
    numbered = numbered_lines(spark, path, index)
    if sep == ",":
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        parsed = F.from_csv("line", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"escape": '"'})
        fields = [parsed.getField(f"c{i}") for i in range(len(names))]
    else:
        fields = [F.try_element_at(F.split("line", sep), F.lit(i + 1)) for i in range(len(names))]
    return numbered.select(F.col(index).cast("int").alias(index), *[f.alias(n) for f, n in zip(fields, names, strict=True)])


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """Feature dictionary (gene_idx, gene_id, gene_symbol); ids are unique and present."""
    genes = read_indexed_lines(spark, path, ["gene_id", "gene_symbol"], index="gene_idx")
    C.require(C.report([C.unique_key(genes, ["gene_id"]), C.not_null(genes, ["gene_id"])]))
    return genes


def read_cells(spark: SparkSession, classification: str, barcodes: str, required: list[str]) -> DataFrame:
    """Cell table joined to the barcode file by line number; both must list the same cells in the same order."""
    codes = read_indexed_lines(spark, barcodes, ["barcode"], index="cell_idx")
    header = spark.read.csv(classification, header=True)
    lost = C.missing_columns(header, required)
    if lost:
        raise ValueError(f"missing columns: {lost}")
    names = header.columns
    # line 1 is the header, so data line k + 1 belongs to cell k
    table = (
        read_indexed_lines(spark, classification, names, sep=",", index="_line")
        .where(F.col("_line") > 1).withColumn("cell_idx", F.col("_line") - 1).drop("_line")
        .withColumnRenamed("barcode", "_stated")
    )
    joined = codes.join(table, "cell_idx", "full_outer")
    C.require(C.report([C.all_true(joined, F.col("barcode") == F.col("_stated"), "same_barcodes")]))
    return joined.drop("_stated")


def cell_summary(cells: DataFrame, source: str, quality: str = "quality") -> DataFrame:
    return cells.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col(quality) == "normal").alias("n_normal")
    )


def save_counts(counts: DataFrame, path: str) -> None:
    """Partitioned by source, so one source's scan prunes the rest."""
    counts.write.mode("overwrite").partitionBy("source").option("compression", "zstd").parquet(path)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Bucketed table: two of them on the same key join without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
