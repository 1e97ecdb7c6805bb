"""CSV, JSON, vector, gene-set and model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewise.operators import contracts as C


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_annotations(spark: SparkSession, path: str, renames: dict[str, str], schema: str | None = None) -> DataFrame:
    """Annotation table with source names mapped to the library's names."""
    df = spark.read.csv(path, header=True, schema=schema) if path.endswith(".csv") else spark.read.parquet(path)
    return df.withColumnsRenamed(renames)


def write_vectors(df: DataFrame, path: str, vector: str, expected_rows: int | None = None) -> None:
    """Metadata plus one float array per row, zstd Parquet; all lengths must agree."""
    facts = [C.fact(df.agg(F.count_distinct(F.size(vector)).alias("k")), "one_length", F.max(F.col("k")) - 1)]
    if expected_rows is not None:
        facts.append(C.expected_count(df, expected_rows))
    C.require(C.report(facts))
    df.withColumn(vector, F.col(vector).cast("array<float>")).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_vectors(spark: SparkSession, path: str, vector: str | None = None) -> DataFrame:
    """Without a vector name only the metadata columns are scanned."""
    df = spark.read.parquet(path)
    if vector is not None:
        return df
    return df.select(*[f.name for f in df.schema if f.dataType.simpleString() != "array<float>"])


def write_report(df: DataFrame, path: str) -> None:
    """One-row run report as JSON."""
    df.write.mode("overwrite").json(path)


def report_json(df: DataFrame, out: str = "report") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines {status, collection, genes[]} -> (collection, symbol).

    Every collection must be frozen and non-empty, with unique symbols.
    """
    sets = spark.read.schema("status string, collection string, genes array<string>").json(path)
    rows = sets.select("collection", F.explode_outer("genes").alias("symbol"))
    C.require(C.report([
        C.all_true(sets, F.col("status") == "frozen", "frozen"),
        C.all_true(sets, F.size("genes") > 0, "not_empty"),
        C.unique_key(rows, ["collection", "symbol"], "unique_symbols"),
    ]))
    return rows


def write_model(df: DataFrame, path: str) -> None:
    """Fold models as Parquet, one directory per fold and part."""
    df.write.mode("overwrite").partitionBy("model_fold").parquet(path)


def read_model(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fold names such as 1/0 are strings, so partition types come from the schema."""
    return spark.read.schema(schema).parquet(path)
