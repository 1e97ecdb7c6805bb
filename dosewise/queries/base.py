"""The given tables read as perturbation data, and the same views in SQL.

supplier = entity, its nation = lineage, order = cell (status P = bad cell),
return flag = condition, order priority = hour, brand/type of the part =
feature (brand = symbol, type = feature set), quantity = count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewise.functions import scalar as S
from dosewise.operators import counts as K
from dosewise.operators import ranking
from dosewise.session import pinned

# Literal maps from the given tables to the domain.
CONDITIONS = {"A": "control", "R": "treated", "N": "untreated"}
PRIORITY_HOURS = {"1-URGENT": 3, "2-HIGH": 6, "3-MEDIUM": 12, "4-NOT SPECIFIED": 24, "5-LOW": 48}
BAD_STATUS = "P"
# The feature dictionary is brands x types: it does not grow with the tables.
DICTIONARY_BOUND = 100_000
# Count rows of one part when they are dealt by cell.
LINES_A_PART = 500_000
SEED = 52711


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; -0.0 becomes 0.0."""
    return df.select(*[
        (F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


def part_genes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("gene_id"),
        F.col("p_brand").alias("gene_symbol"), F.col("p_type").alias("collection"),
    )


def genes(spark: SparkSession, sf: str) -> DataFrame:
    ids = part_genes(spark, sf).drop("p_partkey").distinct()
    indexed = ranking.row_index(ids, [], [F.asc("gene_id")], "gene_idx", largest=DICTIONARY_BOUND)
    return pinned(indexed.withColumn("gene_idx", F.col("gene_idx").cast("int")))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("cell"),
        F.when(F.col("o_orderstatus") == BAD_STATUS, "low_quality").otherwise("normal").alias("quality"),
        S.literal_map("o_orderpriority", PRIORITY_HOURS).alias("hour"),
    )


def dictionary(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """(features, their number); marked for broadcast once the count is within its bound."""
    table_ = genes(spark, sf)
    n = table_.count()
    return (F.broadcast(table_) if n <= DICTIONARY_BOUND else table_), n


def count_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Count rows before their features are looked up."""
    return table(spark, sf, "lineitem").select(
        "l_partkey", F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("cell"),
        S.literal_map("l_returnflag", CONDITIONS).alias("condition"),
        F.col("l_quantity").cast("bigint").alias("x"),
    )


def counts(spark: SparkSession, sf: str, features: DataFrame | None = None) -> DataFrame:
    """Count rows with their gene_id, or with the gene_idx of a dictionary."""
    parts = part_genes(spark, sf).select("p_partkey", "gene_id")
    if features is not None:
        parts = parts.join(features.select("gene_id", "gene_idx"), "gene_id").select("p_partkey", "gene_idx")
    lines = count_lines(spark, sf)
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")


def good_cells(spark: SparkSession, sf: str) -> DataFrame:
    good = table(spark, sf, "orders").where(F.col("o_orderstatus") != BAD_STATUS)  # reaches the Parquet scan
    return good.select(F.col("o_orderkey").alias("cell"), S.literal_map("o_orderpriority", PRIORITY_HOURS).alias("hour"))


def entity_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (entity, cell, condition, hour) of good cells; needs no feature lookup.

    Rows are dealt by cell once, for the distinct, the join and counts of cells; the more rows, the more parts.
    """
    lines = count_lines(spark, sf).select("entity", "cell", "condition")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES_A_PART))
    return lines.repartition(parts, "cell").distinct().join(good_cells(spark, sf).repartition(parts, "cell"), "cell")


def observed(spark: SparkSession, sf: str, features: DataFrame | None = None) -> DataFrame:
    """Counts of good cells with their hour."""
    return counts(spark, sf, features).join(good_cells(spark, sf), "cell")


def profiles(spark: SparkSession, sf: str, keys: tuple[str, ...] = ("entity", "condition"),
             features: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Normalised sparse profiles per key."""
    feature = "gene_id" if features is None else "gene_idx"
    together = [k for k in keys if k != "condition"] if features is not None else None
    return K.normalised(K.pseudobulk(observed(spark, sf, features), list(keys), feature), list(keys), together, parts)


def response(spark: SparkSession, sf: str, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Dense control / treated / delta values per key and gene_idx."""
    features, n = dictionary(spark, sf)
    groups = K.count_pairs(entity_cells(spark, sf), list(keys))
    paired = profiles(spark, sf, (*keys, "condition"), features, K.dense_parts(features, groups, n))
    sparse = K.condition_delta(paired, [*keys, "gene_idx"], "log1p_cpm")
    return K.densify(sparse, list(keys), "gene_idx", n, ["control", "treated", "delta"])


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("lineage"), "n_regionkey")
    return table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("entity"), F.col("s_name").alias("entity_id"), "lineage", "n_regionkey",
        F.col("s_acctbal").alias("sensitivity"),
    )


def embedded(spark: SparkSession, sf: str) -> DataFrame:
    """Vector rows: control half x, response half y, lineage label."""
    v = F.col("embedding").cast("array<double>")
    half = F.floor(F.size(v) / 2).cast("int")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("entity"), F.col("label").alias("lineage"), F.slice(v, F.lit(1), half).alias("x"), F.slice(v, half + 1, F.size(v) - half).alias("y"),
    )


# --- the same views in SQL --------------------------------------------------

GENES = """
genes AS (
  SELECT gene_id, gene_symbol, collection, CAST(row_number() OVER (ORDER BY gene_id) AS INTEGER) AS gene_idx
  FROM (SELECT DISTINCT p_brand || '/' || p_type AS gene_id, p_brand AS gene_symbol, p_type AS collection FROM part))"""
CELLS = """
cells AS (
  SELECT o_orderkey AS cell, CASE WHEN o_orderstatus = 'P' THEN 'low_quality' ELSE 'normal' END AS quality,
    CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 6 WHEN '3-MEDIUM' THEN 12
      WHEN '4-NOT SPECIFIED' THEN 24 WHEN '5-LOW' THEN 48 END AS hour
  FROM orders)"""
COUNTS = """
counts AS (
  SELECT l_suppkey AS entity, l_orderkey AS cell,
    CASE l_returnflag WHEN 'A' THEN 'control' WHEN 'R' THEN 'treated' WHEN 'N' THEN 'untreated' END AS condition,
    CAST(l_quantity AS BIGINT) AS x, p_brand || '/' || p_type AS gene_id
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
OBS = CELLS + "," + COUNTS + """,
obs AS (SELECT c.*, hour FROM counts c JOIN cells USING (cell) WHERE quality = 'normal')"""


def profiles_sql(keys: str) -> str:
    return f"""{OBS},
sums AS (SELECT {keys}, condition, gene_id, CAST(sum(x) AS BIGINT) AS total FROM obs GROUP BY {keys}, condition, gene_id),
profiles AS (
  SELECT *, CAST(sum(total) OVER (PARTITION BY {keys}, condition) AS BIGINT) AS library_size,
    ln(1 + total * 1e6 / sum(total) OVER (PARTITION BY {keys}, condition)) AS log1p_cpm FROM sums)"""


def response_sql(keys: str = "entity") -> str:
    return f"""{GENES},{profiles_sql(keys)},
grid AS (SELECT {keys}, gene_idx, gene_id, gene_symbol, collection FROM (SELECT DISTINCT {keys} FROM sums WHERE condition IN ('control', 'treated')) CROSS JOIN genes),
sides AS (
  SELECT {keys}, gene_id, coalesce(sum(log1p_cpm) FILTER (condition = 'control'), 0) AS control,
    coalesce(sum(log1p_cpm) FILTER (condition = 'treated'), 0) AS treated
  FROM profiles WHERE condition IN ('control', 'treated') GROUP BY {keys}, gene_id),
response AS (
  SELECT {keys}, gene_idx, gene_id, gene_symbol, collection, coalesce(control, 0) AS control, coalesce(treated, 0) AS treated,
    coalesce(treated, 0) - coalesce(control, 0) AS delta
  FROM grid LEFT JOIN sides USING ({keys}, gene_id))"""


SUPPLIERS = """
suppliers AS (
  SELECT s_suppkey AS entity, s_name AS entity_id, n_name AS lineage, n_regionkey, s_acctbal AS sensitivity
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def pearson_sql(x: str, y: str) -> str:
    return (
        f"CASE WHEN max({x}) = min({x}) OR max({y}) = min({y}) THEN NULL "
        f"ELSE covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"
    )


def hash_sql(seed: int | str, *parts: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(parts)}))"


def draw_sql(n: str, seed: int | str, *parts: str) -> str:
    return f"(CAST(('0x' || substr({hash_sql(seed, *parts)}, 1, 15)) AS BIGINT) % {n})"
