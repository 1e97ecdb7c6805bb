"""Resampled refits, inclusion thresholds, transfer to unseen entities by hour."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosewise.operators import counts as K
from dosewise.operators import linear, ranking, resample
from dosewise.operators.linear import Setting
from dosewise.plans import benchmark, robustness
from dosewise.queries import base as B
from dosewise.queries.model_queries import PARTS, _pair, fit_body_sql
from dosewise.queries.registry import query
from dosewise.session import pinned

REPS = 2000
K_FOLDS = 5


def vectors_of(rows, keys, index="gene_idx"):
    """Dense control and delta values -> one row per key with arrays x and y."""
    packed = F.array_sort(F.collect_list(F.struct(index, "control", "delta")))  # one dictionary per key
    return rows.groupBy(*keys).agg(packed.alias("_p")).select(
        *keys, F.transform("_p", lambda e: e["control"]).alias("x"), F.transform("_p", lambda e: e["delta"]).alias("y")
    )


def dense_vectors(sums, keys, size):
    """Summed counts (keys + condition, gene_idx, total) -> x / y vectors of `size` features per key."""
    normal = K.normalised(sums, [*keys, "condition"], together=keys)
    sparse = K.condition_delta(normal, [*keys, "gene_idx"], "log1p_cpm")
    return vectors_of(K.densify(sparse, keys, "gene_idx", size, ["control", "delta"]), keys)


def brand_features(spark, sf):
    """Brand dictionary: (part key -> gene_idx lookup, number of brands)."""
    brands = B.table(spark, sf, "part").select(F.col("p_brand").alias("gene_symbol")).distinct()
    indexed = pinned(ranking.row_index(brands, [], [F.asc("gene_symbol")], "gene_idx", largest=B.DICTIONARY_BOUND))
    size = indexed.count()
    small = F.broadcast(indexed) if size <= B.DICTIONARY_BOUND else indexed
    parts = B.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("gene_symbol"))
    return parts.join(small, "gene_symbol").select("p_partkey", "gene_idx"), size


def brand_counts(spark, sf, parts):
    lines = B.count_lines(spark, sf).where(F.col("condition").isin("control", "treated"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")


def gains_sql(sums: str, folds: str) -> str:
    """Gain intervals from CTEs sums(variant, entity, condition, brand, total) and fo(variant, entity, fold)."""
    text = f"""WITH RECURSIVE {B.CELLS.strip()}, {B.SUPPLIERS.strip()},
br AS (SELECT p_brand AS brand, row_number() OVER (ORDER BY p_brand) AS b FROM (SELECT DISTINCT p_brand FROM part)),
cnt AS (SELECT l_suppkey AS entity, l_orderkey AS cell, CASE l_returnflag WHEN 'A' THEN 'control' ELSE 'treated' END AS condition, CAST(l_quantity AS BIGINT) AS x, p_brand AS brand, hour
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN cells ON l_orderkey = cell WHERE quality = 'normal' AND l_returnflag IN ('A', 'R')),
{sums},
nm AS (SELECT *, ln(1 + total * 1e6 / sum(total) OVER (PARTITION BY variant, entity, condition)) AS v FROM sums),
dl AS (SELECT variant, entity, brand, coalesce(sum(v) FILTER (condition = 'control'), 0) AS c, coalesce(sum(v) FILTER (condition = 'treated'), 0) AS t FROM nm GROUP BY ALL),
dn AS (SELECT variant, entity, b, coalesce(c, 0) AS c, coalesce(t, 0) - coalesce(c, 0) AS d FROM (SELECT DISTINCT variant, entity FROM dl) CROSS JOIN br LEFT JOIN dl USING (variant, entity, brand)),
{folds},
vec AS MATERIALIZED (SELECT variant || '/' || entity AS entity, any_value(entity) AS ent, variant, list(c ORDER BY b) AS x, list(d ORDER BY b) AS y FROM dn GROUP BY variant, dn.entity),
mf AS MATERIALIZED (SELECT variant || '|' || f AS model_fold, variant || '/' || entity AS entity, CASE WHEN fold = f THEN 'test' ELSE 'train' END AS role FROM fo, range({K_FOLDS}) t(f)),
{fit_body_sql(False)}{PARTS},
er AS (SELECT variant, ent AS entity, sqrt(avg(pow(my - y[target], 2))) - sqrt(avg(pow(my + dev - y[target], 2))) AS gain
  FROM dev JOIN ym USING (model_fold, target) JOIN vec USING (entity) WHERE d = 2 AND a = 100.0 GROUP BY ALL),
ps AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY md5(concat_ws('|', '{B.SEED}', entity)), entity) AS pos, count(*) OVER (PARTITION BY variant) AS n FROM er),
dr AS (SELECT variant, rep, {B.draw_sql('n', B.SEED, 'rep', 'pos')} + 1 AS pos FROM ps, range({REPS}) t(rep)),
mm AS (SELECT variant, rep, avg(gain) AS m FROM dr JOIN ps USING (variant, pos) GROUP BY ALL),
ci AS (SELECT variant, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM mm GROUP BY variant)
SELECT variant, round(avg(gain), 5) + 0.0 AS mean, count(*) AS n, round(any_value(ci_low), 5) + 0.0 AS ci_low, round(any_value(ci_high), 5) + 0.0 AS ci_high FROM er JOIN ci USING (variant) GROUP BY variant"""
    return text.replace("range(1, 33)", "range(1, 26)")


@query(gains_sql(
    f"""pick AS (SELECT CAST(r AS VARCHAR) AS variant, u.*, row_number() OVER (PARTITION BY r, entity, condition ORDER BY md5(concat_ws('|', '{B.SEED}', r, cell)), cell) AS rn
  FROM (SELECT DISTINCT entity, cell, condition FROM cnt) u, range(5) t(r)),
sums AS (SELECT variant, entity, condition, brand, sum(x) AS total FROM (SELECT * FROM pick WHERE rn <= 20) JOIN cnt USING (entity, cell, condition) GROUP BY ALL)""",
    f"""ss AS (SELECT lineage, count(*) AS n FROM suppliers GROUP BY lineage), st AS (SELECT lineage, sum(n) OVER (ORDER BY n DESC, lineage) - n AS start FROM ss),
fd AS (SELECT entity, (start + row_number() OVER (PARTITION BY lineage ORDER BY md5(concat_ws('|', '{B.SEED}', entity)), entity) - 1) % {K_FOLDS} AS fold FROM suppliers JOIN st USING (lineage)),
fo AS (SELECT variant, entity, fold FROM (SELECT DISTINCT variant, entity FROM dn) JOIN fd USING (entity))""",
))
def subsample_refit(spark, sf):
    """Twenty cells per entity and condition, five repeats, each re-aggregated and refitted on the same folds."""
    cells = B.entity_cells(spark, sf).where(F.col("condition").isin("control", "treated")).select("entity", "cell", "condition")
    chosen = resample.sample_cells(cells, ["entity", "condition"], ["cell"], 20, B.SEED, 5)
    keys = ["repeat", "entity"]
    parts, n = brand_features(spark, sf)
    picked = brand_counts(spark, sf, parts).join(chosen, ["entity", "cell", "condition"])
    rows = dense_vectors(K.pseudobulk(picked, [*keys, "condition"], "gene_idx"), keys, n)
    tagged = pinned(rows.join(B.suppliers(spark, sf).select("entity", "lineage"), "entity").withColumn("variant", F.col("repeat").cast("string")))
    keyed = pinned(robustness.keyed_variants(tagged, "lineage", K_FOLDS, B.SEED, shared_folds=True))
    losses = robustness.fixed_outer_losses(keyed, [str(r) for r in range(5)], K_FOLDS, dimension=2)
    return B.rounded(robustness.variant_gains(losses, B.SEED, REPS), 5)


@query(gains_sql(
    """su AS (SELECT entity, least(count(DISTINCT cell) FILTER (condition = 'control' AND hour = 24), count(DISTINCT cell) FILTER (condition = 'treated' AND hour = 24)) AS support FROM cnt GROUP BY entity),
sums AS (SELECT CAST(t AS VARCHAR) AS variant, entity, condition, brand, sum(x) AS total FROM cnt JOIN su USING (entity), (SELECT unnest([10, 20, 30]) AS t) WHERE support >= t GROUP BY ALL)""",
    f"""ve AS (SELECT DISTINCT variant, entity, lineage FROM dn JOIN suppliers USING (entity)), ss AS (SELECT variant, lineage, count(*) AS n FROM ve GROUP BY ALL),
st AS (SELECT variant, lineage, sum(n) OVER (PARTITION BY variant ORDER BY n DESC, lineage) - n AS start FROM ss),
fo AS (SELECT variant, entity, (start + row_number() OVER (PARTITION BY variant, lineage ORDER BY md5(concat_ws('|', '{B.SEED}', variant, entity)), entity) - 1) % {K_FOLDS} AS fold FROM ve JOIN st USING (variant, lineage))""",
))
def threshold_sweep(spark, sf):
    """Gain of the fixed model at inclusion thresholds 10 / 20 / 30 with folds dealt again."""
    parts, n = brand_features(spark, sf)
    counted = brand_counts(spark, sf, parts).join(B.good_cells(spark, sf), "cell")
    rows = dense_vectors(K.pseudobulk(counted, ["entity", "condition"], "gene_idx"), ["entity"], n)
    side = lambda c: F.count_if((F.col("condition") == c) & (F.col("hour") == 24))
    support = B.entity_cells(spark, sf).groupBy("entity").agg(F.least(side("control"), side("treated")).alias("support"))
    tagged = rows.join(support, "entity").join(B.suppliers(spark, sf).select("entity", "lineage"), "entity")
    variants = pinned(robustness.inclusion_variants(tagged, "support", (10, 20, 30)))
    keyed = pinned(robustness.keyed_variants(variants, "lineage", K_FOLDS, B.SEED))
    present = sorted(r[0] for r in keyed.select("variant").distinct().collect())  # one name per threshold
    losses = robustness.fixed_outer_losses(keyed, present, K_FOLDS, dimension=2)
    return B.rounded(robustness.variant_gains(losses, B.SEED, REPS), 5)


def _transfer_sql() -> str:
    text = f"""WITH RECURSIVE br AS (SELECT p_brand AS brand, row_number() OVER (ORDER BY p_brand) AS b FROM (SELECT DISTINCT p_brand FROM part)),
{B.CELLS.strip()}, {B.SUPPLIERS.strip()},
hs AS (SELECT l_suppkey AS entity, CASE l_returnflag WHEN 'A' THEN 'control' ELSE 'treated' END AS condition, hour, p_brand AS brand, sum(CAST(l_quantity AS BIGINT)) AS total
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN cells ON l_orderkey = cell WHERE quality = 'normal' AND l_returnflag IN ('A', 'R') GROUP BY ALL),
sc AS (SELECT entity, condition, CAST(hour AS INTEGER) AS hour, brand, total FROM hs UNION ALL SELECT entity, condition, 0, brand, sum(total) FROM hs GROUP BY ALL),
nm AS (SELECT *, ln(1 + total * 1e6 / sum(total) OVER (PARTITION BY entity, condition, hour)) AS v FROM sc),
dl AS (SELECT entity, hour, brand, coalesce(sum(v) FILTER (condition = 'control'), 0) AS c, coalesce(sum(v) FILTER (condition = 'treated'), 0) AS t FROM nm GROUP BY ALL),
dn AS (SELECT entity, hour, b, coalesce(c, 0) AS c, coalesce(t, 0) - coalesce(c, 0) AS d FROM (SELECT DISTINCT entity, hour FROM dl) CROSS JOIN br LEFT JOIN dl USING (entity, hour, brand)),
vec AS MATERIALIZED (SELECT entity, hour, n_regionkey > 0 AS train, list(c ORDER BY b) AS x, list(d ORDER BY b) AS y FROM dn JOIN suppliers USING (entity) GROUP BY entity, hour, n_regionkey),
xr AS MATERIALIZED (SELECT 'all' AS model_fold, entity, x AS e FROM vec WHERE train AND hour = 0), {_pair('px', 'xr')},
xmean AS (SELECT list(m ORDER BY i) AS mean FROM (SELECT i, avg(e[i]) AS m FROM xr, range(1, 33) t(i) GROUP BY i)),
z AS MATERIALIZED (SELECT entity, hour, train, component, (list_dot_product(x, v) - list_dot_product(mean, v)) / sqrt(lam) AS z FROM vec, px, xmean WHERE hour = 0 OR NOT train),
ym AS (SELECT t AS target, avg(y[t]) AS my, count(*) AS n FROM vec, range(1, 33) r(t) WHERE train AND hour = 0 GROUP BY t),
zy AS (SELECT component, t AS target, sum(z * y[t]) AS zy FROM z JOIN vec USING (entity, hour), range(1, 33) r(t) WHERE z.train AND hour = 0 GROUP BY ALL),
pr AS (SELECT entity, hour, target, any_value(my) AS my, any_value(my) + sum(z * zy / (n - 1 + 100.0)) AS p FROM z JOIN zy USING (component) JOIN ym USING (target) WHERE NOT train AND hour > 0 GROUP BY entity, hour, target)
SELECT entity, hour, round(sqrt(avg(pow(my - y[target], 2))), 5) AS rmse_mean, round(sqrt(avg(pow(p - y[target], 2))), 5) AS rmse_direct,
  round(sqrt(avg(pow(my - y[target], 2))) - sqrt(avg(pow(p - y[target], 2))), 5) + 0.0 AS gain FROM pr JOIN vec USING (entity, hour) GROUP BY entity, hour"""
    return text.replace("range(1, 33)", "range(1, 26)")


@query(_transfer_sql())
def transfer_by_hour(spark, sf):
    """Fit on pooled profiles of four regions, predict the fifth region's entities at every hour."""
    parts, size = brand_features(spark, sf)
    joined = brand_counts(spark, sf, parts).join(B.good_cells(spark, sf), "cell")
    hourly = pinned(K.pseudobulk(joined, ["entity", "condition", "hour"], "gene_idx"))
    pooled = hourly.groupBy("entity", "condition", "gene_idx").agg(F.sum("total").alias("total")).withColumn("hour", F.lit(0))
    rows = dense_vectors(hourly.unionByName(pooled), ["entity", "hour"], size)
    regions = B.suppliers(spark, sf).select("entity", "n_regionkey")
    rows = pinned(rows.join(regions, "entity"))
    training = rows.where("n_regionkey > 0 and hour = 0").select("entity", "x", "y")
    external = rows.where("hour > 0").join(training.select("entity"), "entity", "left_anti")
    named = external.withColumn("entity", F.concat_ws("/", "entity", "hour")).select("entity", "x", "y")
    empty = F.array().cast("array<string>")
    fitted = benchmark.fit(training.withColumn("test_of", empty).withColumn("held_of", empty), ["all"], 2)
    target = named.withColumn("test_of", F.array(F.lit("all")))
    settings = [Setting("mean", 0, 100.0), Setting("direct", 2, 100.0)]
    losses = linear.fold_predictions(target, fitted.models(), settings, ["all"], 2, losses=True)
    error = lambda s: F.max(F.when(F.col("setting") == s, F.col("rmse")))
    wide = losses.groupBy("entity").agg(error("mean").alias("rmse_mean"), error("direct").alias("rmse_direct"))
    key = F.split("entity", "/")
    return B.rounded(wide.select(
        key[0].cast("bigint").alias("entity"), key[1].cast("int").alias("hour"), "rmse_mean", "rmse_direct",
        (F.col("rmse_mean") - F.col("rmse_direct")).alias("gain"),
    ), 5)


@query("""
SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_cells, count(DISTINCT l_suppkey) AS n_features, CAST(sum(q) AS BIGINT) AS total, CAST(max(q) AS BIGINT) AS largest
FROM (SELECT l_orderkey, l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY ALL)""")
def matrix_roundtrip(spark, sf):
    """Counts written as a coordinate matrix file and scanned back with its checks."""
    import uuid

    from dosewise.session import ensure_checkpoint_dir
    from dosewise.sources import matrix

    rows = pinned(B.table(spark, sf, "lineitem").groupBy(
        (F.col("l_suppkey") + 1).alias("g"), (F.col("l_orderkey") + 1).alias("c")
    ).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("x")))
    shape = rows.agg(F.max("g"), F.max("c"), F.count(F.lit(1))).first()
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/matrix_{uuid.uuid4().hex}"
    lines = ["%%MatrixMarket matrix coordinate integer general", " ".join(str(v) for v in shape)]
    head = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "k int, value string")
    head.repartition(1).sortWithinPartitions("k").select("value").write.text(f"{folder}/head")
    rows.select(F.concat_ws(" ", "g", "c", "x").alias("value")).write.text(f"{folder}/rows")
    back = matrix.read_matrix(spark, f"{folder}/rows", "lineitem", header=f"{folder}/head")
    return back.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("cell_idx").alias("n_cells"), F.count_distinct("gene_idx").alias("n_features"),
        F.sum("x").alias("total"), F.max("x").alias("largest"),
    )


@query("""
SELECT vec_id AS entity, label, len(embedding) AS length, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 5) + 0.0 AS total FROM embeddings""")
def vector_roundtrip(spark, sf):
    """Vector table written with one float array per row and read back."""
    import uuid

    from dosewise.session import ensure_checkpoint_dir
    from dosewise.sources import tables

    rows = B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("entity"), "label", "embedding")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/vectors_{uuid.uuid4().hex}"
    tables.write_vectors(rows, folder, "embedding", expected_rows=rows.count())
    back = tables.read_vectors(spark, folder, "embedding")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return B.rounded(back.select("entity", "label", F.size("embedding").cast("bigint").alias("length"), total.alias("total")), 5)


@query(f"""
WITH {B.CELLS.strip()},{B.COUNTS}, chosen AS (SELECT cell FROM cells WHERE quality = 'normal' AND hour = 24), e AS (SELECT s_suppkey AS entity FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0)
SELECT cell, entity, condition, gene_id, x FROM counts SEMI JOIN chosen USING (cell) SEMI JOIN e USING (entity)""")
def selected_cells(spark, sf):
    """Count rows of the chosen cells and entities only (semi joins)."""
    chosen = B.good_cells(spark, sf).where("hour = 24")
    ids = B.suppliers(spark, sf).where("n_regionkey = 0").select("entity")
    return K.select_cells(B.counts(spark, sf), chosen).join(ids, "entity", "left_semi")
