"""Feature statistics, mean predictors, neighbours, encoders and dispersion."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosewise.functions import arrays as A
from dosewise.operators import encoders, enrichment, folds, neighbors, summaries, vectors
from dosewise.queries import base as B
from dosewise.queries.registry import query
from dosewise.session import pinned

K = 5
# label folds: embeddings dealt by (label, md5 order)
EMB = f"""
emb AS (SELECT vec_id AS entity, label AS lineage, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
esizes AS (SELECT lineage, count(*) AS n FROM emb GROUP BY lineage),
estarts AS (SELECT lineage, sum(n) OVER (ORDER BY n DESC, lineage) - n AS start FROM esizes),
efold AS (SELECT entity, lineage, e, CAST((start + row_number() OVER (PARTITION BY lineage ORDER BY md5(concat_ws('|', '{B.SEED}', entity)), entity) - 1) % {K} AS INTEGER) AS fold
  FROM emb JOIN estarts USING (lineage)),
elong AS (SELECT entity, lineage, fold, i AS feature, e[i + 1] AS value FROM efold, range(64) t(i)),
xlong AS (SELECT * FROM elong WHERE feature < 32),
ylong AS (SELECT entity, lineage, fold, feature - 32 AS feature, value FROM elong WHERE feature >= 32)"""


def embedded_folds(spark, sf):
    rows = B.embedded(spark, sf)
    dealt = folds.deal_folds(rows.select("entity", "lineage"), "entity", "lineage", K, B.SEED)
    return rows.join(dealt.select("entity", "fold"), "entity")


def members(rows):
    return folds.membership(rows, "entity", "fold", K)


@query(f"""
WITH {B.response_sql()}, {B.SUPPLIERS.strip()},
st AS (SELECT lineage, gene_idx, avg(control) AS mean, var_pop(control) AS variance FROM response JOIN suppliers USING (entity) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY round(variance, 9) DESC, gene_idx) AS rank FROM st WHERE mean >= 0.1 AND variance > 1e-10)
SELECT lineage, gene_idx, round(mean, 6) AS mean, round(variance, 6) AS variance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 50""")
def variable_features(spark, sf):
    """Fifty most variable control features of every lineage."""
    rows = B.response(spark, sf).join(B.suppliers(spark, sf).select("entity", "lineage"), "entity")
    stats = vectors.feature_stats(rows, ["lineage"], "gene_idx", "control")
    top = vectors.variable_features(stats, ["lineage"], "gene_idx", 50)
    return B.rounded(top.select("lineage", "gene_idx", "mean", "variance", "rank"))


@query(f"""
WITH {B.profiles_sql('entity')}, n AS (SELECT condition, count(DISTINCT entity) AS n FROM sums GROUP BY condition),
s AS (SELECT condition, gene_id, sum(log1p_cpm) AS s, sum(log1p_cpm * log1p_cpm) AS q FROM profiles GROUP BY ALL)
SELECT condition, gene_id, round(s / n, 6) AS mean, round(greatest(q / n - (s / n) * (s / n), 0), 6) AS variance, n FROM s JOIN n USING (condition)""")
def sparse_feature_stats(spark, sf):
    """Mean and variance with implicit zeros from sums of stored entries only."""
    rows = pinned(B.profiles(spark, sf))
    sizes = rows.groupBy("condition").agg(F.count_distinct("entity").alias("n"))
    joined = rows.join(F.broadcast(sizes), "condition")  # one row per condition
    return B.rounded(vectors.sparse_feature_stats(joined, ["condition"], "gene_id", "log1p_cpm", "n"))


@query(f"""
WITH {EMB}
SELECT CAST(f AS INTEGER) AS model_fold, CAST(feature AS INTEGER) AS feature, round(avg(value), 6) + 0.0 AS global_mean
FROM ylong, range({K}) t(f) WHERE fold <> f GROUP BY ALL""")
def global_mean(spark, sf):
    """Mean training response per fold and feature."""
    rows = embedded_folds(spark, sf)
    long = vectors.to_long(rows, ["entity"], "y")
    return B.rounded(vectors.global_mean(vectors.train_rows(long, members(rows)), ["model_fold"], "feature", "value"))


@query(f"""
WITH {EMB}, tr AS (SELECT CAST(f AS INTEGER) AS model_fold, y.* FROM ylong y, range({K}) t(f) WHERE fold <> f),
g AS (SELECT model_fold, lineage, feature, avg(value) AS gm, count(*) AS n FROM tr GROUP BY ALL),
a AS (SELECT model_fold, feature, avg(value) AS am FROM tr GROUP BY ALL),
te AS (SELECT entity, lineage, fold AS model_fold FROM efold)
SELECT model_fold, entity, lineage, CAST(feature AS INTEGER) AS feature, round(CASE WHEN n >= 2 THEN gm ELSE am END, 6) + 0.0 AS predicted, NOT coalesce(n >= 2, false) AS fallback
FROM te JOIN a USING (model_fold) LEFT JOIN g USING (model_fold, lineage, feature)""")
def group_mean_fallback(spark, sf):
    """Lineage mean of training responses, global mean where support is too small."""
    rows = embedded_folds(spark, sf)
    long = vectors.to_long(rows, ["entity", "lineage"], "y")
    train = vectors.train_rows(long, members(rows))
    test = rows.select(F.col("fold").alias("model_fold"), "entity", "lineage")
    return B.rounded(vectors.group_mean_with_fallback(train, test, ["model_fold"], "lineage", "feature", "value"))


NEAR = f"""
WITH {EMB}, q AS (SELECT entity, fold, list_slice(e, 1, 32) AS x FROM efold),
p AS (SELECT a.fold AS model_fold, a.entity, b.entity AS neighbor, list_distance(a.x, b.x) AS d FROM q a JOIN q b ON a.fold <> b.fold),
w AS (SELECT *, row_number() OVER (PARTITION BY model_fold, entity ORDER BY d, neighbor) AS rn FROM p)"""


def _nearest(spark, sf):
    rows = pinned(embedded_folds(spark, sf))
    test = rows.select(F.col("fold").alias("model_fold"), "entity", "x")
    train = rows.join(members(rows).where("role = 'train'").select("model_fold", "entity"), "entity").select("model_fold", "entity", "x")
    return neighbors.nearest(test, train, ["model_fold"], "x"), rows


@query(f"""{NEAR}
SELECT w.model_fold, w.entity, neighbor, CAST(y.feature AS INTEGER) AS feature, round(y.value, 6) + 0.0 AS predicted FROM w JOIN ylong y ON y.entity = w.neighbor WHERE rn = 1""")
def nearest_neighbor(spark, sf):
    """Copy the response of the nearest training vector."""
    found, rows = _nearest(spark, sf)
    long = vectors.to_long(rows, ["entity"], "y").withColumnsRenamed({"entity": "neighbor", "value": "predicted"})
    return B.rounded(found.join(long, "neighbor").select("model_fold", "entity", "neighbor", "feature", "predicted"))


@query(f"{NEAR} SELECT model_fold, entity, neighbor, round(d, 6) AS novelty FROM w WHERE rn = 1")
def novelty(spark, sf):
    """Distance of each held-out vector to its nearest training vector."""
    found, _ = _nearest(spark, sf)
    return B.rounded(found.select("model_fold", "entity", "neighbor", F.col("distance").alias("novelty")))


@query("""
WITH d AS (SELECT doc_id AS entity, source AS category, lang AS model_fold FROM documents),
c AS (SELECT model_fold, list_sort(list(DISTINCT category)) AS categories FROM d JOIN labels ON doc_id = entity GROUP BY model_fold)
SELECT entity, model_fold, category, CAST(len(categories) AS INTEGER) AS width,
  CAST(coalesce(list_position(categories, category), 0) AS BIGINT) AS hot, NOT list_contains(categories, category) AS unseen
FROM d JOIN c USING (model_fold)""")
def one_hot(spark, sf):
    """Document sources encoded with the categories seen among labelled documents of the language."""
    docs = B.table(spark, sf, "documents").select(
        F.col("doc_id").alias("entity"), F.col("source").alias("category"), F.col("lang").alias("model_fold")
    )
    seen = docs.join(B.table(spark, sf, "labels").select(F.col("doc_id").alias("entity")), "entity", "left_semi")
    coded = encoders.one_hot(docs, encoders.training_categories(seen, ["model_fold"], "category"), ["model_fold"], "category")
    return coded.select(
        "entity", "model_fold", "category", F.size("encoded").alias("width"),
        F.array_position("encoded", F.lit(1)).alias("hot"), (~F.array_contains("encoded", 1)).alias("unseen"),
    )


@query("""
WITH d AS (SELECT lang AS model_fold, doc_id AS entity, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic FROM labels JOIN documents USING (doc_id)),
l AS (SELECT model_fold, entity, covariate, value FROM d UNPIVOT (value FOR covariate IN (quality, toxic))),
s AS (SELECT model_fold, covariate, avg(value) AS mean, stddev_pop(value) AS sd FROM l GROUP BY ALL HAVING stddev_pop(value) > 1e-12)
SELECT model_fold, entity, covariate, round((value - mean) / sd, 6) AS standardised FROM l JOIN s USING (model_fold, covariate)""")
def standardize_binary(spark, sf):
    """0/1 covariates standardised per language; constant ones dropped."""
    docs = B.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("model_fold"))
    rows = B.table(spark, sf, "labels").join(docs, "doc_id").withColumnRenamed("doc_id", "entity")
    columns = ["quality", "toxic"]
    scales = encoders.binary_scales(rows, ["model_fold"], columns)
    coded = encoders.standardise(rows, scales, ["model_fold"], "entity", columns)
    return B.rounded(coded.select("model_fold", "entity", "covariate", "standardised"))


@query(f"""
WITH {B.response_sql('entity, hour')}, v AS (SELECT hour, gene_idx, var_samp(delta) AS v FROM response GROUP BY ALL)
SELECT hour, round(sqrt(avg(v)), 6) AS dispersion, count(v) AS n_features FROM v GROUP BY hour""")
def dispersion(spark, sf):
    """RMS over features of the between-entity SD of responses, per hour."""
    rows = B.response(spark, sf, ("entity", "hour"))
    return B.rounded(vectors.dispersion(rows, ["hour"], "gene_idx", "delta"))


@query(f"""
WITH {B.response_sql('entity, hour')}, m AS (SELECT hour, gene_idx, avg(delta) AS m FROM response GROUP BY ALL)
SELECT entity, hour, round(sqrt(avg(delta * delta)), 6) AS response_rms, round(sqrt(avg(pow(delta - m, 2))), 6) AS rmse_to_mean
FROM response JOIN m USING (hour, gene_idx) GROUP BY entity, hour""")
def magnitude_rows(spark, sf):
    """Response size and distance to the hourly mean response."""
    rows = pinned(B.response(spark, sf, ("entity", "hour")))
    return B.rounded(vectors.magnitude(rows, ["entity"], ["hour"], "gene_idx", "delta"))


@query(f"""
WITH {B.response_sql('entity, hour')}
SELECT entity, hour, collection, round(avg(delta), 6) + 0.0 AS score, count(DISTINCT gene_idx) AS mapped FROM response GROUP BY ALL""")
def set_score(spark, sf):
    """Mean response of each feature set per entity and hour."""
    rows = B.response(spark, sf, ("entity", "hour"))
    features = B.genes(spark, sf).select("collection", "gene_idx")
    return B.rounded(enrichment.set_scores(rows, features, ["entity", "hour"], "gene_idx"))


@query(f"""
WITH {B.response_sql('entity, hour')}, s AS (SELECT entity, hour, collection, avg(delta) AS score FROM response GROUP BY ALL),
p AS (SELECT entity || '/' || collection AS key, avg(score) FILTER (hour IN (3, 6)) AS early, avg(score) FILTER (hour IN (24, 48)) AS late FROM s GROUP BY ALL)
SELECT key, round(early, 6) + 0.0 AS early, round(late, 6) + 0.0 AS late, round(late - early, 6) + 0.0 AS late_minus_early FROM p""")
def period_difference(spark, sf):
    """Late minus early set score per entity and set."""
    keyed = set_score_raw(spark, sf).withColumn("key", F.concat_ws("/", "entity", "collection"))
    return B.rounded(summaries.period_difference(keyed, "key", "hour", "score"))


def set_score_raw(spark, sf):
    rows = B.response(spark, sf, ("entity", "hour"))
    return enrichment.set_scores(rows, B.genes(spark, sf).select("collection", "gene_idx"), ["entity", "hour"], "gene_idx")


@query(f"""
WITH {B.response_sql('entity, hour')}, s AS (SELECT entity, hour, collection, avg(delta) AS score FROM response GROUP BY ALL),
a AS (SELECT hour, collection, avg(score) AS mean, stddev_samp(score) / sqrt(count(*)) AS sem, count(*) AS n FROM s GROUP BY ALL)
SELECT hour, collection, round(mean, 6) + 0.0 AS mean, round(mean - 1.96 * sem, 6) + 0.0 AS low, round(mean + 1.96 * sem, 6) + 0.0 AS high, n FROM a""")
def hour_mean_sem(spark, sf):
    """Mean set score per hour with 1.96 standard errors."""
    return B.rounded(summaries.mean_with_sem(set_score_raw(spark, sf), ["hour", "collection"], "score"))


@query("""
WITH e AS (SELECT vec_id AS entity, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
d AS (SELECT entity, label, list_slice(e, 1, 32) AS x, list_slice(e, 33, 64) AS y FROM e)
SELECT entity, round(list_dot_product(x, y), 6) + 0.0 AS dot, round(sqrt(list_dot_product(x, x)), 6) AS norm_x, round(sqrt(list_dot_product(y, y)), 6) AS norm_y,
  round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 6) + 0.0 AS cosine,
  round(sqrt(list_dot_product(y, y) / 32 + list_dot_product(x, x) / 32 - 2 * list_dot_product(x, y) / 32), 6) AS delta_rms FROM d""")
def vector_geometry(spark, sf):
    """Array-layout dot, norms, cosine and RMS of the difference."""
    rows = B.embedded(spark, sf)
    delta = A.subtract("y", "x")
    return B.rounded(rows.select(
        "entity", A.dot("x", "y").alias("dot"), A.norm("x").alias("norm_x"), A.norm("y").alias("norm_y"),
        A.cosine("x", "y").alias("cosine"), (A.norm(delta) / (32 ** 0.5)).alias("delta_rms"),
    ))
