"""PCA, ridge, nested cross-validation, low-rank models, transfer.

The SQL side finds eigenvectors by repeated squaring of the covariance matrix
(recursive CTE), so leading components have an independent exact check.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dosewise.operators import enrichment, linear, metrics, vectors
from dosewise.operators.linear import Setting
from dosewise.plans import ablation, benchmark, robustness
from dosewise.queries import base as B
from dosewise.queries.registry import query
from dosewise.queries.vector_queries import EMB
from dosewise.session import pinned

K_OUTER, K_INNER = 5, 4
GRID = benchmark.Grid(dimensions=(1, 2), alphas=(1.0, 10.0, 100.0), ranks=(1, 2))
# squarings: the matrix is raised to 2**24
SQUARINGS = 24


def _matrix(name: str, rows: str) -> str:
    """CTE name(model_fold, m): 32 x 32 training covariance from rows(model_fold, entity, e)."""
    return f"""
{name}_c AS MATERIALIZED (SELECT model_fold, i, j, covar_samp(e[i], e[j]) AS c FROM {rows}, range(1, 33) a(i), range(1, 33) b(j) GROUP BY ALL),
{name} AS (SELECT model_fold, list(r ORDER BY i) AS m FROM (SELECT model_fold, i, list(c ORDER BY j) AS r FROM {name}_c GROUP BY ALL) GROUP BY model_fold)"""


def _leading(name: str, matrix: str) -> str:
    """CTE name(model_fold, v, lam): leading eigenpair of matrix(model_fold, m), largest loading positive."""
    return f"""
{name}_p(model_fold, k, m) AS (
  SELECT model_fold, 0, m FROM {matrix}
  UNION ALL SELECT model_fold, k + 1, list_transform(s, lambda r: list_transform(r, lambda x: x / list_sum(list_transform(range(1, 33), lambda i: s[i][i]))))
  FROM (SELECT model_fold, k, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b))) AS s FROM {name}_p WHERE k < {SQUARINGS})),
{name}_r AS (SELECT model_fold, m[list_position(list_transform(range(1, 33), lambda i: m[i][i]), list_max(list_transform(range(1, 33), lambda i: m[i][i])))] AS r FROM {name}_p WHERE k = {SQUARINGS}),
{name}_n AS (SELECT model_fold, list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS u FROM {name}_r),
{name}_v AS (SELECT model_fold, list_transform(u, lambda x: x * CASE WHEN u[list_position(list_transform(u, lambda y: abs(y)), list_max(list_transform(u, lambda y: abs(y))))] < 0 THEN -1 ELSE 1 END) AS v FROM {name}_n),
{name} AS (SELECT model_fold, v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS lam FROM {name}_v JOIN {matrix} USING (model_fold))"""


def _deflated(name: str, matrix: str, leading: str) -> str:
    return f"""
{name} AS (SELECT model_fold, list_transform(range(1, 33), lambda i: list_transform(range(1, 33), lambda j: m[i][j] - lam * v[i] * v[j])) AS m FROM {matrix} JOIN {leading} USING (model_fold))"""


def _pair(prefix: str, rows: str, mask: str | None = None) -> str:
    """CTE prefix(model_fold, component, v, lam) with two components.

    `mask(model_fold, s)` holds 0/1 per feature and limits the matrix.
    """
    whole = _matrix(f"{prefix}m1", rows)
    if mask:
        whole = _matrix(f"{prefix}m0", rows) + f""",
{prefix}m1 AS (SELECT model_fold, list_transform(range(1, 33), lambda i: list_transform(range(1, 33), lambda j: m[i][j] * s[i] * s[j])) AS m FROM {prefix}m0 JOIN {mask} USING (model_fold))"""
    return (
        whole + "," + _leading(f"{prefix}e1", f"{prefix}m1") + ","
        + _deflated(f"{prefix}m2", f"{prefix}m1", f"{prefix}e1") + "," + _leading(f"{prefix}e2", f"{prefix}m2")
        + f", {prefix} AS MATERIALIZED (SELECT model_fold, 1 AS component, v, lam FROM {prefix}e1 UNION ALL SELECT model_fold, 2, v, lam FROM {prefix}e2)"
    )


MEMBERS = f"""{EMB},
itr AS (SELECT entity, lineage, CAST(f AS INTEGER) AS outer_fold FROM efold, range({K_OUTER}) t(f) WHERE f <> fold),
isz AS (SELECT outer_fold, lineage, count(*) AS n FROM itr GROUP BY ALL),
ist AS (SELECT outer_fold, lineage, sum(n) OVER (PARTITION BY outer_fold ORDER BY n DESC, lineage) - n AS start FROM isz),
inn AS (SELECT entity, outer_fold, CAST((start + row_number() OVER (PARTITION BY outer_fold, lineage ORDER BY md5(concat_ws('|', '{B.SEED}', outer_fold, entity)), entity) - 1) % {K_INNER} AS INTEGER) AS inner_fold
  FROM itr JOIN ist USING (outer_fold, lineage)),
outer_m AS (SELECT CAST(f AS VARCHAR) AS model_fold, entity, CASE WHEN fold = f THEN 'test' ELSE 'train' END AS role FROM efold, range({K_OUTER}) t(f)),
inner_m AS (SELECT outer_fold || '/' || i AS model_fold, entity, CASE WHEN inner_fold = i THEN 'test' ELSE 'train' END AS role FROM inn, range({K_INNER}) t(i))"""


def _fitted_sql(members: str, response: bool = True) -> str:
    """CTEs: z scores, ridge cross products and both PCAs for every fold in `members`."""
    return f"""{MEMBERS}, mf AS MATERIALIZED ({members}),
vec AS MATERIALIZED (SELECT entity, lineage, list_slice(e, 1, 32) AS x, list_slice(e, 33, 64) AS y FROM efold),
{fit_body_sql(response)}"""


def fit_body_sql(response: bool = True, mask: str | None = None, mask_ctes: str = "") -> str:
    """The fits given mf(model_fold, entity, role) and vec(entity, x, y)."""
    text = f"""xr AS MATERIALIZED (SELECT model_fold, entity, x AS e FROM mf JOIN vec USING (entity) WHERE role = 'train'),
{mask_ctes}{_pair('px', 'xr', mask)},
xmean AS (SELECT model_fold, list(m ORDER BY i) AS mean FROM (SELECT model_fold, i, avg(e[i]) AS m FROM xr, range(1, 33) t(i) GROUP BY ALL) GROUP BY model_fold),
z AS MATERIALIZED (SELECT model_fold, entity, role, component, (list_dot_product(x, v) - list_dot_product(mean, v)) / sqrt(lam) AS z FROM mf JOIN vec USING (entity) JOIN px USING (model_fold) JOIN xmean USING (model_fold)),
ntr AS (SELECT model_fold, count(*) AS n FROM mf WHERE role = 'train' GROUP BY 1),
ym AS MATERIALIZED (SELECT model_fold, t AS target, avg(y[t]) AS my FROM mf JOIN vec USING (entity), range(1, 33) r(t) WHERE role = 'train' GROUP BY ALL),
zy AS MATERIALIZED (SELECT model_fold, component, t AS target, sum(z * y[t]) AS zy FROM z JOIN vec USING (entity), range(1, 33) r(t) WHERE role = 'train' GROUP BY ALL)"""
    if response:
        text += f""",
yr AS MATERIALIZED (SELECT model_fold, entity, y AS e FROM mf JOIN vec USING (entity) WHERE role = 'train'),
{_pair('py', 'yr')}"""
    return text


# part(d, alpha): the direct prediction minus the training mean
PARTS = """,
grid AS (SELECT d.d, a.a FROM (SELECT unnest([1, 2]) AS d) d, (SELECT unnest([1.0, 10.0, 100.0]) AS a) a),
dev AS MATERIALIZED (SELECT model_fold, entity, d, a, target, sum(z * zy / (n - 1 + a)) AS dev FROM z JOIN zy USING (model_fold, component) JOIN ntr USING (model_fold) JOIN grid ON component <= d
  WHERE role = 'test' GROUP BY ALL)"""
LOSSES = PARTS + """,
dl AS (SELECT model_fold, entity, 'direct' AS setting, d AS dimension, 0 AS rank, a AS alpha, sqrt(avg(pow(my + dev - y[target], 2))) AS rmse FROM dev JOIN ym USING (model_fold, target) JOIN vec USING (entity) GROUP BY ALL),
sc AS (SELECT model_fold, entity, d, a, component, sum(dev * v[target]) AS s FROM dev JOIN py USING (model_fold) GROUP BY ALL),
lr AS (SELECT model_fold, entity, d, a, r AS rk, target, sum(s * v[target]) AS dev FROM sc JOIN py USING (model_fold, component), range(1, 33) t(target), range(1, 3) q(r) WHERE component <= r GROUP BY ALL),
ll AS (SELECT model_fold, entity, 'low_rank' AS setting, d AS dimension, rk AS rank, a AS alpha, sqrt(avg(pow(my + dev - y[target], 2))) AS rmse FROM lr JOIN ym USING (model_fold, target) JOIN vec USING (entity) GROUP BY ALL),
losses AS MATERIALIZED (SELECT * FROM dl UNION ALL SELECT * FROM ll)"""

BOTH = "SELECT * FROM outer_m UNION ALL SELECT * FROM inner_m"
OUTER_ONLY = "SELECT * FROM outer_m"


def nested(spark, sf):
    rows, names, _, _ = benchmark.nested_rows(B.embedded(spark, sf), "entity", "lineage", K_OUTER, K_INNER, B.SEED)
    return rows, names


def outer_fit(spark, sf, components: int = 2, ranks: int = 2) -> benchmark.Fitted:
    rows, names = benchmark.outer_rows(B.embedded(spark, sf), "entity", "lineage", K_OUTER, B.SEED)
    return benchmark.fit(rows, names, components, ranks)


@query(f"""WITH RECURSIVE {MEMBERS}, xr AS (SELECT model_fold, entity, list_slice(e, 1, 32) AS e FROM outer_m JOIN efold USING (entity) WHERE role = 'train'),
{_matrix('m', 'xr')}
SELECT model_fold, round(list_sum(list_transform(range(1, 33), lambda i: m[i][i])), 6) AS total_variance,
  round(list_sum(list_transform(m, lambda r: list_dot_product(r, r))), 6) AS squared_variance, 32 AS components, 1.0::DOUBLE AS explained FROM m""")
def pca_variance(spark, sf):
    """Eigenvalue sums of the full PCA per fold (trace and squared norm of the covariance)."""
    fitted = outer_fit(spark, sf, components=32, ranks=0)
    return B.rounded(fitted.control.groupBy("model_fold").agg(
        F.sum("eigenvalue").alias("total_variance"), F.sum(F.col("eigenvalue") * F.col("eigenvalue")).alias("squared_variance"),
        F.count(F.lit(1)).cast("int").alias("components"), F.sum("explained_ratio").alias("explained"),
    ))


@query(f"""WITH RECURSIVE {_fitted_sql(OUTER_ONLY, False)}
SELECT model_fold, entity, role, component, round(z, 5) + 0.0 AS z FROM z""")
def pca_scores(spark, sf):
    """Whitened scores of all rows under every fold's control PCA."""
    fitted = outer_fit(spark, sf, ranks=0)
    z = linear.scores(fitted.rows, fitted.control, "x", fitted.folds, whiten=True)
    long = z.select("model_fold", "entity", "role", F.posexplode("z").alias("component", "z"))
    return B.rounded(long.withColumn("component", F.col("component") + 1), 5)


@query(f"""WITH RECURSIVE {_fitted_sql(OUTER_ONLY, False)},
l AS (SELECT model_fold, component, t - 1 AS feature, round(v[t], 7) AS loading FROM px, range(1, 33) r(t)),
k AS (SELECT *, row_number() OVER (PARTITION BY model_fold, component ORDER BY loading, feature) AS lo, row_number() OVER (PARTITION BY model_fold, component ORDER BY loading DESC, feature) AS hi FROM l)
SELECT model_fold, component, CAST(feature AS INTEGER) AS feature, round(loading, 5) + 0.0 AS loading, CAST(rank AS INTEGER) AS rank, direction FROM (
  SELECT *, lo AS rank, 'negative' AS direction FROM k WHERE lo <= 10 UNION ALL SELECT *, hi, 'positive' FROM k WHERE hi <= 10)""")
def pca_loadings(spark, sf):
    """Ten most negative and most positive loadings per fold and component."""
    fitted = outer_fit(spark, sf, ranks=0)
    loadings = linear.tall_loadings(fitted.control).withColumn("loading", F.round("loading", 7))
    top = enrichment.top_loadings(loadings, ["model_fold", "component"], "loading", "feature", 10)
    return B.rounded(top, 5)


@query("""
WITH RECURSIVE v AS (SELECT vec_id AS entity, list_transform(list_slice(embedding, 33, 64), lambda q: CAST(q AS DOUBLE)) AS e, 'all' AS model_fold FROM embeddings),
""" + _pair("p", "v") + """, mean AS (SELECT list(m ORDER BY i) AS mean FROM (SELECT i, avg(e[i]) AS m FROM v, range(1, 33) t(i) GROUP BY i)),
tr AS (SELECT list_sum(list_transform(range(1, 33), lambda i: m[i][i])) AS tr FROM pm1)
SELECT entity, component, round(list_dot_product(e, p.v) - list_dot_product(mean, p.v), 5) + 0.0 AS score, round(lam / tr, 6) AS explained_ratio FROM v, p, mean, tr""")
def descriptive_pca(spark, sf):
    """Two-component PCA of all response vectors, no folds, with explained ratios."""
    empty = F.array().cast("array<string>")
    rows = B.embedded(spark, sf).withColumn("test_of", empty).withColumn("held_of", empty)
    pca = pinned(linear.fit_pca(rows, "y", ["all"], 2))
    z = linear.scores(rows, pca, "y", ["all"], whiten=False, out="score")
    long = z.select("entity", F.posexplode("score").alias("component", "score")).withColumn("component", F.col("component") + 1)
    joined = long.join(pca.select("component", "explained_ratio"), "component")
    return B.rounded(joined.select("entity", "component", F.round("score", 5).alias("score"), "explained_ratio"))


@query(f"""WITH RECURSIVE {_fitted_sql(OUTER_ONLY, False)}{PARTS}
SELECT model_fold, entity, CAST(target - 1 AS INTEGER) AS feature, round(my + dev, 5) + 0.0 AS predicted FROM dev JOIN ym USING (model_fold, target) WHERE d = 2 AND a = 10.0""")
def ridge_fit_predict(spark, sf):
    """Held-out ridge predictions from two whitened components at one penalty."""
    fitted = outer_fit(spark, sf, ranks=0)
    out = linear.fold_predictions(fitted.rows, fitted.models(), [Setting("direct", 2, 10.0)], fitted.folds, 2)
    return B.rounded(vectors.to_long(out, ["model_fold", "entity"], "predicted", value="predicted"), 5)


@query(f"""WITH RECURSIVE {_fitted_sql(OUTER_ONLY, False)}
SELECT model_fold, CAST(dimension AS INTEGER) AS dimension, alpha, CAST(component AS INTEGER) AS component, CAST(target - 1 AS INTEGER) AS target, round(value, 5) + 0.0 AS value FROM (
  SELECT model_fold, 2 AS dimension, 10.0::DOUBLE AS alpha, component, target, zy / (n - 1 + 10.0) AS value FROM zy JOIN ntr USING (model_fold)
  UNION ALL SELECT model_fold, 2, 10.0, 0, target, my FROM ym)""")
def ridge_coefficients(spark, sf):
    """Coefficient table per fold, component and target; component 0 is the intercept."""
    fitted = outer_fit(spark, sf, ranks=0)
    return B.rounded(linear.ridge_coefficients(fitted.moments, [(2, 10.0)]), 5)


@query(f"""WITH RECURSIVE {_fitted_sql(OUTER_ONLY)}{LOSSES},
g AS (SELECT model_fold, entity, d, a, target, sum(s * v[target]) AS dev FROM sc JOIN py USING (model_fold, component), range(1, 33) t(target) WHERE d = 2 AND a = 10.0 GROUP BY ALL)
SELECT model_fold, entity, CAST(target - 1 AS INTEGER) AS feature, round(my + dev, 5) + 0.0 AS predicted FROM g JOIN ym USING (model_fold, target)""")
def low_rank_predict(spark, sf):
    """Held-out predictions through a rank-two response space."""
    fitted = outer_fit(spark, sf)
    out = linear.fold_predictions(fitted.rows, fitted.models(), [Setting("low_rank", 2, 10.0, 2)], fitted.folds, 2)
    return B.rounded(vectors.to_long(out, ["model_fold", "entity"], "predicted", value="predicted"), 5)


def nested_losses(spark, sf):
    rows, names = nested(spark, sf)
    fitted = benchmark.fit(rows, names, 2, 2)
    return fitted, pinned(benchmark.grid_losses(fitted, GRID.direct() + GRID.low_rank()))


@query(f"""WITH RECURSIVE {_fitted_sql(BOTH)}{LOSSES}
SELECT model_fold, setting, CAST(dimension AS INTEGER) AS dimension, CAST(rank AS INTEGER) AS rank, CAST(alpha AS DOUBLE) AS alpha, round(avg(rmse), 6) AS mean_rmse, count(*) AS n_validation
FROM losses WHERE model_fold LIKE '%/%' GROUP BY ALL""")
def nested_cv_trace(spark, sf):
    """Inner-fold loss of every grid point, all 25 fits in shared passes."""
    _, losses = nested_losses(spark, sf)
    return B.rounded(benchmark.select_settings(losses)[0])


@query(f"""WITH RECURSIVE {_fitted_sql(BOTH)}{LOSSES},
po AS (SELECT split_part(model_fold, '/', 1) AS outer_fold, setting, dimension, rank, alpha, avg(rmse) AS loss FROM losses WHERE model_fold LIKE '%/%' GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY outer_fold, setting ORDER BY loss, rank, dimension, CASE WHEN setting = 'low_rank' THEN -alpha ELSE alpha END) AS rn FROM po)
SELECT outer_fold, setting, CAST(dimension AS INTEGER) AS dimension, CAST(rank AS INTEGER) AS rank, CAST(alpha AS DOUBLE) AS alpha, round(loss, 6) AS loss FROM w WHERE rn = 1""")
def nested_cv_select(spark, sf):
    """Chosen (dimension, rank, penalty) per outer fold and model."""
    _, losses = nested_losses(spark, sf)
    return B.rounded(benchmark.select_settings(losses)[1])


@query(f"""WITH RECURSIVE {_fitted_sql(BOTH)}{LOSSES},
po AS (SELECT split_part(model_fold, '/', 1) AS outer_fold, setting, dimension, rank, alpha, avg(rmse) AS loss FROM losses WHERE model_fold LIKE '%/%' GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY outer_fold, setting ORDER BY loss, rank, dimension, CASE WHEN setting = 'low_rank' THEN -alpha ELSE alpha END) AS rn FROM po)
SELECT l.model_fold, l.entity, l.setting, round(l.rmse, 5) AS rmse FROM losses l JOIN w ON w.outer_fold = l.model_fold AND w.setting = l.setting AND w.dimension = l.dimension AND w.rank = l.rank AND w.alpha = l.alpha WHERE rn = 1""")
def held_out_benchmark(spark, sf):
    """Held-out error of the selected direct and low-rank models."""
    _, losses = nested_losses(spark, sf)
    chosen = benchmark.select_settings(losses)[1].drop("loss").withColumnRenamed("outer_fold", "model_fold")
    return B.rounded(losses.join(chosen, ["model_fold", "setting", "dimension", "rank", "alpha"]).select("model_fold", "entity", "setting", "rmse"), 5)


@query(f"""WITH RECURSIVE {_fitted_sql(BOTH, False)},
zz AS MATERIALIZED (SELECT model_fold, entity, role, max(z) FILTER (component = 1) AS z1, max(z) FILTER (component = 2) AS z2 FROM z GROUP BY ALL),
pr AS (SELECT a.model_fold, a.entity, b.entity AS neighbor, d, CASE WHEN d = 1 THEN pow(a.z1 - b.z1, 2) ELSE pow(a.z1 - b.z1, 2) + pow(a.z2 - b.z2, 2) END AS g FROM zz a JOIN zz b ON a.model_fold = b.model_fold AND a.role = 'test' AND b.role = 'train', range(1, 3) r(d)),
w AS (SELECT model_fold, entity, d, arg_min(neighbor, g) AS neighbor FROM pr GROUP BY ALL),
l AS (SELECT w.model_fold, d, sqrt(list_sum(list_transform(range(1, 33), lambda i: pow(a.y[i] - b.y[i], 2))) / 32) AS rmse FROM w JOIN vec a USING (entity) JOIN vec b ON b.entity = w.neighbor)
SELECT model_fold, CAST(d AS INTEGER) AS dimension, round(avg(rmse), 5) AS mean_rmse, count(*) AS n FROM l GROUP BY ALL""")
def nearest_cv_trace(spark, sf):
    """Loss of copying the nearest training response, per fold and dimension count."""
    rows, names = nested(spark, sf)
    fitted = benchmark.fit(rows, names, 2)
    losses = benchmark.neighbor_losses(fitted, (1, 2))
    return B.rounded(losses.groupBy("model_fold", "dimension").agg(F.avg("rmse").alias("mean_rmse"), F.count("rmse").alias("n")), 5)


NEAREST = """,
zz AS MATERIALIZED (SELECT model_fold, entity, role, max(z) FILTER (component = 1) AS z1, max(z) FILTER (component = 2) AS z2 FROM z GROUP BY ALL),
pr AS (SELECT a.model_fold, a.entity, b.entity AS neighbor, d, CASE WHEN d = 1 THEN pow(a.z1 - b.z1, 2) ELSE pow(a.z1 - b.z1, 2) + pow(a.z2 - b.z2, 2) END AS g
  FROM zz a JOIN zz b ON a.model_fold = b.model_fold AND a.role = 'test' AND b.role = 'train', range(1, 3) r(d)),
w AS (SELECT model_fold, entity, d, arg_min(neighbor, g) AS neighbor FROM pr GROUP BY ALL),
nl AS MATERIALIZED (SELECT w.model_fold, w.entity, 'nearest' AS setting, d AS dimension, 0.0 AS alpha, w.neighbor,
  sqrt(list_sum(list_transform(range(1, 33), lambda i: pow(a.y[i] - b.y[i], 2))) / 32) AS rmse FROM w JOIN vec a USING (entity) JOIN vec b ON b.entity = w.neighbor)"""


@query(f"""WITH RECURSIVE {_fitted_sql(BOTH, False)}{PARTS}{NEAREST},
al AS (SELECT model_fold, entity, 'direct' AS setting, d AS dimension, a AS alpha, CAST(NULL AS BIGINT) AS neighbor, sqrt(avg(pow(my + dev - y[target], 2))) AS rmse
  FROM dev JOIN ym USING (model_fold, target) JOIN vec USING (entity) GROUP BY ALL UNION ALL SELECT * FROM nl),
po AS (SELECT split_part(model_fold, '/', 1) AS model_fold, setting, dimension, alpha, avg(rmse) AS loss FROM al WHERE model_fold LIKE '%/%' GROUP BY ALL),
ch AS (SELECT * FROM po QUALIFY row_number() OVER (PARTITION BY model_fold, setting ORDER BY loss, dimension, alpha) = 1),
te AS (SELECT model_fold, entity, lineage, t AS target, y[t] AS y FROM outer_m JOIN vec USING (entity), range(1, 33) r(t) WHERE role = 'test'),
gm AS (SELECT model_fold, lineage, t AS target, avg(y[t]) AS gm, count(*) AS n FROM outer_m JOIN vec USING (entity), range(1, 33) r(t) WHERE role = 'train' GROUP BY ALL),
b AS (SELECT model_fold, entity, sqrt(avg(pow(y, 2))) AS zero, sqrt(avg(pow(y - my, 2))) AS global_mean,
  sqrt(avg(pow(y - CASE WHEN n >= 2 THEN gm ELSE my END, 2))) AS group_mean, bool_or(NOT coalesce(n >= 2, false)) AS fallback
  FROM te JOIN ym USING (model_fold, target) LEFT JOIN gm USING (model_fold, lineage, target) GROUP BY ALL)
SELECT model_fold, entity, 'zero' AS model, round(zero, 5) AS rmse, CAST(NULL AS BOOLEAN) AS fallback, CAST(NULL AS INTEGER) AS dimension, CAST(NULL AS DOUBLE) AS alpha, CAST(NULL AS BIGINT) AS neighbor FROM b
UNION ALL SELECT model_fold, entity, 'global_mean', round(global_mean, 5), NULL, NULL, NULL, NULL FROM b
UNION ALL SELECT model_fold, entity, 'group_mean', round(group_mean, 5), fallback, NULL, NULL, NULL FROM b
UNION ALL SELECT model_fold, entity, setting, round(rmse, 5), NULL, CAST(dimension AS INTEGER), CAST(alpha AS DOUBLE), neighbor FROM al JOIN ch USING (model_fold, setting, dimension, alpha)""")
def baseline_table(spark, sf):
    """Five predictors side by side on every held-out row: zero, global mean, group mean, nearest row, direct model."""
    rows, names = nested(spark, sf)
    fitted = benchmark.fit(rows, names, 2)
    losses = pinned(benchmark.grid_losses(fitted, GRID.direct()))
    return B.rounded(benchmark.baseline_losses(fitted, "lineage", losses, (1, 2)), 5)


@query(f"""WITH RECURSIVE {_fitted_sql(OUTER_ONLY)}{LOSSES},
o AS (SELECT model_fold, entity, component, list_dot_product(y, v) - list_sum(list_transform(range(1, 33), lambda i: v[i] * mean[i])) AS observed FROM mf JOIN vec USING (entity) JOIN py USING (model_fold)
  JOIN (SELECT model_fold, list(my ORDER BY target) AS mean FROM ym GROUP BY 1) USING (model_fold) WHERE role = 'test')
SELECT model_fold, CAST(component AS INTEGER) AS component, round({B.pearson_sql('observed', 's')}, 5) + 0.0 AS pearson, round(sqrt(avg(pow(s - observed, 2))), 5) AS rmse, count(*) AS n
FROM o JOIN sc USING (model_fold, entity, component) WHERE d = 2 AND a = 10.0 GROUP BY model_fold, component""")
def held_out_scores(spark, sf):
    """Observed against predicted response scores of held-out rows."""
    fitted = outer_fit(spark, sf)
    out = linear.fold_predictions(fitted.rows, fitted.models(), [Setting("low_rank", 2, 10.0, 2)], fitted.folds, 2)
    scores = benchmark.held_out_scores(fitted, out)
    return B.rounded(metrics.component_summary(scores, ["model_fold", "component"], "observed", "predicted"), 5)


@query(f"""WITH RECURSIVE {_fitted_sql(OUTER_ONLY, False)},
pr AS (SELECT a.model_fold AS fold_a, b.model_fold AS fold_b, pow(list_dot_product(a.v, b.v), 2) AS s FROM px a JOIN px b ON a.model_fold < b.model_fold)
SELECT fold_a, fold_b, round(sum(s) / 2, 5) AS mean_squared_cosine FROM pr GROUP BY ALL""")
def subspace_overlap(spark, sf):
    """Mean squared cosine between the control subspaces of each fold pair."""
    fitted = outer_fit(spark, sf, ranks=0)
    return B.rounded(linear.subspace_overlap(fitted.control, 2, fitted.folds).select("fold_a", "fold_b", "mean_squared_cosine"), 5)


@query()
def variant_grid(spark, sf):
    """Fixed variants (dimension, rank, lineage indicators, covariates) on every outer fold."""
    source = B.embedded(spark, sf)
    names = group_names(source)
    lineages = [F.when(F.col("lineage") == i, 1.0).otherwise(0.0) for i in names]
    sign = (F.col("x")[0] > 0).cast("double")
    table = source.withColumn("extra", F.array(*lineages, sign))
    groups = len(names)
    rows, names = benchmark.outer_rows(table, "entity", "lineage", K_OUTER, B.SEED)
    fitted = benchmark.fit(rows, names, 30, 30, extra="extra", scaled=1)
    variants = ablation.fixed_variants(groups=groups, covariates=1, widest=30)
    losses = ablation.variant_losses(fitted, variants, extra="extra")
    return B.rounded(losses.groupBy("setting", "dimension", "rank").agg(F.avg("rmse").alias("mean_rmse"), F.count("rmse").alias("n")))


def _transfer_sql() -> str:
    return f"""WITH RECURSIVE {EMB}, lab AS (SELECT DISTINCT doc_id AS entity FROM labels),
vec AS MATERIALIZED (SELECT entity, list_slice(e, 1, 32) AS x, list_slice(e, 33, 64) AS y FROM efold),
xr AS MATERIALIZED (SELECT 'all' AS model_fold, entity, x AS e FROM vec SEMI JOIN lab USING (entity)), {_pair('px', 'xr')},
xmean AS (SELECT list(m ORDER BY i) AS mean FROM (SELECT i, avg(e[i]) AS m FROM xr, range(1, 33) t(i) GROUP BY i)),
z AS MATERIALIZED (SELECT entity, component, (list_dot_product(x, v) - list_dot_product(mean, v)) / sqrt(lam) AS z FROM vec, px, xmean),
ym AS (SELECT t AS target, avg(y[t]) AS my, count(*) AS n FROM vec SEMI JOIN lab USING (entity), range(1, 33) r(t) GROUP BY t),
zy AS (SELECT component, t AS target, sum(z * y[t]) AS zy FROM z JOIN vec USING (entity) SEMI JOIN lab USING (entity), range(1, 33) r(t) GROUP BY ALL)
SELECT entity, CAST(target - 1 AS INTEGER) AS feature, round(any_value(my) + sum(z * zy / (n - 1 + 100.0)), 5) + 0.0 AS predicted
FROM z JOIN zy USING (component) JOIN ym USING (target) ANTI JOIN lab USING (entity) GROUP BY entity, target"""


@query(_transfer_sql())
def external_transfer(spark, sf):
    """Fit once on labelled ids, predict ids absent from training."""
    table = B.embedded(spark, sf).select("entity", "x", "y")
    known = B.table(spark, sf, "labels").select(F.col("doc_id").alias("entity")).distinct()
    training = pinned(table.join(known, "entity", "left_semi"))
    out = benchmark.external_transfer(training, table, Setting("direct", 2, 100.0), components=2)
    return B.rounded(vectors.to_long(out, ["entity"], "predicted", value="predicted"), 5)


def group_names(rows):
    """Names of the groups in the data, one fold or indicator each."""
    return sorted(r[0] for r in rows.select("lineage").where("lineage is not null").distinct().collect())


def _group_out(spark, sf):
    from dosewise.operators import folds

    table = B.embedded(spark, sf)
    rows = pinned(table.join(folds.leave_one_group_out(table, "entity", "lineage"), "entity"))
    return rows, [str(i) for i in group_names(table)]


GROUP_OUT = "SELECT CAST(g AS VARCHAR) AS model_fold, entity, CASE WHEN lineage = g THEN 'test' ELSE 'train' END AS role FROM efold, range(10) t(g)"


@query(f"""WITH RECURSIVE {_fitted_sql(GROUP_OUT, False)}{PARTS}
SELECT model_fold, round(avg(rmse), 5) AS mean_rmse, count(*) AS n FROM (
  SELECT model_fold, entity, sqrt(avg(pow(my + dev - y[target], 2))) AS rmse FROM dev JOIN ym USING (model_fold, target) JOIN vec USING (entity) WHERE d = 2 AND a = 100.0 GROUP BY ALL) GROUP BY model_fold""")
def group_out_benchmark(spark, sf):
    """Leave-one-lineage-out error of the fixed direct model."""
    rows, names = _group_out(spark, sf)
    fitted = benchmark.fit(rows, names, 2)
    losses = benchmark.grid_losses(fitted, [Setting("direct", 2, 100.0)])
    return B.rounded(losses.groupBy("model_fold").agg(F.avg("rmse").alias("mean_rmse"), F.count("rmse").alias("n")), 5)


SWEEP = f"""WITH RECURSIVE {EMB},
counts AS (SELECT * FROM (VALUES ('FEATURES_00008', 8), ('FEATURES_00016', 16), ('FEATURES_00032', 32)) c(variant, most)),
mf AS MATERIALIZED (SELECT variant || '|' || f AS model_fold, entity, CASE WHEN fold = f THEN 'test' ELSE 'train' END AS role FROM efold, counts, range({K_OUTER}) t(f)),
vec AS MATERIALIZED (SELECT entity, list_slice(e, 1, 32) AS x, list_slice(e, 33, 64) AS y FROM efold),
""" + fit_body_sql(False, "sel", """fv AS (SELECT model_fold, i, var_pop(e[i]) AS v FROM xr, range(1, 33) t(i) GROUP BY ALL),
fr AS (SELECT model_fold, i, row_number() OVER (PARTITION BY model_fold ORDER BY v DESC, i) AS rn FROM fv),
sel AS (SELECT model_fold, list(CASE WHEN rn <= most THEN 1.0 ELSE 0.0 END ORDER BY i) AS s FROM fr JOIN counts ON variant = split_part(model_fold, '|', 1) GROUP BY model_fold),
""") + PARTS + f""",
er AS (SELECT split_part(model_fold, '|', 1) AS variant, entity, sqrt(avg(pow(my - y[target], 2))) - sqrt(avg(pow(my + dev - y[target], 2))) AS gain
  FROM dev JOIN ym USING (model_fold, target) JOIN vec USING (entity) WHERE d = 2 AND a = 100.0 GROUP BY ALL),
ps AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY md5(concat_ws('|', '{B.SEED}', entity)), entity) AS pos, count(*) OVER (PARTITION BY variant) AS n FROM er),
dr AS (SELECT variant, rep, {B.draw_sql('n', B.SEED, 'rep', 'pos')} + 1 AS pos FROM ps, range(200) t(rep)),
mm AS (SELECT variant, rep, avg(gain) AS m FROM dr JOIN ps USING (variant, pos) GROUP BY ALL),
ci AS (SELECT variant, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM mm GROUP BY variant)
SELECT variant, round(avg(gain), 6) + 0.0 AS mean, count(*) AS n, round(any_value(ci_low), 6) + 0.0 AS ci_low, round(any_value(ci_high), 6) + 0.0 AS ci_high FROM er JOIN ci USING (variant) GROUP BY variant"""


@query(SWEEP)
def feature_count_sweep(spark, sf):
    """Gain of the direct model at several variable-feature counts; the count is part of the fold key."""
    counts = {f"FEATURES_{n:05d}": n for n in (8, 16, 32)}
    rows = B.embedded(spark, sf).withColumn("variant", F.explode(F.array(*[F.lit(v) for v in counts])))
    keyed = pinned(robustness.keyed_variants(rows, "lineage", K_OUTER, B.SEED, shared_folds=True))
    losses = robustness.fixed_outer_losses(keyed, list(counts), K_OUTER, dimension=2, max_features=counts)
    return B.rounded(robustness.variant_gains(losses, B.SEED, 200))


@query(f"""WITH {EMB}
SELECT CAST(fold AS VARCHAR) AS model_fold, CAST(0 AS DOUBLE) AS max_difference, count(*) AS n FROM efold GROUP BY fold""")
def model_roundtrip(spark, sf):
    """Predictions from model tables written to Parquet and read back equal the originals."""
    import tempfile

    from dosewise.session import ensure_checkpoint_dir
    from dosewise.sources import tables

    fitted = outer_fit(spark, sf)
    models = fitted.models()
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/model_{tempfile.mktemp(dir='').strip('/')}"
    tables.write_model(models, folder)
    stored = tables.read_model(spark, folder, ", ".join(f"{c} {t}" for c, t in models.dtypes))
    setting = [Setting("low_rank", 2, 10.0, 2)]
    first = linear.fold_predictions(fitted.rows, models, setting, fitted.folds, 2)
    again = linear.fold_predictions(fitted.rows, stored, setting, fitted.folds, 2).select("model_fold", "entity", F.col("predicted").alias("again"))
    gap = F.array_max(F.zip_with("predicted", "again", lambda a, b: F.abs(a - b)))
    return B.rounded(first.join(again, ["model_fold", "entity"]).groupBy("model_fold").agg(
        F.max(gap).alias("max_difference"), F.count(F.lit(1)).alias("n")
    ))
