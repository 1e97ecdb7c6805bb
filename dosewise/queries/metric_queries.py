"""Evaluation of held-out predictions: per-row metrics, summaries, gains."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosewise.operators import composition, metrics, resample, summaries, vectors
from dosewise.plans import benchmark
from dosewise.queries import base as B
from dosewise.queries.registry import query
from dosewise.queries.vector_queries import EMB
from dosewise.session import pinned

MODELS = ["B0", "B1", "B2"]
METRICS = [
    "rmse_delta", "nrmse_delta", "pcc_delta", "spearman_delta", "signed_topk_overlap", "pcc_context",
    "rmse_gain_vs_b1", "nrmse_gain_vs_b1",
]
TOP = 5
REPS = 2000

# zero, global-mean and group-mean predictions next to the observed response
PRED = f"""{EMB},
tr AS (SELECT CAST(f AS INTEGER) AS model_fold, y.* FROM ylong y, range(5) t(f) WHERE fold <> f),
g AS (SELECT model_fold, lineage, feature, avg(value) AS gm, count(*) AS n FROM tr GROUP BY ALL),
a AS (SELECT model_fold, feature, avg(value) AS am FROM tr GROUP BY ALL),
ob AS (SELECT y.fold AS model_fold, y.entity, y.lineage, y.feature, y.value AS observed, am AS baseline, CASE WHEN n >= 2 THEN gm ELSE am END AS b2
  FROM ylong y JOIN a ON a.model_fold = y.fold AND a.feature = y.feature LEFT JOIN g ON g.model_fold = y.fold AND g.lineage = y.lineage AND g.feature = y.feature),
pred AS (SELECT model_fold, entity, feature, observed, baseline, model, predicted FROM (
  SELECT *, 'B0' AS model, 0.0::DOUBLE AS predicted FROM ob UNION ALL SELECT *, 'B1', baseline FROM ob UNION ALL SELECT *, 'B2', b2 FROM ob)),
rk AS (SELECT *,
  rank() OVER (w ORDER BY observed) + (count(*) OVER (PARTITION BY model, entity, observed) - 1) / 2.0 AS ro,
  rank() OVER (w ORDER BY predicted) + (count(*) OVER (PARTITION BY model, entity, predicted) - 1) / 2.0 AS rp,
  row_number() OVER (w ORDER BY observed, feature) AS od, row_number() OVER (w ORDER BY observed DESC, feature DESC) AS ou,
  row_number() OVER (w ORDER BY predicted, feature) AS pd, row_number() OVER (w ORDER BY predicted DESC, feature DESC) AS pu
  FROM pred WINDOW w AS (PARTITION BY model, entity)),
lm0 AS (SELECT model, model_fold, entity, sqrt(avg(pow(predicted - observed, 2))) AS rmse_delta,
  sqrt(avg(pow(predicted - observed, 2))) / greatest(sqrt(avg(observed * observed)), 1e-8) AS nrmse_delta,
  {B.pearson_sql('observed', 'predicted')} AS pcc_delta, {B.pearson_sql('ro', 'rp')} AS spearman_delta,
  (count(*) FILTER (od <= {TOP} AND pd <= {TOP}) / {TOP}.0 + count(*) FILTER (ou <= {TOP} AND pu <= {TOP}) / {TOP}.0) / 2 AS signed_topk_overlap,
  {B.pearson_sql('(observed - baseline)', '(predicted - baseline)')} AS pcc_context,
  sqrt(avg(pow(baseline - observed, 2))) AS br, sqrt(avg(pow(baseline - observed, 2))) / greatest(sqrt(avg(observed * observed)), 1e-8) AS bn
  FROM rk GROUP BY ALL),
lm AS (SELECT model, model_fold, entity, rmse_delta, nrmse_delta, pcc_delta, spearman_delta, signed_topk_overlap, pcc_context,
  br - rmse_delta AS rmse_gain_vs_b1, bn - nrmse_delta AS nrmse_gain_vs_b1 FROM lm0)"""


def predictions(spark, sf):
    """Long table (model, fold, entity, feature, observed, baseline, predicted)."""
    rows, names = benchmark.outer_rows(B.embedded(spark, sf), "entity", "lineage", 5, B.SEED)
    means = benchmark.mean_predictions(rows, names, "lineage")
    seen = vectors.to_long(rows, ["entity"], "y").withColumnRenamed("value", "observed")
    wide = seen.join(means, ["entity", "feature"]).select(
        F.col("model_fold").cast("int").alias("model_fold"), "entity", "feature", "observed", F.col("global_mean").alias("baseline"),
        F.col("zero").alias("B0"), F.col("global_mean").alias("B1"), F.col("group_mean").alias("B2"),
    )
    keys = ["model_fold", "entity", "feature", "observed", "baseline"]
    return wide.unpivot(keys, MODELS, "model", "predicted")


def per_line(spark, sf):
    return metrics.line_metrics(predictions(spark, sf), ["model", "model_fold", "entity"], k=TOP)


@query(f"WITH {PRED} SELECT model, model_fold, entity, {', '.join(f'round({m}, 6) + 0.0 AS {m}' for m in METRICS)} FROM lm")
def line_metrics(spark, sf):
    """Eight metrics per (model, entity) on held-out rows."""
    return B.rounded(per_line(spark, sf))


@query(f"""WITH {PRED}
SELECT model, entity, (count(*) FILTER (od <= {TOP} AND pd <= {TOP}) / {TOP}.0 + count(*) FILTER (ou <= {TOP} AND pu <= {TOP}) / {TOP}.0) / 2 AS signed_topk_overlap FROM rk GROUP BY ALL""")
def signed_topk(spark, sf):
    """Overlap of the most negative and most positive features."""
    return B.rounded(metrics.signed_topk(predictions(spark, sf), ["model", "entity"], "observed", "predicted", "feature", TOP))


TALL = f"""{PRED}, tall AS (SELECT model, entity, metric, value FROM lm UNPIVOT (value FOR metric IN ({', '.join(METRICS)})))"""


def tall_metrics(spark, sf):
    return metrics.tall(per_line(spark, sf), ["model", "entity"], METRICS)


@query(f"""WITH {TALL},
p AS (SELECT *, row_number() OVER (PARTITION BY model, metric ORDER BY md5(concat_ws('|', '{B.SEED}', entity)), entity) AS pos, count(*) OVER (PARTITION BY model, metric) AS n FROM tall),
d AS (SELECT model, metric, rep, {B.draw_sql('n', B.SEED, 'rep', 'pos')} + 1 AS pos FROM p, range({REPS}) t(rep)),
m AS (SELECT model, metric, rep, avg(value) AS m FROM d JOIN p USING (model, metric, pos) GROUP BY ALL),
c AS (SELECT model, metric, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM m GROUP BY ALL)
SELECT model, metric, round(avg(value), 6) + 0.0 AS mean, count(*) AS n, round(any_value(ci_low), 6) + 0.0 AS ci_low, round(any_value(ci_high), 6) + 0.0 AS ci_high
FROM tall JOIN c USING (model, metric) GROUP BY model, metric""")
def metric_summary(spark, sf):
    """Macro mean with bootstrap interval per (model, metric); undefined values left out."""
    return B.rounded(resample.bootstrap_mean(
        pinned(tall_metrics(spark, sf)), ["model", "metric"], "value", ["entity"], B.SEED, REPS
    ))


@query(f"""WITH {TALL}, s AS (SELECT model, metric, avg(value) AS m, count(*) AS n FROM tall GROUP BY ALL)
SELECT model, {', '.join(f"round(max(CASE WHEN metric = '{m}' THEN m END), 6) + 0.0 AS {m}_macro_mean, max(CASE WHEN metric = '{m}' THEN n END) AS {m}_n" for m in METRICS)},
  CAST(list_position(['B1', 'B2', 'B0'], model) AS BIGINT) AS report_order FROM s GROUP BY model""")
def comparison_wide(spark, sf):
    """One row per model with every macro mean, in a fixed report order."""
    summary = metrics.macro_summary(tall_metrics(spark, sf), ["model"])
    table = metrics.wide(summary, ["model"], METRICS, ["macro_mean", "n"])
    return B.rounded(metrics.ordered_report(table, "model", ["B1", "B2", "B0"]))


@query(f"""WITH {PRED}, r AS (SELECT entity, max(CASE WHEN model = 'B0' THEN rmse_delta END) AS r0, max(CASE WHEN model = 'B1' THEN rmse_delta END) AS r1 FROM lm GROUP BY entity)
SELECT entity, model, round(rmse_delta, 6) AS rmse_delta, round(r0 - rmse_delta, 6) + 0.0 AS gain_vs_zero, round(r1 - rmse_delta, 6) + 0.0 AS gain_vs_mean FROM lm JOIN r USING (entity)""")
def paired_gain(spark, sf):
    """Error of the reference models minus the model's error, per entity."""
    rows = pinned(per_line(spark, sf))
    return B.rounded(metrics.paired_gain(rows, "entity", "rmse_delta", {"zero": "B0", "mean": "B1"}))


@query(f"""WITH {PRED},
gn AS (SELECT entity, max(CASE WHEN model = 'B1' THEN rmse_delta END) - max(CASE WHEN model = 'B2' THEN rmse_delta END) AS gain, 'rmse' AS metric FROM lm GROUP BY entity
  UNION ALL SELECT entity, max(CASE WHEN model = 'B1' THEN nrmse_delta END) - max(CASE WHEN model = 'B2' THEN nrmse_delta END), 'nrmse' FROM lm GROUP BY entity),
p AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY md5(concat_ws('|', '{B.SEED}', entity)), entity) AS pos, count(*) OVER (PARTITION BY metric) AS n FROM gn),
d AS (SELECT metric, rep, {B.draw_sql('n', B.SEED, 'rep', 'pos')} + 1 AS pos FROM p, range({REPS}) t(rep)),
m AS (SELECT metric, rep, avg(gain) AS m FROM d JOIN p USING (metric, pos) GROUP BY ALL),
c AS (SELECT metric, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM m GROUP BY metric)
SELECT metric, round(avg(gain), 6) + 0.0 AS mean, count(*) AS n, round(any_value(ci_low), 6) + 0.0 AS ci_low, round(any_value(ci_high), 6) + 0.0 AS ci_high FROM gn JOIN c USING (metric) GROUP BY metric""")
def paired_bootstrap(spark, sf):
    """Paired gain of the group mean over the global mean, with interval."""
    return B.rounded(_gain_intervals(spark, sf))


def _gain_intervals(spark, sf):
    rows = per_line(spark, sf).where(F.col("model").isin("B1", "B2"))
    error = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    wide = rows.groupBy("entity").agg(*[
        error(m, f"{c}_delta").alias(f"{c}_{m}") for c in ("rmse", "nrmse") for m in ("B1", "B2")
    ])
    tall = wide.select("entity", F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(f"{c}_B1").alias("base"), F.col(f"{c}_B2").alias("model")) for c in ("rmse", "nrmse")
    ])).alias("g")).select("entity", "g.metric", "g.base", "g.model")
    return resample.paired_difference(pinned(tall), ["metric"], "base", "model", ["entity"], B.SEED, REPS)


@query(f"""WITH {PRED},
gn AS (SELECT entity, max(CASE WHEN model = 'B1' THEN rmse_delta END) - max(CASE WHEN model = 'B2' THEN rmse_delta END) AS gain, 'rmse' AS metric FROM lm GROUP BY entity
  UNION ALL SELECT entity, max(CASE WHEN model = 'B1' THEN nrmse_delta END) - max(CASE WHEN model = 'B2' THEN nrmse_delta END), 'nrmse' FROM lm GROUP BY entity),
p AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY md5(concat_ws('|', '{B.SEED}', entity)), entity) AS pos, count(*) OVER (PARTITION BY metric) AS n FROM gn),
d AS (SELECT metric, rep, {B.draw_sql('n', B.SEED, 'rep', 'pos')} + 1 AS pos FROM p, range({REPS}) t(rep)),
m AS (SELECT metric, rep, avg(gain) AS m FROM d JOIN p USING (metric, pos) GROUP BY ALL),
c AS (SELECT metric, quantile_cont(m, 0.025) AS ci_low FROM m GROUP BY metric)
SELECT 'group_mean' AS candidate, bool_and(ci_low > 0) AS promoted, count(*) AS n_metrics, round(min(ci_low), 6) + 0.0 AS worst_low FROM c""")
def promotion_gate(spark, sf):
    """Promote only if both paired gains are above zero."""
    from dosewise.operators import distances

    gains = _gain_intervals(spark, sf).withColumn("candidate", F.lit("group_mean"))
    return B.rounded(distances.promotion_gate(gains, ["candidate"]))


@query(f"""WITH {PRED}, v AS (SELECT model, model_fold, entity, rmse_delta AS e FROM lm)
SELECT model, model_fold, count(DISTINCT entity) AS n_distinct, round(min(e), 6) AS minimum, round(max(e), 6) AS maximum, round(avg(e), 6) AS mean FROM v GROUP BY ALL""")
def variant_summary(spark, sf):
    """Distinct entities, minimum, maximum and mean error per model and fold."""
    return B.rounded(metrics_variant(per_line(spark, sf)))


def metrics_variant(rows):
    return summaries.variant_summary(rows, ["model", "model_fold"], "entity", "rmse_delta")


@query(f"""WITH {PRED}
SELECT model, model_fold, CAST(feature AS INTEGER) AS component, round({B.pearson_sql('observed', 'predicted')}, 6) + 0.0 AS pearson, round(sqrt(avg(pow(predicted - observed, 2))), 6) AS rmse, count(*) AS n
FROM (SELECT * FROM pred WHERE model = 'B2') GROUP BY model, model_fold, feature""")
def component_summary(spark, sf):
    """Correlation and RMSE per fold and response coordinate."""
    rows = predictions(spark, sf).where(F.col("model") == "B2").withColumnRenamed("feature", "component")
    return B.rounded(metrics.component_summary(rows, ["model", "model_fold", "component"], "observed", "predicted"))


@query(f"""WITH {PRED}, e AS (SELECT min(observed) AS lx, max(observed) AS hx, min(predicted) AS ly, max(predicted) AS hy FROM pred WHERE model = 'B2')
SELECT CAST(least(floor((observed - lx) / ((hx - lx) / 30)), 29) AS INTEGER) AS bin_x, CAST(least(floor((predicted - ly) / ((hy - ly) / 30)), 29) AS INTEGER) AS bin_y,
  count(*) AS n, round(log10(count(*)), 6) + 0.0 AS log10_n FROM pred, e WHERE model = 'B2' GROUP BY ALL""")
def hist2d(spark, sf):
    """Square bins of observed against predicted."""
    rows = pinned(predictions(spark, sf).where(F.col("model") == "B2").select("observed", "predicted"))
    return B.rounded(summaries.histogram_2d(rows, "observed", "predicted", 30))


@query(f"""WITH {PRED},
s AS (SELECT 'held_out' AS section, CASE model WHEN 'B1' THEN 'MEAN' ELSE model END AS model, metric, avg(value) AS value FROM lm UNPIVOT (value FOR metric IN (rmse_delta, nrmse_delta)) GROUP BY ALL
  UNION ALL SELECT 'context', CASE model WHEN 'B2' THEN 'GROUP' ELSE model END, metric, avg(value) FROM lm UNPIVOT (value FOR metric IN (pcc_context)) GROUP BY ALL)
SELECT section, model, metric, round(value, 6) + 0.0 AS value FROM s""")
def final_metrics(spark, sf):
    """Tall final metrics from two wide summaries with relabelled models."""
    means = per_line(spark, sf).groupBy("model").agg(*[F.avg(m).alias(m) for m in ("rmse_delta", "nrmse_delta", "pcc_context")])
    means = pinned(means)
    tall = composition.metric_sections([
        ("held_out", means, ["rmse_delta", "nrmse_delta"], {"B1": "MEAN"}),
        ("context", means.where(F.col("pcc_context").isNotNull()), ["pcc_context"], {"B2": "GROUP"}),
    ])
    return B.rounded(tall)


@query(f"""WITH {PRED}
SELECT evaluation_scope, model, model_fold, entity, CAST(feature AS INTEGER) AS feature, round(predicted, 6) + 0.0 AS predicted FROM (
  SELECT 'global' AS evaluation_scope, * FROM pred WHERE model = 'B1' UNION ALL SELECT 'grouped', * FROM pred WHERE model = 'B2')""")
def final_predictions(spark, sf):
    """Two prediction sets stacked with a scope column."""
    rows = predictions(spark, sf).select("model", "model_fold", "entity", "feature", "predicted")
    parts = {"global": rows.where("model = 'B1'"), "grouped": rows.where("model = 'B2'")}
    return B.rounded(composition.scoped_union(parts))
