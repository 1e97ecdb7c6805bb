"""Cohort tables, pseudobulk, normalisation, responses and count QC."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosewise.functions import scalar as S
from dosewise.operators import resample, shared_bootstrap, summaries
from dosewise.operators import counts as K
from dosewise.queries import base as B
from dosewise.queries.registry import query
from dosewise.session import pinned

LABELS = {("control", 6): "control_early", ("control", 24): "control_late", ("treated", 24): "treated_late"}


@query(f"""
WITH {B.OBS}, {B.SUPPLIERS.strip()},
u AS (SELECT DISTINCT entity, cell, condition, hour FROM obs),
c AS (SELECT entity,
  count(*) FILTER (condition = 'control' AND hour IN (3, 6)) AS control_early,
  count(*) FILTER (condition = 'control' AND hour IN (24, 48)) AS control_late,
  count(*) FILTER (condition = 'treated' AND hour IN (24, 48)) AS treated_late FROM u GROUP BY entity)
SELECT entity, entity_id, lineage, control_early, control_late, treated_late,
  control_early + control_late AS control_pooled,
  control_late >= 20 AND treated_late >= 20 AS strict_eligible,
  control_early + control_late >= 20 AND treated_late >= 20 AS pooled_eligible
FROM c JOIN suppliers USING (entity)""")
def cell_count_matrix(spark, sf):
    """Cells per entity and condition, pooled control, two eligibility flags."""
    period = S.period("hour")
    labelled = B.entity_cells(spark, sf).withColumn(
        "label", F.when(F.col("condition").isin("control", "treated"), F.concat_ws("_", "condition", period))
    )
    wide = K.condition_counts(labelled, "entity", "label", ["control_early", "control_late", "treated_late"])
    flagged = K.cohort_flags(wide, "control_early", "control_late", "treated_late")
    return flagged.join(B.suppliers(spark, sf).select("entity", "entity_id", "lineage"), "entity")


@query(f"""
WITH {B.OBS}
SELECT entity, condition, CAST(sum(x) AS BIGINT) AS library_size, count(DISTINCT cell) AS n_cells,
  count(DISTINCT gene_id) AS detected
FROM obs GROUP BY entity, condition""")
def pooled_profiles(spark, sf):
    """Counts and cells pooled over hours before any normalisation."""
    keys = ["entity", "condition"]
    sums = K.pseudobulk(B.observed(spark, sf), keys, "gene_id").groupBy(*keys).agg(
        F.sum("total").alias("library_size"), F.count(F.lit(1)).alias("detected"))
    cells = B.entity_cells(spark, sf).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"))  # a cell has one hour
    return sums.join(cells, keys).select(*keys, "library_size", "n_cells", "detected")


@query(f"""
WITH {B.OBS}
SELECT entity, condition, hour, gene_id, CAST(sum(x) AS BIGINT) AS total FROM obs GROUP BY ALL""")
def pseudobulk_sum(spark, sf):
    """Exact count sums per (entity, condition, hour, feature)."""
    return K.pseudobulk(B.observed(spark, sf), ["entity", "condition", "hour"], "gene_id")


@query(f"""
WITH {B.OBS}
SELECT entity, condition, hour, count(DISTINCT cell) AS n_cells FROM obs GROUP BY ALL""")
def cells_per_group(spark, sf):
    """Distinct cells per (entity, condition, hour)."""
    return K.cells_per_group(B.entity_cells(spark, sf), ["entity", "condition", "hour"])


@query(f"""
WITH {B.profiles_sql('entity, hour')}
SELECT entity, hour, condition, gene_id, total, library_size, round(log1p_cpm, 6) AS log1p_cpm FROM profiles""")
def log1p_cpm(spark, sf):
    """log1p counts per million per profile; zeros stay absent."""
    return B.rounded(B.profiles(spark, sf, ("entity", "hour", "condition")).select(
        "entity", "hour", "condition", "gene_id", "total", "library_size", "log1p_cpm"
    ))


@query(f"""
WITH {B.response_sql()}
SELECT entity, gene_idx, round(control, 6) AS control, round(treated, 6) AS treated, round(delta, 6) + 0.0 AS delta FROM response""")
def response_delta(spark, sf):
    """Treated minus control over the whole feature dictionary."""
    return B.rounded(B.response(spark, sf))


@query(f"""
WITH {B.response_sql()}
SELECT gene_id, gene_symbol, count(delta) AS n, round(avg(delta), 6) + 0.0 AS mean, round(quantile_cont(delta, 0.5), 6) + 0.0 AS median,
  round(avg(CASE WHEN delta < 0 THEN 1.0 ELSE 0.0 END), 6) AS fraction_negative
FROM response GROUP BY gene_id, gene_symbol""")
def marker_summary(spark, sf):
    """Per feature: n, mean, median, fraction of negative responses."""
    named = B.response(spark, sf).join(B.genes(spark, sf).select("gene_idx", "gene_id", "gene_symbol"), "gene_idx")
    return B.rounded(summaries.marker_summary(pinned(named), ["gene_id", "gene_symbol"], "delta"))


@query(f"""
WITH {B.response_sql()},
listed AS (SELECT entity, row_number() OVER (ORDER BY entity) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT entity FROM response)),
draws AS (SELECT rep, {B.draw_sql('n', B.SEED, 'rep', 'pos')} + 1 AS pos, count(*) AS times FROM listed, range(2000) r(rep) GROUP BY ALL),
means AS (SELECT gene_id, rep, sum(times * delta) / sum(times) AS m FROM response JOIN listed USING (entity) JOIN draws USING (pos) GROUP BY ALL),
bounds AS (SELECT gene_id, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM means GROUP BY gene_id)
SELECT gene_id, count(delta) AS n, round(avg(delta), 6) + 0.0 AS mean, round(any_value(ci_low), 6) + 0.0 AS ci_low, round(any_value(ci_high), 6) + 0.0 AS ci_high
FROM response JOIN bounds USING (gene_id) GROUP BY gene_id""")
def marker_intervals(spark, sf):
    """Mean response per feature with a bootstrap interval over entities, drawn once for all features."""
    genes = B.genes(spark, sf).select("gene_idx", "gene_id")
    named = pinned(B.response(spark, sf).join(genes, "gene_idx").select("entity", "gene_id", "delta"))
    means = named.groupBy("gene_id").agg(F.count("delta").alias("n"), F.avg("delta").alias("mean"))
    bounds = shared_bootstrap.feature_intervals(named, "gene_id", "entity", "delta", B.SEED)
    return B.rounded(means.join(bounds, "gene_id"))


@query(f"""
WITH {B.OBS},
c AS (SELECT cell, entity, condition, CAST(sum(x) AS DOUBLE) AS library, CAST(count(*) AS DOUBLE) AS detected,
  CAST(sum(CASE WHEN upper(gene_id) LIKE 'BRAND#1/%' THEN x ELSE 0 END) AS DOUBLE) AS marked
  FROM (SELECT o.*, entity, condition, gene_id, x FROM (SELECT DISTINCT cell FROM cells) o JOIN counts USING (cell)) GROUP BY ALL),
f AS (SELECT condition, coalesce(library, 0) AS library, detected, CASE WHEN library > 0 THEN marked / library ELSE 0 END AS marked_fraction FROM c)
SELECT condition, count(*) AS n_cells, count(*) FILTER (library = 0) AS zero_library,
  round(quantile_cont(library, 0.05), 6) AS library_p05, round(quantile_cont(library, 0.5), 6) AS library_median, round(quantile_cont(library, 0.95), 6) AS library_p95,
  round(quantile_cont(detected, 0.05), 6) AS detected_p05, round(quantile_cont(detected, 0.5), 6) AS detected_median, round(quantile_cont(detected, 0.95), 6) AS detected_p95,
  round(quantile_cont(marked_fraction, 0.05), 6) AS marked_fraction_p05, round(quantile_cont(marked_fraction, 0.5), 6) AS marked_fraction_median,
  round(quantile_cont(marked_fraction, 0.95), 6) AS marked_fraction_p95
FROM f GROUP BY condition""")
def cell_qc(spark, sf):
    """Per-condition spread of per-cell library size, detected features and marked fraction."""
    rows = B.counts(spark, sf)
    keys = ["entity", "cell", "condition"]
    marked = F.upper("gene_id").startswith("BRAND#1/")
    listed = B.count_lines(spark, sf).select(*keys).distinct()
    return B.rounded(K.cell_qc(rows, listed, marked, keys, "condition"))


@query(f"""
WITH {B.profiles_sql('entity, hour')}
SELECT gene_id, CAST(sum(total) AS BIGINT) AS total, count(*) FILTER (hour = 6 AND total > 0) AS n_early, count(*) FILTER (hour = 24 AND total > 0) AS n_late
FROM sums WHERE condition = 'control' AND hour IN (6, 24) GROUP BY gene_id HAVING sum(total) >= 100 AND n_early >= 10 AND n_late >= 10""")
def control_feature_mask(spark, sf):
    """Features with enough control counts in enough entities at two hours."""
    control = pseudobulk_sum(spark, sf).where(F.col("condition") == "control")
    return K.control_feature_mask(control, "gene_id")


def _pairs_by_entity(spark, sf, left, right, third=None):
    """Two dense (condition, hour) profiles of every entity that owns both, side by side.

    With a third one, column `third` has it too, null for an entity that does not own it.
    """
    sides = {left: "left", right: "right"} | ({third: "third"} if third else {})
    label = None
    for (condition, hour), name in sides.items():
        test = (F.col("condition") == condition) & (F.col("hour") == hour)
        label = F.when(test, name) if label is None else label.when(test, name)
    features, n = B.dictionary(spark, sf)
    wanted = B.observed(spark, sf, features).withColumn("side", label).where(F.col("side").isNotNull())
    keys = ["entity", "side"]
    rows = K.normalised(K.pseudobulk(wanted, keys, "gene_idx"), keys, together=["entity"])
    pick = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("log1p_cpm"))), F.lit(0.0)).alias(s)
    names = list(sides.values())
    owned = rows.groupBy("entity").agg(
        F.count_distinct(F.when(F.col("side") != "third", F.col("side"))).alias("n"), F.max((F.col("side") == "third").cast("int")).alias("has_third")).where("n = 2")
    wide = rows.groupBy("entity", "gene_idx").agg(*[pick(s) for s in names]).join(owned.select("entity"), "entity", "left_semi")
    dense = K.densify(wide, ["entity"], "gene_idx", n, names)
    if third:
        dense = dense.join(owned.select("entity", "has_third"), "entity").withColumn("third", F.when(F.col("has_third") == 1, F.col("third"))).drop("has_third")
    return dense, features


def _pairs_sql(left, right):
    (lc, lh), (rc, rh) = left, right
    return f"""{B.GENES},{B.profiles_sql('entity, hour')},
p AS (SELECT entity, gene_id, log1p_cpm, CASE WHEN condition = '{lc}' AND hour = {lh} THEN 'left' WHEN condition = '{rc}' AND hour = {rh} THEN 'right' END AS side FROM profiles),
own AS (SELECT entity FROM p WHERE side IS NOT NULL GROUP BY entity HAVING count(DISTINCT side) = 2),
w AS (SELECT entity, gene_id, coalesce(sum(log1p_cpm) FILTER (side = 'left'), 0) AS l, coalesce(sum(log1p_cpm) FILTER (side = 'right'), 0) AS r FROM p WHERE side IS NOT NULL GROUP BY ALL),
pairs AS (SELECT entity, gene_idx, gene_id, coalesce(l, 0) AS l, coalesce(r, 0) AS r FROM own CROSS JOIN genes LEFT JOIN w USING (entity, gene_id)),
ranked AS (SELECT *, rank() OVER (PARTITION BY entity ORDER BY l) + (count(*) OVER (PARTITION BY entity, l) - 1) / 2.0 AS rl,
  rank() OVER (PARTITION BY entity ORDER BY r) + (count(*) OVER (PARTITION BY entity, r) - 1) / 2.0 AS rr FROM pairs)"""


@query(f"""
WITH {_pairs_sql(('control', 6), ('control', 24))},
mask AS (SELECT gene_id FROM sums WHERE condition = 'control' AND hour IN (6, 24) GROUP BY gene_id
  HAVING sum(total) >= 100 AND count(*) FILTER (hour = 6) >= 10 AND count(*) FILTER (hour = 24) >= 10),
m AS (SELECT entity, gene_idx, gene_id, l, r FROM pairs SEMI JOIN mask USING (gene_id)),
tp AS (SELECT entity, gene_id, sum(log1p_cpm) AS t FROM profiles WHERE condition = 'treated' AND hour = 24 GROUP BY ALL),
tr AS (SELECT m.entity, sqrt(avg(pow(coalesce(t, 0) - r, 2))) AS treated_rmse FROM m LEFT JOIN tp USING (entity, gene_id) WHERE m.entity IN (SELECT entity FROM tp) GROUP BY m.entity),
k AS (SELECT *, rank() OVER (PARTITION BY entity ORDER BY l) + (count(*) OVER (PARTITION BY entity, l) - 1) / 2.0 AS rl,
  rank() OVER (PARTITION BY entity ORDER BY r) + (count(*) OVER (PARTITION BY entity, r) - 1) / 2.0 AS rr FROM m)
SELECT entity, round(sqrt(avg(pow(r - l, 2))), 6) AS rmse, round({B.pearson_sql('l', 'r')}, 6) AS pearson,
  round(sum(l * r) / nullif(sqrt(sum(l * l) * sum(r * r)), 0), 6) AS cosine, round({B.pearson_sql('rl', 'rr')}, 6) AS spearman,
  round(any_value(treated_rmse), 6) AS treated_rmse, round(sqrt(avg(pow(r - l, 2))) / nullif(any_value(treated_rmse), 0), 6) AS rmse_ratio
FROM k LEFT JOIN tr USING (entity) GROUP BY entity""")
def control_qc(spark, sf):
    """Control at 6 h against control at 24 h on the masked features, per entity, and against the change by treatment.

    Entities without a treated profile at 24 h have no treated RMSE and no ratio.
    """
    pairs, dictionary = _pairs_by_entity(spark, sf, ("control", 6), ("control", 24), ("treated", 24))
    mask = F.broadcast(control_feature_mask(spark, sf).join(dictionary, "gene_id").select("gene_idx"))  # within the dictionary
    masked = pairs.join(mask, "gene_idx", "left_semi")
    compared = K.compare_vectors(masked, ["entity"], "left", "right", ranks=True, largest=B.DICTIONARY_BOUND, third="third")
    return B.rounded(compared.withColumn("rmse_ratio", F.try_divide("rmse", F.col("treated_rmse"))))


@query(f"""
WITH {_pairs_sql(('control', 48), ('untreated', 48))}
SELECT entity, round(sqrt(avg(pow(r - l, 2))), 6) AS rmse, round({B.pearson_sql('l', 'r')}, 6) AS pearson,
  round(sum(l * r) / nullif(sqrt(sum(l * l) * sum(r * r)), 0), 6) AS cosine, round({B.pearson_sql('rl', 'rr')}, 6) AS spearman
FROM ranked GROUP BY entity""")
def untreated_qc(spark, sf):
    """Untreated against control at 48 h."""
    pairs, _ = _pairs_by_entity(spark, sf, ("control", 48), ("untreated", 48))
    return B.rounded(K.compare_vectors(pairs, ["entity"], "left", "right", ranks=True, largest=B.DICTIONARY_BOUND))


@query(f"""
WITH {B.GENES},{B.profiles_sql('entity, hour')},
ps AS (SELECT entity, gene_id, coalesce(sum(log1p_cpm) FILTER (condition = 'control' AND hour = 6), 0) AS c6,
  coalesce(sum(log1p_cpm) FILTER (condition = 'control' AND hour = 24), 0) AS c24,
  coalesce(sum(log1p_cpm) FILTER (condition = 'treated' AND hour = 24), 0) AS t24 FROM profiles GROUP BY ALL),
own AS (SELECT entity FROM profiles WHERE (condition = 'control' AND hour IN (6, 24)) OR (condition = 'treated' AND hour = 24)
  GROUP BY entity HAVING count(DISTINCT condition || hour) = 3),
d AS (SELECT entity, coalesce(c24, 0) - coalesce(c6, 0) AS a, coalesce(t24, 0) - coalesce(c24, 0) AS b
  FROM own CROSS JOIN genes LEFT JOIN ps USING (entity, gene_id))
SELECT entity, round(sqrt(avg(a * a)), 6) AS control_change_rms, round(sqrt(avg(b * b)), 6) AS response_rms,
  round({B.pearson_sql('a', 'b')}, 6) AS pearson, round(sum(a * b) / nullif(sqrt(sum(a * a) * sum(b * b)), 0), 6) AS cosine
FROM d GROUP BY entity""")
def direction_compare(spark, sf):
    """Control change over time against the treatment response, per entity.

    Absent features add zero to every sum, so only the feature count is needed.
    """
    tests = {
        "c6": (F.col("condition") == "control") & (F.col("hour") == 6),
        "c24": (F.col("condition") == "control") & (F.col("hour") == 24),
        "t24": (F.col("condition") == "treated") & (F.col("hour") == 24),
    }
    label = S.first_match([(t, n) for n, t in tests.items()], "")
    features, size = B.dictionary(spark, sf)
    wanted = B.observed(spark, sf, features).withColumn("side", label).where(F.col("side") != "")
    keys = ["entity", "side"]
    rows = K.normalised(K.pseudobulk(wanted, keys, "gene_idx"), keys, together=["entity"])
    owned = rows.groupBy("entity").agg(F.count_distinct("side").alias("n")).where("n = 3").select("entity")
    value = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("log1p_cpm"))), F.lit(0.0))
    diffs = rows.join(owned, "entity", "left_semi").groupBy("entity", "gene_idx").agg(
        (value("c24") - value("c6")).alias("a"), (value("t24") - value("c24")).alias("b")
    )
    n = F.lit(float(size))
    total = lambda e: F.sum(e)
    a, b = F.col("a"), F.col("b")
    sums = diffs.groupBy("entity").agg(
        total(a).alias("sa"), total(b).alias("sb"), total(a * a).alias("aa"), total(b * b).alias("bb"), total(a * b).alias("ab")
    )
    cov = F.col("ab") / n - F.col("sa") * F.col("sb") / (n * n)
    va, vb = (F.col(q) / n - F.col(s) * F.col(s) / (n * n) for q, s in (("aa", "sa"), ("bb", "sb")))
    return B.rounded(sums.select(
        "entity", F.sqrt(F.col("aa") / n).alias("control_change_rms"), F.sqrt(F.col("bb") / n).alias("response_rms"),
        F.try_divide(cov, F.sqrt(va * vb)).alias("pearson"),
        F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))).alias("cosine"),
    ))


@query(f"""
WITH {B.OBS}, u AS (SELECT DISTINCT entity, cell, condition, hour FROM obs),
g AS (SELECT entity, condition, hour, count(*) AS n_cells FROM u GROUP BY ALL),
m AS (SELECT entity, count(*) AS n_groups, min(n_cells) AS min_cells FROM g WHERE condition <> 'untreated' GROUP BY entity)
SELECT entity, n_groups, min_cells, n_groups = 10 AND min_cells >= 10 AS eligible_t10, n_groups = 10 AND min_cells >= 20 AS eligible_t20,
  n_groups = 10 AND min_cells >= 30 AS eligible_t30 FROM m""")
def group_eligibility(spark, sf):
    """All ten matched (condition, hour) groups present with at least t cells."""
    groups = K.cells_per_group(B.entity_cells(spark, sf), ["entity", "condition", "hour"])
    return K.group_eligibility(groups, "entity")


@query(f"""
WITH {B.OBS}, u AS (SELECT DISTINCT entity, cell, condition FROM obs),
r AS (SELECT repeat, u.*, row_number() OVER (PARTITION BY repeat, entity, condition ORDER BY md5(concat_ws('|', '{B.SEED}', repeat, cell)), cell) AS rn
  FROM u, range(5) t(repeat)), s AS (SELECT * FROM r WHERE rn <= 20),
b AS (SELECT CAST(repeat AS INTEGER) AS repeat, entity, condition, gene_id, sum(x) AS total FROM s JOIN obs USING (entity, cell, condition) GROUP BY ALL)
SELECT repeat, entity, condition, gene_id, CAST(total AS BIGINT) AS total,
  round(ln(1 + total * 1e6 / sum(total) OVER (PARTITION BY repeat, entity, condition)), 6) AS log1p_cpm FROM b""")
def equal_n_subsample(spark, sf):
    """Twenty cells per (entity, condition) and repeat, re-aggregated and normalised."""
    obs = B.counts(spark, sf)
    cells = B.entity_cells(spark, sf).select("entity", "cell", "condition")
    chosen = resample.sample_cells(cells, ["entity", "condition"], ["cell"], 20, B.SEED, 5)
    keys = ["repeat", "entity", "condition"]
    sums = K.pseudobulk(obs.join(chosen, ["entity", "cell", "condition"]), keys, "gene_id")
    return B.rounded(K.normalised(sums, keys).drop("library_size"))


@query(f"""
WITH {B.GENES},{B.OBS}, u AS (SELECT DISTINCT entity, cell, condition FROM obs WHERE condition IN ('control', 'treated')),
r AS (SELECT repeat, u.*, row_number() OVER (PARTITION BY repeat, entity, condition ORDER BY md5(concat_ws('|', '{B.SEED}', repeat, cell)), cell) AS rn,
  count(*) OVER (PARTITION BY repeat, entity, condition) AS n FROM u, range(5) t(repeat)),
h AS (SELECT CAST(repeat AS INTEGER) AS repeat, entity, condition, cell, CASE WHEN rn <= n // 2 THEN 'a' WHEN rn <= 2 * (n // 2) THEN 'b' END AS half FROM r),
s AS (SELECT repeat, entity, condition, half, gene_id, sum(x) AS total FROM h JOIN obs USING (entity, cell, condition) WHERE half IS NOT NULL GROUP BY ALL),
p AS (SELECT *, ln(1 + total * 1e6 / sum(total) OVER (PARTITION BY repeat, entity, condition, half)) AS v FROM s),
w AS (SELECT repeat, entity, gene_id, coalesce(sum(v) FILTER (condition = 'treated' AND half = 'a'), 0) - coalesce(sum(v) FILTER (condition = 'control' AND half = 'a'), 0) AS a,
  coalesce(sum(v) FILTER (condition = 'treated' AND half = 'b'), 0) - coalesce(sum(v) FILTER (condition = 'control' AND half = 'b'), 0) AS b FROM p GROUP BY ALL),
d AS (SELECT repeat, entity, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT DISTINCT repeat, entity FROM w) CROSS JOIN genes LEFT JOIN w USING (repeat, entity, gene_id)),
k AS (SELECT *, rank() OVER (PARTITION BY repeat, entity ORDER BY a) + (count(*) OVER (PARTITION BY repeat, entity, a) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY repeat, entity ORDER BY b) + (count(*) OVER (PARTITION BY repeat, entity, b) - 1) / 2.0 AS rb FROM d)
SELECT repeat, entity, round(sqrt(avg(pow(a - b, 2))), 6) AS rmse, round(sqrt(avg(pow(a - b, 2))) / 2, 6) AS noise_floor,
  round({B.pearson_sql('a', 'b')}, 6) AS pearson, round({B.pearson_sql('ra', 'rb')}, 6) AS spearman FROM k GROUP BY ALL""")
def split_half_noise(spark, sf):
    """Response from one half of the cells against the other half."""
    features, n = B.dictionary(spark, sf)
    obs = B.counts(spark, sf, features)
    cells = pinned(B.entity_cells(spark, sf).where(F.col("condition").isin("control", "treated")).select("entity", "cell", "condition"))
    halves = resample.split_halves(cells, ["entity", "condition"], ["cell"], B.SEED, 5)
    keys = ["repeat", "entity", "condition", "half"]
    sums = K.pseudobulk(obs.join(halves, ["entity", "cell", "condition"]), keys, "gene_idx")
    parts = K.dense_parts(cells, 5 * cells.select("entity").distinct().count(), n)
    signed = K.normalised(sums, keys, ["repeat", "entity"], parts).withColumn(
        "signed", F.when(F.col("condition") == "treated", F.col("log1p_cpm")).otherwise(-F.col("log1p_cpm"))
    )
    # treated - control of both halves in one aggregation
    side = lambda h: F.coalesce(F.sum(F.when(F.col("half") == h, F.col("signed"))), F.lit(0.0)).alias(h)
    wide = signed.groupBy("repeat", "entity", "gene_idx").agg(side("a"), side("b"))
    dense = K.densify(wide, ["repeat", "entity"], "gene_idx", n, ["a", "b"])
    result = K.compare_vectors(dense, ["repeat", "entity"], "a", "b", ranks=True, largest=B.DICTIONARY_BOUND)
    return B.rounded(result.select("repeat", "entity", "rmse", (F.col("rmse") / 2).alias("noise_floor"), "pearson", "spearman"))
