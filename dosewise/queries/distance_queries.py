"""Distances between samples of vectors and latent shifts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from dosewise.operators import distances, metrics
from dosewise.queries import base as B
from dosewise.queries.registry import query
from dosewise.session import pinned

DIRECTIONS = 100
# Length of the given vectors, for the SQL; Spark takes it from the data.
DIMS = 64
# Each label compares its vectors with even parity hash (x) to the others (y).
SAMPLES = f"""
s AS (SELECT vec_id AS entity, label, CASE WHEN substr(md5(concat_ws('|', 'side', vec_id)), 1, 1) < '8' THEN 'x' ELSE 'y' END AS side,
  list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings)"""
DIRS = f"""
dn AS (SELECT d AS direction, i AS dim,
  sqrt(-2 * ln(({B.draw_sql('4294967296', B.SEED, "'a'", 'd', 'i')} + 0.5) / 4294967296)) * cos(2 * {math.pi!r} * (({B.draw_sql('4294967296', B.SEED, "'b'", 'd', 'i')} + 0.5) / 4294967296)) AS w FROM range({DIRECTIONS}) a(d), range(1, {DIMS + 1}) b(i)),
dirs AS (SELECT direction, list(w / n ORDER BY dim) AS w FROM dn JOIN (SELECT direction, sqrt(sum(w * w)) AS n FROM dn GROUP BY 1) USING (direction) GROUP BY direction)"""


def samples(spark, sf):
    half = F.substring(F.md5(F.concat_ws("|", F.lit("side"), F.col("vec_id").cast("string")).cast("binary")), 1, 1)
    return B.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("entity"), "label", F.when(half < "8", "x").otherwise("y").alias("side"),
        F.col("embedding").cast("array<double>").alias("v"),
    )


@query(f"""WITH {SAMPLES}, p AS (SELECT a.label, a.side || b.side AS k, avg(list_distance(a.v, b.v)) AS d FROM s a JOIN s b USING (label) GROUP BY ALL),
n AS (SELECT label, count(*) FILTER (side = 'x') AS n_x, count(*) FILTER (side = 'y') AS n_y FROM s GROUP BY label)
SELECT label, n_x, n_y, round(greatest(2 * max(d) FILTER (k = 'xy') - max(d) FILTER (k = 'xx') - max(d) FILTER (k = 'yy'), 0), 6) AS energy_distance FROM p JOIN n USING (label) GROUP BY ALL""")
def energy_distance(spark, sf):
    """Multivariate energy distance between the two samples of every label."""
    return B.rounded(distances.energy_distance(samples(spark, sf), ["label"], "side", "entity", "v"))


W1 = """
c AS (SELECT {keys}, v, sum(CASE WHEN side = 'x' THEN 1 ELSE 0 END) AS cx, sum(CASE WHEN side = 'y' THEN 1 ELSE 0 END) AS cy FROM {rows} GROUP BY ALL),
g AS (SELECT {keys}, abs(sum(cx) OVER w / sum(cx) OVER (PARTITION BY {keys}) - sum(cy) OVER w / sum(cy) OVER (PARTITION BY {keys})) * (lead(v) OVER w - v) AS g FROM c WINDOW w AS (PARTITION BY {keys} ORDER BY v)),
w1 AS (SELECT {keys}, coalesce(sum(g), 0) AS wasserstein FROM g GROUP BY ALL)"""


@query(f"""WITH {SAMPLES},{DIRS}, r AS (SELECT label, side, direction, list_dot_product(s.v, w) AS v FROM s, dirs),{W1.format(keys='label, direction', rows='r')}
SELECT label, round(avg(wasserstein), 6) AS sliced_wasserstein FROM w1 GROUP BY label""")
def sliced_wasserstein(spark, sf):
    """Mean one-dimensional Wasserstein distance over fixed directions."""
    rows = samples(spark, sf)
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    dirs = pinned(distances.directions(spark, DIRECTIONS, dims, B.SEED))
    return B.rounded(distances.sliced_wasserstein(rows, ["label"], "side", "v", dirs, DIRECTIONS))


@query(f"""WITH o AS (SELECT o_orderpriority AS key, CASE WHEN o_orderstatus = 'F' THEN 'x' ELSE 'y' END AS side, o_totalprice AS v FROM orders),{W1.format(keys='key', rows='o')}
SELECT key, round(wasserstein, 4) AS wasserstein FROM w1""")
def wasserstein_1d(spark, sf):
    """Exact Wasserstein distance between two price samples per priority."""
    rows = B.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("key"), F.when(F.col("o_orderstatus") == "F", "x").otherwise("y").alias("side"), F.col("o_totalprice").alias("v")
    )
    return B.rounded(distances.wasserstein_1d(rows, ["key"], "side", "v"), 4)


@query(f"""WITH {SAMPLES}, m AS (SELECT label, i, avg(v[i]) FILTER (side = 'y') - avg(v[i]) FILTER (side = 'x') AS d FROM s, range(1, {DIMS + 1}) t(i) GROUP BY ALL),
ov AS (SELECT i, avg(v[i]) AS l FROM s, range(1, {DIMS + 1}) t(i) GROUP BY i), pr AS (SELECT label, sum(d * l) AS q FROM m JOIN ov USING (i) GROUP BY label),
sh AS (SELECT label, 'NO_CHANGE' AS model, list_transform(range({DIMS}), lambda i: 0.0) AS shift FROM pr UNION ALL SELECT label, 'MEAN', list(d ORDER BY i) FROM m GROUP BY label UNION ALL SELECT label, 'PROJECTED', list(q * l ORDER BY i) FROM pr, ov GROUP BY label),
mv AS (SELECT label, model, entity, list_transform(range(1, {DIMS + 1}), lambda i: v[i] + shift[i]) AS v FROM s JOIN sh USING (label) WHERE side = 'x'),
al AS (SELECT label, model, 'x' AS side, v FROM mv UNION ALL SELECT label, model, 'y', v FROM s JOIN (SELECT DISTINCT label, model FROM sh) USING (label) WHERE side = 'y'),
p AS (SELECT a.label, a.model, a.side || b.side AS k, avg(list_distance(a.v, b.v)) AS d FROM al a JOIN al b ON a.label = b.label AND a.model = b.model GROUP BY ALL)
SELECT label, model, round(greatest(2 * max(d) FILTER (k = 'xy') - max(d) FILTER (k = 'xx') - max(d) FILTER (k = 'yy'), 0), 6) AS energy_distance FROM p GROUP BY ALL""")
def latent_shift(spark, sf):
    """Control vectors moved by each model's shift, compared with the treated sample."""
    rows = pinned(samples(spark, sf))
    long = rows.select("label", "side", F.posexplode("v").alias("feature", "value"))
    side = lambda s: F.avg(F.when(F.col("side") == s, F.col("value")))
    deltas = pinned(long.groupBy("label", "feature").agg((side("y") - side("x")).alias("delta")))
    axis = long.groupBy("feature").agg(F.avg("value").alias("loading")).withColumn("component", F.lit(0))
    projected = distances.latent_shift(deltas, axis, ["label"]).select("label", F.col("shift")[0].alias("q"))
    packed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("feature", F.col(c).alias("w")))), lambda e: e["w"])
    mean = deltas.groupBy("label").agg(packed("delta").alias("shift")).withColumn("model", F.lit("MEAN"))
    moved = deltas.join(axis.select("feature", "loading"), "feature").join(projected, "label").withColumn("w", F.col("q") * F.col("loading"))
    low = moved.groupBy("label").agg(packed("w").alias("shift")).withColumn("model", F.lit("PROJECTED"))
    still = mean.select("label", F.transform("shift", lambda v: v * 0.0).alias("shift"), F.lit("NO_CHANGE").alias("model"))
    shifts = pinned(metrics.union_all([mean, low, still]))
    cells = distances.shifted_cells(rows.where("side = 'x'"), shifts, "label", "v")
    treated = rows.where("side = 'y'").join(shifts.select("label", "model"), "label")
    both = cells.select("label", "model", "side", "entity", "v").unionByName(treated.select("label", "model", "side", "entity", "v"))
    return B.rounded(distances.energy_distance(pinned(both), ["label", "model"], "side", "entity", "v").drop("n_x", "n_y"))


COMPONENTS = 10
MOST_VARIABLE = 2000


@query()
def latent_shift_components(spark, sf):
    """Control and treated vectors in ten components of the control vectors, the control side moved by predicted shifts.

    Models: no change, the label's own mean difference, the mean difference of
    all other labels. Labels with one side only are left out.
    """
    rows = pinned(samples(spark, sf))
    pca = distances.control_components(rows, "side", "entity", "v", COMPONENTS, MOST_VARIABLE)
    space = pinned(distances.in_components(rows, pca, "v", "entity", centre=True))
    side = lambda s: F.avg(F.when(F.col("side") == s, F.col("value")))
    long = rows.select("label", "side", F.posexplode("v").alias("feature", "value"))
    deltas = pinned(long.groupBy("label", "feature").agg((side("y") - side("x")).alias("delta")).where("delta IS NOT NULL"))
    totals = deltas.groupBy("feature").agg(F.sum("delta").alias("all"), F.count("delta").alias("n"))
    other = deltas.join(totals, "feature").where("n > 1").withColumn("delta", (F.col("all") - F.col("delta")) / (F.col("n") - 1))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("feature", "delta"))), lambda e: e["delta"])
    vectors = lambda df, model: df.groupBy("label").agg(packed.alias("shift")).withColumn("model", F.lit(model))
    still = deltas.withColumn("delta", F.lit(0.0))
    moves = metrics.union_all([vectors(still, "NO_CHANGE"), vectors(deltas, "LABEL_MEAN"), vectors(other, "OTHER_LABELS")])
    shifts = pinned(distances.in_components(moves, pca, "shift", "label", centre=False))
    moved = distances.shifted_cells(space.where("side = 'x'"), shifts, "label", "v")
    treated = space.where("side = 'y'").join(shifts.select("label", "model"), "label")
    columns = ["label", "model", "side", "entity", "v"]
    both = pinned(moved.select(*columns).unionByName(treated.select(*columns)))
    dirs = pinned(distances.directions(spark, DIRECTIONS, pca.count(), B.SEED))
    keys = ["label", "model"]
    energy = distances.energy_distance(both, keys, "side", "entity", "v")
    return B.rounded(energy.join(distances.sliced_wasserstein(both, keys, "side", "v", dirs, DIRECTIONS), keys))
