"""Bootstrap, permutation, multiple testing and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosewise.operators import enrichment, resample, summaries, vectors
from dosewise.queries import base as B
from dosewise.queries.registry import query
from dosewise.session import pinned

BOOT, PERM = resample.BOOTSTRAPS, resample.PERMUTATIONS
MEANS = resample.BOOTSTRAPS


def rank_sql(keys: str, value: str) -> str:
    return f"rank() OVER (PARTITION BY {keys} ORDER BY {value}) + (count(*) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0"


# --- entity features used as test inputs ------------------------------------

FEATURES = f"""{B.response_sql()}, {B.SUPPLIERS.strip()},
size AS (SELECT entity, sqrt(avg(delta * delta)) AS response_rms, avg(delta) AS response_mean FROM response GROUP BY entity),
sup AS (SELECT entity, least(count(DISTINCT cell) FILTER (condition = 'control'), count(DISTINCT cell) FILTER (condition = 'treated')) AS min_cells FROM obs GROUP BY entity),
feat AS (SELECT entity, lineage, n_regionkey, sensitivity, sensitivity > 5000 AS flag_a, n_regionkey < 2 AS flag_b, response_rms, response_mean, CAST(min_cells AS DOUBLE) AS min_cells
  FROM size JOIN sup USING (entity) JOIN suppliers USING (entity))"""


def entity_features(spark, sf):
    response = B.response(spark, sf).groupBy("entity").agg(
        F.sqrt(F.avg(F.col("delta") * F.col("delta"))).alias("response_rms"), F.avg("delta").alias("response_mean")
    )
    side = lambda c: F.count_distinct(F.when(F.col("condition") == c, F.col("cell")))
    support = B.entity_cells(spark, sf).groupBy("entity").agg(
        F.least(side("control"), side("treated")).cast("double").alias("min_cells")
    )
    return pinned(
        response.join(support, "entity").join(B.suppliers(spark, sf), "entity")
        .withColumn("flag_a", F.col("sensitivity") > 5000).withColumn("flag_b", F.col("n_regionkey") < 2)
    )


def _tall(df, pairs):
    """(test, entity, x, y) rows for several column pairs."""
    return df.select("entity", F.explode(F.array(*[
        F.struct(F.lit(name).alias("test"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        for name, x, y in pairs
    ])).alias("t")).select("t.test", "entity", "t.x", "t.y")


SPEARMAN_PAIRS = [
    ("rms_sensitivity", "sensitivity", "response_rms"), ("mean_sensitivity", "sensitivity", "response_mean"),
    ("rms_cells", "min_cells", "response_rms"),
]


def _spearman_ctes(source: str, seed) -> str:
    """CTEs ending in `sp(test, effect, ci_low, ci_high, p_value, n)` from source(test, entity, x, y)."""
    return f"""
s0 AS (SELECT *, {rank_sql('test', 'x')} AS rx, {rank_sql('test', 'y')} AS ry,
  row_number() OVER (PARTITION BY test ORDER BY md5(concat_ws('|', '{seed}', entity)), entity) AS pos, count(*) OVER (PARTITION BY test) AS n FROM {source}),
so AS (SELECT test, {B.pearson_sql('rx', 'ry')} AS effect, count(*) AS n, sum(rx * ry) AS s FROM s0 GROUP BY test),
sd AS (SELECT test, rep, {B.draw_sql('n', seed, 'rep', 'pos')} + 1 AS pos FROM s0, range({BOOT}) t(rep)),
sb AS (SELECT d.test, rep, x, y FROM sd d JOIN s0 USING (test, pos)),
sr AS (SELECT test, rep, {rank_sql('test, rep', 'x')} AS bx, {rank_sql('test, rep', 'y')} AS bc FROM sb),
sc AS (SELECT test, rep, {B.pearson_sql('bx', 'bc')} AS r FROM sr GROUP BY ALL),
si AS (SELECT test, quantile_cont(r, 0.025) AS ci_low, quantile_cont(r, 0.975) AS ci_high FROM sc GROUP BY test),
sp0 AS (SELECT test, rep, rx, row_number() OVER (PARTITION BY test, rep ORDER BY md5(concat_ws('|', '{seed}p', rep, pos)), pos) AS rn FROM s0, range({PERM}) t(rep)),
sn AS (SELECT a.test, rep, sum(a.rx * b.ry) AS sp FROM sp0 a JOIN s0 b ON a.test = b.test AND a.rn = b.pos GROUP BY ALL),
sh AS (SELECT test, count(*) FILTER (abs(sp - n * (n + 1) * (n + 1) / 4.0) >= abs(s - n * (n + 1) * (n + 1) / 4.0)) AS hits FROM sn JOIN so USING (test) GROUP BY test),
sp AS (SELECT test, effect, ci_low, ci_high, (hits + 1.0) / ({PERM} + 1.0) AS p_value, n FROM so JOIN si USING (test) JOIN sh USING (test))"""


@query(f"""WITH {FEATURES},
src AS (SELECT 'rms_sensitivity' AS test, entity, sensitivity AS x, response_rms AS y FROM feat UNION ALL SELECT 'mean_sensitivity', entity, sensitivity, response_mean FROM feat
  UNION ALL SELECT 'rms_cells', entity, min_cells, response_rms FROM feat),{_spearman_ctes('src', B.SEED)}
SELECT test, round(effect, 6) AS effect, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p_value, 6) AS p_value, n FROM sp""")
def spearman_perm(spark, sf):
    """Spearman effects with re-ranked bootstrap intervals and permutation p-values."""
    rows = _tall(entity_features(spark, sf), SPEARMAN_PAIRS)
    return B.rounded(resample.spearman_inference(rows, ["test"], "x", "y", ["entity"], B.SEED, BOOT, PERM))


def _partial_ctes(source: str, seed) -> str:
    return f"""
q0 AS (SELECT *, {rank_sql('test', 'x')} AS rx, {rank_sql('test', 'y')} AS ry, {rank_sql('test', 'z')} AS rz,
  row_number() OVER (PARTITION BY test ORDER BY md5(concat_ws('|', '{seed}', entity)), entity) AS pos, count(*) OVER (PARTITION BY test) AS n FROM {source}),
qf AS (SELECT test, avg(rx) AS mx, avg(ry) AS my, avg(rz) AS mz, coalesce(covar_pop(rx, rz) / nullif(var_pop(rz), 0), 0) AS bx, coalesce(covar_pop(ry, rz) / nullif(var_pop(rz), 0), 0) AS bb FROM q0 GROUP BY test),
qe AS (SELECT test, pos, n, rx - mx - bx * (rz - mz) AS ex, ry - my - bb * (rz - mz) AS ey FROM q0 JOIN qf USING (test)),
qo AS (SELECT test, {B.pearson_sql('ex', 'ey')} AS effect, count(*) AS n, sum(ex * ey) AS s FROM qe GROUP BY test),
qd AS (SELECT test, rep, {B.draw_sql('n', seed, 'rep', 'pos')} + 1 AS pos FROM q0, range({BOOT}) t(rep)),
qb AS (SELECT d.test, rep, x, y, z FROM qd d JOIN q0 USING (test, pos)),
qr AS (SELECT test, rep, {rank_sql('test, rep', 'x')} AS a, {rank_sql('test, rep', 'y')} AS b, {rank_sql('test, rep', 'z')} AS c FROM qb),
qc AS (SELECT test, rep, {B.pearson_sql('a', 'b')} AS xy, {B.pearson_sql('a', 'c')} AS xz, {B.pearson_sql('b', 'c')} AS yz FROM qr GROUP BY ALL),
qi AS (SELECT test, quantile_cont(r, 0.025) AS ci_low, quantile_cont(r, 0.975) AS ci_high FROM (SELECT test, (xy - xz * yz) / nullif(sqrt(greatest((1 - xz * xz) * (1 - yz * yz), 0)), 0) AS r FROM qc) GROUP BY test),
qp AS (SELECT test, rep, ex, row_number() OVER (PARTITION BY test, rep ORDER BY md5(concat_ws('|', '{seed}p', rep, pos)), pos) AS rn FROM qe, range({PERM}) t(rep)),
qn AS (SELECT a.test, rep, sum(a.ex * b.ey) AS sp FROM qp a JOIN qe b ON a.test = b.test AND a.rn = b.pos GROUP BY ALL),
qh AS (SELECT test, count(*) FILTER (round(abs(sp) / n, 9) >= round(abs(s) / n, 9)) AS hits FROM qn JOIN qo USING (test) GROUP BY test),
pp AS (SELECT test, effect, ci_low, ci_high, (hits + 1.0) / ({PERM} + 1.0) AS p_value, n FROM qo JOIN qi USING (test) JOIN qh USING (test))"""


@query(f"""WITH {FEATURES},
src AS (SELECT 'rms_given_cells' AS test, entity, sensitivity AS x, response_rms AS y, min_cells AS z FROM feat),{_partial_ctes('src', B.SEED)}
SELECT test, round(effect, 6) AS effect, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p_value, 6) AS p_value, n FROM pp""")
def partial_spearman(spark, sf):
    """Spearman of sensitivity and response size given the cell count."""
    rows = entity_features(spark, sf).select(
        F.lit("rms_given_cells").alias("test"), "entity", F.col("sensitivity").alias("x"), F.col("response_rms").alias("y"), F.col("min_cells").alias("z")
    )
    return B.rounded(resample.partial_spearman_inference(rows, ["test"], "x", "y", "z", ["entity"], B.SEED, BOOT, PERM))


def _cliff_ctes(source: str, seed) -> str:
    """From source(test, entity, v, f)."""
    delta = "2 * (sum(CASE WHEN f THEN {r} ELSE 0 END) - count(*) FILTER (f) * (count(*) FILTER (f) + 1) / 2.0) / (count(*) FILTER (f) * count(*) FILTER (NOT f)) - 1"
    return f"""
c0 AS (SELECT *, {rank_sql('test', 'v')} AS r, row_number() OVER (PARTITION BY test, f ORDER BY md5(concat_ws('|', '{seed}', entity)), entity) AS spos, count(*) OVER (PARTITION BY test, f) AS sn,
  row_number() OVER (PARTITION BY test ORDER BY md5(concat_ws('|', '{seed}', entity)), entity) AS pos FROM {source}),
co AS (SELECT test, {delta.format(r='r')} AS effect, count(*) AS n, count(*) FILTER (f) AS nf, sum(v) AS t, sum(v) FILTER (f) AS s FROM c0 GROUP BY test),
cd AS (SELECT test, f, rep, {B.draw_sql('sn', seed, 'rep', 'spos')} + 1 AS spos FROM c0, range({BOOT}) t(rep)),
cb AS (SELECT d.test, d.f, rep, v FROM cd d JOIN c0 USING (test, f, spos)),
cr AS (SELECT test, f, rep, {rank_sql('test, rep', 'v')} AS br FROM cb),
cdl AS (SELECT test, rep, {delta.format(r='br')} AS d FROM cr GROUP BY ALL),
cint AS (SELECT test, quantile_cont(d, 0.025) AS ci_low, quantile_cont(d, 0.975) AS ci_high FROM cdl GROUP BY test),
cp AS (SELECT test, rep, v, row_number() OVER (PARTITION BY test, rep ORDER BY md5(concat_ws('|', '{seed}p', rep, pos)), pos) AS rn FROM c0, range({PERM}) t(rep)),
cn AS (SELECT test, rep, sum(v) AS sp FROM cp JOIN co USING (test) WHERE rn <= nf GROUP BY ALL),
ch AS (SELECT test, count(*) FILTER (round(abs(sp / nf - (t - sp) / (n - nf)), 9) >= round(abs(s / nf - (t - s) / (n - nf)), 9)) AS hits FROM cn JOIN co USING (test) GROUP BY test),
cl AS (SELECT test, effect, ci_low, ci_high, (hits + 1.0) / ({PERM} + 1.0) AS p_value, n FROM co JOIN cint USING (test) JOIN ch USING (test))"""


@query(f"""
WITH d AS (SELECT lang AS test, doc_id AS entity, CAST(n_chars AS DOUBLE) AS v, toxic = 1 AS f FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT 'all', doc_id, CAST(n_chars AS DOUBLE), quality = 1 FROM documents JOIN labels USING (doc_id)),
ok AS (SELECT test FROM d GROUP BY test HAVING count(*) FILTER (f) >= 2 AND count(*) FILTER (NOT f) >= 2), src AS (SELECT d.* FROM d SEMI JOIN ok USING (test)),{_cliff_ctes('src', B.SEED)}
SELECT test, round(effect, 6) + 0.0 AS effect, round(ci_low, 6) + 0.0 AS ci_low, round(ci_high, 6) + 0.0 AS ci_high, round(p_value, 6) AS p_value, n FROM cl""")
def cliffs_delta(spark, sf):
    """Document length of flagged against other documents."""
    docs = B.table(spark, sf, "documents").join(B.table(spark, sf, "labels"), "doc_id").select(
        "lang", F.col("doc_id").alias("entity"), F.col("n_chars").cast("double").alias("v"), "toxic", "quality"
    )
    rows = docs.select(F.col("lang").alias("test"), "entity", "v", (F.col("toxic") == 1).alias("f")).unionByName(
        docs.select(F.lit("all").alias("test"), "entity", "v", (F.col("quality") == 1).alias("f"))
    )
    result = resample.cliffs_delta_inference(pinned(rows), ["test"], "v", "f", ["entity"], B.SEED, BOOT, PERM)
    return B.rounded(result.where(F.col("effect").isNotNull()))


def _eta_ctes(source: str, seed) -> str:
    """From source(test, entity, v, g)."""
    return f"""
e0 AS (SELECT test, entity, g, v - avg(v) OVER (PARTITION BY test) AS d, row_number() OVER (PARTITION BY test ORDER BY md5(concat_ws('|', '{seed}', entity)), entity) AS pos FROM {source}),
et AS (SELECT test, count(*) AS n, sum(d * d) AS total FROM e0 GROUP BY test),
eb AS (SELECT test, sum(s * s / c) AS b FROM (SELECT test, g, sum(d) AS s, count(*) AS c FROM e0 GROUP BY ALL) GROUP BY test),
ep AS (SELECT test, rep, d, row_number() OVER (PARTITION BY test, rep ORDER BY md5(concat_ws('|', '{seed}p', rep, pos)), pos) AS rn FROM e0, range({PERM}) t(rep)),
en AS (SELECT test, rep, sum(s * s / c) AS b FROM (SELECT a.test, rep, e0.g, sum(a.d) AS s, count(*) AS c FROM ep a JOIN e0 ON a.test = e0.test AND a.rn = e0.pos GROUP BY ALL) GROUP BY ALL),
eh AS (SELECT test, count(*) FILTER (round(en.b / total, 9) >= round(eb.b / total, 9)) AS hits FROM en JOIN et USING (test) JOIN eb USING (test) GROUP BY test),
es AS (SELECT test, b / total AS effect, (hits + 1.0) / ({PERM} + 1.0) AS p_value, n FROM et JOIN eb USING (test) JOIN eh USING (test))"""


@query(f"""
WITH src AS (SELECT 'lang' AS test, doc_id AS entity, CAST(n_chars AS DOUBLE) AS v, lang AS g FROM documents UNION ALL SELECT 'source', doc_id, CAST(n_chars AS DOUBLE), source FROM documents),
{_eta_ctes('src', B.SEED)}
SELECT test, round(effect, 6) AS effect, round(p_value, 6) AS p_value, n FROM es""")
def eta_squared(spark, sf):
    """Share of document length explained by language and by source."""
    docs = B.table(spark, sf, "documents")
    rows = docs.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("test"), F.col("doc_id").alias("entity"), F.col("n_chars").cast("double").alias("v"), F.col(c).alias("g"))
        for c in ("lang", "source")
    ])).alias("r")).select("r.*")
    return B.rounded(resample.eta_squared_inference(rows, ["test"], "v", "g", ["entity"], B.SEED, PERM))


@query(f"""
WITH v AS (SELECT c_mktsegment AS test, c_custkey AS entity, sum(o_totalprice) AS v FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY test ORDER BY md5(concat_ws('|', '{B.SEED}', entity)), entity) AS pos, count(*) OVER (PARTITION BY test) AS n FROM v),
d AS (SELECT test, rep, {B.draw_sql('n', B.SEED, 'rep', 'pos')} + 1 AS pos FROM p, range({MEANS}) t(rep)),
m AS (SELECT test, rep, avg(v) AS m FROM d JOIN p USING (test, pos) GROUP BY ALL),
c AS (SELECT test, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM m GROUP BY test)
SELECT test, round(avg(v), 4) AS mean, count(*) AS n, round(any_value(ci_low), 4) AS ci_low, round(any_value(ci_high), 4) AS ci_high FROM v JOIN c USING (test) GROUP BY test""")
def bootstrap_ci(spark, sf):
    """Mean spend per market segment with a bootstrap interval."""
    spend = B.table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    rows = B.table(spark, sf, "customer").join(spend, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_mktsegment").alias("test"), F.col("c_custkey").alias("entity"), "v"
    )
    return B.rounded(resample.bootstrap_mean(rows, ["test"], "v", ["entity"], B.SEED, MEANS), 4)


def bh_sql(source: str, family: str, ids: str) -> str:
    """CTEs b1..bh adding fdr_bh to source(p_value)."""
    part = f"PARTITION BY {family}" if family else ""
    return f"""
b1 AS (SELECT *, row_number() OVER ({part} ORDER BY p_value, {ids}) AS rnk, count(*) OVER ({part}) AS m FROM {source} WHERE p_value IS NOT NULL),
bh AS (SELECT *, greatest(least(min(p_value * m / rnk) OVER ({part} ORDER BY rnk DESC ROWS UNBOUNDED PRECEDING), 1), 0) AS fdr_bh FROM b1)"""


@query(f"""
WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice / (SELECT max(o_totalprice) FROM orders) AS p_value, o_orderpriority AS family FROM orders),
{bh_sql('o', 'family', 'o_orderkey')}
SELECT family, o_orderkey, round(p_value, 6) AS p_value, round(fdr_bh, 6) AS fdr_bh FROM bh""")
def bh_adjust(spark, sf):
    """Benjamini-Hochberg over price quantile scores, one family per priority."""
    orders = B.table(spark, sf, "orders")
    top = orders.agg(F.max("o_totalprice").alias("_top"))
    rows = summaries.one_row(orders, top).select(
        F.col("o_orderpriority").alias("family"), "o_orderkey", (F.col("o_totalprice") / F.col("_top")).alias("p_value")
    )
    return B.rounded(enrichment.benjamini_hochberg(rows, ["family"], "p_value", ["o_orderkey"]))


@query(f"""WITH {FEATURES},
src AS (SELECT 'sensitivity/rms' AS test, entity, sensitivity AS x, response_rms AS y FROM feat UNION ALL SELECT 'sensitivity/mean', entity, sensitivity, response_mean FROM feat),{_spearman_ctes('src', B.SEED)},
psrc AS (SELECT 'sensitivity/rms|cells' AS test, entity, sensitivity AS x, response_rms AS y, min_cells AS z FROM feat),{_partial_ctes('psrc', B.SEED)},
csrc AS (SELECT 'flag_a/rms' AS test, entity, response_rms AS v, flag_a AS f FROM feat UNION ALL SELECT 'flag_b/rms', entity, response_rms, flag_b FROM feat),{_cliff_ctes('csrc', B.SEED)},
esrc AS (SELECT 'region/rms' AS test, entity, response_rms AS v, n_regionkey AS g FROM feat),{_eta_ctes('esrc', B.SEED)},
allt AS (SELECT 'spearman' AS family, * FROM sp UNION ALL BY NAME SELECT 'partial_spearman' AS family, * FROM pp UNION ALL BY NAME SELECT 'cliffs_delta' AS family, * FROM cl UNION ALL BY NAME SELECT 'eta_squared' AS family, * FROM es),
{bh_sql('allt', '', 'test')}
SELECT family, test, round(effect, 6) AS effect, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p_value, 6) AS p_value, n, round(fdr_bh, 6) AS fdr_bh FROM bh""")
def association_registry(spark, sf):
    """All association tests in one table, one adjusted family."""
    from dosewise.plans import association

    feats = entity_features(spark, sf)
    return B.rounded(association.registry(
        spearman=_tall(feats, [("sensitivity/rms", "sensitivity", "response_rms"), ("sensitivity/mean", "sensitivity", "response_mean")]),
        partial=feats.select(
            F.lit("sensitivity/rms|cells").alias("test"), "entity", F.col("sensitivity").alias("x"), F.col("response_rms").alias("y"), F.col("min_cells").alias("z")
        ),
        binary=feats.select("entity", F.explode(F.array(*[
            F.struct(F.lit(f"{f}/rms").alias("test"), F.col("response_rms").alias("x"), F.col(f).alias("y")) for f in ("flag_a", "flag_b")
        ])).alias("t")).select("t.test", "entity", "t.x", "t.y"),
        categorical=feats.select(F.lit("region/rms").alias("test"), "entity", F.col("response_rms").alias("x"), F.col("n_regionkey").alias("y")),
        ids=["entity"], seed=B.SEED, bootstraps=BOOT, permutations=PERM,
    ))


@query(f"""WITH {B.response_sql()}, {B.SUPPLIERS.strip()},
v AS (SELECT gene_symbol AS test, entity, avg(delta) AS y FROM response GROUP BY ALL), src AS (SELECT v.*, sensitivity AS x FROM v JOIN suppliers USING (entity)),
{_spearman_ctes('src', B.SEED)},
m0 AS (SELECT *, row_number() OVER (PARTITION BY test ORDER BY md5(concat_ws('|', '{B.SEED}', entity)), entity) AS pos, count(*) OVER (PARTITION BY test) AS n FROM src),
md AS (SELECT test, rep, {B.draw_sql('n', B.SEED, 'rep', 'pos')} + 1 AS pos FROM m0, range({BOOT}) t(rep)),
mm AS (SELECT test, rep, avg(y) AS m FROM md JOIN m0 USING (test, pos) GROUP BY ALL),
mi AS (SELECT test, quantile_cont(m, 0.025) AS mean_low, quantile_cont(m, 0.975) AS mean_high FROM mm GROUP BY test),
ma AS (SELECT test, avg(y) AS mean FROM src GROUP BY test),
allt AS (SELECT * FROM sp JOIN mi USING (test) JOIN ma USING (test)),
{bh_sql('allt', '', 'test')}
SELECT test, round(mean, 6) AS mean, round(mean_low, 6) AS mean_low, round(mean_high, 6) AS mean_high, round(effect, 6) AS effect, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p_value, 6) AS p_value, n, round(fdr_bh, 6) AS fdr_bh FROM bh""")
def target_features(spark, sf):
    """Mean response of every symbol and its association with sensitivity, own adjusted family."""
    from dosewise.plans import association

    named = B.response(spark, sf).join(B.genes(spark, sf).select("gene_idx", "gene_symbol"), "gene_idx")
    values = named.groupBy(F.col("gene_symbol").alias("test"), "entity").agg(F.avg("delta").alias("y"))
    rows = values.join(B.suppliers(spark, sf).select("entity", F.col("sensitivity").alias("x")), "entity")
    return B.rounded(association.target_table(pinned(rows), ["entity"], B.SEED, BOOT, PERM))


# --- feature sets ------------------------------------------------------------

TOPSETS = f"""{B.response_sql()}, {B.SUPPLIERS.strip()},
ld AS (SELECT lineage AS model_fold, gene_idx, gene_id, avg(delta) AS loading FROM response JOIN suppliers USING (entity) GROUP BY ALL),
tl AS (SELECT *, row_number() OVER (PARTITION BY model_fold ORDER BY round(loading, 9), gene_idx) AS lo, row_number() OVER (PARTITION BY model_fold ORDER BY round(loading, 9) DESC, gene_idx) AS hi FROM ld),
tops AS (SELECT model_fold, 'negative' AS direction, gene_idx, gene_id AS symbol, loading, lo AS rank FROM tl WHERE lo <= 25 UNION ALL SELECT model_fold, 'positive', gene_idx, gene_id, loading, hi FROM tl WHERE hi <= 25),
sets AS (SELECT collection, gene_id AS symbol FROM genes)"""


def _tops(spark, sf):
    dictionary = B.genes(spark, sf)
    rows = B.response(spark, sf).join(B.suppliers(spark, sf).select("entity", F.col("lineage").alias("model_fold")), "entity")
    means = rows.groupBy("model_fold", "gene_idx").agg(F.round(F.avg("delta"), 9).alias("loading"))
    top = enrichment.top_loadings(pinned(means), ["model_fold"], "loading", "gene_idx", 25)
    named = top.join(dictionary.select("gene_idx", F.col("gene_id").alias("symbol")), "gene_idx")
    return pinned(named), dictionary.select("collection", F.col("gene_id").alias("symbol"))


@query(f"WITH {TOPSETS} SELECT model_fold, direction, symbol, CAST(rank AS INTEGER) AS rank, round(loading, 6) + 0.0 AS loading FROM tops")
def top_features(spark, sf):
    """25 most negative and most positive features per lineage."""
    top, _ = _tops(spark, sf)
    return B.rounded(top.select("model_fold", "direction", "symbol", "rank", "loading"))


@query(f"""WITH {TOPSETS},
z AS (SELECT collection, count(DISTINCT symbol) AS set_size FROM sets GROUP BY collection),
t AS (SELECT model_fold, direction, count(DISTINCT symbol) AS top_size FROM tops GROUP BY ALL),
h AS (SELECT model_fold, direction, collection, count(DISTINCT symbol) AS overlap, string_agg(DISTINCT symbol, ';' ORDER BY symbol) AS overlap_symbols FROM tops JOIN sets USING (symbol) GROUP BY ALL),
g AS (SELECT t.*, z.*, coalesce(overlap, 0) AS overlap, coalesce(overlap_symbols, '') AS overlap_symbols, (SELECT count(DISTINCT symbol) FROM sets) AS nu FROM t CROSS JOIN z LEFT JOIN h USING (model_fold, direction, collection)),
lf AS (SELECT n, lgamma(n + 1.0) AS f FROM range(400) r(n)),
tail AS (SELECT model_fold, direction, collection, sum(exp(a.f - i.f - b.f + c.f - d.f - e.f - (u.f - k.f - l.f))) AS p
  FROM g, LATERAL (SELECT unnest(range(greatest(overlap, set_size + top_size - nu), least(set_size, top_size) + 1)) AS ii) s
  JOIN lf a ON a.n = set_size JOIN lf i ON i.n = ii JOIN lf b ON b.n = set_size - ii JOIN lf c ON c.n = nu - set_size JOIN lf d ON d.n = top_size - ii JOIN lf e ON e.n = nu - set_size - top_size + ii
  JOIN lf u ON u.n = nu JOIN lf k ON k.n = top_size JOIN lf l ON l.n = nu - top_size GROUP BY ALL),
gt AS (SELECT g.*, CASE WHEN overlap <= 0 THEN 1.0 ELSE least(p, 1.0) END AS p_value FROM g LEFT JOIN tail USING (model_fold, direction, collection)),
{bh_sql('gt', '', 'model_fold, direction, collection')}
SELECT model_fold, direction, collection, top_size, set_size, overlap, overlap_symbols, round(p_value, 6) AS p_value, round(fdr_bh, 6) AS fdr_bh FROM bh""")
def set_enrichment(spark, sf):
    """Over-representation of every top list in every feature set."""
    top, sets = _tops(spark, sf)
    tested = enrichment.over_representation(top, sets, sets, ["model_fold", "direction"])
    return B.rounded(tested.select(
        "model_fold", "direction", "collection", "top_size", "set_size", "overlap", "overlap_symbols", "p_value", "fdr_bh"
    ))


@query(f"""WITH {TOPSETS}
SELECT model_fold, direction, collection, string_agg(DISTINCT symbol, ';' ORDER BY symbol) AS symbols, count(DISTINCT symbol) AS n FROM tops JOIN sets USING (symbol) GROUP BY ALL""")
def overlap_list(spark, sf):
    """Sorted overlap symbols per list and set."""
    top, sets = _tops(spark, sf)
    found = enrichment.overlaps(top, sets, ["model_fold", "direction"]).where(F.col("overlap") > 0)
    return found.select("model_fold", "direction", "collection", F.col("overlap_symbols").alias("symbols"), F.col("overlap").alias("n"))


@query(f"""WITH {B.response_sql()}, {B.SUPPLIERS.strip()},
st AS (SELECT lineage AS model_fold, gene_idx, avg(control) AS mean, var_pop(control) AS variance FROM response JOIN suppliers USING (entity) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY model_fold ORDER BY round(variance, 9) DESC, gene_idx) AS rank FROM st WHERE mean >= 0.1 AND variance > 1e-10),
sel AS (SELECT model_fold, gene_idx FROM r WHERE rank <= 50)
SELECT NULL AS model_fold, collection, count(DISTINCT gene_symbol) AS defined_symbols, count(DISTINCT gene_symbol) AS mapped_symbols,
  (SELECT count(DISTINCT b.gene_idx) FROM genes b WHERE b.gene_symbol IN (SELECT c.gene_symbol FROM genes c WHERE c.collection = a.collection)) AS mapped_columns, NULL::BIGINT AS selected_columns
FROM genes a GROUP BY collection
UNION ALL SELECT model_fold, s.collection, NULL, NULL, NULL, count(DISTINCT gene_idx) FROM sel JOIN genes g USING (gene_idx) JOIN (SELECT DISTINCT collection, gene_symbol FROM genes) s ON s.gene_symbol = g.gene_symbol GROUP BY ALL""")
def panel_coverage(spark, sf):
    """Defined and mapped symbols per set, and selected columns per fold."""
    dictionary = B.genes(spark, sf)
    rows = B.response(spark, sf).join(B.suppliers(spark, sf).select("entity", F.col("lineage").alias("model_fold")), "entity")
    top = vectors.variable_features(vectors.feature_stats(rows, ["model_fold"], "gene_idx", "control"), ["model_fold"], "gene_idx", 50)
    sets = dictionary.select("collection", F.col("gene_symbol").alias("symbol")).distinct()
    genes = dictionary.select(F.col("gene_symbol").alias("symbol"), "gene_idx")
    return enrichment.panel_coverage(sets, genes, top.select("model_fold", "gene_idx"), "gene_idx")


@query(f"""WITH {TOPSETS},
h AS (SELECT model_fold, direction, collection, count(DISTINCT symbol) AS n FROM tops JOIN sets USING (symbol) GROUP BY ALL)
SELECT collection, count(*) FILTER (direction = 'negative' AND n >= 5) AS negative, count(*) FILTER (direction = 'positive' AND n >= 5) AS positive FROM h GROUP BY collection""")
def grouped_flag_counts(spark, sf):
    """Lists with at least five overlapping symbols, by set and direction."""
    top, sets = _tops(spark, sf)
    found = enrichment.overlaps(top, sets, ["model_fold", "direction"])
    return enrichment.flag_counts(found, "collection", "direction", ["negative", "positive"], F.col("overlap") >= 5)
