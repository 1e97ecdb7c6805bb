"""Annotation joins, descriptive tables, reports, profiles, manifests, contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosewise.functions import scalar as S
from dosewise.operators import composition, enrichment, metrics, ranking, summaries, vectors
from dosewise.operators import contracts as C
from dosewise.operators import counts as K
from dosewise.plans import ablation
from dosewise.queries import base as B
from dosewise.queries.inference_queries import FEATURES, entity_features
from dosewise.queries.registry import query
from dosewise.session import pinned
from dosewise.sources import manifest, profile


# --- tags and annotations ----------------------------------------------------

@query("""
WITH t AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'DMSO' WHEN 'view' THEN 'Tram' WHEN 'signup' THEN 'Untreated' ELSE event_type END || '_' ||
  CASE hour(ts) // 4 WHEN 0 THEN '3' WHEN 1 THEN '6' WHEN 2 THEN '12' WHEN 3 THEN '24' WHEN 4 THEN '48' ELSE '96' END || 'hr' AS tag FROM events),
p AS (SELECT event_id, tag, regexp_extract(tag, '^(DMSO|Tram|Untreated)_(3|6|12|24|48)hr$', 1) AS a, regexp_extract(tag, '^(DMSO|Tram|Untreated)_(3|6|12|24|48)hr$', 2) AS h FROM t),
c AS (SELECT *, CASE WHEN a = 'DMSO' THEN 'control' WHEN a = 'Tram' THEN 'treated' WHEN a = 'Untreated' AND h = '48' THEN 'untreated' END AS condition FROM p)
SELECT event_id, tag, condition, CASE WHEN condition IS NOT NULL THEN CAST(h AS INTEGER) END AS hour,
  CASE WHEN condition IS NULL THEN NULL WHEN h IN ('3', '6') THEN 'early' WHEN h IN ('24', '48') THEN 'late' ELSE 'middle' END AS period, CASE WHEN condition IS NOT NULL THEN tag END AS rebuilt FROM c""")
def tag_parse(spark, sf):
    """Sample tags parsed to condition, hour and period, and written back."""
    events = B.table(spark, sf, "events")
    prefix = F.coalesce(S.literal_map("event_type", {"click": "DMSO", "view": "Tram", "signup": "Untreated"}), F.col("event_type"))
    hours = S.literal_map(F.floor(F.hour("ts") / 4).cast("int"), {0: "3", 1: "6", 2: "12", 3: "24", 4: "48"})
    tagged = events.select("event_id", F.concat(prefix, F.lit("_"), F.coalesce(hours, F.lit("96")), F.lit("hr")).alias("tag"))
    parsed = tagged.withColumn("condition", S.tag_condition("tag")).withColumn("hour", S.tag_hour("tag"))
    return parsed.select(
        "event_id", "tag", "condition", "hour", F.when(F.col("hour").isNotNull(), S.period("hour")).alias("period"),
        S.tag_text("condition", "hour").alias("rebuilt"),
    )


@query("""
WITH e AS (SELECT user_id, event_type, ts, event_id, value FROM events), u AS (SELECT DISTINCT user_id FROM events),
f AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM e WHERE event_type = 'purchase')
SELECT u.user_id, coalesce(event_type, 'unspecified') AS first_kind, coalesce(round(value, 4), 0.0) AS first_value, coalesce(value, 0) > 50 AS large, c_mktsegment AS segment, coalesce(c_mktsegment = 'BUILDING', false) AS in_pool
FROM u LEFT JOIN f ON u.user_id = f.user_id AND rn = 1 LEFT JOIN customer ON u.user_id = c_custkey""")
def annotation_join(spark, sf):
    """Left join on a deduplicated key with filled nulls and thresholds."""
    events = B.table(spark, sf, "events")
    users = events.select("user_id").distinct()
    bought = events.where("event_type = 'purchase'").select(
        "user_id", "event_id", F.col("event_type").alias("first_kind"), F.round("value", 4).alias("first_value")
    )
    segments = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    joined = composition.annotate(users, bought, "user_id", "event_id", {"first_kind": "unspecified", "first_value": 0.0})
    joined = joined.join(segments, "user_id", "left")
    return joined.select(
        "user_id", "first_kind", "first_value", S.over_threshold("first_value", 50).alias("large"), "segment",
        F.coalesce(F.col("segment") == "BUILDING", F.lit(False)).alias("in_pool"),
    )


@query(f"""
WITH {B.SUPPLIERS.strip()}, n AS (SELECT lineage, count(*) AS n FROM suppliers GROUP BY lineage)
SELECT entity, lineage, CASE WHEN n < 4 THEN 'other / rare' ELSE lineage END AS display_group FROM suppliers JOIN n USING (lineage)""")
def rare_lump(spark, sf):
    """Lineages with fewer than four entities shown together."""
    return vectors.display_groups(B.suppliers(spark, sf).select("entity", "lineage"), "lineage")


@query(f"""
WITH {FEATURES}, q AS (SELECT s_suppkey AS entity, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
v AS (SELECT l_suppkey AS entity, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY 1),
w AS (SELECT entity, count(DISTINCT cell) AS n_cells FROM obs GROUP BY entity)
SELECT entity, lineage, region, round(response_rms, 6) AS response_rms, round(response_mean, 6) + 0.0 AS response_mean, round(response_rms - abs(response_mean), 6) + 0.0 AS gain, min_cells, n_cells, round(revenue, 2) AS revenue
FROM feat JOIN q USING (entity) JOIN v USING (entity) JOIN w USING (entity)""")
def final_line_table(spark, sf):
    """Several one-to-one joins and a gain column per entity."""
    feats = entity_features(spark, sf).select("entity", "lineage", "n_regionkey", "response_rms", "response_mean", "min_cells")
    regions = B.table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    revenue = B.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("entity")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")
    )
    cells = B.entity_cells(spark, sf).groupBy("entity").agg(F.count_distinct("cell").alias("n_cells"))
    joined = composition.join_chain(feats, [(regions, ["n_regionkey"]), (revenue, ["entity"]), (cells, ["entity"])])
    return B.rounded(joined.select(
        "entity", "lineage", "region", "response_rms", "response_mean", (F.col("response_rms") - F.abs("response_mean")).alias("gain"),
        "min_cells", "n_cells", F.round("revenue", 2).alias("revenue"),
    ))


# --- descriptive tables --------------------------------------------------------

COHORT = f"""
WITH {B.OBS}, u AS (SELECT DISTINCT entity, cell, condition, hour FROM obs),
g AS (SELECT entity, condition, hour, count(*) AS n FROM u GROUP BY ALL)"""


@query(f"""{COHORT}
SELECT cohort, count(DISTINCT entity) AS n_entities, CAST(sum(n) AS BIGINT) AS n_cells FROM (
  SELECT 'all' AS cohort, * FROM g UNION ALL SELECT 'control', * FROM g WHERE condition = 'control' UNION ALL SELECT 'treated', * FROM g WHERE condition = 'treated'
  UNION ALL SELECT 'early', * FROM g WHERE hour IN (3, 6) UNION ALL SELECT 'large', * FROM g WHERE n >= 30) GROUP BY cohort""")
def cohort_summary(spark, sf):
    """Entities and cells of five overlapping cohorts in one pass."""
    groups = K.cells_per_group(B.entity_cells(spark, sf), ["entity", "condition", "hour"])
    tests = {
        "all": F.lit(True), "control": F.col("condition") == "control", "treated": F.col("condition") == "treated",
        "early": F.col("hour").isin(3, 6), "large": F.col("n_cells") >= 30,
    }
    return summaries.cohort_summary(groups, tests, "entity", "n_cells")


@query("""
SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(sum(value), 4) AS total,
  round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY event_type""")
def explore_summary(spark, sf):
    """count, mean, sd, extremes, total and exact quartiles per event type."""
    table = summaries.describe(B.table(spark, sf, "events"), ["event_type"], "value")
    return B.rounded(table.withColumn("total", F.round("total", 4)))


@query("""
WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 16)), 15) AS INTEGER) AS bin, count(*) AS n FROM orders, e GROUP BY 1""")
def hist1d(spark, sf):
    """Sixteen equal-width bins, last one closed."""
    return summaries.histogram(B.table(spark, sf, "orders"), "o_totalprice", 16)


ERRORS = """
WITH b AS (SELECT c_custkey AS entity, c_acctbal, count(o_orderkey) AS support, avg(o_totalprice) AS magnitude, stddev_pop(o_totalprice) AS error, max(o_totalprice) - min(o_totalprice) AS novelty
  FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL)"""


def error_rows(spark, sf):
    """Per customer: spread as error, mean as magnitude, range as novelty, orders as support."""
    orders, customers = B.table(spark, sf, "orders"), B.table(spark, sf, "customer")
    stats = orders.groupBy(F.col("o_custkey").alias("entity")).agg(
        F.count("o_orderkey").alias("support"), F.avg("o_totalprice").alias("magnitude"),
        F.stddev_pop("o_totalprice").alias("error"), (F.max("o_totalprice") - F.min("o_totalprice")).alias("novelty"),
    )
    return pinned(stats.join(customers.select(F.col("c_custkey").alias("entity"), "c_acctbal"), "entity"))


@query(f"""{ERRORS}, q AS (SELECT quantile_cont(error, 0.75) AS qe, quantile_cont(magnitude, 0.75) AS qm, quantile_cont(novelty, 0.75) AS qn, quantile_cont(CAST(support AS DOUBLE), 0.25) AS qs FROM b),
f AS (SELECT entity, error >= qe - 1e-9 AS high_error, magnitude >= qm AS high_magnitude, novelty >= qn AS high_novelty, support <= qs AS low_support FROM b, q)
SELECT *, CASE WHEN high_error AND high_magnitude THEN 'high_magnitude_target' WHEN high_error AND high_novelty THEN 'baseline_novelty' WHEN high_error AND low_support THEN 'low_cell_support'
  WHEN high_error THEN 'mixed_unexplained' ELSE 'not_high_error' END AS error_type FROM f""")
def error_taxonomy(spark, sf):
    """Quantile flags and the first matching error type per entity."""
    classed = summaries.error_classes(error_rows(spark, sf), "error", "magnitude", "novelty", "support")
    return classed.select("entity", "high_error", "high_magnitude", "high_novelty", "low_support", "error_type")


@query("""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.1) AS lo, quantile_cont(o_totalprice, 0.9) AS hi FROM orders)
SELECT o_orderkey, o_totalprice FROM orders, q WHERE o_totalprice BETWEEN lo AND hi""")
def trim_tails(spark, sf):
    """Orders between the 10 % and 90 % price quantiles, inclusive."""
    return summaries.trim_tails(B.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query(f"""{ERRORS}, r AS (SELECT entity, round(error, 4) AS error, row_number() OVER (ORDER BY round(error, 4), entity) AS position, count(*) OVER () AS n FROM b)
SELECT entity, error, position, CASE WHEN position <= 5 THEN 'best' WHEN position > n - 5 THEN 'worst' ELSE 'median' END AS case FROM r
WHERE position <= 5 OR position > n - 5 OR position BETWEEN n // 2 - 1 AND n // 2 + 3""")
def prediction_cases(spark, sf):
    """Five best, middle and worst entities by error."""
    rows = error_rows(spark, sf).select("entity", F.round("error", 4).alias("error"))
    return summaries.prediction_cases(pinned(rows), "error", "entity")


@query(f"""{ERRORS}, r AS (SELECT entity, round(abs(magnitude - novelty), 4) AS distance, row_number() OVER (ORDER BY round(abs(magnitude - novelty), 4), entity) AS rn, count(*) OVER () AS n FROM b)
SELECT entity, distance FROM r WHERE rn = n // 2 + 1""")
def representative_row(spark, sf):
    """The entity at the middle position by distance."""
    rows = error_rows(spark, sf).select("entity", F.round(F.abs(F.col("magnitude") - F.col("novelty")), 4).alias("distance"))
    return vectors.representative(pinned(rows), [F.asc("distance"), F.asc("entity")])


@query(f"""{ERRORS} SELECT entity, round(error, 4) AS error, round(magnitude, 4) AS magnitude FROM b ORDER BY round(error, 4) DESC, entity LIMIT 10""")
def top_errors(spark, sf):
    """Ten largest errors (a top-k report)."""
    rows = error_rows(spark, sf).select("entity", F.round("error", 4).alias("error"), F.round("magnitude", 4).alias("magnitude"))
    return rows.orderBy(F.desc("error"), "entity").limit(10)


@query("""
WITH v AS (SELECT n_name AS name, avg(s_acctbal) AS m, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
k AS (SELECT r_name AS region, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT region, arg_min(name, struct_pack(m := round(m, 6), name := name)) AS name, round(min(m), 6) AS m, arg_max(name, struct_pack(n := n, name := name)) AS largest FROM v JOIN k USING (name) GROUP BY region""")
def best_parameters(spark, sf):
    """Argmin and argmax with explicit ties per key."""
    nation = B.table(spark, sf, "nation")
    means = B.table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("n_name").alias("name"), "n_regionkey"
    ).agg(F.round(F.avg("s_acctbal"), 6).alias("m"), F.count(F.lit(1)).alias("n"))
    named = means.join(B.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumnRenamed("r_name", "region")
    low = metrics.best_parameters(named, ["region"], "m", [F.col("name")], ["name"])
    high = named.groupBy("region").agg(F.max_by("name", F.struct("n", "name")).alias("largest"))
    return B.rounded(low.join(high, "region"))


@query("""
WITH t AS (SELECT p_type AS t, p_brand AS b, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
m AS (SELECT a.t AS l, c.t AS r, round(sum(a.q * c.q) / sqrt(sum(a.q * a.q) * sum(c.q * c.q)), 6) AS v FROM t a JOIN t c USING (b) GROUP BY ALL)
SELECT l AS left_type, """ + ", ".join(f"max(CASE WHEN r = '{t}' THEN CASE WHEN l = r THEN 1.0 ELSE v END END) AS \"{t}\"" for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM m GROUP BY l")
def similarity_matrix(spark, sf):
    """Symmetric cosine matrix of part types over brands, unit diagonal."""
    lines = B.table(spark, sf, "lineitem").select("l_partkey", "l_quantity")
    parts = B.table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    sums = pinned(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "p_brand").agg(F.sum("l_quantity").alias("q")))
    left = sums.select(F.col("p_type").alias("left_type"), "p_brand", F.col("q").alias("x"))
    right = sums.select(F.col("p_type").alias("right_type"), "p_brand", F.col("q").alias("y"))
    # type x type per brand: a fixed dictionary, not rows
    pairs = left.join(right, "p_brand").where(F.col("left_type") < F.col("right_type"))
    cos = pairs.groupBy("left_type", "right_type").agg(S.cosine("x", "y").alias("v"))
    names = [r[0] for r in sums.select("p_type").distinct().sort("p_type").collect()]  # the columns of the report
    return B.rounded(enrichment.symmetric_matrix(cos, "left_type", "right_type", "v", names))


# --- reports, profiles, manifests, contracts ----------------------------------

@query(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(DISTINCT {c}) AS n_distinct, count(*) - count({c}) AS n_null, "
    f"array_to_string(list_slice(list_sort(list(DISTINCT CAST({c} AS VARCHAR))), 1, 20), ';') AS examples FROM documents"
    for c, t in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))))
def column_profile(spark, sf):
    """Type, distinct and null counts and first values of document columns."""
    table = profile.column_profile(B.table(spark, sf, "documents"))
    return table.withColumn("examples", F.array_join("examples", ";"))


@query("""
SELECT min(l_quantity) AS minimum, max(l_quantity) AS maximum, bool_and(l_quantity = round(l_quantity)) AS integer_like, count(l_quantity) AS n_values FROM lineitem""")
def matrix_profile(spark, sf):
    """Minimum, maximum and integer test over all stored counts."""
    lines = B.table(spark, sf, "lineitem")
    v = F.col("l_quantity")
    return lines.agg(
        F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.bool_and(v == F.rint(v)).alias("integer_like"), F.count(v).alias("n_values")
    )


@query("""
SELECT o_orderpriority AS analysis, CAST(regexp_extract(o_orderpriority, '([0-9]+)', 1) AS INTEGER) AS level, count(*) AS n, round(avg(o_totalprice), 4) AS estimate
FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1""")
def report_sql(spark, sf):
    """Ad-hoc SQL over a registered view."""
    B.table(spark, sf, "orders").createOrReplaceTempView("dosewise_orders")
    return spark.sql("""
      SELECT o_orderpriority AS analysis, CAST(regexp_extract(o_orderpriority, '([0-9]+)', 1) AS INT) AS level,
        count(*) AS n, round(avg(o_totalprice), 4) AS estimate
      FROM dosewise_orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderpriority""")


@query("""
SELECT o_orderstatus AS status, CAST(to_json(struct_pack(n := count(*), largest := max(o_orderkey))) AS VARCHAR) AS report, sha256(o_orderstatus || ':' || count(*)) AS digest, CAST(count(*) AS BIGINT) AS parsed_n FROM orders GROUP BY o_orderstatus""")
def json_report(spark, sf):
    """Nested JSON record, its digest, and the value read back from it."""
    sums = B.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("largest")
    )
    report = F.to_json(F.struct("n", "largest"))
    return sums.select(
        "status", report.alias("report"), S.text_sha256(F.concat_ws(":", "status", "n")).alias("digest"),
        F.from_json(report, "n bigint").getField("n").alias("parsed_n"),
    )


@query()
def file_manifest(spark, sf):
    """Bytes, SHA-256 and row counts of all Parquet files of the folder."""
    glob = f"{sf}/*.parquet"
    found = spark.read.format("binaryFile").load(glob).select(F.regexp_extract("path", r"([^/]+)\.parquet(?:/[^/]+)*$", 1).alias("name")).distinct()
    facts = []
    for name in sorted(r["name"] for r in found.collect()):
        given = B.table(spark, sf, name)
        vectors = [c for c, kind in given.dtypes if kind.startswith("array")]
        facts.append(manifest.row_facts(given, vectors[0] if vectors else None))
    listed = manifest.file_manifest(spark, glob, metrics.union_all(facts)).fillna(0, ["row_count"])
    return listed.withColumn("path", F.element_at(F.split("path", "/"), -1))


@query("""
WITH s AS (SELECT p_partkey AS path, p_retailprice AS bytes, 'stored' AS origin FROM part), n AS (SELECT DISTINCT l_partkey AS path, CAST(-1 AS DOUBLE) AS bytes, 'new' AS origin FROM lineitem WHERE l_quantity >= 50)
SELECT * FROM s ANTI JOIN n USING (path) UNION ALL SELECT * FROM n""")
def manifest_upsert(spark, sf):
    """Rewritten keys replace their rows, the rest stay."""
    stored = B.table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_retailprice").alias("bytes"), F.lit("stored").alias("origin"))
    new = B.table(spark, sf, "lineitem").where("l_quantity >= 50").select(
        F.col("l_partkey").alias("path"), F.lit(-1.0).alias("bytes"), F.lit("new").alias("origin")
    ).distinct()
    return manifest.upsert(stored, new)


@query("""
SELECT rule, CAST(v AS BIGINT) AS violations, v = 0 AS passed FROM (
  SELECT 'unique_key' AS rule, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) <> 1)) AS v
  UNION ALL SELECT 'not_null', (SELECT count(*) FROM lineitem WHERE l_suppkey IS NULL OR l_quantity IS NULL)
  UNION ALL SELECT 'integer_counts', (SELECT count(*) FROM lineitem WHERE NOT (l_quantity >= 0 AND l_quantity = round(l_quantity)))
  UNION ALL SELECT 'discount_range', (SELECT count(*) FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.05))
  UNION ALL SELECT 'complete_grid', (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag) <> 3))
  UNION ALL SELECT 'one_id_per_key', (SELECT count(*) FROM (SELECT p_type FROM part GROUP BY p_type HAVING count(DISTINCT p_brand) > 1))
  UNION ALL SELECT 'no_leakage', (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
  UNION ALL SELECT 'same_set', (SELECT count(*) FROM (SELECT DISTINCT s_nationkey FROM supplier) a FULL JOIN (SELECT DISTINCT c_nationkey FROM customer) b ON s_nationkey = c_nationkey WHERE s_nationkey IS NULL OR c_nationkey IS NULL)
  UNION ALL SELECT 'exactly_one_match', (SELECT count(*) FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) USING (doc_id) WHERE coalesce(n, 0) <> 1)
  UNION ALL SELECT 'not_empty', 0
  UNION ALL SELECT 'recomputed', (SELECT count(*) FROM documents WHERE abs(n_chars - length(text)) > 0)
  UNION ALL SELECT 'monotone', (SELECT count(*) FROM (SELECT count(*) FILTER (l_quantity >= 10) AS a, count(*) FILTER (l_quantity >= 20) AS b, count(*) FILTER (l_quantity >= 30) AS c FROM lineitem) WHERE b > a OR c > b)
  UNION ALL SELECT 'same_dictionary', (SELECT count(*) FROM nation LEFT JOIN region ON n_nationkey = r_regionkey WHERE n_name IS DISTINCT FROM r_name))""")
def contract_report(spark, sf):
    """Every kind of data-quality rule over the given tables; some are meant to fail."""
    lines, parts = B.table(spark, sf, "lineitem"), B.table(spark, sf, "part")
    docs, labels = B.table(spark, sf, "documents"), B.table(spark, sf, "labels")
    q = F.col("l_quantity")
    supplied = B.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    bought = B.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    sizes = lines.select(F.explode(F.array(*[F.when(q >= t, F.lit(t)) for t in (10, 20, 30)])).alias("t")).where("t is not null").groupBy("t").agg(
        F.count(F.lit(1)).alias("n")
    )
    stored = docs.select("doc_id", F.col("n_chars").alias("value"))
    computed = docs.select("doc_id", F.length("text").cast("bigint").alias("value"))
    nations = B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("name"))
    regions = B.table(spark, sf, "region").select(F.col("r_regionkey").alias("i"), F.col("r_name").alias("name"))
    return C.report([
        C.unique_key(lines, ["l_orderkey", "l_linenumber"]), C.not_null(lines, ["l_suppkey", "l_quantity"]),
        C.all_true(lines, (q >= 0) & (q == F.rint(q)), "integer_counts"), C.all_true(lines, F.col("l_discount").between(0, 0.05), "discount_range"),
        C.complete_grid(lines, "l_suppkey", ["l_returnflag"]), C.functional_dependency(parts, "p_type", "p_brand"),
        C.disjoint(docs, labels, ["doc_id"]), C.same_set(supplied, bought, ["k"]), C.exactly_one_match(docs.select("doc_id"), labels, "doc_id"),
        C.not_empty(lines), C.within_tolerance(stored, computed, ["doc_id"], "value", 0.0), C.non_increasing(sizes, "t", "n"),
        C.same_dictionary(nations, regions, "i", "name"),
    ])


@query(f"""
WITH {FEATURES}, m AS (SELECT lineage, avg(response_mean) AS estimate, min(response_mean) AS low, n_regionkey AS r FROM feat GROUP BY lineage, n_regionkey),
a AS (SELECT r AS analysis, min(estimate) AS low, max(estimate) AS high, min(low) AS bound, count(*) FILTER (estimate > 0) AS pos, count(*) AS n FROM m GROUP BY r)
SELECT CAST(analysis AS VARCHAR) AS analysis, CASE WHEN analysis = 0 THEN 'limitation' WHEN analysis = 1 THEN CASE WHEN bound > 0 THEN 'robust' ELSE 'inconclusive' END WHEN low > 0 THEN 'robust' ELSE 'sensitive' END AS status,
  CASE WHEN analysis = 2 THEN printf('positive repeats %d/%d', pos, n) ELSE printf('gain range %.6f to %.6f', low, high) END AS evidence FROM a""")
def conclusions(spark, sf):
    """Verdict and evidence text per analysis."""
    feats = entity_features(spark, sf)
    rows = feats.groupBy("lineage", "n_regionkey").agg(F.avg("response_mean").alias("estimate"), F.min("response_mean").alias("ci95_low"))
    kind = F.when(F.col("n_regionkey") == 0, "noise").when(F.col("n_regionkey") == 1, "interval").when(F.col("n_regionkey") == 2, "repeat").otherwise("sweep")
    tagged = rows.select(F.col("n_regionkey").cast("string").alias("analysis"), F.lit("rmse_gain_vs_b1").alias("metric"), "estimate", "ci95_low", kind.alias("kind"))
    return summaries.conclusions(tagged)


@query(f"""
WITH {FEATURES}
SELECT round({B.pearson_sql('sensitivity', 'response_mean')}, 6) AS pearson, round((SELECT {B.pearson_sql('a', 'b')} FROM (SELECT rank() OVER (ORDER BY sensitivity) + (count(*) OVER (PARTITION BY sensitivity) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY response_mean) + (count(*) OVER (PARTITION BY response_mean) - 1) / 2.0 AS b FROM feat)), 6) AS spearman, round(quantile_cont(response_rms, 0.5), 6) AS median_rms, round(avg(CASE WHEN response_mean > 0 THEN 1.0 ELSE 0.0 END), 6) AS fraction_positive FROM feat""")
def landscape_summary(spark, sf):
    """Association of one response score with sensitivity, medians and sign fractions."""
    feats = entity_features(spark, sf).withColumn("k", F.lit(1))
    ranked = ranking.average_rank(ranking.average_rank(feats, ["k"], "sensitivity", "rx"), ["k"], "response_mean", "ry")
    base = ranked.groupBy("k").agg(
        S.pearson("sensitivity", "response_mean").alias("pearson"), S.pearson("rx", "ry").alias("spearman"), S.fraction(F.col("response_mean") > 0).alias("fraction_positive")
    )
    middle = ranking.quantiles(feats, ["k"], "response_rms", {"median_rms": 0.5})
    return B.rounded(base.join(middle, "k").drop("k"))


@query("""
WITH d AS (SELECT label AS dimension, count(*) AS n FROM embeddings GROUP BY label), g AS (SELECT dimension, r.rank FROM d, (SELECT unnest([0, 2, 5]) AS rank) r)
SELECT dimension, rank, CAST(CASE WHEN rank = 0 THEN (dimension + 1) * 32 ELSE 32 * (rank + 1) + rank * (dimension + 1) END AS BIGINT) AS parameter_count FROM g""")
def complexity_table(spark, sf):
    """Parameter counts of direct and low-rank models."""
    dims = B.table(spark, sf, "embeddings").select(F.col("label").alias("dimension")).distinct()
    grid = dims.withColumn("rank", F.explode(F.array(F.lit(0), F.lit(2), F.lit(5))))
    return ablation.complexity(grid, 32)
