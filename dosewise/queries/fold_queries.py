"""Fold assignment, membership and balance checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosewise.operators import contracts as C
from dosewise.operators import folds
from dosewise.queries import base as B
from dosewise.queries.registry import query
from dosewise.session import pinned

K_OUTER, K_INNER = 5, 4

OUTER = f"""{B.SUPPLIERS.strip()},
sizes AS (SELECT lineage, count(*) AS n FROM suppliers GROUP BY lineage),
starts AS (SELECT lineage, sum(n) OVER (ORDER BY n DESC, lineage) - n AS start FROM sizes),
outer_f AS (SELECT entity, lineage, CAST((start + row_number() OVER (PARTITION BY lineage ORDER BY md5(concat_ws('|', '{B.SEED}', entity)), entity) - 1) % {K_OUTER} AS INTEGER) AS fold
  FROM suppliers JOIN starts USING (lineage))"""
INNER = f"""{OUTER},
tr AS (SELECT entity, lineage, CAST(f AS INTEGER) AS outer_fold FROM outer_f, range({K_OUTER}) t(f) WHERE f <> fold),
isizes AS (SELECT outer_fold, lineage, count(*) AS n FROM tr GROUP BY ALL),
istarts AS (SELECT outer_fold, lineage, sum(n) OVER (PARTITION BY outer_fold ORDER BY n DESC, lineage) - n AS start FROM isizes),
inner_f AS (SELECT entity, lineage, outer_fold, CAST((start + row_number() OVER (PARTITION BY outer_fold, lineage ORDER BY md5(concat_ws('|', '{B.SEED}', outer_fold, entity)), entity) - 1) % {K_INNER} AS INTEGER) AS inner_fold
  FROM tr JOIN istarts USING (outer_fold, lineage))"""


def _outer(spark, sf):
    return folds.deal_folds(B.suppliers(spark, sf).select("entity", "lineage"), "entity", "lineage", K_OUTER, B.SEED)


@query(f"WITH {OUTER} SELECT entity, lineage, fold FROM outer_f")
def outer_folds(spark, sf):
    """Balanced outer folds that spread every lineage."""
    return _outer(spark, sf).select("entity", "lineage", "fold")


@query(f"WITH {INNER} SELECT outer_fold, entity, lineage, inner_fold FROM inner_f")
def inner_folds(spark, sf):
    """Folds of every outer training set."""
    inner = folds.inner_folds(_outer(spark, sf), "entity", "lineage", K_OUTER, K_INNER, B.SEED)
    return inner.select("outer_fold", "entity", "lineage", "inner_fold")


@query(f"""WITH {OUTER}
SELECT CAST(f AS INTEGER) AS model_fold, entity, CASE WHEN fold = f THEN 'test' ELSE 'train' END AS role FROM outer_f, range({K_OUTER}) t(f)""")
def fold_membership(spark, sf):
    """One row per (model fold, entity) with its role."""
    return folds.membership(_outer(spark, sf), "entity", "fold", K_OUTER)


@query(f"""WITH {OUTER},
s AS (SELECT fold, count(*) AS n FROM outer_f GROUP BY fold), l AS (SELECT lineage, fold, count(*) AS n FROM outer_f GROUP BY ALL)
SELECT rule, CAST(violations AS BIGINT) AS violations, violations = 0 AS passed FROM (
  SELECT 'unique_key' AS rule, (SELECT count(*) - count(DISTINCT entity) FROM outer_f) AS violations
  UNION ALL SELECT 'fold_sizes', (SELECT CASE WHEN max(n) - min(n) <= 1 AND count(*) = {K_OUTER} THEN 0 ELSE 1 END FROM s)
  UNION ALL SELECT 'no_leakage', 0
  UNION ALL SELECT 'complete_grid', 0)""")
def fold_checks(spark, sf):
    """Balance, uniqueness, disjointness and completeness of the folds."""
    outer = pinned(outer_folds(spark, sf))
    members = folds.membership(outer, "entity", "fold", K_OUTER)
    balance = folds.fold_balance(outer, "entity", "fold", K_OUTER)
    train, test = members.where("role = 'train'"), members.where("role = 'test'")
    return C.report([
        C.unique_key(outer, ["entity"]),
        C.all_true(balance, F.col("balanced"), "fold_sizes"),
        C.disjoint(train, test, ["model_fold", "entity"]),
        C.complete_grid(members, "model_fold", ["entity"]),
    ])


@query(f"""WITH {B.SUPPLIERS.strip()}, n AS (SELECT lineage, count(*) AS n_test FROM suppliers GROUP BY lineage)
SELECT lineage AS model_fold, n_test, (SELECT count(*) FROM suppliers) - n_test AS n_train FROM n""")
def leave_one_group_out(spark, sf):
    """Every lineage as its own fold: training size from the held-out rows alone."""
    rows = B.suppliers(spark, sf)
    keyed = folds.leave_one_group_out(rows, "entity", "lineage")
    total = rows.agg(F.count(F.lit(1)).alias("total")).withColumn("k", F.lit(1))
    held = keyed.select(F.explode("held_of").alias("model_fold")).groupBy("model_fold").agg(F.count(F.lit(1)).alias("n_test"))
    joined = held.withColumn("k", F.lit(1)).join(F.broadcast(total), "k")
    return joined.select("model_fold", "n_test", (F.col("total") - F.col("n_test")).alias("n_train"))
