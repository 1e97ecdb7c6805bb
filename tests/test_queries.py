"""A sample of registered queries against their SQL, and registry rules."""

import math

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
NAMES = [
    "pseudobulk_sum", "response_delta", "cell_count_matrix", "split_half_noise", "outer_folds", "line_metrics", "bh_adjust",
    "spearman_perm", "set_enrichment", "ridge_fit_predict", "nested_cv_select", "energy_distance", "sliced_wasserstein", "tag_parse",
]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def clean(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return str(round(float(v), 4) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(clean(r[c]) for c in columns) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted(tuple(clean(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    assert got == want and got


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_cells_are_dealt_into_parts_of_bounded_rows(spark, monkeypatch):
    from dosewise.queries import base

    sf = "/root/testdata/sf0.001"
    few = base.entity_cells(spark, sf)
    monkeypatch.setattr(base, "LINES_A_PART", 300)
    many = base.entity_cells(spark, sf)
    assert many.rdd.getNumPartitions() >= base.count_lines(spark, sf).count() / 300 > few.rdd.getNumPartitions()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_dense_responses_are_dealt_into_parts_of_bounded_rows(spark, monkeypatch):
    from dosewise.operators import counts
    from dosewise.queries import base

    sf = "/root/testdata/sf0.001"
    few = base.response(spark, sf, ("entity", "hour"))
    rows = few.count()
    monkeypatch.setattr(counts, "DENSE_ROWS_A_PART", 100, raising=False)
    many = base.response(spark, sf, ("entity", "hour"))
    assert many.rdd.getNumPartitions() >= rows / 100 > few.rdd.getNumPartitions()
    rounded = lambda df: sorted((r.entity, r.hour, r.gene_idx, round(r.delta, 9) + 0.0) for r in df.collect())
    assert rounded(few) == rounded(many)
