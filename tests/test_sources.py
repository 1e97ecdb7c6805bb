import json

import pytest
from pyspark.sql import functions as F

from dosewise.operators import composition
from dosewise.operators import contracts as C
from dosewise.sources import manifest, matrix, profile, tables


def write(path, text):
    path.write_text(text)
    return str(path)


def test_matrix_scan(spark, tmp_path):
    path = write(tmp_path / "m.mtx", "%%MatrixMarket matrix coordinate integer general\n% note\n2 3 4\n1 1 5\n2 1 1\n2 3 7\n1 2 3\n")
    got = sorted((r.gene_idx, r.cell_idx, r.x) for r in matrix.read_matrix(spark, path, "s").collect())
    assert got == [(1, 1, 5), (1, 2, 3), (2, 1, 1), (2, 3, 7)]


def test_matrix_entry_equal_to_the_dimension_line_is_kept(spark, tmp_path):
    path = write(tmp_path / "m.mtx", "%%MatrixMarket matrix coordinate integer general\n1 1 1\n1 1 1\n")
    assert [(r.gene_idx, r.cell_idx, r.x) for r in matrix.read_matrix(spark, path, "s").collect()] == [(1, 1, 1)]


@pytest.mark.parametrize("body", ["2 3 5\n1 1 5\n", "1 1 1\n1 1 -4\n", "1 1 1\n1 1 0.5\n", "1 1 1\n2 1 4\n"])
def test_bad_matrices_are_refused(spark, tmp_path, body):
    path = write(tmp_path / "m.mtx", "%%MatrixMarket matrix coordinate integer general\n" + body)
    with pytest.raises(ValueError):
        matrix.read_matrix(spark, path, "s")


def test_lines_are_numbered_over_files_and_blocks(spark, tmp_path, conf):
    (tmp_path / "many").mkdir()
    for name, start in (("a", 0), ("b", 500)):
        write(tmp_path / "many" / f"{name}.txt", "".join(f"line {start + i}\n" for i in range(500)))
    conf("spark.sql.files.maxPartitionBytes", 700)
    conf("spark.sql.files.openCostInBytes", 1)
    got = matrix.numbered_lines(spark, str(tmp_path / "many"), "i").collect()
    assert {r.i: r.line for r in got} == {i + 1: f"line {i}" for i in range(1000)}


def test_dictionary_and_cells(spark, tmp_path):
    genes = matrix.read_genes(spark, write(tmp_path / "g.tsv", "ENS1\tAAA\nENS2\tBBB\nENS3\tAAA\n"))
    assert [(r.gene_idx, r.gene_id, r.gene_symbol) for r in genes.orderBy("gene_idx").collect()] == [(1, "ENS1", "AAA"), (2, "ENS2", "BBB"), (3, "ENS3", "AAA")]
    with pytest.raises(ValueError):
        matrix.read_genes(spark, write(tmp_path / "bad.tsv", "ENS1\tAAA\nENS1\tBBB\n"))
    codes = write(tmp_path / "b.tsv", "c1\nc2\n")
    good = write(tmp_path / "c.csv", "barcode,entity,quality\nc1,A,normal\nc2,B,doublet\n")
    cells = matrix.read_cells(spark, good, codes, ["barcode", "quality"])
    summary = matrix.cell_summary(cells.withColumn("source", F.lit("s")), "source").first()
    assert (summary.n_cells, summary.n_normal) == (2, 1)
    quoted = write(tmp_path / "q.csv", 'barcode,entity,quality\nc1,"A, ""x""",normal\nc2,B,doublet\n')
    assert {r.cell_idx: (r.entity, r.quality) for r in matrix.read_cells(spark, quoted, codes, ["barcode"]).collect()} == {1: ('A, "x"', "normal"), 2: ("B", "doublet")}
    swapped = write(tmp_path / "d.csv", "barcode,entity,quality\nc2,A,normal\nc1,B,doublet\n")
    with pytest.raises(ValueError):
        matrix.read_cells(spark, swapped, codes, ["barcode"])
    with pytest.raises(ValueError):
        matrix.read_cells(spark, good, codes, ["missing"])


def test_gene_sets_must_be_frozen(spark, tmp_path):
    good = write(tmp_path / "s.json", json.dumps({"status": "frozen", "collection": "a", "genes": ["X", "Y"]}))
    assert tables.read_gene_sets(spark, good).count() == 2
    for bad in ({"status": "draft", "genes": ["X"]}, {"status": "frozen", "genes": []}, {"status": "frozen", "genes": ["X", "X"]}):
        path = write(tmp_path / "bad.json", json.dumps({"collection": "a", **bad}))
        with pytest.raises(ValueError):
            tables.read_gene_sets(spark, path)


def test_vector_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [4.0, 5.0, 6.0])], "entity string, v array<double>")
    path = str(tmp_path / "v")
    tables.write_vectors(df, path, "v", expected_rows=2)
    assert {r.entity: r.v for r in tables.read_vectors(spark, path, "v").collect()} == {"a": [1.0, 2.0, 3.0], "b": [4.0, 5.0, 6.0]}
    assert tables.read_vectors(spark, path).columns == ["entity"]
    ragged = spark.createDataFrame([("a", [1.0]), ("b", [4.0, 5.0])], "entity string, v array<double>")
    with pytest.raises(ValueError):
        tables.write_vectors(ragged, path, "v")
    with pytest.raises(ValueError):
        tables.write_vectors(df, path, "v", expected_rows=3)


def test_csv_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    tables.write_csv(df, str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c"), "i int, s string").collect() == df.collect()
    tables.write_report(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().s == "a"
    assert json.loads(tables.report_json(df).first().report) == {"i": 1, "s": "a"}
    path = write(tmp_path / "ann.csv", "CCLE,line\nx,1\n")
    assert tables.read_annotations(spark, path, {"CCLE": "entity"}).columns == ["entity", "line"]


def test_manifest_notices_a_change(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    write(folder / "a.txt", "hello")
    write(folder / "b.txt", "world")
    scanned = manifest.file_manifest(spark, str(folder / "*.txt"))
    stored = spark.createDataFrame(scanned.collect(), scanned.schema)
    assert all(r.passed for r in manifest.verify(stored, scanned).collect())
    write(folder / "b.txt", "World")
    failed = {r.rule for r in manifest.verify(stored, manifest.file_manifest(spark, str(folder / "*.txt"))).collect() if not r.passed}
    assert failed == {"sha256"}
    merged = manifest.upsert(stored, manifest.file_manifest(spark, str(folder / "b.txt")))
    assert merged.count() == 2
    lost = stored.unionByName(stored.limit(1).withColumn("path", F.lit("gone")))
    assert {r.rule: r.violations for r in manifest.verify(lost, scanned).collect()}["file_exists"] == 1


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "i int, s string")
    got = {r.column: r for r in profile.column_profile(df).collect()}
    assert (got["s"].n_distinct, got["s"].n_null, got["s"].examples) == (2, 1, ["a", "b"])
    assert (got["i"].dtype, got["i"].n_distinct) == ("int", 2)


def test_contracts(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5), ("b", 1, None)], "k string, h int, v double")
    violations = lambda f: f.first().violations
    assert violations(C.unique_key(df, ["k"])) == 1 and violations(C.unique_key(df, ["k", "h"])) == 0
    assert violations(C.not_null(df, ["v"])) == 1
    assert violations(C.complete_grid(df, "k", ["h"])) == 1
    assert violations(C.expected_count(df, 4)) == 1 and violations(C.expected_distinct(df, ["k"], 2)) == 0
    assert violations(C.all_true(df, F.col("v") >= 0, "r")) == 1
    assert violations(C.functional_dependency(df, "k", "h")) == 1
    assert violations(C.not_empty(df.limit(0))) == 1
    assert violations(C.within_tolerance(df.where("h = 1"), df.where("k = 'a' and h = 1"), ["k"], "v", 0.1)) == 1
    assert violations(C.non_increasing(df, "h", "h")) == 1
    assert violations(C.same_set(df, df.where("k = 'a'"), ["k"])) == 1
    assert C.missing_columns(df, ["k", "zz"]) == ["zz"] and C.schema_matches(df, df.schema)
    named = spark.createDataFrame([("n", 94.0)], "name string, value double")
    assert violations(C.named_values([named, named.withColumn("value", F.lit(93.0))], named)) == 1
    stages = spark.createDataFrame([("s1", "passed"), ("s2", "failed")], "stage string, status string")
    assert not C.stages_passed(stages).first().all_passed
    with pytest.raises(ValueError, match="unique_key: 1"):
        C.require(C.report([C.unique_key(df, ["k"]), C.not_empty(df)]))


def test_first_row_per_key_follows_the_order(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 5, "only")], "k string, o int, v string")
    assert {r.k: r.v for r in composition.first_per_key(df, "k", "o").collect()} == {"a": "early", "b": "only"}
