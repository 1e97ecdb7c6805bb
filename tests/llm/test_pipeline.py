"""Every stage of the pipeline on the rows of the one before."""

import re

import pyarrow as pa

import corpus_pipeline as P
from dosewise.llm import nbest, quality
from dosewise.llm.common import table
from test_resemblance import brute_kept

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        result = stage(spark, docs, SF)
        if k < len(P.STAGES) - 1:
            assert result.columns == columns
        result.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.toPandas()
    source = table(spark, SF, "documents").toPandas()
    good, exact, near, mixed, ids = kept.values()

    model = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert set(good.doc_id) == {i for i, s in zip(source.doc_id, model.score(source.text.tolist())) if s >= 0.7}
    first = {}
    for i, t in sorted(zip(good.doc_id, good.text), key=lambda r: (-len(r[1]), r[0])):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), i)
    assert set(exact.doc_id) == set(first.values())
    assert set(near.doc_id) == brute_kept(exact.doc_id, exact.text)
    assert set(mixed.doc_id) <= set(near.doc_id) and len(ids) == len(mixed)
    assert sorted(nbest.decode(i, nbest.default_model()) for i in ids.ids) == sorted(mixed.text)


def test_run(spark):
    assert P.run(spark, SF).count() > 0


def test_batches_of_long_texts_are_small(spark, docs, tmp_path):
    """Rows of all stages with Python come in batches of bounded bytes, not of up to 10,000 rows of 64 MB."""
    docs([(i, f"{i} " * 2_000) for i in range(1_500)]).coalesce(1).write.parquet(f"{tmp_path}/docs")
    rows = spark.read.parquet(f"{tmp_path}/docs").select("text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    for stage in (P.quality_filter, P.near_dedup, P.encode):
        for key in P.BATCHES:
            spark.conf.unset(key)
        stage(spark, table(spark, SF, "documents"), SF)
        found = rows.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r.n for r in found) == 1_500
        assert max(r.n for r in found) <= 1_000 and max(r.bytes for r in found) < 5 << 20
