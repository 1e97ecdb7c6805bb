"""Range sharding: laws of the shards, equal texts together, hot texts split."""

import zlib

from pyspark.sql import functions as F

from dosewise.llm import splitters
from dosewise.llm.common import table

SF = "/root/testdata/sf0.1"


def laws(got, docs, n):
    assert len(got) == len(docs)
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert got.shard.between(0, n - 1).all()


def test_table(spark):
    docs = table(spark, SF, "documents").toPandas()
    got = splitters.shard_documents(table(spark, SF, "documents")).toPandas()
    laws(got, docs, 24)
    both = got.merge(docs, on="doc_id")
    data = both.text.map(lambda t: t.encode())
    assert (both["size"] == data.map(len) + 8).all() and (both.text_crc32 == data.map(zlib.crc32)).all()
    per = got.groupby("shard")["size"].sum()
    assert len(per) == 24 and per.max() < 1.03 * per.mean() and per.min() > 0.97 * per.mean()
    assert (both.groupby("text").shard.nunique() == 1).all()
    again = splitters.shard_documents(table(spark, SF, "documents").repartition(5)).toPandas()
    assert dict(zip(got.doc_id, zip(got.shard, got.slot))) == dict(zip(again.doc_id, zip(again.shard, again.slot)))


def test_hot_text_and_odd_rows(spark, docs):
    rows = [(i, "the same long text " * 20) for i in range(3000)] + [(10_000 + i, f"text {i} " * (1 + i % 40)) for i in range(3000)]
    rows += [(None, None), (1, ""), (1, ""), (2, "x" * 100_000), (None, "y")]
    got = splitters.shard_documents(docs(rows)).toPandas()
    laws(got, rows, 24)
    per = got.groupby("shard")["size"].sum()
    assert len(per) == 24 and per.max() - per.min() <= 100_000 + 2 * per.mean() / 8
    assert got[got["size"] == 8].text_crc32.eq(0).all() and got.grown_shard.isna().all() and set(got.law) == {"bytes"}


def test_small_tables(spark, docs):
    assert splitters.shard_documents(docs([])).count() == 0
    got = splitters.shard_documents(docs([(1, "a")])).collect()
    assert len(got) == 1 and got[0].slot == 0


def test_pieces_follow_the_key_order(spark):
    rows = spark.range(5000).select("id", F.md5(F.col("id").cast("string")).alias("key"), F.lit(10).cast("long").alias("size"))
    placed = splitters.ranged(rows, splitters.boundaries(rows, 100)).toPandas().sort_values("key")
    assert placed.piece.is_monotonic_increasing and placed.piece.nunique() > 150
