"""Mixing against a brute-force account of blocks and slots."""

import re

import numpy as np
import pandas as pd

from dosewise.llm import mixing
from dosewise.llm.common import table

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(3 * sizes[s] for s in stopped)
        share = {s: 3.0 * sizes[s] if s in stopped else left * weight[s] / max(1, sum(weight[f] for f in free)) for s in names}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return share
        stopped |= set(over)


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    got = mixing.Mix(docs).counts().toPandas()
    text = docs.toPandas().set_index("doc_id")
    assert sorted(got.doc_id) == sorted(text.index)
    assert all(n == len(WORD.findall(text.text[i] or "")) for i, n in zip(got.doc_id, got["size"]))
    got["source"] = [text.source[i] for i in got.doc_id]
    per = got.groupby("source").agg(size=("size", "sum"), seen=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    want = brute_targets(per["size"].to_dict())
    assert (per["size"] == per.seen).all() and np.allclose(per.target, [want[s] for s in per.index])
    assert (abs(per.taken - per.target) <= 2 * mixing.BLOCK_WORDS).all() and (got.taken <= 3 * got["size"]).all()
    again = mixing.Mix(docs.repartition(7, "text")).counts().toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))


def test_documents_hold_what_is_taken(spark):
    mix = mixing.Mix(table(spark, SF, "documents"))
    counts, text = mix.counts().toPandas(), mix.docs.toPandas().set_index("doc_id")
    out = mix.documents()
    assert out.columns == mix.docs.columns
    out = out.toPandas()
    assert (out.n_chars == out.text.str.len()).all()
    taken = out.assign(n=[len(WORD.findall(t)) for t in out.text]).groupby("doc_id").n.sum()
    assert taken.to_dict() == {i: n for i, n in zip(counts.doc_id, counts.taken) if n}
    for i, t in zip(out.doc_id, out.text):
        own = WORD.findall(text.text[i])
        assert t == text.text[i] or set(WORD.findall(t)) <= set(own)


def test_capped_sources_and_odd_rows(spark):
    rows = [(i, "w " * 50, "big") for i in range(100)] + [(200, "a b c", "tiny"), (201, None, "tiny"), (202, " \n", None), (203, "x", None), (203, "x", None), (None, "y z", "")]
    docs = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, size int, start int")
    got = mixing.Mix(docs).counts().toPandas()
    sizes = {"big": 5000, "tiny": 3, None: 2, "": 2}
    want = brute_targets(sizes)
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    assert got[got.doc_id == 200].target.item() == want["tiny"] == 9 and got[got.doc_id == 200].taken.item() == 9
    assert got[got.doc_id == 203].taken.sum() == 6 and got[got.doc_id == 202].taken.item() == 0
    assert mixing.Mix(docs.limit(0)).counts().count() == 0 and mixing.Mix(docs.limit(0)).documents().count() == 0


def test_permutation_and_draws():
    for n in (1, 2, 3, 17, 1000):
        for key in (0, 5, 2**63 + 11):
            at = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(at) == list(range(n))
    quotas = pd.DataFrame({"none": False, "name": list("abc"), "blocks": [10, 300, 5], "quota": [30, 200, 15]})
    drawn = mixing.draw(quotas, 8, 1)
    assert drawn.groupby("name").n.sum().to_dict() == {"a": 30, "b": 200, "c": 15}
    per = drawn.groupby("shard").n.sum()
    assert per.sum() == 245 and per.max() - per.min() <= 1
    for _, own in drawn.groupby("name"):
        own = own.sort_values("shard")
        assert (own["first"] == own.n.cumsum() - own.n).all()
