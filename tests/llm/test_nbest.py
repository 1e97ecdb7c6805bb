"""N-best segmentation against enumeration of all segmentations, and round trips."""

import random

import pytest
from pyspark.sql import functions as F

import pyarrow as pa
from dosewise.llm import nbest
from dosewise.llm.common import table

PATH = nbest.default_model()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return nbest.Vocabulary(PATH)


def brute(text, n, vocabulary):
    into, out = vocabulary.edges(text), []

    def go(end, score, reverse):
        if end == 0:
            out.append((score, tuple(reverse[::-1])))
        for i, s, own in into[end]:
            go(i, score + s, reverse + list(own[::-1]))

    go(len(text), 0.0, [])
    return sorted(out, key=lambda f: (-f[0], f[1][::-1]))[:n]


def test_words_equal_enumeration(vocabulary):
    rng = random.Random(3)
    for _ in range(150):
        word = "".join(rng.choice("▁tahein\nñ漢q") for _ in range(rng.randint(1, 9)))
        want = brute(word, 6, vocabulary)
        assert nbest.nbest(word, 6, vocabulary) == want and nbest._nbest_lists(vocabulary.edges(word), 6) == want


@pytest.mark.parametrize("n", [1, 2, 4, 7])
def test_texts_equal_enumeration(vocabulary, n):
    rng = random.Random(n)
    tool = nbest.Segmenter(PATH, n)
    for _ in range(120):
        text = "".join(rng.choice("the ain \nñ漢ab") for _ in range(rng.randint(1, 9)))
        (ids, score, others), = tool.segment([text])
        got = [(score, tuple(ids.tolist()))] + [(s, tuple(nbest.edited(ids.tolist(), e))) for s, e in others]
        assert got == brute(vocabulary.model.normalize(text), n, vocabulary)


def test_long_words(vocabulary):
    tool = nbest.Segmenter(PATH, 3)
    for text in ("a" * 300, "ab" * 1500, "x" * 47 + "the" * 20, "a\0b", "q" * 48, "q" * 49):
        (ids, score, others), = tool.segment([text])
        every = [ids.tolist()] + [nbest.edited(ids.tolist(), e) for _, e in others]
        assert len({tuple(i) for i in every}) == len(every) and all(vocabulary.model.decode(i) == text for i in every)
        scores = [score] + [s for s, _ in others]
        assert scores == sorted(scores, reverse=True) and (len(every) == 3 or text == "a\0b")


def test_table_round_trip(spark):
    docs = table(spark, SF, "documents")
    got = nbest.encode(docs).toPandas()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(text) and got.decoded.all()
    for _, r in got.head(40).iterrows():
        assert nbest.decode(r.ids, PATH) == text[r.doc_id]
        for other in r.others:
            ids = nbest.edited(r.ids.tolist(), [(e["at"], e["drop"], e["ids"]) for e in other["edits"]])
            assert nbest.decode(ids, PATH) == text[r.doc_id] and other["score"] <= r.score


def test_edge_cases(spark, docs):
    rows = [(1, None), (2, ""), (3, " "), (4, "▁"), (5, "a b"), (5, "a b"), (None, "c"), (6, "thon " * 100_000)]
    got = nbest.encode(docs(rows)).withColumn("n", F.size("ids")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[1].n == by[2].n == 0 and by[1].decoded and not by[4].decoded and by[6].decoded and by[6].n >= 100_000
    assert nbest.encode(docs([])).count() == 0
    with pytest.raises(ValueError):
        nbest.Segmenter(PATH, 0)


def test_steps_are_bounded_by_characters(monkeypatch):
    monkeypatch.setattr(nbest, "CHARACTERS_AT_ONCE", 10)
    monkeypatch.setattr(nbest, "TEXTS_AT_ONCE", 3)
    texts = ["abc", None, "", "x", "y" * 30, "ab", "cd", "é" * 6, "z"]
    assert list(nbest.steps(pa.array(texts))) == [(0, 3), (3, 1), (4, 1), (5, 3), (8, 1)]
    assert list(nbest.steps(pa.array([], pa.string()))) == []


def test_words_used_again_stay_when_memory_is_full(monkeypatch):
    monkeypatch.setattr(nbest, "REMEMBERED", 40)
    tool, plain, learned = nbest.Segmenter(PATH, 3), nbest.Segmenter(PATH, 3), []
    inner = tool._learn
    tool._learn = lambda words: (learned.extend(words), inner(words))
    result = lambda t, text: [(ids.tolist(), score, others) for ids, score, others in t.segment([text])]
    for k in range(60):
        text = f"the same words again and x{k}y z{k}"
        assert result(tool, text) == result(plain, text)
        plain.__init__(PATH, 3) if k % 20 == 19 else None
    assert len(tool.known) <= 60 and learned.count("▁same") == 1 and learned.count("▁again") == 1


@pytest.mark.parametrize("hold", [True, False])
def test_a_worker_gives_up_vocabulary_and_words(hold):
    class Docs:
        dtypes = [("doc_id", "bigint"), ("text", "string")]

        def selectExpr(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one two", None]})
    nbest.segmenter.cache_clear()
    out = list(nbest.encode(Docs(), hold=hold)(iter([batch])))
    assert [r for b in out for r in b.column("doc_id").to_pylist()] == [1, 2]
    assert nbest.segmenter.cache_info().currsize == hold
    nbest.segmenter.cache_clear()
