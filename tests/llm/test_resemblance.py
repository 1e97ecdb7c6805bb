"""Near copies against brute force over all pairs: changed words, large groups, odd rows."""

import random

import corpus_pipeline as P
import pytest
from dosewise.llm import resemblance
from dosewise.llm.common import filed, table
from pyspark.sql import functions as F
from test_dedup import brute_groups

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def brute_kept(ids, texts):
    roots = brute_groups([shingles(t) for t in texts], alike)
    return {min(i for i, q in zip(ids, roots) if q == r) for r in roots}


def test_stage_drops_copies_with_a_few_changed_words(spark, docs):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(10, " ".join(base)), (11, " ".join(base[:60] + ["other"] + base[61:])), (12, " ".join(base[:60] + ["x"] + base[61:90] + ["y", "z"] + base[92:]))]
    rows += [(13, " ".join(base[:60])), (14, " ".join(f"v{rng.randrange(5000)}" for _ in range(90)))]
    got = P.near_dedup(spark, docs(rows), SF)
    assert {r.doc_id for r in got.collect()} == brute_kept(*zip(*rows)) == {10, 13, 14}


def test_given_documents(spark):
    source = table(spark, SF, "documents").dropDuplicates(["text"])
    rows = [(r.doc_id, r.text) for r in source.select("doc_id", "text").collect()]
    got = {r.doc_id for r in resemblance.without_near_copies(source).collect()}
    assert got == brute_kept(*zip(*rows)) and len(got) < len(rows)


def family_texts(rng, families, shared, own, last=0):
    """Texts on one template: two of each family, alike or not."""
    template = [f"t{k}" for k in range(shared)]
    out = []
    for f in range(families):
        mine = [f"f{f}x{k}" for k in range(own)]
        for _ in range(2):
            words = template + mine
            for _ in range(rng.randrange(last, last + 8)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_mixed_families_on_one_template(spark, docs, monkeypatch, small):
    if small:  # many blocks
        monkeypatch.setattr(resemblance, "LISTED", 3)
        monkeypatch.setattr(resemblance, "BLOCK_ROWS", 40)
    rng = random.Random(7)
    texts = family_texts(rng, 90, 330, 70) + family_texts(rng, 60, 345, 55, 5)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r.doc_id for r in resemblance.without_near_copies(docs(rows)).collect()}
    assert got == brute_kept(*zip(*rows)) and 60 < len(got) < 300


@pytest.mark.parametrize("rows_a_block", [1_024, 50])
def test_large_group_of_copies_with_strangers(spark, docs, monkeypatch, rows_a_block):
    monkeypatch.setattr(resemblance, "BLOCK_ROWS", rows_a_block)
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(i, " ".join(base[: (k := rng.randrange(200))] + [f"new{i}"] + base[k + 1 :])) for i in range(300)]
    for i in range(60):  # some close to the copies, some not quite
        words = list(base)
        for k in range(rng.randrange(3, 9)):
            words[rng.randrange(200)] = f"far{i}x{k}"
        rows.append((600 + i, " ".join(words)))
    rows += [(900 + i, " ".join(f"u{rng.randrange(5000)}" for _ in range(50))) for i in range(20)]
    got = {r.doc_id for r in resemblance.without_near_copies(docs(rows)).collect()}
    assert got == brute_kept(*zip(*rows)) and {0, *range(900, 920)} < got


def test_a_chain_of_copies_is_one_group(spark, docs):
    words = [f"c{k}" for k in range(1200)]
    rows = [(i, " ".join(words[10 * i : 10 * i + 160])) for i in range(100)]
    got = {r.doc_id for r in resemblance.without_near_copies(docs(rows)).collect()}
    assert got == brute_kept(*zip(*rows)) == {0}


def test_odd_rows(spark, docs):
    rows = [(3, None), (2, " \n"), (None, "one two"), (7, "One  two"), (8, "one two three"), (9, "one two")]
    assert sorted(r.doc_id for r in resemblance.without_near_copies(docs(rows)).collect()) == [2, 7, 8]
    assert resemblance.without_near_copies(docs([])).count() == 0


def test_simhash_balls_find_candidates_and_sets_decide(spark, docs):
    words = [f"s{k}" for k in range(1000)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(f"o{k}" for k in range(1000)), " ".join(words)]
    source = filed(docs(list(enumerate(texts))))
    rows = resemblance.keyed(source, "doc_id", "text").withColumn("node", F.col("doc_id").cast("long"))

    def found(changed):
        return {tuple(sorted((r.a, r.b))) for r in resemblance.links(source, resemblance.pinned(changed), F.col("text")).collect()}

    prints = {r.node: r.fp for r in rows.collect()}
    assert prints[0] == prints[3] and 0 < bin((prints[0] ^ prints[1]) % 2**64).count("1") <= 2
    without_bands = rows.withColumn("keys", F.expr("cast(array() as array<bigint>)"))
    assert found(without_bands) == {(0, 1), (0, 3)}
    assert found(without_bands.withColumn("fp", F.lit(7).cast("long"))) == {(0, 1), (0, 3)}
