"""Exact and near deduplication against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dosewise.llm import components, simhash, stream_dedup

TEXTS = [
    (1, "The cat sat on the mat"), (2, "the CAT sat on\tthe mat"), (3, "thecatsatonthemat"), (4, None), (5, ""), (6, " \n\x0b"),
    (7, "The cat sat on the mat "), (8, "one two"), (9, "one two"), (9, "one two"), (None, "one two"), (10, "É " * 3000), (11, "é " * 3000),
    (None, None), (12, "a b c d e f g h i j k l m n o p"), (13, "a b c d e f g h i j k l m n o q"),
]


def brute_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def brute_groups(values, linked):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_simhash_equals_brute_force(spark, docs):
    got = simhash.near_duplicates(docs(TEXTS)).collect()
    prints = [brute_fingerprint(t) for _, t in TEXTS]
    roots = brute_groups(prints, lambda a, b: bin(a ^ b).count("1") <= 2)
    low = {r: min((i for (i, _), q in zip(TEXTS, roots) if q == r and i is not None), default=None) for r in roots}
    want = sorted((str(i), f"{p:016x}", str(low[r])) for (i, _), p, r in zip(TEXTS, prints, roots))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 6)
    values = sorted({int(b) ^ sum(1 << int(i) for i in rng.choice(63, rng.integers(0, 4))) for b in base for _ in range(30)})
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    distance = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert all(distance(r.a, r.b) <= 2 and r.a < r.b for r in found) and len({(r.a, r.b) for r in found}) == len(found)
    pairs = {(r.a, r.b) for r in found}
    want = brute_groups(values, lambda a, b: distance(a, b) <= 2)
    assert brute_groups(values, lambda a, b: (b, a) in pairs or (a, b) in pairs) == want


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), radius=3)


def test_near_duplicates_leave_one_row_each(spark, docs):
    kept = simhash.without_near_duplicates(docs(TEXTS))
    assert kept.columns == docs(TEXTS).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 10) == [1, 3, 4, 8]


def test_components_of_path_star_and_loop(spark):
    rows = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 130)}, 300: 300, 301: 300}


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (i, t), n in zip(rows, norm):
        group = [(len(u or ""), -1e9 if j is None else -j, j) for (j, u), m in zip(rows, norm) if m == n]
        out.append((str(i), str(max(group, key=lambda g: g[:2])[2]), len(group), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


def test_exact_equals_brute_force(spark, docs):
    got = stream_dedup.deduplicate(docs(TEXTS)).withColumn("hex", F.lower(F.hex("digest"))).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.hex) for r in got) == brute_exact(TEXTS)


def test_colliding_digests_are_told_apart(spark, docs):
    weak = lambda text: F.lit(b"same").cast("binary")
    got = stream_dedup.deduplicate(docs(TEXTS), digest=weak).collect()
    want = [w[:3] for w in brute_exact(TEXTS)]
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == want


def test_state_goes_on_over_runs_and_files(spark, docs, tmp_path):
    for part, rows in (("a", TEXTS[:6]), ("b", TEXTS[6:])):
        docs(rows).write.parquet(f"{tmp_path}/{part}")
        got = stream_dedup.deduplicate(spark.read.parquet(f"{tmp_path}/{part}"), folder=f"{tmp_path}/work")
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got.collect()) == [w[:3] for w in brute_exact(TEXTS)]
    both = spark.read.parquet(f"{tmp_path}/a", f"{tmp_path}/b")
    kept = stream_dedup.without_duplicates(both)
    assert kept.columns == both.columns and kept.count() == len({w[3] for w in brute_exact(TEXTS)})


def test_colliding_digests_over_runs(spark, docs, tmp_path):
    """Content that an earlier run claimed is compared with, also when a later file sorts before it."""
    first = lambda text: F.substring(text, 1, 1).cast("binary")
    runs = {"z run 1": [(1, "alpha"), (2, "beta"), (7, "avocado")], "a run 2": [(3, "apple"), (4, "al pha"), (8, "beta")], "m run 3": [(5, "apple"), (6, "avocado"), (9, "b")]}
    for part, rows in runs.items():
        docs(rows).write.parquet(f"{tmp_path}/{part}")
        got = stream_dedup.deduplicate(spark.read.parquet(f"{tmp_path}/{part}"), folder=f"{tmp_path}/work", digest=first).collect()
    # of equal texts the longest original stays: "al pha"
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {1: (4, 2), 4: (4, 2), 2: (2, 2), 8: (2, 2), 7: (6, 2), 6: (6, 2), 3: (3, 2), 5: (3, 2), 9: (9, 1)}
    assert {r.doc_id for r in got if r.kept} == {2, 3, 4, 6, 9}


def test_a_table_given_twice_keeps_one_row_each(spark, docs, tmp_path):
    docs([(1, "x y"), (2, "xy"), (None, None)]).write.parquet(f"{tmp_path}/t")
    for _ in range(2):
        got = stream_dedup.deduplicate(spark.read.parquet(f"{tmp_path}/t"), folder=f"{tmp_path}/work").collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 2 and {r.group_size for r in got} == {2, 4}


def test_empty_tables(spark, docs):
    none = docs([])
    assert simhash.near_duplicates(none).count() == 0 and simhash.without_near_duplicates(none).count() == 0
    assert stream_dedup.deduplicate(none).count() == 0 and stream_dedup.without_duplicates(none).count() == 0
