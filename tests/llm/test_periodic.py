"""Runs against brute force over all starts and periods, planted periods, long and odd texts."""

import hashlib
import random
import time
from zlib import crc32

from dosewise.llm import periodic, queries
from dosewise.llm.common import table


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end > start and end + q - start >= max(6, 4 * q):
                found.setdefault((start, end + q), q)
            start = end + 1
    return sorted(((a, b, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_smallest(words):
    return next(q for q in range(1, len(words) + 1) if all(a == b for a, b in zip(words, words[q:])))


def test_against_brute_force():
    rng = random.Random(1)
    for case in range(1500):
        words = []
        while len(words) < rng.randrange(5, 160):
            unit = [rng.choice("abcdef"[: rng.randrange(1, 7)]) for _ in range(rng.randrange(1, 12))]
            words += (unit * rng.randrange(1, 9))[: rng.randrange(1, 60)]
        got = periodic.find_runs(words)
        assert got == brute_runs(words)
        for a, b, q in got:
            assert brute_smallest(words[a:b]) == q
        gone = {k for a, b, q in got for k in range(a + q, b)}
        assert periodic.collapsed(words, got) == [w for k, w in enumerate(words) if k not in gone]


def test_long_texts_stay_fast():
    rng = random.Random(2)
    period = [str(rng.randrange(10**9)) for _ in range(9_000)]
    began = time.time()
    assert periodic.find_runs(["x"] * 300_000) == [(0, 300_000, 1)]
    assert periodic.find_runs(["y", "z", *(period * 5), "end"]) == [(2, 45_002, 9_000)]
    coin = [rng.choice("ab") for _ in range(60_000)]
    assert all(brute_smallest(coin[a:b]) == q and b - a >= max(6, 4 * q) for a, b, q in periodic.find_runs(coin))
    assert time.time() - began < 30


def expected(doc_id, text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    n, h = len(words), crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    shown = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    gone = {k for a, b, q in runs for k in range(a + q, b)}
    digests = ("".join(f"{a},{b - a},{q}\n" for a, b, q in runs), " ".join(w for k, w in enumerate(words) if k not in gone))
    return (doc_id, len(runs), *shown, *(hashlib.sha256(d.encode()).hexdigest() for d in digests))


def test_query_on_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect())
    want = sorted(expected(r.doc_id, r.text) for r in table(spark, sf, "documents").collect())
    assert got == want and sum(r[1] > 0 for r in got) > 5


def test_odd_rows(spark, docs):
    rows = [(1, None), (2, " \t"), (3, "a a a a a"), (4, "a A a a a a a a"), (4, "a A a a a a a a"), (None, "é é é é é é"), (6, "x y z")]
    got = [tuple(r)[:7] + (r.collapsed,) for r in periodic.detect(docs(rows)).orderBy("doc_id", "n_words").collect()]
    run = (4, 8, 1, 2, 6, 1, 6000, "a A a")
    assert got == [(None, 6, 1, 0, 6, 1, 6000, "é"), (1, 0, 0, None, None, None, None, ""), (2, 0, 0, None, None, None, None, ""), (3, 5, 0, None, None, None, None, "a a a a a"),
                   run, run, (6, 2, 0, None, None, None, None, "x y z")]
    assert periodic.detect(docs([])).count() == 0
