"""Divergence against brute force: prefixes in bytes, ties, repeated rows, tiles and blocks, odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from dosewise.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, support, top):
    rows = [tuple(v or "" for v in r) for r in rows]
    found = [(lang, source, TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        df = Counter(t for l, _, ts in found if l == lang for t in set(ts))
        kept = sorted(t for t, n in df.items() if n >= support)
        sources = {s for l, s, _ in rows if l == lang}
        counts = {s: Counter(t for l, s2, ts in found if (l, s2) == (lang, s) for t in ts if t in set(kept)) for s in sources}

        def shares(c):
            return {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(sum(counts.values(), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, own, n in (("pair", pairs, len(pairs)), ("term", terms, top)):
                own.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(own[:n])]
    return sorted(out)


def made(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as n", "2 as p", "'x' as item")


def words(rng, n):
    stems = ["a", "ab", "abc", "abcd", "Abcde", "zé", "zè", "漢字", "漢", "long" * 9, "long" * 9 + "er", "it", "item"]
    return " ".join(rng.choice(stems) + rng.choice(["", "", "s", "0", "-x"]) for _ in range(n))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 4)
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "HELD", 7)
    rng = random.Random(5)
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", "s4", "s5", "S6", "é7", None]), words(rng, rng.randrange(0, 12))) for _ in range(160)]
    rows += rows[:20] + [("de", "only", "rare"), ("de", "", None), ("de", None, ""), (None, "null", "abc")]
    got = sorted(tuple(r) for r in divergence.audit(made(spark, rows), support=6, top=4).collect())
    assert got == brute(rows, 6, 4) and len(got) > 50


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence.Bitmap, "of", lambda self, lang: lambda prefix: True)
    rng = random.Random(6)
    rows = [("en", rng.choice("ab"), words(rng, 6)) for _ in range(60)]
    assert sorted(tuple(r) for r in divergence.audit(made(spark, rows), support=9, top=50).collect()) == brute(rows, 9, 50)


def test_bitmap_has_all_its_members(spark):
    rows = [(lang, f"{lang}{k}".encode()) for lang in ("en", "é", "") for k in range(500)]
    bits = divergence.Bitmap(spark.createDataFrame(rows, "lang string, item binary"))
    has = {lang: bits.of(lang) for lang in ("en", "é", "")}
    assert all(has[lang](item) for lang, item in rows)
    assert sum(has["en"](f"other{k}".encode()) for k in range(2000)) < 200


def test_no_rows_and_no_terms(spark):
    assert divergence.audit(made(spark, [])).count() == 0
    got = divergence.audit(made(spark, [("en", "a", "one"), ("en", "b", None), (None, None, None)]), support=2).orderBy("lang", "source").collect()
    assert [tuple(r) for r in got] == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_row_groups_hold_few_chunks(spark, monkeypatch):
    """Readers hold a whole row group, so its bytes are bounded, not its rows."""
    monkeypatch.setattr(divergence, "HELD", 2_000)
    monkeypatch.setattr(divergence, "GROUP_BYTES", 50_000, raising=False)
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(500)) for _ in range(160)]
    chunks = divergence.encode(spark.createDataFrame([("en", "s", t) for t in texts], "lang string, source string, text string").coalesce(1))
    (file,) = chunks.inputFiles()
    found = pq.ParquetFile(file.removeprefix("file:")).metadata
    assert found.num_rows == 40
    assert max(found.row_group(k).num_rows for k in range(found.num_row_groups)) <= 6


def test_packed_numbers_come_back():
    for numbers in ([], [0], [5, 3, 2**31 - 1, 0, 7], list(range(0, 900, 3))):
        assert divergence._unpacked(divergence._packed(np.array(numbers, np.int64))).tolist() == numbers


def test_batches_are_set_back(spark):
    before = [spark.conf.get(k) for k in divergence.BATCHES]
    divergence.audit(made(spark, [("en", "a", "one one two")]), support=1)
    assert [spark.conf.get(k) for k in divergence.BATCHES] == before
