"""Merkle audit against a plain comparison of all records."""

import hashlib

import pytest

from dosewise.llm import fixity

SCHEMA = "file string, at long, record long, hash string"


def hashed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(left, right):
    a = {(f or "", -1 if at is None else at): h for f, at, _, h in left}
    b = {(f or "", -1 if at is None else at): h for f, at, _, h in right}
    return sorted((f, at, "missing" if b.get((f, at)) is None else "added" if a.get((f, at)) is None else "altered")
                  for f, at in a.keys() | b.keys() if a.get((f, at)) != b.get((f, at)))


@pytest.mark.parametrize("range_bytes,fanout,levels", [(100, 2, 3), (65_536, 16, 4), (7, 3, 6)])
def test_finds_every_difference(spark, range_bytes, fanout, levels):
    left = [(f, at, at // 10, hashed(f"{f}{at}")) for f in ("a", "b", "c") for at in range(0, 3000, 30)] + [(None, None, None, hashed("x")), ("only", 5, 1, hashed("y"))]
    right = [r for r in left if r[:2] not in (("a", 60), ("only", 5))]
    right = [(f, at, r, hashed("z") if (f, at) in (("b", 90), (None, None)) else h) for f, at, r, h in right] + [("a", 61, 9, hashed("new")), ("more", 0, 0, hashed("w"))]
    got = fixity.audit(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), range_bytes, fanout, levels).collect()
    assert sorted((r.file, r.at, r.verdict) for r in got if r.kind == "record") == plain(left, right)
    wrong = {r.file for r in got if r.kind == "root" and r.verdict != "equal"}
    assert wrong == {f for f, _, _ in plain(left, right)} and {r.file for r in got if r.kind == "root"} == {"a", "b", "c", "", "only", "more"}
    assert sum(r.records for r in got if r.kind == "root" and r.file == "c") == 100


def test_repeated_rows_and_empty_tables(spark):
    rows = [("a", 0, 1, hashed("x"))] * 3 + [("a", 0, 2, hashed("y")), ("a", 9, 3, None)]
    left, none = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)
    same = fixity.audit(left, spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert [r.verdict for r in same] == ["equal"]
    fewer = fixity.audit(left, spark.createDataFrame(rows[1:], SCHEMA)).collect()
    assert [(r.kind, r.at) for r in fewer] == [("root", 0), ("record", 0)]
    assert fixity.audit(none, none).count() == 0
    assert {r.verdict for r in fixity.audit(left, none).collect()} == {"missing"} and {r.verdict for r in fixity.audit(none, left).collect()} == {"added"}


def test_page_records_are_laid_end_to_end(spark):
    pages = spark.createDataFrame([(i, None if i == 3 else f"u{i}", None if i == 2 else "é" * i, 1) for i in range(6)], "page_id long, url string, html string, at int")
    got = sorted(fixity.page_records(pages, per_file=4).collect(), key=lambda r: r.record)
    body = lambda i: ("" if i == 3 else f"u{i}") + "\n" + ("" if i == 2 else "é" * i)
    want, offset = [], {}
    for i in range(6):
        file = f"part-{i // 4}"
        want.append((file, offset.get(file, 0), i, hashed(body(i))))
        offset[file] = offset.get(file, 0) + len(body(i).encode())
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("per_file", [1, 4, 100])
def test_offsets_do_not_depend_on_the_order_of_rows(spark, per_file):
    rows = [(1, "u", "one"), (1, "u", "two"), (1, None, "three"), (None, "u", "four"), (None, "u", "five"), (1, "u", "two"), (None, "u", "four"), (2, "", None)]
    frames = [spark.createDataFrame(r, "page_id long, url string, html string") for r in (rows, rows[::-1], rows[3:] + rows[:3])]
    records = [fixity.page_records(f, per_file=per_file) for f in frames]
    laid = [sorted((r.file or "", r.at, r.record or 0, r.hash) for r in t.collect()) for t in records]
    assert laid[0] == laid[1] == laid[2] and len(laid[0]) == len(rows)
    sizes = {hashed(f"{u or ''}\n{h or ''}"): len(f"{u or ''}\n{h or ''}") for _, u, h in rows}
    for file in {r[0] for r in laid[0]}:  # end to end
        own = [r for r in laid[0] if r[0] == file]
        assert [r[1] for r in own] == [sum(sizes[h] for _, _, _, h in own[:k]) for k in range(len(own))]
    assert {r.verdict for r in fixity.audit(records[0], records[1]).collect()} == {"equal"}
