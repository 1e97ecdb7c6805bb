"""The manifest query lists every Parquet table of the folder."""

import hashlib
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from dosewise.queries.table_queries import file_manifest
from dosewise.sources import manifest

SF = Path("/root/testdata/sf0.001")


def test_all_files(spark):
    got = {r.path: (r.bytes, r.sha256, r.row_count) for r in file_manifest(spark, str(SF)).collect()}
    want = {f.name: (f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest(), pq.ParquetFile(f).metadata.num_rows) for f in SF.glob("*.parquet")}
    assert got == want and len(got) == 14


def tree(content, fanout):
    """Digest of a file's lines, fanout hashes into one."""
    pieces = content.split(b"\n")
    if pieces[-1] == b"":
        pieces.pop()
    level = [hashlib.sha256(p).hexdigest() for p in pieces]
    while len(level) > 1:
        parts = [level[k : k + fanout] for k in range(0, len(level), fanout)]
        level = [hashlib.sha256("".join(p).encode()).hexdigest() if len(p) > 1 else p[0] for p in parts]
    return hashlib.sha256(f"{len(content)}|{level[0] if level else ''}".encode()).hexdigest()


@pytest.mark.parametrize("split", ["1000", "64m"])
def test_files_over_the_limit_are_read_in_parts(spark, conf, tmp_path, monkeypatch, split):
    monkeypatch.setattr(manifest, "FANOUT", 7)
    conf("spark.sql.files.maxPartitionBytes", split)
    conf("spark.sql.files.openCostInBytes", "0")
    contents = {
        "parquet.bin": (SF / "orders.parquet").read_bytes()[:40_000], "lines": b"a\nb\n\n" * 900, "open+end %41": b"x\nyz", "feeds": b"\n" * 50,
        "one": b"\x00\xff\r\n\x80" * 3, "small": b"s"}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[-1]: r for r in manifest.file_manifest(spark, str(tmp_path), largest=2).collect()}
    assert {n: (r.bytes, r.sha256, r.parts_sha256) for n, r in got.items()} == {
        n: (len(c), hashlib.sha256(c).hexdigest() if len(c) <= 2 else None, None if len(c) <= 2 else tree(c, 7)) for n, c in contents.items()}
    stored = manifest.file_manifest(spark, str(tmp_path), largest=2)
    assert all(r.passed for r in manifest.verify(stored, stored).collect())
    (tmp_path / "lines").write_bytes(b"a\nc\n\n" * 900)
    changed = {r.rule: r.violations for r in manifest.verify(spark.createDataFrame(list(got.values()), stored.schema), manifest.file_manifest(spark, str(tmp_path), largest=2)).collect()}
    assert changed["parts_sha256"] == 1 and changed["sha256"] == 0 and changed["bytes"] == 0
