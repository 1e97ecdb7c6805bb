"""Runs of repeated words: recursive frequency splitting, then a lag scan of the segments that survive.

A run is a maximal stretch of words with smallest period q and a length of at least max(6, 4 q), so every one of its
words occurs at least four times in it. A word that occurs fewer times in a segment can be in none of the segment's
runs and splits it; the pieces are split again until nothing changes. Most texts end here.

A surviving segment is scanned by lags. For lags q from h up to 2 h, h a power of two, a run holds a multiple a of h
at most h - 1 words after its start, and the 2 h words from a and from a + q are then equal. All such (a, q) are found
at once by comparing hashes of windows, n comparisons for each h. Those inside a known run whose period divides q belong
to that run; each lag that is left is scanned in full, word against word, so hashes decide nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST = 6
REPEATS = 4
ODD = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]  # start, end (exclusive), period


def _stretches(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values."""
    edges = np.flatnonzero(np.diff(held, prepend=False, append=False))
    return edges[::2], edges[1::2]


def segments(codes: np.ndarray) -> list[tuple[int, int]]:
    """Stretches in which every word occurs at least REPEATS times, of at least LEAST words."""
    done, todo = [], [(0, len(codes))]
    while todo:
        low, high = todo.pop()
        _, at, counts = np.unique(codes[low:high], return_inverse=True, return_counts=True)
        held = counts[at] >= REPEATS
        if held.all():
            done.append((low, high))
            continue
        starts, ends = _stretches(held)
        wide = ends - starts >= LEAST
        todo.extend(zip((low + starts[wide]).tolist(), (low + ends[wide]).tolist()))
    return done


def lag_scan(codes: np.ndarray) -> list[Run]:
    """All runs of a segment."""
    n, found, h = len(codes), {}, 1
    hashes = codes.astype(np.uint64) * ODD + np.uint64(1)  # of windows of h words
    while REPEATS * h <= n:
        hashes = hashes[:-h] * ODD + (hashes[h:] ^ (hashes[h:] >> np.uint64(29)))  # of 2 h words
        rows = np.zeros((len(hashes) // h + 2) * h, np.uint64)
        rows[: len(hashes)] = hashes
        rows = rows.reshape(-1, h)
        anchor, lag = np.nonzero(rows[1:] == rows[:-1, :1])
        inside = (anchor + 1) * h + lag < len(hashes)
        start, lag = anchor[inside] * h, lag[inside] + h
        period, end = np.ones(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for (a, b), q in found.items():  # two runs that share so many words would be one
            if b - a >= 3 * h:
                where = slice(-(-a // h), (b - 3 * h) // h + 1)
                period[where], end[where] = q, b
        at = start // h
        known = (lag % period[at] == 0) & (start + lag + 2 * h <= end[at])
        for q in np.unique(lag[~known & (REPEATS * lag <= n)]).tolist():
            starts, ends = _stretches(codes[:-q] == codes[q:])
            long = ends - starts + q >= max(LEAST, REPEATS * q)
            for a, b in zip(starts[long].tolist(), (ends[long] + q).tolist()):
                found.setdefault((a, b), q)  # an equal stretch has a period that divides q
        h *= 2
    return [(a, b, q) for (a, b), q in found.items()]


def find_runs(words: list) -> list[Run]:
    """All runs of a list of hashable words, by start, then period."""
    if len(words) < LEAST:
        return []
    index: dict = {}
    codes = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    runs = [(low + a, low + b, q) for low, high in segments(codes) for a, b, q in lag_scan(codes[low:high])]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[Run]) -> list:
    """The words less those that a run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, end, q in runs:
        gone[start + q : end] = True
    return [words[k] for k in np.flatnonzero(~gone).tolist()]


def detect(docs: DataFrame, change: Callable[[int | str | None, list[bytes]], list[bytes]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_runs, start, length, period, exponent_milli, runs, collapsed) of every row's whole text.

    Words are what ASCII white space leaves, case matters. start to exponent_milli are of the longest run (of equal
    ones the first, then the smallest period), null without runs. `runs` holds every run as (start, length, period);
    `collapsed` is the text with one period of each run, its words joined by one space. `change` makes the words to
    look at from the id and the words. Null texts count as empty; repeated rows and null ids are all returned; other
    columns are ignored. An empty table gives an empty result.
    """
    source = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")
    kind = pa.list_(pa.struct({"start": pa.int64(), "length": pa.int64(), "period": pa.int64()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.binary())):
                words = (text.as_py() or b"").split()
                if change is not None:
                    words = change(id_.as_py(), words)
                runs = find_runs(words)
                a, b, q = max(runs, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=(None, None, None))
                best = (a, b - a, q, 1000 * (b - a) // q) if runs else (None,) * 4
                rows.append((len(words), len(runs), *best, [{"start": s, "length": e - s, "period": p} for s, e, p in runs], b" ".join(collapsed(words, runs))))
            columns = list(zip(*rows)) if rows else [()] * 8
            arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], kind), pa.array(columns[7], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"])

    return source.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
                                  "runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: int | str | None, words: list[bytes]) -> list[bytes]:
    """Every tenth text by the checksum of its id, made periodic from some word on; a null id leaves the words alone."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // len(tail) + 1))[: n - a]
