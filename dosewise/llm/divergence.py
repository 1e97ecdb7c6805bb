"""How far the sources of a language diverge in their words: iceberg prefix refinement, then smoothed shares.

The terms that at least `support` documents of a language hold are found by prefixes. A term is followed by a mark of
its end, and its first bytes are a prefix. Level by level prefixes grow; each pass counts, for every prefix that is left,
the documents that hold a term with it, and prefixes below the support are dropped with all that begins with them.
A prefix that reaches a term's end is complete; the search ends when only complete ones are left.

Documents are read once and written as chunks: the sorted distinct terms of some hundred documents of a language, and
for each document the places of its terms there. Every level's pass reads the chunks and counts with arrays: terms of
one prefix lie side by side. A chunk is some MB, so files hold few of them in a row group and batches one: what a task
holds depends on neither the rows nor the size of a file. Tasks add up before anything is shuffled. Which prefixes are left is told to the tasks by
a bitmap of hashes of a bounded size (BITS at most). A wrong bit, or a full bitmap, only lets a prefix be counted again
that the exact count then drops, so the result doesn't depend on it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dosewise.llm.common import checked, shared_folder
from dosewise.session import pinned

SUPPORT = 30
FIRST = 3  # bytes of the first prefixes; each level adds half, FIRST at least
# A bitmap has at least 16 bits a prefix, up to 2 ** 27 bits (16 MB).
BITS = 1 << 27
# Distinct terms of documents, one by one, of a chunk; a longer document is a chunk of its own.
HELD = 1_000_000
# Bytes of a row group of the chunk table. Readers hold a whole one, and by default writers look at its size after 100 rows only.
GROUP_BYTES = 8 << 20
# Rows and bytes of a batch for Python; by default it is up to 10,000 rows or 64 MB.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
# Cells of a table of sources by terms, for each term of a document, up to which a chunk is counted in such a table.
DENSE = 8
# Terms of one block and sources of one tile when sources are compared.
BLOCK, TILE = 1_024, 256
UNIT, SMOOTHING = 1_000_000_000, 5
TOP = 50

END = b" "
# Term bytes are letters A-Z (as a-z), a-z and all of 0x80 and above; others become END.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else END[0] for b in range(256))
CHUNK = "lang string, terms binary, sources array<string>, source binary, ends binary, places binary, times binary"


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return text.translate(_TABLE).split() if text else []


def _packed(numbers: np.ndarray) -> bytes:
    """Differences as int32, first all lowest bytes, then all second ones, ..: small ones compress well."""
    return np.diff(numbers, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel(), dtype=np.int64)


class Bitmap:
    """A set of (lang, prefix) by hash: has all that are in it, and some others."""

    def __init__(self, found: DataFrame) -> None:
        """`found` has distinct (lang, item) rows; give a checkpointed table, it is read twice."""
        rows, self.bits = found.count(), 1 << 16
        while self.bits < min(BITS, 16 * rows):
            self.bits *= 2
        slot = (F.xxhash64("lang", "item").bitwiseAND(self.bits - 1)).alias("slot")
        words = found.select(slot).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("word"))
        table = words.toArrow()  # BITS / 64 rows at most
        full = np.zeros(self.bits // 64, np.int64)
        full[table.column("at").to_numpy()] = table.column("word").to_numpy()
        self.shared = found.sparkSession.sparkContext.broadcast(full.view(np.uint8).tobytes())

    def of(self, lang: str):
        """A test of prefixes of one language, in a task."""
        octets, mask, hash_ = self.shared.value, self.bits - 1, xxhash.xxh64_intdigest
        seed = hash_(lang.encode(), 42)

        def has(prefix: bytes) -> bool:
            slot = hash_(prefix, seed) & mask
            return octets[slot >> 3] >> (slot & 7) & 1 == 1

        return has


class _Numbers(dict):
    """Numbers of terms in order of arrival."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class _Chunk:
    """Documents of one language on their way to a row of the chunk table."""

    def __init__(self, lang: str) -> None:
        self.lang, self.numbers, self.sources = lang, _Numbers(), _Numbers()
        self.source, self.sizes, self.places, self.times, self.held = [], [], [], [], 0

    def add(self, source: str, text: bytes | None) -> None:
        own = Counter(terms(text))
        self.source.append(self.sources[source])
        self.sizes.append(len(own))
        self.places.append(np.fromiter(map(self.numbers.__getitem__, own), np.int64, len(own)))
        self.times.append(np.fromiter(own.values(), np.int64, len(own)))
        self.held += len(own)

    def row(self) -> pa.RecordBatch:
        """The chunk; places are ranks of the terms in order of bytes, rising inside each document."""
        names = sorted(self.numbers)
        rank = np.empty(len(names), np.int64)
        rank[np.fromiter(map(self.numbers.__getitem__, names), np.int64, len(names))] = np.arange(len(names))
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        places, times = rank[np.concatenate(self.places)], np.concatenate(self.times)
        order = np.argsort(doc * max(1, len(names)) + places)
        columns = [
            pa.array([self.lang], pa.string()), pa.array([b"".join(n + END for n in names)], pa.binary()), pa.array([list(self.sources)], pa.list_(pa.string())),
            *(pa.array([_packed(v)], pa.binary()) for v in (np.array(self.source), np.cumsum(self.sizes), places[order], times[order]))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "terms", "sources", "source", "ends", "places", "times"])


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """BATCHES hold inside, where all that goes to Python is computed."""
    before = {key: spark.conf.get(key) for key in BATCHES}
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def encode(rows: DataFrame) -> DataFrame:
    """The chunk table of rows (lang, source, text) without nulls, written to the shared folder and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[str, _Chunk] = {}
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary())):
                if lang not in chunks:
                    chunks[lang] = _Chunk(lang)
                chunks[lang].add(source, text.as_py())
                if sum(c.held for c in chunks.values()) >= HELD:
                    yield chunks.pop(max(chunks, key=lambda k: chunks[k].held)).row()
        for chunk in chunks.values():
            yield chunk.row()

    path = shared_folder(rows.sparkSession, "terms")
    written = {"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false", "compression": "zstd"}
    rows.mapInArrow(run, CHUNK).write.options(**written).parquet(path)
    return rows.sparkSession.read.parquet(path)


def _terms(batch: pa.RecordBatch, k: int) -> tuple[pa.Array, np.ndarray]:
    """A chunk's terms, each with END, and their lengths without it."""
    every = batch.column("terms")[k].as_buffer()
    ends = np.flatnonzero(np.frombuffer(every, np.uint8) == END[0]) + 1
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), every]), np.diff(offsets) - len(END)


def _ints(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return _unpacked(batch.column(name)[k].as_buffer())


def _starts(items: pa.Array) -> np.ndarray:
    """Whether each of the sorted items differs from the one before."""
    new = np.ones(len(items), bool)
    if len(items) > 1:
        new[1:] = pc.not_equal(items[1:], items[:-1]).to_numpy(zero_copy_only=False)
    return new


def _counted(lang: str, sources: pa.Array | None, items: pa.Array, ns: np.ndarray) -> pa.RecordBatch:
    columns = {"lang": pa.repeat(pa.scalar(lang, pa.string()), len(items)), "source": sources, "item": items, "n": pa.array(ns, pa.int64())}
    return pa.RecordBatch.from_pydict({k: v for k, v in columns.items() if v is not None})


def _level(chunks: DataFrame, length: int, before: int, left: Bitmap | None) -> DataFrame:
    """(lang, item, n): documents of a language that hold an open prefix of `length` bytes, partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has: dict = {}
        for batch in batches:
            for k, lang in enumerate(batch.column("lang").to_pylist()):
                every, sizes = _terms(batch, k)
                at = np.flatnonzero(sizes >= before)
                names = every.take(pa.array(at))
                if left:
                    if lang not in has:
                        has[lang] = left.of(lang)
                    known = pc.binary_slice(names, 0, before)
                    new = _starts(known)
                    open_ = np.fromiter(map(has[lang], known.filter(pa.array(new)).to_pylist()), bool, np.count_nonzero(new))
                    open_ = open_[np.cumsum(new) - 1]
                    at, names = at[open_], names.filter(pa.array(open_))
                prefixes = pc.binary_slice(names, 0, length)
                new = _starts(prefixes)
                # place of a term -> number of its prefix, in order; -1 if it ended before or its prefix was dropped
                number = np.full(len(sizes), -1, np.int64)
                number[at] = np.cumsum(new) - 1
                ends = _ints(batch, "ends", k)
                own = number[_ints(batch, "places", k)]
                doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                held = own >= 0
                own, doc = own[held], doc[held]
                first = np.ones(len(own), bool)
                first[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
                yield _counted(lang, None, prefixes.filter(pa.array(new)), np.bincount(own[first], minlength=np.count_nonzero(new)))

    return chunks.select("lang", "terms", "ends", "places").mapInArrow(run, "lang string, item binary, n long")


def iceberg(chunks: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(lang, item): terms that at least `support` documents of a language hold."""
    length, before, left, kept = FIRST, 0, None, None
    while True:
        counted = _level(chunks, length, before, left).groupBy("lang", "item").agg(F.sum("n").alias("n"))
        found = pinned(counted.where(F.col("n") >= support).select("lang", "item"))
        whole = F.endswith("item", F.lit(END))
        done = found.where(whole).select("lang", F.expr(f"substring(item, 1, octet_length(item) - {len(END)})").alias("item"))
        kept = done if kept is None else kept.unionByName(done)
        open_ = found.where(~whole)
        if open_.isEmpty():
            return pinned(kept)
        left = Bitmap(open_)
        before, length = length, length + max(FIRST, length // 2)


def occurrences(chunks: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, n): how often each kept term occurs in each group, where it does."""
    left = Bitmap(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has: dict = {}
        for batch in batches:
            for k, lang in enumerate(batch.column("lang").to_pylist()):
                if lang not in has:
                    has[lang] = left.of(lang)
                every, sizes = _terms(batch, k)
                names = pc.binary_slice(every, 0, -len(END))
                kept_ = np.fromiter(map(has[lang], names.to_pylist()), bool, len(names))
                width = max(1, np.count_nonzero(kept_))
                number = np.where(kept_, np.cumsum(kept_) - 1, -1)
                ends, sources = _ints(batch, "ends", k), batch.column("sources")[k].values
                group = np.repeat(_ints(batch, "source", k), np.diff(ends, prepend=0))
                own = number[_ints(batch, "places", k)]
                held = own >= 0
                keys, times = group[held] * width + own[held], _ints(batch, "times", k)[held]
                if len(sources) * width <= DENSE * len(keys):
                    sums = np.bincount(keys, weights=times)
                    keys = np.flatnonzero(sums)
                    sums = sums[keys]
                else:
                    keys, at = np.unique(keys, return_inverse=True)
                    sums = np.bincount(at, weights=times, minlength=len(keys))
                items = names.filter(pa.array(kept_)).take(pa.array(keys % width))
                yield _counted(lang, sources.take(pa.array(keys // width)), items, sums.astype(np.int64))

    summed = chunks.mapInArrow(run, "lang string, source string, item binary, n long").groupBy("lang", "source", "item").agg(F.sum("n").alias("n"))
    return summed.join(checked(kept), ["lang", "item"])


def share(n: Column | int, total: str, size: str) -> Column:
    """1 + floor(UNIT (n + SMOOTHING) / (total + SMOOTHING size)), exact; null if the divisor is 0."""
    over = F.lit(UNIT).cast("decimal(10,0)") * ((n if isinstance(n, Column) else F.lit(n)) + SMOOTHING).cast("decimal(20,0)")
    under = F.expr(f"nullif({total} + {SMOOTHING} * {size}, 0)").cast("decimal(20,0)")
    return F.call_function("div", over, under) + 1


def _distances(group: pd.DataFrame) -> pd.DataFrame:
    """Sums of absolute differences between the sources of two tiles over one block of terms."""
    width = int(group["width"].iloc[0])
    matrix = np.repeat(group["base"].to_numpy(np.int64)[:, None], width, axis=1)
    for k, (at, p) in enumerate(zip(group["at"], group["p"])):
        if at is not None and len(at):
            matrix[k, np.asarray(at, np.int64)] = np.asarray(p, np.int64)
    names, tile = group["source"].to_numpy(), group["tile"].to_numpy()
    first, second = group["first"].iloc[0], group["second"].iloc[0]
    out = []
    for k in np.flatnonzero(tile == first):
        others = np.flatnonzero(tile == second)
        if first == second:
            others = others[others > k]
        sums = np.abs(matrix[others] - matrix[k]).sum(axis=1)
        out.append(pd.DataFrame({"lang": group["lang"].iloc[0], "a": names[k], "b": names[others], "value": sums}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "a": [], "b": [], "value": []})


def _pairs(groups: DataFrame, counts: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language: block of terms by tile of sources by tile."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("long")
    tiles = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) / TILE).cast("long")
    groups = pinned(groups.withColumn("parts", parts).withColumn("tiles", tiles))
    langs = groups.groupBy("lang").agg(F.first("parts").alias("parts"))
    blocked = kept.join(checked(langs), "lang").withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts"))).drop("parts")
    here = Window.partitionBy("lang", "part")
    placed = pinned(blocked.withColumn("at", F.row_number().over(here.orderBy("item")) - 1).withColumn("width", F.count(F.lit(1)).over(here)))
    held = counts.join(checked(placed.drop("width")), ["lang", "item"]).groupBy("lang", "source", "part").agg(F.collect_list(F.struct("at", "p")).alias("held"))
    widths = placed.groupBy("lang", "part").agg(F.first("width").alias("width"))
    dense = groups.select("lang", "source", "base", "tiles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    dense = dense.join(widths, ["lang", "part"], "left").join(held, ["lang", "source", "part"], "left").select(
        "lang", "part", "source", F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("width", F.lit(0)).alias("width"),
        F.col("held.at").alias("at"), F.col("held.p").alias("p"), F.pmod(F.xxhash64("source"), F.col("tiles")).alias("tile"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    met = dense.withColumn("first", F.least("tile", "other")).withColumn("second", F.greatest("tile", "other")).drop("other")
    sums = met.groupBy("lang", "part", "first", "second").applyInPandas(_distances, "lang string, a string, b string, value long")
    half = pinned(sums.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value")))
    one = half.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
    return one.unionByName(half.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))


def audit(docs: DataFrame, support: int = SUPPORT, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) for every group (lang, source).

    Each lang keeps the terms in at least `support` of its rows. A group's share of a term is
    1 + floor(10^9 (count + 5) / (N + 5 V)), N its occurrences of the V kept terms; a lang's share is that of all its
    rows. Part `pair` has each other source of the lang with the sum of absolute share differences over all kept terms,
    largest first; part `term` the `top` terms of the group whose share exceeds the lang's, by that excess. Ties go to
    the smaller item in UTF-8. Nulls in any column count as ''. Repeated rows count as often as they stand. A lang
    without kept terms has pairs of value 0 and no terms; an empty table gives an empty result.
    """
    text = [F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    with small_batches(docs.sparkSession):
        return _audit(docs.select(*text), support, top)


def _audit(rows: DataFrame, support: int, top: int) -> DataFrame:
    chunks = encode(rows)
    kept = iceberg(chunks, support)
    counts = pinned(occurrences(chunks, kept))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    all_ = rows.select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
    all_ = all_.select("lang", "source", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("total", F.lit(0)).alias("total"))
    groups = pinned(all_.withColumn("base", share(0, "total", "size")))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    shares = counts.join(checked(groups), ["lang", "source"]).select("lang", "source", "item", "n", "size", share(F.col("n"), "total", "size").alias("p"))
    shares = pinned(shares)

    whole = shares.groupBy("lang", "item", "size").agg(F.sum("n").alias("n")).join(langs, "lang")
    whole = pinned(whole.select("lang", "item", share(F.col("n"), "lang_total", "size").alias("q")))
    above = shares.join(checked(whole), ["lang", "item"]).where("p > q").select("lang", "source", F.col("item").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    pairs = _pairs(groups, shares.select("lang", "source", "item", "p"), kept).withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(best.withColumn("part", F.lit("term")).select(*columns))
