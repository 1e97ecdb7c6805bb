"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within `radius` bits have a common variant within `radius / 2` bits of both. Every distinct fingerprint
emits its variants, the variants are shuffled, and the few fingerprints that meet at one variant (never more than the
ball has members) are chained in order. Chains join exactly what all pairs of the bucket would join.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosewise.llm.common import filed, join_hot, locator, without
from dosewise.llm.components import components
from dosewise.session import pinned

BITS = 64
SEED = 42
# Shingles whose bits are counted at once; bounds the memory of a long text.
BLOCK = 65_536


def shingles(text: str | None, width: int) -> np.ndarray:
    """64-bit hashes of the `width`-word shingles in order; a shorter text is one shingle, none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only A-Z and ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(width, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    hash_ = xxhash.xxh64_intdigest
    return np.fromiter((hash_(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)


def folded(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint of shingle hashes, repeats included; 0 without any."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        octets = hashes[at : at + BLOCK].view(np.uint8).reshape(-1, BITS // 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def simhash(text: str | None, width: int) -> int:
    """Signed 64-bit fingerprint; 0 without words."""
    return folded(shingles(text, width))


def fingerprint(text: Column, width: int = 3) -> Column:
    """SimHash of the `width`-word shingles of the lower-cased (A-Z) text; null counts as empty."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, width) for t in texts], dtype="int64")

    return of(text)


def ball(radius: int) -> list[int]:
    """Masks of all changes of at most `radius` bits, as signed longs."""
    masks = [sum(1 << i for i in at) for n in range(radius + 1) for at in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(fingerprints: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links (a, b), a < b, that connect the same fingerprints as all pairs within `radius` bits.

    `fingerprints` holds distinct fingerprints in column `fp`. Members of one bucket are within radius / 2 of its
    variant, so consecutive ones are always within an even radius of each other.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    met = fingerprints.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    chained = met.select(F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")).alias("a"), F.col("fp").alias("b"))
    found = chained.where(F.col("a").isNotNull()).distinct()
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def groups(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, at, fp, component_id, kept) of every row of a filed table; `at` locates the row, component_id is the smallest id of its group.

    Null and wordless texts have fingerprint 0 and are linked like any other. Rows with a null id belong to their
    group but name it only (with null) if it has no other rows. Of each group the row with the smallest (id, at) is
    kept, null ids last. Repeated rows are all returned. Other columns are ignored, whatever their names. An empty
    table gives an empty result.
    """
    rows = pinned(docs.select(F.col(id_col).alias("doc_id"), locator().alias("at"), fingerprint(F.col(text_col), width).alias("fp")))
    first = pinned(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")).alias("first")))
    linked = components(links(first.select("fp"), radius)).join(first.withColumnRenamed("fp", "node"), "node")
    named = linked.groupBy("root").agg(F.min("first").alias("low")).join(linked.select("node", "root"), "root")
    names = first.join(named.select(F.col("node").alias("fp"), "low"), "fp", "left").select("fp", "n", F.coalesce("low", "first").alias("low"))
    return join_hot(rows, pinned(names), "fp", "n").select(
        "doc_id", "at", "fp", F.col("low.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("at") == F.col("low.at"))).alias("kept"),
    )


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row, the fingerprint as 16 hexadecimal digits. Cases as in `groups`."""
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return groups(filed(docs), width, radius, id_col, text_col).select("doc_id", hexed.alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of near duplicates, all columns as they are. Cases as in `groups`."""
    docs = filed(docs)
    return without(docs, groups(docs, width, radius, id_col, text_col).where("not kept"))
