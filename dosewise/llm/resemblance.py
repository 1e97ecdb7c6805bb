"""Near copies by the Jaccard similarity of their five-word shingles: SimHash balls and MinHash bands find candidates, exact sets decide.

SimHash fingerprints are linked through their balls, as in `simhash`; the rows of a group of linked fingerprints share a
key. That alone can't find all near copies: pairs with a similarity of 0.8 are up to 14 bits apart, and a ball of that
radius can't be listed. So each text also has 25 band keys of five minima; a pair with a similarity of 0.8 shares one with
a probability of 0.99995. Every two rows that share a key of either kind are compared, unless links already connect them:

1. Each row is compared with the first row of each of its keys. Groups of copies, however large, are connected by this.
2. Where the rows of a key are still in several groups, rows of different groups are compared: all pairs of a key with
   few rows; of a larger key, or keys that have groups in common, block against block. Only rows outside the largest
   group meet all others. In a block pair the minima rule out pairs (see AGREE), the sets decide, and rows that a new
   link has connected are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosewise.llm import simhash
from dosewise.llm.common import checked, filed, join_hot, locator, without
from dosewise.llm.components import components
from dosewise.llm.simhash import folded, shingles
from dosewise.session import pinned

WIDTH = 5
SIMILARITY = 0.8
BANDS, MINIMA = 25, 5
# Of a pair with the least similarity, fewer of the 125 minima than these agree with a probability of 10 ** -7.
AGREE = 75
# Rows of one key up to which pairs are listed; above it blocks are compared.
LISTED = 16
# A block has about so many rows, and shingles of about so many bytes.
BLOCK_ROWS, BLOCK_BYTES = 1_024, 4 << 20
CHUNK = 512
ROWS_AT_ONCE = 256

_random = np.random.default_rng(5)
TURN = _random.integers(0, 1 << 64, (BANDS * MINIMA, 1), np.uint64)
FACTOR = _random.integers(0, 1 << 64, (BANDS * MINIMA, 1), np.uint64) | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingles(text, WIDTH))


def minima(own: np.ndarray) -> np.ndarray:
    """The least of each permuted hash; texts without words share all of theirs."""
    low = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), CHUNK):
        np.minimum(low, ((own[at : at + CHUNK] ^ TURN) * FACTOR).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """BANDS keys, each of MINIMA minima."""
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(low.reshape(BANDS, MINIMA))], np.uint64).view(np.int64)


def octets(low: np.ndarray) -> bytes:
    """One byte of each of the minima."""
    return (low >> np.uint64(56)).astype(np.uint8).tobytes()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, at, fp, keys) of every row of a filed table: its fingerprint and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, found = [], [np.zeros(0, np.int64)]
            for text in batch.column("text"):
                hashes = shingles(text.as_py(), WIDTH)
                prints.append(folded(hashes))
                found.append(band_keys(minima(np.unique(hashes))))
            keys = np.concatenate(found)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS), pa.int32()), pa.array(keys))
            columns = [batch.column("doc_id"), batch.column("at"), pa.array(prints, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "fp", "keys"])
        pa.default_memory_pool().release_unused()  # the worker waits for its next task without them

    rows = docs.select(F.col(id_col).alias("doc_id"), locator().alias("at"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, at struct<file:string,row:long>, fp long, keys array<long>")


def ball_keys(rows: DataFrame) -> DataFrame:
    """(node, key) of rows (node, fp): one key for all whose fingerprints are linked through balls, equal ones included."""
    prints = pinned(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    linked = components(simhash.links(prints.select("fp"))).withColumnRenamed("node", "_fp")
    named = prints.join(linked, F.col("fp") == F.col("_fp"), "left").select("fp", "n", F.coalesce("root", "fp").alias("root"))
    several = named.groupBy("root").agg(F.sum("n").alias("_all")).where("_all > 1").select("root")
    named = pinned(named.join(several, "root").select("fp", "n", F.xxhash64(F.lit("ball"), "root").alias("key")))
    return pinned(join_hot(rows.select("node", "fp"), named, "fp", "n").select("node", "key"))


def shingled(texts: DataFrame) -> DataFrame:
    """(node, set, octets) of rows (node, text): the shingles in order, and a byte of each of the minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                own = [shingle_set(t.as_py()) for t in part.column("text")]
                ends = pa.array(np.cumsum([0, *map(len, own)]), pa.int32())
                sets = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(own).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("node"), sets, pa.array([octets(minima(s)) for s in own], pa.binary())], ["node", "set", "octets"])
        pa.default_memory_pool().release_unused()

    return texts.mapInArrow(run, "node long, set array<long>, octets binary")


def similar(a: Column, b: Column) -> Column:
    """Whether two arrays without repeats have a Jaccard similarity of at least SIMILARITY; two empty ones have."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(all_ == 0, True).otherwise(both / (all_ - both) >= SIMILARITY)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The similar ones of the pairs (a, b). The sets of one side move once, those of the other once a pair."""
    first, second = (sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in ("a", "b"))
    return pinned(pairs.join(second, "b").join(first, "a").where(similar(F.col("set_a"), F.col("set_b"))).select("a", "b"))


def _grouped(met: DataFrame, links: DataFrame) -> DataFrame:
    """`met` with the group (smallest node) of each node."""
    found = components(links).withColumnRenamed("node", "_node")
    return met.join(found, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node")).drop("_node")


def _block_links(pair: pd.DataFrame) -> pd.DataFrame:
    """Links between the rows of two blocks that join groups not joined before."""
    first, second = int(pair["first"].iloc[0]), int(pair["second"].iloc[0])
    left, right = (pair[pair["own"] == own].reset_index(drop=True) for own in (first, second))
    bytes_left, bytes_right = (np.frombuffer(b"".join(side["octets"]), np.uint8).reshape(len(side), -1) for side in (left, right))
    sets_left, sets_right = (side["set"].tolist() for side in (left, right))
    joined = {r: r for r in pair["root"].tolist()}

    def top(root: int) -> int:
        while joined[root] != root:
            joined[root] = root = joined[joined[root]]
        return root

    roots_left, roots_right = left["root"].tolist(), right["root"].tolist()
    found = []
    for k, own in enumerate(sets_left):
        agree = np.count_nonzero(bytes_right == bytes_left[k], axis=1)
        if first == second:
            agree[: k + 1] = 0
        near = np.flatnonzero(agree >= AGREE)
        todo, at_once = near[np.argsort(-agree[near], kind="stable")].tolist(), 1
        while todo := [m for m in todo if top(roots_right[m]) != top(roots_left[k])]:
            for m in todo[:at_once]:
                both = len(np.intersect1d(own, sets_right[m], assume_unique=True))
                if both >= SIMILARITY * (len(own) + len(sets_right[m]) - both):
                    found.append((left["node"].iloc[k], right["node"].iloc[m]))
                    joined[top(roots_right[m])] = top(roots_left[k])
                    break
            todo, at_once = todo[at_once:], 4 * at_once
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _between_blocks(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) that join groups, from rows (key, node, root) of keys with many rows and several groups.

    Groups that meet in a key are a family, also over several keys, so that a row is in blocks of one family only. The
    largest group of a family keeps its rows apart from the rest; its blocks don't meet each other.
    """
    roots = pinned(met.select("key", "root").distinct())
    lows = pinned(roots.groupBy("key").agg(F.min("root").alias("low"), F.count(F.lit(1)).alias("n")))
    family = components(join_hot(roots, lows, "key", "n").select(F.col("low").alias("a"), F.col("root").alias("b"))).toDF("root", "family")
    nodes = pinned(met.select("node", "root").distinct())
    groups = pinned(nodes.groupBy("root").agg(F.count(F.lit(1)).alias("n")).join(family, "root"))
    rows = join_hot(nodes, groups, "root", "n")
    widest = pinned(groups.groupBy("family").agg(F.max(F.struct("n", "root"))["root"].alias("widest")))
    rows = pinned(rows.join(checked(widest), "family").withColumn("rest", F.col("root") != F.col("widest")).select("family", "node", "root", "rest").join(sets, "node"))

    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum(8 * F.size("set") + 150) / BLOCK_BYTES)).cast("int")
    sizes = rows.groupBy("family", "rest").agg(size.alias("n"))
    sizes = sizes.groupBy("family").agg(F.max(F.when(F.col("rest"), F.col("n"))).alias("outer"), F.max(F.when(~F.col("rest"), F.col("n"))).alias("inner"))
    dealt = rows.join(checked(pinned(sizes)), "family")
    hashed = F.xxhash64("node")
    # blocks of the rest are 0, 1, ..; those of the largest group -1, -2, ..
    dealt = dealt.withColumn("own", F.when(F.col("rest"), F.pmod(hashed, F.col("outer"))).otherwise(-1 - F.pmod(hashed, F.col("inner"))).cast("int"))
    outer = F.sequence(F.lit(0), F.col("outer") - 1)
    inner = F.sequence(-F.col("inner"), F.lit(-1))
    pairs = F.when(F.col("rest"), F.concat(
        F.transform(outer, lambda k: F.struct(F.least("own", k).alias("first"), F.greatest("own", k).alias("second"))),
        F.transform(inner, lambda k: F.struct(F.col("own").alias("first"), k.alias("second")))))
    pairs = pairs.otherwise(F.transform(outer, lambda k: F.struct(k.alias("first"), F.col("own").alias("second"))))
    placed = dealt.select("family", "node", "root", "set", "octets", "own", F.explode(pairs).alias("pair")).select("*", "pair.*").drop("pair")
    return placed.groupBy("family", "first", "second").applyInPandas(_block_links, "a long, b long")


def links(docs: DataFrame, rows: DataFrame, text: Column) -> DataFrame:
    """(a, b) of similar rows that share a key, as many as connect all of them; rows: (node, at, fp, keys)."""
    met = rows.select("node", F.explode("keys").alias("key")).unionByName(ball_keys(rows))
    shared = pinned(met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead")).where("n > 1"))
    met = pinned(join_hot(met, shared, "key", "n"))
    asked = pinned(met.select("node").distinct().join(rows.select("node", F.col("at").alias("_of")), "node"))
    placed = docs.select(locator().alias("_at"), text.alias("text")).join(checked(asked), F.col("_at") == F.col("_of"))
    sets = pinned(shingled(placed.select("node", "text")))

    stars = pinned(met.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    found = _verified(stars, sets)
    met = pinned(_grouped(met.drop("lead"), found))
    open_ = pinned(met.groupBy("key", "n").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "n"))
    met = pinned(join_hot(met.drop("n"), open_, "key", "n"))

    before = F.collect_list(F.struct("node", "root")).over(Window.partitionBy("key").orderBy("node").rowsBetween(1 - LISTED, -1))
    listed = met.where(F.col("n") <= LISTED).select(F.col("node").alias("b"), "root", before.alias("before"))
    listed = listed.select("b", "root", F.explode("before").alias("a")).where("a.root != root").select("a.node", "b").toDF("a", "b").distinct()
    found = found.unionByName(_verified(listed.join(stars, ["a", "b"], "left_anti"), sets))
    large = met.where(F.col("n") > LISTED)
    return found if large.isEmpty() else found.unionByName(_between_blocks(large, sets))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of near copies, all columns as they are.

    Rows are a group if links of similar pairs connect them; the row with the smallest (id, place) stays, null ids last.
    Null texts count as empty, and texts without words are equal. Repeated rows are copies. An empty table stays empty.
    """
    docs = filed(docs)
    placed = pinned(keyed(docs, id_col, text_col).withColumn("node", F.monotonically_increasing_id()))
    linked = components(links(docs, placed, F.col(text_col)))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")
    rows = pinned(linked.join(placed.select("node", "at", rank.alias("rank")), "node"))
    kept = rows.groupBy("root").agg(F.min("rank").alias("low")).select(F.col("low.at").alias("at"))
    return without(docs, rows.select("at").join(kept, "at", "left_anti"))
