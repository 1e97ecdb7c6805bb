"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by three random sign changes, each followed by a Hadamard transform, and assigned to the nearest
signed axis; that is its bucket in one table. Several independent tables index every vector. A query looks into the
buckets of its several nearest axes in each table (multiprobe), and the candidates found there are ranked by their exact
cosine. Vectors and queries meet in a shuffle on (table, axis, part): buckets are dealt over parts of bounded size and
queries go to all parts of their buckets. Each part returns at most k candidates a query.

Of equal vectors only the k + 1 with the smallest ids can be among a query's k nearest (one of them may be the query), so
these stand for all of them in the index and a vector repeated any number of times makes no large bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from dosewise.session import pinned

TABLES = 12
PROBES = 8
SEED = 7
# Vectors of a bucket that meet its queries in one task, and queries in one block of a task.
PART_ROWS = 4_096
BLOCK = 1_024


def usable(vector: Column) -> Column:
    """Not null, of some length, no component null, NaN or infinite, not all zero."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def rotated(vectors: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Three rounds of signs and Hadamard transform on rows padded with zeros to a power of two."""
    size = 1 << max(0, int(vectors.shape[1] - 1).bit_length())
    out = np.zeros((len(vectors), size))
    out[:, : vectors.shape[1]] = vectors
    rng = np.random.default_rng([seed, table, size])
    for _ in range(3):
        out *= rng.choice([-1.0, 1.0], size)
        half = 1
        while half < size:
            pairs = out.reshape(len(out), -1, 2, half)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), size)
            half *= 2
    return out


def axes(vectors: np.ndarray, table: int, probes: int, seed: int = SEED) -> np.ndarray:
    """The `probes` nearest signed axes of each row, nearest first; axis a has code 2a, its opposite 2a + 1."""
    turned = rotated(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), table, seed)
    signed = np.stack([turned, -turned], axis=2).reshape(len(turned), -1)
    return np.argsort(-signed, axis=1, kind="stable")[:, :probes]


def hashed(vectors: DataFrame, tables: int, probes: int, seed: int = SEED) -> DataFrame:
    """(id, v, tab, axis) for each table and each of the `probes` nearest axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.asarray(batch.column("v").value_lengths())
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                rows = np.asarray(part.column("v").flatten()).astype(np.float64).reshape(-1, size)
                for t in range(tables):
                    near = axes(rows, t, probes, seed)
                    for p in range(near.shape[1]):
                        columns = [part.column("id"), part.column("v"), pa.array(np.full(len(rows), t, np.int32)), pa.array(near[:, p].astype(np.int32))]
                        yield pa.RecordBatch.from_arrays(columns, ["id", "v", "tab", "axis"])

    kind = dict(vectors.dtypes)["v"]
    return vectors.select("id", "v").mapInArrow(run, f"id long, v {kind}, tab int, axis int")


def cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of aligned rows, in double precision, summed the same way wherever the rows stand."""
    dot, a, b = ((x * y).sum(axis=1) for x, y in ((queries, rows), (queries, queries), (rows, rows)))
    return dot / (np.sqrt(a) * np.sqrt(b))


def best(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of each query, other than itself: (query_id, vec_id, score); ties to the smaller id."""
    out = []
    for size in sorted(set(queries["v"].map(len)) & set(rows["v"].map(len))):
        some = rows[rows["v"].map(len) == size].sort_values("id")
        x, ids = np.stack(some["v"].tolist()).astype(np.float64), some["id"].to_numpy(np.int64)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        own = queries[queries["v"].map(len) == size]
        for at in range(0, len(own), BLOCK):
            block = own.iloc[at : at + BLOCK]
            q, q_ids = np.stack(block["v"].tolist()).astype(np.float64), block["id"].to_numpy(np.int64)
            near = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ unit.T
            near[q_ids[:, None] == ids[None, :]] = -np.inf
            cut = min(k, len(ids)) - 1
            floor = -np.partition(-near, cut, axis=1)[:, cut]
            # everything within rounding of the k-th product is scored exactly
            i, j = np.nonzero((near >= floor[:, None] - 1e-9) & np.isfinite(near))
            score = cosines(q[i], x[j])
            order = np.lexsort((ids[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.searchsorted(i, i, side="left")
            keep = np.arange(len(i)) - first < k
            out.append(pd.DataFrame({"query_id": q_ids[i[keep]], "vec_id": ids[j[keep]], "score": score[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, tables: int = TABLES, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest other rows by cosine, as found by the index, or among all vectors if it finds too few.

    Rows whose id is null, or whose vector is null, zero or holds a null or non-finite component, take no part. Only
    vectors of equal length are compared. A query has fewer than k rows only if there are fewer candidates. Rows that
    repeat an id and vector count once; an id with several vectors is several rows. Other columns are ignored.
    """
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"  # floats move at half the size
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"), is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).dropDuplicates(["id", "v"])
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    indexed = rows.withColumn("n", first).where(F.col("n") <= k + 1).select("id", "v")
    table = pinned(hashed(indexed, tables, 1))
    parts = pinned(table.groupBy("tab", "axis").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts")))
    # one row per table and axis: at most tables x 2 x (vector length) rows
    spread = table.join(F.broadcast(parts), ["tab", "axis"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    asked = hashed(rows.where("asks"), tables, probes).join(F.broadcast(parts), ["tab", "axis"])
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    def rank(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        return best(queries, candidates, k)

    keys = ["tab", "axis", "part"]
    found = asked.drop("parts").groupBy(*keys).cogroup(spread.drop("parts").groupBy(*keys)).applyInPandas(rank, "query_id long, vec_id long, score double")
    nearest = pinned(found.distinct())
    rest = exhaustive(rows.where("asks"), indexed, nearest, k)
    nearest = nearest if rest is None else nearest.unionByName(rest).distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return nearest.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exhaustive(queries: DataFrame, indexed: DataFrame, nearest: DataFrame, k: int) -> DataFrame | None:
    """(query_id, vec_id, score) of the k nearest of all vectors for queries that the index gave too few; None if there are none.

    Too few are less than k and less than the other vectors of the query's length. Queries and vectors are dealt over
    parts of PART_ROWS, and every part of the ones meets every part of the others.
    """
    length = F.size("v").alias("len")
    sizes = pinned(indexed.groupBy(length).agg(F.count(F.lit(1)).alias("n")))
    got = nearest.groupBy(F.col("query_id").alias("id")).agg(F.count_distinct("vec_id").alias("got"))
    short = queries.select("id", "v", length).join(got, "id", "left").join(F.broadcast(sizes), "len")
    short = pinned(short.where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.col("n") - 1)).select("id", "v", "len", "n"))
    if short.isEmpty():
        return None
    part = lambda n: F.ceil(n / PART_ROWS).cast("int")
    parts = F.broadcast(pinned(short.groupBy("len").agg(part(F.count(F.lit(1))).alias("asking"), part(F.max("n")).alias("given"))))

    def dealt(side: DataFrame, own: str, other: str) -> GroupedData:
        placed = side.select("id", "v", length).join(parts, "len").withColumn(f"{own}_part", F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        copied = placed.withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return copied.drop("asking", "given").groupBy("len", "asking_part", "given_part")

    def rank(asked: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        return best(asked, candidates, k)

    met = dealt(short, "asking", "given").cogroup(dealt(indexed, "given", "asking"))
    return met.applyInPandas(rank, "query_id long, vec_id long, score double")
