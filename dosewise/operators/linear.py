"""Fold-keyed PCA and ridge on array rows.

Row layout: (entity, x ARRAY<DOUBLE>, y ARRAY<DOUBLE>, test_of, held_of
ARRAY<STRING> [, extra ARRAY<DOUBLE>]). All model folds are fitted in the same
passes: partial moment blocks per partition (`mapInPandas`), summed per
(fold, tile), then one small dense solve per fold. Task memory is bounded by
FLUSH_BYTES plus one batch, whatever the number of rows or folds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.operators.vectors import MIN_VARIANCE
from dosewise.session import BROADCAST_BYTES_KEY, DEFAULT_BROADCAST_BYTES, fresh, limit, pinned

TILE = 128
TARGET_BLOCK = 2048
# Tasks that emit partial sums: a merge group then holds at most this many blocks.
MAX_PARTIALS = 512
# Second-level partial sums of one key.
MERGE_GROUPS = 64
FLUSH_BYTES = 256 * 1024 * 1024
MIN_SD = 1e-12
# Widest table solved from the feature Gram matrix, and most rows solved from the row one.
# A task of the row path holds one Gram matrix of MAX_DUAL_ROWS squared numbers per fold.
MAX_GRAM_FEATURES = 8_000
MAX_DUAL_ROWS = 1_000
GRAM_KEY = "spark.dosewise.gramFeatures"
DUAL_KEY = "spark.dosewise.dualRows"
DUAL_BLOCK = 512
# Blocks a Krylov basis may hold before it is compressed to its leading Ritz vectors.
RESTART_BLOCKS = 4
# Prefix of the key that sums all rows of a variant.
TOTAL = "*"

BLOCK_SCHEMA = "model_fold string, ti int, tj int, stat array<double>"
PCA_SCHEMA = (
    "model_fold string, component int, eigenvalue double, explained_ratio double, n_train bigint, "
    "n_selected int, loading array<double>, mean array<double>"
)
KRYLOV_SCHEMA = (
    "model_fold string, width int, held int, basis array<double>, images array<double>, block array<double>, "
    "eigen array<double>, trace double, done boolean"
)
RIDGE_SCHEMA = "model_fold string, target_block int, n_design int, n_scaled int, stat array<double>"


def stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.empty((0, 0))


def mask_of(column: pd.Series, fold: str) -> np.ndarray:
    return np.fromiter((fold in v for v in column), dtype=bool, count=len(column))


def scope_of(fold: str) -> str:
    """Variant part of a fold name ("variant|fold"), empty when there is none."""
    return fold.split("|", 1)[0] if "|" in fold else ""


def fold_columns(rows: DataFrame) -> list[str]:
    return [c for c in ("test_of", "held_of", "variant") if c in rows.columns]


def in_scope(pdf: pd.DataFrame, fold: str) -> np.ndarray:
    """Rows of the fold's variant; rows without variants belong to every fold."""
    if "variant" not in pdf:
        return np.ones(len(pdf), dtype=bool)
    return (pdf["variant"] == scope_of(fold)).to_numpy()


def train_mask(pdf: pd.DataFrame, fold: str) -> np.ndarray:
    return in_scope(pdf, fold) & ~mask_of(pdf["held_of"], fold)


class BlockSums:
    """Keyed running sums of small arrays with a memory ceiling."""

    def __init__(self, names: list[str]):
        self.names, self.sums, self.bytes = names, {}, 0

    def add(self, key: tuple, value: np.ndarray) -> None:
        held = self.sums.get(key)
        if held is None:
            self.sums[key] = value
            self.bytes += value.nbytes
        else:
            held += value

    def full(self) -> bool:
        return self.bytes > FLUSH_BYTES

    def drain(self) -> Iterator[pd.DataFrame]:
        for key, value in self.sums.items():
            yield pd.DataFrame([[*key, value]], columns=[*self.names, "stat"])
        self.sums, self.bytes = {}, 0


def sum_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Elementwise sum of `stat` per key in two levels: at most MERGE_GROUPS partial sums of a key meet in the second."""
    types = dict(blocks.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", stat array<double>"

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, stack(pdf["stat"]).sum(axis=0)]], columns=[*keys, "stat"])

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return merge(key[:-1], pdf)

    salted = blocks.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
    return salted.groupBy(*keys, "_salt").applyInPandas(first, schema).groupBy(*keys).applyInPandas(merge, schema)


def held_and_total(pdf: pd.DataFrame) -> list[tuple[str, np.ndarray]]:
    """(key, mask) of every sum a batch contributes to: one total per variant, one per fold left out."""
    scopes = sorted(set(pdf["variant"])) if "variant" in pdf else [""]
    out = [(TOTAL + s, (pdf["variant"] == s).to_numpy() if "variant" in pdf else np.ones(len(pdf), dtype=bool)) for s in scopes]
    held = {f for fs in pdf["held_of"] for f in fs}
    return out + [(f, mask_of(pdf["held_of"], f)) for f in sorted(held)]


def per_fold(blocks: DataFrame, folds: list[str], keys: list[str]) -> DataFrame:
    """Variant totals copied to their folds (+) next to the held-out sums (-)."""
    names = F.array(*[F.struct(F.lit(TOTAL + scope_of(f)).alias("t"), F.lit(f).alias("f")) for f in folds])
    total = F.col("model_fold").startswith(TOTAL)
    targets = F.when(
        total, F.transform(F.filter(names, lambda n: n["t"] == F.col("model_fold")), lambda n: n["f"])
    ).otherwise(F.array("model_fold"))
    return blocks.select(
        F.explode(targets).alias("model_fold"), *keys,
        F.when(total, F.col("stat")).otherwise(F.transform("stat", lambda v: -v)).alias("stat"),
    ).where(F.col("model_fold").isin(*folds))


def moment_blocks(rows: DataFrame, column: str, folds: list[str], subset: np.ndarray | None = None) -> DataFrame:
    """Signed training moments (count, sums, cross products) per fold and feature tile.

    Every row is summed once overall and once per fold that leaves it out; a
    fold's training moments are the sum of its signed blocks, so folds do not
    multiply the work. `subset` limits the columns.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = BlockSums(["model_fold", "ti", "tj"])
        for pdf in batches:
            if not len(pdf):
                continue
            data = stack(pdf[column])
            if subset is not None:
                data = data[:, subset]
            for key, mask in held_and_total(pdf):
                part = data[mask]
                for i in range(0, data.shape[1], TILE):
                    for j in range(i, data.shape[1], TILE):
                        a, b = part[:, i:i + TILE], part[:, j:j + TILE]
                        stat = np.concatenate([[len(part)], a.sum(axis=0), b.sum(axis=0), (a.T @ b).ravel()])
                        sums.add((key, i // TILE, j // TILE), stat)
                        if sums.full():
                            yield from sums.drain()
        yield from sums.drain()

    needed = [c for c in fold_columns(rows) if c != "test_of"]
    blocks = rows.select(column, *needed).coalesce(MAX_PARTIALS).mapInPandas(partial, BLOCK_SCHEMA)
    return per_fold(sum_blocks(blocks, ["model_fold", "ti", "tj"]), folds, ["ti", "tj"])


def unpack_moments(pdf: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, centred cross products) from the signed tiles of one fold."""
    tiles: dict[tuple[int, int], np.ndarray] = {}
    for i, j, s in zip(pdf["ti"], pdf["tj"], pdf["stat"], strict=True):
        tiles[int(i), int(j)] = tiles.get((int(i), int(j)), 0.0) + np.asarray(s)
    count = 1 + max(i for i, _ in tiles)
    # a diagonal tile stores 1 + 2w + w*w numbers
    width = [int(round(np.sqrt(len(tiles[t, t])))) - 1 for t in range(count)]
    starts = np.concatenate([[0], np.cumsum(width)])
    n = int(round(tiles[0, 0][0]))
    total = np.zeros(starts[-1])
    gram = np.zeros((starts[-1], starts[-1]))
    for (i, j), stat in tiles.items():
        wi, wj = width[i], width[j]
        block = stat[1 + wi + wj:].reshape(wi, wj)
        ri, rj = slice(starts[i], starts[i] + wi), slice(starts[j], starts[j] + wj)
        gram[ri, rj] = block
        if i == j:
            total[ri] = stat[1:1 + wi]
        else:
            gram[rj, ri] = block.T
    mean = total / max(n, 1)
    return n, mean, gram - n * np.outer(mean, mean)


def feature_moments(rows: DataFrame, column: str, folds: list[str]) -> DataFrame:
    """(fold, stat): training count, sums and sums of squares of every feature."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = BlockSums(["model_fold"])
        for pdf in batches:
            if not len(pdf):
                continue
            data = stack(pdf[column])
            for key, mask in held_and_total(pdf):
                part = data[mask]
                sums.add((key,), np.concatenate([[len(part)], part.sum(axis=0), (part * part).sum(axis=0)]))
                if sums.full():
                    yield from sums.drain()
        yield from sums.drain()

    needed = [c for c in fold_columns(rows) if c != "test_of"]
    blocks = rows.select(column, *needed).coalesce(MAX_PARTIALS).mapInPandas(
        partial, "model_fold string, stat array<double>"
    )
    return sum_blocks(per_fold(sum_blocks(blocks, ["model_fold"]), folds, []), ["model_fold"])


def select_features(
    rows: DataFrame, column: str, folds: list[str], max_features: int | dict[str, int], min_mean: float | None,
    panel: list[int] | None,
) -> dict[str, np.ndarray]:
    """Most variable features of each fold's training rows: at most max_features indices per fold.

    A dict gives each variant its own limit.
    """

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        stat = np.asarray(pdf["stat"].iloc[0])
        n, width = stat[0], (len(stat) - 1) // 2
        mean = stat[1:1 + width] / n
        variance = np.maximum(stat[1 + width:] / n - mean * mean, 0.0)
        chosen = np.arange(width) if panel is None else np.asarray(sorted(set(panel)))
        keep = variance[chosen] > MIN_VARIANCE
        if min_mean is not None:
            keep &= mean[chosen] >= min_mean
        chosen = chosen[keep]
        most = max_features[scope_of(key[0])] if isinstance(max_features, dict) else max_features
        chosen = chosen[np.argsort(-variance[chosen], kind="stable")][:most]
        return pd.DataFrame({"model_fold": [key[0]], "chosen": [chosen.astype(np.int32)]})

    table = feature_moments(rows, column, folds).groupBy("model_fold").applyInPandas(
        choose, "model_fold string, chosen array<int>"
    )
    return {r["model_fold"]: np.asarray(r["chosen"], dtype=int) for r in table.collect()}


PCA_COLUMNS = [
    "model_fold", "component", "eigenvalue", "explained_ratio", "n_train", "n_selected", "loading", "mean",
]


def component_rows(fold: str, values, vectors, spread: float, n: int, selected: int, mean) -> pd.DataFrame:
    """Model rows with the largest loading of each component positive; the mean is stored once."""
    peaks = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    vectors = vectors * np.where(peaks < 0, -1.0, 1.0)
    out = []
    for c in range(vectors.shape[1]):
        value = max(float(values[c]), 0.0)
        out.append([
            fold, c + 1, value, value / spread if spread > 0 else 0.0, n, selected, vectors[:, c], mean if c == 0 else None,
        ])
    return pd.DataFrame(out, columns=PCA_COLUMNS)


def fit_pca(
    rows: DataFrame, column: str, folds: list[str], components: int,
    max_features: int | dict[str, int] | None = None, min_mean: float | None = None, panel: list[int] | None = None,
) -> DataFrame:
    """PCA per fold over training rows; loadings outside the selection are 0.

    With `max_features` the most variable features of each fold's training rows
    are used (mean and variance floors, ties by lower index). Up to
    MAX_GRAM_FEATURES columns the solve is exact from the feature Gram matrix;
    wider tables use the row Gram matrix while rows are few (exact), and block
    Krylov iteration to a tolerance beyond that; the results agree.
    """
    first = rows.select(F.size(column)).first()
    if first is None:
        raise ValueError("no rows to fit")
    width = first[0]
    chosen: dict[str, np.ndarray] = {}
    if max_features is not None or panel is not None:
        chosen = select_features(rows, column, folds, max_features or width, min_mean, panel)
    subset = np.unique(np.concatenate(list(chosen.values()))) if chosen else np.arange(width)
    spark = rows.sparkSession
    if len(subset) > limit(spark, GRAM_KEY, MAX_GRAM_FEATURES):
        if rows.count() <= limit(spark, DUAL_KEY, MAX_DUAL_ROWS):
            return dual_pca(rows, column, folds, components, chosen)
        return subspace_pca(rows, column, folds, components, chosen)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, cross = unpack_moments(pdf)
        own = np.searchsorted(subset, chosen[key[0]]) if chosen else np.arange(len(subset))
        if n < 3 or not len(own):
            raise ValueError(f"fold {key[0]}: {n} training rows, {len(own)} features")
        kept = min(components, n - 1, len(own))
        scaled = cross[np.ix_(own, own)] / (n - 1)
        values, vectors = np.linalg.eigh(scaled)
        values, vectors = values[::-1][:kept], vectors[:, ::-1][:, :kept]
        full = np.zeros((width, kept))
        full[subset[own]] = vectors
        centre = np.zeros(width)
        centre[subset] = mean
        return component_rows(key[0], values, full, np.trace(scaled), n, len(own), centre)

    blocks = moment_blocks(rows, column, folds, None if len(subset) == width else subset)
    return blocks.groupBy("model_fold").applyInPandas(solve, PCA_SCHEMA)


def fold_features(chosen: dict[str, np.ndarray], fold: str, width: int) -> np.ndarray:
    return chosen[fold] if chosen else np.arange(width)


def project_back(
    rows: DataFrame, column: str, folds: list[str], weights: dict[str, tuple], chosen: dict[str, np.ndarray], kind: str
) -> DataFrame:
    """Sum over training rows of row x weight: (fold, stat) with features x components.

    `weights[fold]` is either a row-keyed table ("rows": entity -> k numbers) or
    feature directions ("features": features x k) with the fold mean.
    """
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = BlockSums(["model_fold"])
        for pdf in batches:
            if not len(pdf):
                continue
            data = stack(pdf[column])
            for fold in folds:
                train = train_mask(pdf, fold)
                own = fold_features(chosen, fold, data.shape[1])
                mean, table = shared.value[fold]
                part = data[train][:, own] - mean[own]
                if kind == "rows":
                    k = len(next(iter(table.values())))
                    w = np.array([table[e] for e in pdf["entity"][train]]).reshape(-1, k)
                else:
                    w = part @ table
                sums.add((fold,), np.concatenate([(part.T @ w).ravel(), [np.sum(part * part)]]))
                if sums.full():
                    yield from sums.drain()
        yield from sums.drain()

    needed = [c for c in fold_columns(rows) if c != "test_of"]
    blocks = rows.select("entity", column, *needed).coalesce(MAX_PARTIALS).mapInPandas(
        partial, "model_fold string, stat array<double>"
    )
    return sum_blocks(blocks, ["model_fold"])


def fold_means(rows: DataFrame, column: str, folds: list[str]) -> dict[str, tuple[int, np.ndarray]]:
    """Training count and mean vector per fold (folds x features numbers)."""
    out = {}
    for r in feature_moments(rows, column, folds).collect():
        stat = np.asarray(r["stat"])
        width = (len(stat) - 1) // 2
        out[r["model_fold"]] = (int(round(stat[0])), stat[1:1 + width] / max(stat[0], 1.0))
    return out


def dual_pca(rows: DataFrame, column: str, folds: list[str], components: int, chosen: dict[str, np.ndarray]) -> DataFrame:
    """Exact PCA of few, very wide rows from the row Gram matrix.

    Feature blocks are spread over tasks (each holds every row's slice of one
    block); their n x n matrices are summed in two levels before a fold solve.
    """
    means = fold_means(rows, column, folds)
    width = len(next(iter(means.values()))[1])
    wanted = {f: np.isin(np.arange(width), fold_features(chosen, f, width)) for f in folds}
    needed = [c for c in fold_columns(rows) if c != "test_of"]
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit((width - 1) // DUAL_BLOCK)),
        lambda b: F.struct(b.alias("b"), F.slice(F.col(column), b * DUAL_BLOCK + 1, DUAL_BLOCK).alias("part")),
    )
    sliced = rows.select("entity", *needed, F.explode(pieces).alias("_s")).select("entity", *needed, "_s.b", "_s.part")
    listed = rows.select("entity", *needed).toPandas().sort_values("entity")
    names = {f: listed["entity"][train_mask(listed, f)].to_numpy() for f in folds}

    def gram(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("entity")
        start, data, out = key[0] * DUAL_BLOCK, stack(pdf["part"]), []
        for fold in folds:
            train = train_mask(pdf, fold)
            span = slice(start, start + data.shape[1])
            part = (data[train] - means[fold][1][span])[:, wanted[fold][span]]
            out.append([fold, (part @ part.T).ravel()])
        return pd.DataFrame(out, columns=["model_fold", "stat"])

    blocks = sliced.groupBy("b").applyInPandas(gram, "model_fold string, stat array<double>")

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(names[key[0]])
        k = np.asarray(pdf["stat"].iloc[0]).reshape(n, n)
        kept = min(components, n - 1)
        values, vectors = np.linalg.eigh(k)
        values, vectors = values[::-1][:kept], vectors[:, ::-1][:, :kept]
        # loadings = rows' x eigenvector / singular value
        scaled = vectors / np.sqrt(np.maximum(values, 1e-300))
        return pd.DataFrame([[key[0], scaled.ravel(), values, float(np.trace(k))]],
                            columns=["model_fold", "weights", "eigen", "trace"])

    solved = sum_blocks(blocks, ["model_fold"]).groupBy("model_fold").applyInPandas(
        solve, "model_fold string, weights array<double>, eigen array<double>, trace double"
    ).collect()
    weights, facts = {}, {}
    for r in solved:
        own = names[r["model_fold"]]
        table = np.asarray(r["weights"]).reshape(len(own), -1)
        weights[r["model_fold"]] = (means[r["model_fold"]][1], dict(zip(own, table, strict=True)))
        facts[r["model_fold"]] = (np.asarray(r["eigen"]), r["trace"])
    sums = project_back(rows, column, folds, weights, chosen, "rows")

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fold, (eigen, trace) = key[0], facts[key[0]]
        n, mean = means[fold]
        own = fold_features(chosen, fold, width)
        full = np.zeros((width, len(eigen)))
        full[own] = np.asarray(pdf["stat"].iloc[0])[:-1].reshape(len(own), len(eigen))
        return component_rows(fold, eigen / (n - 1), full, trace / (n - 1), n, len(own), mean)

    return sums.groupBy("model_fold").applyInPandas(finish, PCA_SCHEMA)


def fold_groups(sizes: dict[str, int], most: int) -> list[list[str]]:
    """Folds in name order, dealt into groups of at most `most` bytes (a larger fold is a group of its own)."""
    groups: list[list[str]] = []
    held = 0
    for fold, size in sorted(sizes.items()):
        if groups and held + size <= most:
            groups[-1].append(fold)
            held += size
        else:
            groups.append([fold])
            held = size
    return groups


@dataclass
class Krylov:
    """One fold's orthonormal basis, its images under the centred cross product, and the block to multiply next."""
    basis: np.ndarray
    images: np.ndarray
    block: np.ndarray

    @classmethod
    def of(cls, row: pd.Series) -> Krylov:
        parts = [np.asarray(row[c], dtype=np.float64) for c in ("basis", "images", "block")]
        return cls(*[p.reshape(row["width"], -1) for p in parts])

    def advance(self, image: np.ndarray, components: int, most: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, bool]:
        """Take in the block's image; returns leading values and vectors, and whether they are final.

        A basis of more than `most` columns is replaced by its leading Ritz
        vectors. What the basis lacks lies in the next block alone, so the
        iteration goes on from there as if nothing had been dropped.
        """
        self.basis, self.images = np.hstack([self.basis, self.block]), np.hstack([self.images, image])
        small = self.basis.T @ self.images
        values, mix = np.linalg.eigh((small + small.T) / 2)
        values, mix = values[::-1], mix[:, ::-1]
        floor = max(values[0], 1e-300)
        top, vectors = values[:components], self.basis @ mix[:, :components]
        left = np.linalg.norm(self.images @ mix[:, :components] - vectors * top, axis=0).max()
        rest = image - self.basis @ (self.basis.T @ image)
        rest -= self.basis @ (self.basis.T @ rest)
        u, size, _ = np.linalg.svd(rest, full_matrices=False)
        kept = self.block.shape[1]
        self.block = u[:, size > 1e-10 * floor]
        if self.basis.shape[1] + self.block.shape[1] > most:
            self.basis, self.images = self.basis @ mix[:, :kept], self.images @ mix[:, :kept]
        return top, vectors, bool(left <= tolerance * floor or not self.block.shape[1])


def subspace_pca(
    rows: DataFrame, column: str, folds: list[str], components: int, chosen: dict[str, np.ndarray],
    passes: int = 200, extra: int = 10, tolerance: float = 1e-9,
) -> DataFrame:
    """PCA of many very wide rows by restarted block Krylov iteration, to a tolerance.

    Each pass is one distributed job over the rows that multiplies one more
    block per fold. Bases are rows of a checkpointed table and advance in one
    task per fold, which holds features x (components + extra) x
    (2 RESTART_BLOCKS + 2) numbers; the driver sees blocks on their way to a
    broadcast only, a bounded group of folds at a time. A fold is done when
    every component's residual is below the tolerance, relative to the largest
    eigenvalue, or its basis spans all features; running out of passes is an
    error.
    """
    spark = rows.sparkSession
    means = fold_means(rows, column, folds)
    width = len(next(iter(means.values()))[1])
    most = limit(spark, BROADCAST_BYTES_KEY, DEFAULT_BROADCAST_BYTES)
    names = KRYLOV_SCHEMA.replace(",", "").split()[::2]

    def start(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        size = len(fold_features(chosen, key[0], width))
        k = min(components + extra, size)
        block = np.linalg.qr(np.random.default_rng(size).standard_normal((size, k)))[0]
        return pd.DataFrame([[key[0], size, k, [], [], block.ravel(), [], 0.0, False]], columns=names)

    def step(key: tuple, state: pd.DataFrame, image: pd.DataFrame) -> pd.DataFrame:
        row, stat = state.iloc[0], np.asarray(image["stat"].iloc[0])
        fold = Krylov.of(row)
        values, vectors, done = fold.advance(
            stat[:-1].reshape(fold.block.shape), components, RESTART_BLOCKS * row["held"], tolerance
        )
        arrays = [vectors, vectors[:, :0], vectors[:, :0]] if done else [fold.basis, fold.images, fold.block]
        return pd.DataFrame(
            [[key[0], row["width"], row["held"], *[a.ravel() for a in arrays], values, float(stat[-1]), done]], columns=names
        )

    def multiplied(state: DataFrame) -> DataFrame:
        sizes = {r["model_fold"]: 8 * r["n"] for r in state.select("model_fold", F.size("block").alias("n")).collect()}
        parts = []
        for group in fold_groups(sizes, most):
            own = state.where(F.col("model_fold").isin(*group)).select("model_fold", "width", "block").collect()
            held = {r["model_fold"]: (means[r["model_fold"]][1], np.asarray(r["block"]).reshape(r["width"], -1)) for r in own}
            parts.append(project_back(rows, column, group, held, chosen, "features"))
        return reduce(DataFrame.unionAll, parts)

    state = pinned(spark.createDataFrame([(f,) for f in folds], "model_fold string").groupBy("model_fold").applyInPandas(start, KRYLOV_SCHEMA))
    finished = []
    for _ in range(passes):
        active = state.where("not done")
        images = multiplied(active)
        state = pinned(active.groupBy("model_fold").cogroup(fresh(images).groupBy("model_fold")).applyInPandas(step, KRYLOV_SCHEMA))
        finished.append(state.where("done"))
        if state.where("not done").isEmpty():
            break
    else:
        late = [r["model_fold"] for r in state.where("not done").select("model_fold").collect()]
        raise RuntimeError(f"no convergence in {passes} passes: {sorted(late)}")

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row, (n, mean) = pdf.iloc[0], means[key[0]]
        vectors = np.asarray(row["basis"]).reshape(row["width"], -1)
        kept = min(components, n - 1, vectors.shape[1])
        own = fold_features(chosen, key[0], width)
        full = np.zeros((width, kept))
        full[own] = vectors[:, :kept]
        return component_rows(key[0], np.asarray(row["eigen"])[:kept] / (n - 1), full, row["trace"] / (n - 1), n, len(own), mean)

    return reduce(DataFrame.unionAll, finished).groupBy("model_fold").applyInPandas(finish, PCA_SCHEMA)


@dataclass
class Projection:
    mean: np.ndarray
    loadings: np.ndarray
    scale: np.ndarray

    def scores(self, data: np.ndarray, whiten: bool) -> np.ndarray:
        z = (data - self.mean) @ self.loadings
        return z / self.scale if whiten else z


def load_projection(pdf: pd.DataFrame) -> Projection:
    pdf = pdf.sort_values("component")
    scale = np.sqrt(np.maximum(pdf["eigenvalue"].to_numpy(dtype=float), 1e-300))
    return Projection(np.asarray(pdf["mean"].iloc[0], dtype=float), stack(pdf["loading"]).T, scale)


def apply_models(
    rows: DataFrame, models: DataFrame, doubles: F.Column | str, folds: list[str],
    load: Callable, apply: Callable, schema: str, columns: list[str], entity: str = "entity", whole: bool = False,
) -> DataFrame:
    """Run `apply({fold: model}, rows)` over all rows; with `whole`, on the iterator of a task's row batches.

    Folds are dealt into groups whose measured size is under the broadcast
    limit; each group is one pass over the rows, without a shuffle. Only a fold
    that is larger by itself makes the tables meet by (fold, salt): each group
    then sees one fold's model and a bounded share of the rows.
    """
    spark = rows.sparkSession
    most = limit(spark, BROADCAST_BYTES_KEY, DEFAULT_BROADCAST_BYTES)
    counted = models.groupBy("model_fold").agg(F.sum(F.size(doubles)).alias("n")).collect()
    sizes = {r["model_fold"]: 8 * (r["n"] or 0) for r in counted}
    if max(sizes.values(), default=0) <= most:
        def one_pass(group: list[str] | None) -> DataFrame:
            table = (models if group is None else models.where(F.col("model_fold").isin(*group))).toPandas()
            shared = spark.sparkContext.broadcast({f: load(g) for f, g in table.groupby("model_fold")})

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                if whole:
                    yield from apply(shared.value, batches)
                    return
                for pdf in batches:
                    if len(pdf):
                        yield from apply(shared.value, pdf)

            return rows.select(*columns).mapInPandas(run, schema)

        groups = fold_groups(sizes, most)
        return reduce(DataFrame.unionAll, [one_pass(g) for g in groups]) if len(groups) > 1 else one_pass(None)
    salts = max(1, rows.count() // 2000)
    spread = rows.select(
        *columns, F.explode(F.array(*[F.lit(f) for f in folds])).alias("model_fold"),
        F.pmod(F.xxhash64(entity), F.lit(salts)).alias("_salt"),
    )
    copies = models.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame()
        parts = list(apply({key[0]: load(right)}, iter([left]) if whole else left))
        return pd.concat(parts) if parts else pd.DataFrame()

    return spread.groupBy("model_fold", "_salt").cogroup(fresh(copies).groupBy("model_fold", "_salt")).applyInPandas(meet, schema)


def scores(rows: DataFrame, pca: DataFrame, column: str, folds: list[str], whiten: bool, out: str = "z") -> DataFrame:
    """(model_fold, entity, scores, role) of every row under every fold's PCA.

    Roles: train, test, or excluded (neither fitted nor evaluated in that fold).
    """

    def run(models: dict, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        data = stack(pdf[column])
        for fold, model in models.items():
            scope = in_scope(pdf, fold)
            if not scope.any():
                continue
            z = model.scores(data[scope], whiten)
            test, held = mask_of(pdf["test_of"], fold), mask_of(pdf["held_of"], fold)
            role = np.where(test, "test", np.where(held, "excluded", "train"))[scope]
            yield pd.DataFrame({"model_fold": fold, "entity": pdf["entity"][scope], "role": role, out: list(z)})

    kind = dict(rows.dtypes)["entity"]
    return apply_models(
        rows, pca, "loading", folds, load_projection, run,
        f"model_fold string, entity {kind}, role string, {out} array<double>",
        ["entity", column, *fold_columns(rows)],
    )


def design(model: Projection, pdf: pd.DataFrame, column: str, extra: str | None) -> np.ndarray:
    z = model.scores(stack(pdf[column]), True)
    return np.hstack([z, stack(pdf[extra])]) if extra else z


def ridge_moments(
    rows: DataFrame, pca: DataFrame, folds: list[str], column: str = "x", target: str = "y",
    extra: str | None = None, scaled: int = 0,
) -> DataFrame:
    """Sufficient statistics of multi-output ridge per (fold, target block).

    The design is the whitened scores followed by `extra` columns, of which the
    last `scaled` are standardised with training moments at solve time.
    """

    def run(models: dict, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = BlockSums(["model_fold", "target_block", "n_design", "n_scaled"])
        for pdf in batches:
            if not len(pdf):
                continue
            y = stack(pdf[target])
            for fold, model in models.items():
                train = train_mask(pdf, fold)
                if not train.any():
                    continue
                d = design(model, pdf[train], column, extra)
                yt = y[train]
                head = np.concatenate([[len(d)], d.sum(axis=0), (d.T @ d).ravel()])
                for b in range(0, y.shape[1], TARGET_BLOCK):
                    part = yt[:, b:b + TARGET_BLOCK]
                    stat = np.concatenate([head, part.sum(axis=0), (d.T @ part).ravel()])
                    sums.add((fold, b // TARGET_BLOCK, d.shape[1], scaled), stat)
                if sums.full():
                    yield from sums.drain()
        yield from sums.drain()

    needed = [c for c in fold_columns(rows) if c != "test_of"]
    columns = ["entity", column, target, *needed] + ([extra] if extra else [])
    blocks = apply_models(rows.coalesce(MAX_PARTIALS), pca, "loading", folds, load_projection, run, RIDGE_SCHEMA, columns, whole=True)
    return sum_blocks(blocks, ["model_fold", "target_block", "n_design", "n_scaled"])


@dataclass
class RidgeStats:
    n: int
    z_mean: np.ndarray
    zz: np.ndarray
    y_mean: np.ndarray
    zy: np.ndarray
    n_scaled: int

    def solve(self, columns: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """(coefficients per chosen column, their training means)."""
        sd = np.ones(len(columns))
        if self.n_scaled:
            first = len(self.z_mean) - self.n_scaled
            inside = columns >= first
            sd[inside] = np.sqrt(np.diag(self.zz)[columns[inside]] / self.n)
            columns, sd = columns[sd > MIN_SD], sd[sd > MIN_SD]
        a = self.zz[np.ix_(columns, columns)] / np.outer(sd, sd) + alpha * np.eye(len(columns))
        weights = np.linalg.solve(a, self.zy[columns] / sd[:, None]) / sd[:, None]
        full = np.zeros((len(self.z_mean), self.zy.shape[1]))
        full[columns] = weights
        return full, self.z_mean

    def mixing(self, z: np.ndarray, columns: np.ndarray, alpha: float) -> np.ndarray:
        """Rows w with prediction = y_mean + w @ zy, so a solve never touches the targets."""
        sd = np.ones(len(columns))
        if self.n_scaled:
            inside = columns >= len(self.z_mean) - self.n_scaled
            sd[inside] = np.sqrt(np.diag(self.zz)[columns[inside]] / self.n)
            columns, sd = columns[sd > MIN_SD], sd[sd > MIN_SD]
        a = self.zz[np.ix_(columns, columns)] / np.outer(sd, sd) + alpha * np.eye(len(columns))
        w = np.zeros((len(z), len(self.z_mean)))
        w[:, columns] = np.linalg.solve(a, ((z - self.z_mean)[:, columns] / sd).T).T / sd
        return w

    def predict(self, z: np.ndarray, columns: np.ndarray, alpha: float) -> np.ndarray:
        return self.y_mean + self.mixing(z, columns, alpha) @ self.zy


def load_ridge(pdf: pd.DataFrame) -> RidgeStats:
    pdf = pdf.sort_values("target_block")
    k, y_sums, cross = int(pdf["n_design"].iloc[0]), [], []
    for stat in pdf["stat"]:
        stat = np.asarray(stat)
        rest = stat[1 + k + k * k:]
        width = len(rest) // (k + 1)
        y_sums.append(rest[:width])
        cross.append(rest[width:].reshape(k, width))
    n = int(round(stat[0]))
    z_sum, zz = stat[1:1 + k], stat[1 + k:1 + k + k * k].reshape(k, k)
    y_sum, zy = np.concatenate(y_sums), np.hstack(cross)
    z_mean = z_sum / n
    return RidgeStats(
        n, z_mean, zz - n * np.outer(z_mean, z_mean), y_sum / n,
        zy - np.outer(z_sum, y_sum) / n, int(pdf["n_scaled"].iloc[0]),
    )


def ridge_coefficients(moments: DataFrame, grid: list[tuple[int, float]]) -> DataFrame:
    """(fold, dimension, alpha, component, target, value); component 0 is the intercept."""
    schema = "model_fold string, dimension int, alpha double, component int, target int, value double"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        stats = load_ridge(pdf)
        first, out = key[1] * TARGET_BLOCK, []
        for dimension, alpha in grid:
            columns = np.arange(min(dimension, len(stats.z_mean)))
            weights, mean = stats.solve(columns, alpha)
            table = np.vstack([stats.y_mean - mean @ weights, weights[: len(columns)]])
            c, t = np.indices(table.shape)
            out.append(pd.DataFrame({
                "model_fold": key[0], "dimension": dimension, "alpha": alpha,
                "component": c.ravel(), "target": t.ravel() + first, "value": table.ravel(),
            }))
        return pd.concat(out)

    return moments.groupBy("model_fold", "target_block").applyInPandas(run, schema)


@dataclass
class FoldModel:
    control: Projection
    ridge: RidgeStats
    response: Projection | None

    def low_rank(self, prediction: np.ndarray, rank: int) -> np.ndarray:
        v = self.response.loadings[:, :rank]
        return self.ridge.y_mean + ((prediction - self.ridge.y_mean) @ v) @ v.T


class SquaredErrors:
    """Errors of many settings from products computed once per row.

    With r = y - mean and prediction w @ zy the squared error is
    |r|^2 - 2 w.(zy r) + w (zy zy') w'; through a response space V it is the same
    with zy V and V'r. No setting needs a pass over the targets.
    """

    def __init__(self, model: FoldModel, observed: np.ndarray):
        ridge, residual = model.ridge, observed - model.ridge.y_mean
        self.targets = observed.shape[1]
        self.size = np.sum(residual * residual, axis=1)
        self.cross = residual @ ridge.zy.T
        self.gram = ridge.zy @ ridge.zy.T
        if model.response is not None:
            self.spanned = residual @ model.response.loadings
            self.mixed = ridge.zy @ model.response.loadings

    def rmse(self, w: np.ndarray, rank: int) -> np.ndarray:
        if rank:
            scores = w @ self.mixed[:, :rank]
            error = self.size - 2 * np.sum(scores * self.spanned[:, :rank], axis=1) + np.sum(scores * scores, axis=1)
        else:
            error = self.size - 2 * np.sum(w * self.cross, axis=1) + np.sum((w @ self.gram) * w, axis=1)
        return np.sqrt(np.maximum(error, 0.0) / self.targets)


def fold_models(pca: DataFrame, moments: DataFrame, response: DataFrame | None = None) -> DataFrame:
    """All parts of the fitted fold models in one tall table (`part` tells them apart)."""
    def part(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            "model_fold", F.lit(name).alias("part"), "component", "eigenvalue", "loading", "mean",
            F.lit(None).cast("int").alias("target_block"), F.lit(None).cast("int").alias("n_design"),
            F.lit(None).cast("int").alias("n_scaled"), F.lit(None).cast("array<double>").alias("stat"),
        )

    table = part(pca, "control").unionByName(
        moments.withColumn("part", F.lit("ridge")), allowMissingColumns=True
    )
    return table if response is None else table.unionByName(part(response, "response"))


def load_fold_model(pdf: pd.DataFrame) -> FoldModel:
    pieces = dict(list(pdf.groupby("part")))
    response = load_projection(pieces["response"]) if "response" in pieces else None
    return FoldModel(load_projection(pieces["control"]), load_ridge(pieces["ridge"]), response)


def model_size() -> F.Column:
    return F.concat(F.coalesce("loading", F.array()), F.coalesce("mean", F.array()), F.coalesce("stat", F.array()))


@dataclass(frozen=True)
class Setting:
    """One point of a grid: which score columns, which extras, penalty, response rank (0 = full)."""
    name: str
    dimension: int
    alpha: float
    rank: int = 0
    extras: tuple[int, ...] = ()


def fold_predictions(
    rows: DataFrame, models: DataFrame, settings: list[Setting], folds: list[str], components: int,
    column: str = "x", target: str = "y", extra: str | None = None, losses: bool = False,
) -> DataFrame:
    """Predictions (or per-entity RMSE) of every setting for each fold's test rows."""
    kind = dict(rows.dtypes)["entity"]
    head = f"model_fold string, entity {kind}, setting string, dimension int, rank int, alpha double"
    schema = head + (", rmse double" if losses else ", predicted array<double>")

    def run(models_by_fold: dict, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for fold, model in models_by_fold.items():
            test = mask_of(pdf["test_of"], fold) & in_scope(pdf, fold)
            if not test.any():
                continue
            part = pdf[test]
            z = design(model.control, part, column, extra)
            width = model.control.loadings.shape[1]
            error = SquaredErrors(model, stack(part[target])) if losses else None
            for s in settings:
                if s.dimension > width or (s.rank and s.rank > model.response.loadings.shape[1]):
                    continue
                columns = np.array([*range(s.dimension), *[width + e for e in s.extras]], dtype=int)
                out = {
                    "model_fold": fold, "entity": part["entity"], "setting": s.name,
                    "dimension": s.dimension, "rank": s.rank, "alpha": s.alpha,
                }
                if losses:
                    out["rmse"] = error.rmse(model.ridge.mixing(z, columns, s.alpha), s.rank)
                else:
                    predicted = model.ridge.predict(z, columns, s.alpha)
                    out["predicted"] = list(model.low_rank(predicted, s.rank) if s.rank else predicted)
                yield pd.DataFrame(out)

    needed = [c for c in fold_columns(rows) if c != "held_of"]
    columns = ["entity", column, *needed] + ([target] if losses else []) + ([extra] if extra else [])
    return apply_models(rows, models, model_size(), folds, load_fold_model, run, schema, columns)


def tall_loadings(pca: DataFrame) -> DataFrame:
    """(fold, component, feature, loading); features are 0-based positions."""
    return pca.select("model_fold", "component", F.posexplode("loading").alias("feature", "loading"))


def subspace_overlap(pca: DataFrame, rank: int, folds: list[str]) -> DataFrame:
    """Squared cosines between the leading subspaces of each pair of folds a < b.

    The later fold's rows are copied to the earlier fold names and met by key.
    """
    top = pca.where(F.col("component") <= rank).select("model_fold", "component", "loading")
    left = top.select(F.col("model_fold").alias("fold_a"), F.col("component").alias("ca"), F.col("loading").alias("la"))
    earlier = F.filter(F.array(*[F.lit(f) for f in folds]), lambda f: f < F.col("model_fold"))
    right = top.select(
        F.explode(earlier).alias("fold_a"), F.col("model_fold").alias("fold_b"), F.col("component").alias("cb"), F.col("loading").alias("lb")
    )
    schema = "fold_a string, fold_b string, mean_squared_cosine double, min_squared_cosine double, max_squared_cosine double"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = stack(pdf.drop_duplicates("ca").sort_values("ca")["la"])
        b = stack(pdf.drop_duplicates("cb").sort_values("cb")["lb"])
        s = np.linalg.svd(a @ b.T, compute_uv=False) ** 2
        return pd.DataFrame([[*key, s.mean(), s.min(), s.max()]], columns=[
            "fold_a", "fold_b", "mean_squared_cosine", "min_squared_cosine", "max_squared_cosine",
        ])

    return left.join(right, "fold_a").groupBy("fold_a", "fold_b").applyInPandas(run, schema)
