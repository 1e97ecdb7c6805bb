"""Compression classifier: how much better a good-text dictionary compresses a text than a bad-text one.

Two zstandard dictionaries are trained on a bounded sample of labelled texts of either class. A text is compressed whole
with each; the difference of the two sizes, normalised by their sum, and both sizes per byte become a probability by
logistic regression on labelled texts that no dictionary has seen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample and of the dictionaries."""

    per_class: int = 2_500  # labelled rows of a class that are read, in the order of a hash of the id
    longest: int = 32_768  # characters of the longest text used for fitting; scoring takes any length
    for_dictionary: int = 1_000  # of those, at most half, train the dictionary; the rest calibrate
    dictionary_bytes: int = 112_640
    level: int = 3
    penalty: float = 1.0


@dataclass
class Model:
    good: bytes
    bad: bytes
    level: int
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    _ready: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_ready": []}

    def _compressors(self) -> list:
        if not self._ready:
            for content in (self.good, self.bad):
                dictionary = zstandard.ZstdCompressionDict(content)
                dictionary.precompute_compress(level=self.level)
                compressor = zstandard.ZstdCompressor(
                    level=self.level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)
                self._ready.append((compressor, len(compressor.compress(b""))))
        return self._ready

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Normalised size difference, both sizes per byte, log length; squares and products. Texts are read whole."""
        (good, good_frame), (bad, bad_frame) = self._compressors()
        rows = np.zeros((len(texts), 3))
        for i, text in enumerate(texts):
            data = (text or "").encode("utf-8", "surrogatepass")
            rows[i] = len(good.compress(data)) - good_frame, len(bad.compress(data)) - bad_frame, len(data)
        g, b, n = rows.T
        base = np.column_stack([(g - b) / np.maximum(g + b, 1), np.minimum(g / np.maximum(n, 1), 2), np.minimum(b / np.maximum(n, 1), 2), np.log1p(n)])
        pairs = [base[:, i] * base[:, j] for i in range(4) for j in range(i, 4)]
        return np.column_stack([base, *pairs])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        scaled = (self.features(texts) - self.mean) / self.deviation
        return 1 / (1 + np.exp(-np.clip(scaled @ self.weights[:-1] + self.weights[-1], -40, 40)))


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """Trained dictionary; the plain texts themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, texts, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:] or b"\n" * 8


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, penalty: float) -> np.ndarray:
    """Weights and intercept by Newton steps, each halved until the loss falls; `share` weighs the rows."""
    a = np.column_stack([x, np.ones(len(x))])
    ridge = np.r_[np.full(x.shape[1], penalty), 1e-6]

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(share @ (np.logaddexp(0, z) - y * z) + ridge @ (w * w) / 2)

    w = np.zeros(a.shape[1])
    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        hessian = (a * (share * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(hessian, a.T @ (share * (p - y)) + ridge * w)
        size = 1.0
        while size > 1e-10 and loss(w - size * step) >= now:
            size /= 2
        if size <= 1e-10:
            break
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, now):
            break
    return w


def fit_rows(good: list[str], bad: list[str], n_good: int, n_bad: int, settings: Settings = Settings()) -> Model:
    """Model from sampled texts; n_good and n_bad are the classes' sizes in all labelled rows, for calibration."""
    samples = {1: [t or "" for t in good], 0: [t or "" for t in bad]}
    # as many texts for either dictionary, so that neither knows more of what both classes share
    both = min((len(v) + 1) // 2 for v in samples.values())
    cut = {k: min(settings.for_dictionary, both or (len(v) + 1) // 2) for k, v in samples.items()}
    contents = {k: _dictionary([t.encode("utf-8", "surrogatepass") for t in v[: cut[k]]], settings.dictionary_bytes) for k, v in samples.items()}
    model = Model(contents[1], contents[0], settings.level, np.zeros(14), np.ones(14), np.zeros(15))
    rest = {k: v[cut[k]:] for k, v in samples.items()}
    texts = rest[1] + rest[0]
    if not texts:  # nothing to calibrate on: the share of good rows, or one half
        share = (n_good + 1) / (n_good + n_bad + 2)
        model.weights[-1] = np.log(share / (1 - share))
        return model
    x = model.features(texts)
    y = np.r_[np.ones(len(rest[1])), np.zeros(len(rest[0]))]
    share = np.r_[np.full(len(rest[1]), n_good / max(1, len(rest[1]))), np.full(len(rest[0]), n_bad / max(1, len(rest[0])))]
    model.mean, model.deviation = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    model.weights = _logistic((x - model.mean) / model.deviation, y, share * len(y) / share.sum(), settings.penalty)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 4, is 2. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out.

    Labels with a null id or quality are left out; an id labelled more than once has its mean label, one half counting
    as good. Only ids (at most 2 x per_class) are broadcast and only their texts reach the driver.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    sizes = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    turn = F.md5(F.col("doc_id").cast("string"))
    chosen = [known.where(F.col("good") == g).withColumn("turn", turn).orderBy("turn", "doc_id").limit(settings.per_class) for g in (1, 0)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("labelled_id"), "good", "turn"))
    texts = docs.select("doc_id", "text").where(F.char_length("text") <= settings.longest)
    rows = texts.join(sample, F.col("doc_id") == F.col("labelled_id")).groupBy("labelled_id", "good", "turn").agg(F.min("text").alias("text"))
    read = sorted(rows.collect(), key=lambda r: (r["turn"], r["labelled_id"]))
    good, bad = ([r["text"] for r in read if r["good"] == g] for g in (1, 0))
    return fit_rows(good, bad, sizes.get(1, 0), sizes.get(0, 0), settings)


def score(text: Column, model: Model) -> Column:
    """Probability that the text is good; null counts as empty."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()), dtype="float64")

    return of(text)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows scored at least `threshold`, all columns as they are."""
    return docs.where(score(F.col("text"), model) >= threshold)

