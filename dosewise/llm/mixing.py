"""Mixing sources to target weights by blocks.

The words of a source form one stream in an order drawn from its documents' identifiers, cut into blocks of a fixed
number of words. The mix has one slot for each block's worth of words. Every output shard draws a multinomial count for
each source from what is left of the sources' quotas, so the quotas come out exactly and no block is used more often
than its source's cap. Slot k of a source stands for block k mod n under a pseudorandom permutation of the n blocks, a
new one for each pass, and blocks join slots by (source, index).

Only one row per source, or per source and shard, is ever handled in one task; documents, blocks and slots are spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosewise.llm.common import WORD, checked, filed, locator, words
from dosewise.session import pinned

BLOCK_WORDS = 64
WEIGHTS = (1, 2, 3)
MOST = 3  # times its size that a source, and so a document, is taken at most
SHARDS = 64
SEED = 11
# Buckets into which the stream of a source is cut for its running totals.
BUCKETS = 4096
# Slots made from one row.
CHUNK = 65_536


def _name(source: str | Column) -> Column:
    """Null sources as a name of their own that sorts last: (is null, name)."""
    c = F.col(source) if isinstance(source, str) else source
    return F.struct(c.isNull().alias("none"), F.coalesce(c, F.lit("")).alias("name"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(src, source_size, target) from one (src, size) row per document.

    Sources in code point order, null last, take the weights in turn and share all words; a target stops at `most`
    times its source's size and the excess goes to the others by weight. The stopped sources are the first ones in the
    order of most x size / weight, so running totals over the source table find the level at which the rest share.
    """
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy("src")) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("top", F.col("source_size") * float(most))
    by = Window.orderBy(F.col("top") / F.col("weight"), "src")
    upto, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("top").over(upto), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source whose share stays below its stop sets the level for itself and all after it
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("top"), F.struct((F.col("top") / F.col("weight")).alias("at"), "src", "level"))).over(Window.partitionBy())
    shared = F.least(level["level"] * F.col("weight"), F.col("top"))
    return per.select("src", "source_size", F.coalesce(shared, F.col("top")).alias("target"))


def streams(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, at, src, size, start): each row's place in the word stream of its source.

    The order is by a hash of the id and the locator. Running totals are taken inside hash buckets and carried over the
    buckets, so a source that holds most rows is summed by many tasks.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), locator().alias("at"), _name(source_col).alias("src"), words(F.col(text_col)).alias("size"),
    ).withColumn("turn", F.xxhash64(F.lit(SEED), "doc_id"))
    rows = pinned(rows.withColumn("bucket", F.pmod("turn", F.lit(BUCKETS))))
    whole = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("src", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("carry"))
    inside = Window.partitionBy("src", "bucket").orderBy("turn", "doc_id", "at", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(carried, ["src", "bucket"])
    return placed.select("doc_id", "at", "src", "size", (F.col("carry") + F.col("own")).alias("start"))


def draw(quotas: pd.DataFrame, shards: int, seed: int) -> pd.DataFrame:
    """(src, blocks, shard, first, n): multinomial counts of each output shard, drawn from what is left of the quotas."""
    quotas = quotas.sort_values(["none", "name"]).reset_index(drop=True)
    left = quotas["quota"].to_numpy(np.int64).copy()
    total, given, out = int(left.sum()), np.zeros(len(left), np.int64), []
    for shard in range(shards):
        slots = (shard + 1) * total // shards - shard * total // shards
        if not slots:
            continue
        rng = np.random.default_rng([seed, shard])
        counts = np.minimum(rng.multinomial(slots, left / left.sum()), left)
        for i in np.argsort(-(left - counts), kind="stable"):  # what a source had no blocks left for goes to the fullest
            more = min(slots - int(counts.sum()), int(left[i] - counts[i]))
            if more <= 0:
                break
            counts[i] += more
        drawn = quotas.assign(shard=shard, first=given, n=counts)
        out.append(drawn[counts > 0])
        left -= counts
        given = given + counts
    columns = ["none", "name", "blocks", "shard", "first", "n"]
    return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each index under a pseudorandom permutation of 0 .. size - 1 chosen by key.

    A four-round Feistel network over the next even power of two; a result outside the range goes through again.
    """
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2))) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(1, 5):
            mixed = (right + k + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def slots(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(src, pass, index, shard, slot) of every slot of the mix, from (src, blocks, quota) rows, one per source."""

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if rows:
            yield draw(pd.concat(rows), shards, seed)

    flat = quotas.select("src.none", "src.name", "blocks", "quota").coalesce(1)
    counts = flat.mapInPandas(drawn, "none boolean, name string, blocks long, shard int, first long, n long")
    counts = pinned(counts.select(F.struct("none", "name").alias("src"), "blocks", "shard", "first", "n"))
    steps = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))
    chunks = counts.withColumn("from", F.explode(steps)).repartition("src", "shard", "from")
    upto = F.least(F.col("from") + CHUNK, F.col("n")) - 1
    each = chunks.select("src", "blocks", "shard", F.explode(F.sequence(F.col("first") + F.col("from"), F.col("first") + upto)).alias("slot"))
    each = each.withColumn("pass", F.expr("slot div blocks").cast("int"))

    @F.pandas_udf("long")
    def place(slot: pd.Series, blocks: pd.Series, key: pd.Series) -> pd.Series:
        n = blocks.to_numpy(np.int64)
        return pd.Series(permuted(slot.to_numpy(np.int64) % n, n, key.to_numpy(np.int64).view(np.uint64)))

    return each.withColumn("index", place("slot", "blocks", F.xxhash64(F.lit(seed), "src", "pass"))).select("src", "pass", "index", "shard", "slot")


class Mix:
    """One mix of a table: `rows` (one per document), `taken` (one per document piece that a slot holds)."""

    def __init__(
        self, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, shards: int = SHARDS,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    ) -> None:
        """Rows with null or wordless text have size 0 and are never taken; a null source is a source of its own.

        Repeated rows are documents of their own. Other columns are ignored, whatever their names. An empty table
        gives an empty mix. Every source's taken words are within one block of its target, apart from the shorter
        last block of a stream.
        """
        docs = filed(docs)
        self.docs, self.text_col = docs, text_col
        placed = pinned(streams(docs, id_col, text_col, source_col))
        goals = pinned(targets(placed, weights, most))
        self.rows = placed.join(checked(goals), "src")
        blocks = F.ceil(F.col("source_size") / block_words)
        quota = F.least(F.round(blocks * F.col("target") / F.col("source_size")), blocks * most)
        quotas = goals.where("source_size > 0").select("src", blocks.cast("long").alias("blocks"), quota.cast("long").alias("quota"))
        first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
        pieces = placed.where("size > 0").withColumn("index", F.explode(F.sequence(first, last)))
        begin = F.greatest(F.col("index") * block_words, F.col("start"))
        end = F.least((F.col("index") + 1) * block_words, F.col("start") + F.col("size"))
        pieces = pieces.select("doc_id", "at", "src", "start", "size", "index", (begin - F.col("start")).alias("word"), (end - begin).alias("n"))
        # a shuffle in any case: slots come from few rows, by which their size would be taken for small
        self.taken = pieces.join(slots(quotas, shards).hint("merge"), ["src", "index"])

    def counts(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) of every document."""
        sums = self.taken.groupBy("src", "start").agg(F.sum("n").alias("n"))
        held = F.col("size") > 0  # only rows with words have a place of their own in the stream
        own = self.rows.withColumn("key", F.when(held, F.col("start")))
        found = own.join(sums.withColumnRenamed("start", "key"), ["src", "key"], "left")
        return found.select("doc_id", "size", "source_size", "target", F.coalesce("n", F.lit(0)).alias("taken"))

    def documents(self) -> DataFrame:
        """The mix as documents with the columns of the table: for each pass, the words of a document that it takes.

        A document taken whole keeps its text as it is; of others the taken words are joined by one space. n_chars is
        counted anew where there is such a column.
        """
        whole = self.taken.groupBy("at", "src", "start", "size", "pass").agg(
            F.sum("n").alias("_mix_taken"), F.sort_array(F.collect_list(F.struct("word", "n"))).alias("_mix_spans"))
        whole = whole.select(F.col("at").alias("_mix_key"), "_mix_taken", "_mix_spans", F.col("size").alias("_mix_size"), F.col("pass").alias("_mix_pass"))
        docs = self.docs.withColumn("_mix_at", locator())
        held = docs.join(whole, F.col("_mix_at") == F.col("_mix_key"))
        split = F.regexp_extract_all(F.col(self.text_col), F.lit(f"({WORD})"), F.lit(1))
        cut = F.array_join(F.flatten(F.transform("_mix_spans", lambda s: F.slice(split, (s["word"] + 1).cast("int"), s["n"].cast("int")))), " ")
        text = F.when(F.col("_mix_taken") == F.col("_mix_size"), F.col(self.text_col)).otherwise(cut)
        held = held.withColumn(self.text_col, text)
        if "n_chars" in self.docs.columns:
            held = held.withColumn("n_chars", F.char_length(self.text_col).cast(dict(self.docs.dtypes)["n_chars"]))
        return held.select(*self.docs.columns)
