"""Seeded sampling, split halves, bootstrap and permutation inference.

Every draw is an md5 of (seed, replicate, position), so a replicate can be
recomputed on any executor. Resampling is B x n rows keyed by (test, replicate);
positions spread hot tests over all tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosewise.functions import scalar as S
from dosewise.functions.draws import draw_below, order_hash, order_number
from dosewise.operators import ranking
from dosewise.operators import replicates as replicate
from dosewise.session import DEFAULT_WINDOW_ROWS, WINDOW_ROWS_KEY, limit, pinned

# Default replicates and interval bounds.
BOOTSTRAPS = 2000
PERMUTATIONS = 10_000
LOW, HIGH = 0.025, 0.975
MIN_PAIRS = 5
# Replicated rows per task.
ROWS_PER_TASK = 2_000_000
# Counted rows up to which base values are broadcast to the draws.
BROADCAST_ROWS = 500_000
# Decimals kept when a permuted statistic is compared with the observed one.
TIE_DIGITS = 9
# Groups up to this size are resampled inside one row; larger ones by joined rows. The draws are the same.
PACKED_ROWS = 1_000
PACKED_ROWS_KEY = "spark.dosewise.packedRows"
# Groups up to this size are held by one task, a few numbers of 8 bytes a row, and their replicates are computed there in
# blocks; only of larger ones a row is shuffled for each draw.
RANKED_ROWS = 8_000_000
RANKED_ROWS_KEY = "spark.dosewise.rankedRows"


def replicates(df: DataFrame, n: int, out: str = "rep") -> DataFrame:
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def sample_cells(cells: DataFrame, keys: list[str], cell: list[str], n: int, seed: int | str, repeats: int) -> DataFrame:
    """n cells per key and repeat without replacement; a key with fewer cells is an error."""
    rows, least, largest = cells.groupBy(*keys).count().agg(F.sum("count"), F.min("count"), F.max("count")).first()
    if rows and least < n:
        raise ValueError(f"some groups have fewer than {n} cells")
    repeated = _repeated(cells, keys, repeats, rows or 0, largest or 0).withColumn("_h", order_hash(seed, "repeat", *cell))
    return ranking.top_rows(
        repeated, ["repeat", *keys], [F.asc("_h"), *[F.asc(c) for c in cell]], n
    ).drop("_h", "rn")


def _repeated(cells: DataFrame, keys: list[str], repeats: int, rows: int, largest: int) -> DataFrame:
    """Every row once per repeat; dealt by key before, so that rows and not their repeats are shuffled.

    A key whose repeats don't fit one window stays where it is, and its repeats are shuffled by themselves.
    """
    spark = cells.sparkSession
    if largest * repeats <= limit(spark, WINDOW_ROWS_KEY, DEFAULT_WINDOW_ROWS):
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * repeats / ROWS_PER_TASK))
        cells = cells.repartition(parts, *keys)
    return replicates(cells, repeats, "repeat")


def undersized(cells: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Keys that cannot supply n cells; must be empty before sampling."""
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells")).where(F.col("n_cells") < n)


def split_halves(cells: DataFrame, keys: list[str], cell: list[str], seed: int | str, repeats: int) -> DataFrame:
    """Two random halves of equal size per key and repeat; an odd cell is dropped."""
    rows, largest = cells.groupBy(*keys).count().agg(F.sum("count"), F.max("count")).first()
    rows, largest = rows or 0, largest or 0
    ranked = ranking.hash_rank(
        _repeated(cells, keys, repeats, rows, largest), ["repeat", *keys], order_hash(seed, "repeat", *cell), cell, "rn", "_n",
        largest=largest,
    )
    half = F.floor(F.col("_n") / 2)
    return (
        ranked.withColumn("half", F.when(F.col("rn") <= half, "a").when(F.col("rn") <= 2 * half, "b"))
        .where(F.col("half").isNotNull()).drop("rn", "_n")
    )


def extent(base: DataFrame) -> tuple[int, int]:
    """(rows, largest group) of a positioned table; one cheap pass over a checkpoint."""
    row = base.agg(F.count(F.lit(1)), F.max("n")).first()
    return row[0] or 0, row[1] or 0


def spread(base: DataFrame, keys: list[str], copies: int, rows: int) -> DataFrame:
    """Partition by position so that `copies` replicates of every row fill all cores."""
    cores = base.sparkSession.sparkContext.defaultParallelism
    return base.repartition(max(cores, math.ceil(rows * copies / ROWS_PER_TASK)), *keys, "pos")


def lookup(base: DataFrame, rows: int) -> DataFrame:
    """Base values as a join side: broadcast only when the counted rows are few."""
    return F.broadcast(base) if rows <= BROADCAST_ROWS else base


def positioned(
    df: DataFrame, keys: list[str], ids: list[str], seed: int | str, largest: int | None = None
) -> DataFrame:
    """Rows with a position 1..n per key in a reproducible random order, checkpointed."""
    return pinned(ranking.hash_rank(df, keys, order_hash(seed, *ids), ids, "pos", "n", largest=largest))


def bootstrap_rows(
    base: DataFrame, keys: list[str], values: list[str], count: int, seed: int | str, rows: int
) -> DataFrame:
    """count replicates of n draws with replacement; one row per draw."""
    drawn = replicates(spread(base.select(*keys, "pos", "n"), keys, count, rows), count).select(
        *keys, "rep", (draw_below(F.col("n"), seed, "rep", "pos") + 1).alias("pos")
    )
    return ranking.join_null_safe(drawn, lookup(base.select(*keys, "pos", *values), rows), [*keys, "pos"])


def packed(base: DataFrame, keys: list[str], values: list[str], copies: int) -> DataFrame:
    """One row per key and replicate with the values as arrays in order of position, dealt over the cores.

    For groups under PACKED_ROWS: a replicate is then computed inside its row, without a shuffle or a window.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", *values)))
    arrays = base.groupBy(*keys).agg(ordered.alias("_rows")).select(
        *keys, F.size("_rows").alias("n"), *[F.col("_rows").getField(c).alias(c) for c in values])
    cores = base.sparkSession.sparkContext.defaultParallelism
    step = math.ceil(copies / cores)
    dealt = arrays.withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(copies - 1), F.lit(step)))).repartition(cores, *keys, "_from")
    return dealt.withColumn("rep", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + step, F.lit(copies)) - 1))).drop("_from")


def drawn_mean(value: str, seed: int | str) -> Column:
    """Mean of n draws with replacement from the array `value`; the draws of `bootstrap_rows`."""
    each = lambda total, pos: total + F.element_at(value, (draw_below(F.col("n"), seed, "rep", pos) + 1).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), each) / F.col("n")


def interval(replicated: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Percentile interval over the replicates of each key (a fixed number of rows)."""
    return replicated.groupBy(*keys).agg(
        F.percentile(value, F.lit(LOW)).alias("ci_low"), F.percentile(value, F.lit(HIGH)).alias("ci_high")
    )


def bootstrap_mean(
    df: DataFrame, keys: list[str], value: str, ids: list[str], seed: int | str, count: int = BOOTSTRAPS
) -> DataFrame:
    """Mean with a percentile bootstrap interval per key; undefined values are left out."""
    base = positioned(df.where(S.is_finite(value)).select(*keys, *ids, value), keys, ids, seed)
    rows, largest = extent(base)
    if largest <= limit(base.sparkSession, PACKED_ROWS_KEY, PACKED_ROWS):
        as_double = base.withColumn(value, F.col(value).cast("double"))
        means = packed(as_double, keys, [value], count).select(*keys, "rep", drawn_mean(value, seed).alias("_m"))
    elif _fits(base, largest):
        means = replicate.statistics(base.select(*keys, "pos", F.col(value).cast("double").alias("v")), keys, ["v"], replicate.drawn_mean, count, seed, "_m", rows)
    else:
        means = bootstrap_rows(base, keys, [value], count, seed, rows).groupBy(*keys, "rep").agg(F.avg(value).alias("_m"))
    centre = base.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return ranking.join_null_safe(centre, interval(means, keys, "_m"), keys)


def paired_difference(
    df: DataFrame, keys: list[str], left: str, right: str, ids: list[str], seed: int | str, count: int = BOOTSTRAPS
) -> DataFrame:
    gains = df.withColumn("gain", F.col(left) - F.col(right))
    return bootstrap_mean(gains, keys, "gain", ids, seed, count)


def p_value(hits: Column, count: int) -> Column:
    return (hits + 1.0) / (count + 1.0)


def permuted(
    base: DataFrame, keys: list[str], keep: list[str], count: int, seed: int | str, rows: int, largest: int
) -> DataFrame:
    """count random orders: each row gets its place `rn` in every replicate."""
    copies = replicates(spread(base.select(*keys, "pos", "n", *keep), keys, count, rows), count)
    if largest <= limit(base.sparkSession, WINDOW_ROWS_KEY, DEFAULT_WINDOW_ROWS):
        shuffled = copies.withColumn("_h", order_number(seed, "rep", "pos"))
        place = Window.partitionBy(*keys, "rep").orderBy("_h", "pos")
        return shuffled.withColumn("rn", F.row_number().over(place).cast("bigint")).drop("_h")
    return ranking.hash_rank(copies, [*keys, "rep"], order_hash(seed, "rep", "pos"), ["pos"], "rn", largest=largest)


def _fits(base: DataFrame, largest: int) -> bool:
    """Whether every test's values may be packed into one row."""
    return largest <= limit(base.sparkSession, RANKED_ROWS_KEY, RANKED_ROWS)


def _products(base: DataFrame, keys: list[str], a: str, b: str, count: int, seed: int | str, total: int) -> DataFrame:
    """(keys, rep, _sp): sums of products of the permuted column a with b."""
    pairs = base.select(*keys, "pos", F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    return replicate.statistics(pairs, keys, ["a", "b"], replicate.permuted_product, count, f"{seed}p", "_sp", total)


def spearman_inference(
    df: DataFrame, keys: list[str], x: str, y: str, ids: list[str], seed: int | str,
    bootstraps: int = BOOTSTRAPS, permutations: int = PERMUTATIONS,
) -> DataFrame:
    """Spearman effect, bootstrap interval (pairs re-ranked) and permutation p.

    Rank products are multiples of 1/4 and sum exactly, so the permutation
    count does not depend on summation order.
    """
    rows = df.where(S.is_finite(x, y)).select(*keys, *ids, x, y)
    most = ranking.largest_group(rows, keys)
    ranked = ranking.average_rank(ranking.average_rank(rows, keys, x, "rx", most), keys, y, "ry", most)
    base = positioned(ranked, keys, ids, seed, most)
    total, largest = extent(base)
    observed = base.groupBy(*keys).agg(
        S.pearson("rx", "ry").alias("effect"), F.count(F.lit(1)).alias("n"), F.sum(F.col("rx") * F.col("ry")).alias("_s")
    )
    if _fits(base, largest):
        pairs = base.select(*keys, "pos", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        drawn = replicate.statistics(pairs, keys, ["x", "y"], replicate.spearman, bootstraps, seed, "_r", total)
        sums = _products(base, keys, "rx", "ry", permutations, seed, total)
    else:
        draws = bootstrap_rows(base, keys, [x, y], bootstraps, seed, total)
        rkeys = [*keys, "rep"]
        reranked = ranking.average_rank(ranking.average_rank(draws, rkeys, x, "bx", largest), rkeys, y, "by", largest)
        drawn = reranked.groupBy(*rkeys).agg(S.pearson("bx", "by").alias("_r"))
        shuffled = permuted(base, keys, ["rx"], permutations, f"{seed}p", total, largest)
        partner = lookup(base.select(*keys, F.col("pos").alias("rn"), "ry"), total)
        sums = shuffled.join(partner, [*keys, "rn"]).groupBy(*keys, "rep").agg(F.sum(F.col("rx") * F.col("ry")).alias("_sp"))
    spread = interval(drawn, keys, "_r")
    centre = F.col("n") * (F.col("n") + 1) * (F.col("n") + 1) / 4.0
    hits = (
        sums.join(observed, keys)
        .groupBy(*keys)
        .agg(F.count_if(F.abs(F.col("_sp") - centre) >= F.abs(F.col("_s") - centre)).alias("_hits"))
    )
    enough = (F.col("n") >= MIN_PAIRS) & F.col("effect").isNotNull()
    return observed.join(spread, keys, "left").join(hits, keys, "left").select(
        *keys, F.when(enough, F.col("effect")).alias("effect"),
        F.when(enough, F.col("ci_low")).alias("ci_low"), F.when(enough, F.col("ci_high")).alias("ci_high"),
        F.when(enough, p_value(F.col("_hits"), permutations)).alias("p_value"), "n",
    )


def partial_correlation(xy: Column, xz: Column, yz: Column) -> Column:
    return F.try_divide(xy - xz * yz, F.sqrt(F.greatest((1 - xz * xz) * (1 - yz * yz), F.lit(0.0))))


def partial_spearman_inference(
    df: DataFrame, keys: list[str], x: str, y: str, covariate: str, ids: list[str], seed: int | str,
    bootstraps: int = BOOTSTRAPS, permutations: int = PERMUTATIONS,
) -> DataFrame:
    """Spearman of x and y after removing the ranked covariate; p permutes the residuals of y."""
    rows = df.where(S.is_finite(x, y, covariate)).select(*keys, *ids, x, y, covariate)
    most = ranking.largest_group(rows, keys)
    for source, name in ((x, "rx"), (y, "ry"), (covariate, "rz")):
        rows = ranking.average_rank(rows, keys, source, name, most)
    base = positioned(rows, keys, ids, seed, most)
    total, largest = extent(base)
    fits = base.groupBy(*keys).agg(
        F.avg("rx").alias("_mx"), F.avg("ry").alias("_my"), F.avg("rz").alias("_mz"),
        F.coalesce(F.try_divide(F.covar_pop("rx", "rz"), F.var_pop("rz")), F.lit(0.0)).alias("_bx"),
        F.coalesce(F.try_divide(F.covar_pop("ry", "rz"), F.var_pop("rz")), F.lit(0.0)).alias("_by"),
    )
    residual = pinned(base.join(fits, keys).select(
        *keys, "pos", "n",
        (F.col("rx") - F.col("_mx") - F.col("_bx") * (F.col("rz") - F.col("_mz"))).alias("ex"),
        (F.col("ry") - F.col("_my") - F.col("_by") * (F.col("rz") - F.col("_mz"))).alias("ey"),
    ))
    observed = residual.groupBy(*keys).agg(
        S.pearson("ex", "ey").alias("effect"), F.count(F.lit(1)).alias("n"), F.sum(F.col("ex") * F.col("ey")).alias("_s")
    )
    if _fits(base, largest):
        triples = base.select(*keys, "pos", *[F.col(c).cast("double").alias(name) for c, name in ((x, "x"), (y, "y"), (covariate, "z"))])
        drawn = replicate.statistics(triples, keys, ["x", "y", "z"], replicate.partial_spearman, bootstraps, seed, "_r", total)
        sums = _products(residual, keys, "ex", "ey", permutations, seed, total)
    else:
        rkeys, draws = [*keys, "rep"], bootstrap_rows(base, keys, [x, y, covariate], bootstraps, seed, total)
        for source, name in ((x, "bx"), (y, "by"), (covariate, "bz")):
            draws = ranking.average_rank(draws, rkeys, source, name, largest)
        correlated = draws.groupBy(*rkeys).agg(
            S.pearson("bx", "by").alias("xy"), S.pearson("bx", "bz").alias("xz"), S.pearson("by", "bz").alias("yz")
        )
        drawn = correlated.select(*rkeys, partial_correlation(F.col("xy"), F.col("xz"), F.col("yz")).alias("_r"))
        shuffled = permuted(residual, keys, ["ex"], permutations, f"{seed}p", total, largest)
        partner = lookup(residual.select(*keys, F.col("pos").alias("rn"), "ey"), total)
        sums = shuffled.join(partner, [*keys, "rn"]).groupBy(*keys, "rep").agg(F.sum(F.col("ex") * F.col("ey")).alias("_sp"))
    spread = interval(drawn, keys, "_r")
    # residuals have mean zero, so the product sum orders like the correlation
    scaled = lambda c: F.round(F.abs(F.col(c)) / F.col("n"), TIE_DIGITS)
    hits = sums.join(observed, keys).groupBy(*keys).agg(F.count_if(scaled("_sp") >= scaled("_s")).alias("_hits"))
    enough = (F.col("n") >= MIN_PAIRS) & F.col("effect").isNotNull()
    return observed.join(spread, keys, "left").join(hits, keys, "left").select(
        *keys, F.when(enough, F.col("effect")).alias("effect"),
        F.when(enough, F.col("ci_low")).alias("ci_low"), F.when(enough, F.col("ci_high")).alias("ci_high"),
        F.when(enough, p_value(F.col("_hits"), permutations)).alias("p_value"), "n",
    )


def delta_from_ranks(rank: str, flag: str) -> Column:
    """Cliff's delta from the rank sum of the flagged group."""
    n1 = F.count_if(F.col(flag)).cast("double")
    n0 = F.count_if(~F.col(flag)).cast("double")
    r1 = F.sum(F.when(F.col(flag), F.col(rank)).otherwise(0.0))
    return F.try_divide(2.0 * (r1 - n1 * (n1 + 1) / 2.0), n1 * n0) - 1.0


def cliffs_delta_inference(
    df: DataFrame, keys: list[str], value: str, flag: str, ids: list[str], seed: int | str,
    bootstraps: int = BOOTSTRAPS, permutations: int = PERMUTATIONS,
) -> DataFrame:
    """Cliff's delta (flagged minus rest), stratified bootstrap, label-permutation p.

    The p-value compares absolute mean differences, not deltas.
    """
    rows = df.where(S.is_finite(value) & F.col(flag).isNotNull()).select(
        *keys, *ids, F.col(value).cast("double").alias("v"), F.col(flag).cast("boolean").alias("f")
    )
    most = ranking.largest_group(rows, keys)
    ranked = ranking.average_rank(rows, keys, "v", "r", most)
    strata = positioned(ranked, [*keys, "f"], ids, seed, most)
    base = positioned(strata.withColumnRenamed("pos", "stratum_pos").drop("n"), keys, ids, seed, most)
    total, largest = extent(base)
    observed = base.groupBy(*keys).agg(
        delta_from_ranks("r", "f").alias("effect"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("f")).alias("n_flagged"), F.sum("v").alias("_t"),
        F.sum(F.when(F.col("f"), F.col("v"))).alias("_s"),
    )
    if _fits(base, largest):
        flagged = base.select(*keys, "pos", "v", F.col("f").cast("double").alias("f"), F.col("stratum_pos").cast("double").alias("stratum_pos"))
        drawn = replicate.statistics(flagged, keys, ["v", "f", "stratum_pos"], replicate.stratified_delta, bootstraps, seed, "_d", total)
        sums = replicate.statistics(flagged, keys, ["v", "f"], replicate.permuted_head, permutations, f"{seed}p", "_sp", total)
    else:
        draws = bootstrap_rows(strata, [*keys, "f"], ["v"], bootstraps, seed, total)
        rkeys = [*keys, "rep"]
        reranked = ranking.average_rank(draws, rkeys, "v", "br", largest)
        drawn = reranked.groupBy(*rkeys).agg(delta_from_ranks("br", "f").alias("_d"))
        sizes = observed.select(*keys, "n_flagged")
        shuffled = permuted(base, keys, ["v"], permutations, f"{seed}p", total, largest).join(sizes, keys)
        sums = shuffled.where(F.col("rn") <= F.col("n_flagged")).groupBy(*rkeys).agg(F.sum("v").alias("_sp"))
    spread = interval(drawn, keys, "_d")
    gap = lambda c: F.round(
        F.abs(F.try_divide(F.col(c), F.col("n_flagged")) - F.try_divide(F.col("_t") - F.col(c), F.col("n") - F.col("n_flagged"))),
        TIE_DIGITS,
    )
    hits = sums.join(observed, keys).groupBy(*keys).agg(F.count_if(gap("_sp") >= gap("_s")).alias("_hits"))
    enough = (F.col("n_flagged") >= 2) & (F.col("n") - F.col("n_flagged") >= 2)
    return observed.join(spread, keys, "left").join(hits, keys, "left").select(
        *keys, F.when(enough, F.col("effect")).alias("effect"),
        F.when(enough, F.col("ci_low")).alias("ci_low"), F.when(enough, F.col("ci_high")).alias("ci_high"),
        F.when(enough, p_value(F.col("_hits"), permutations)).alias("p_value"), "n",
    )


def eta_squared_inference(
    df: DataFrame, keys: list[str], value: str, group: str, ids: list[str], seed: int | str,
    permutations: int = PERMUTATIONS,
) -> DataFrame:
    """Between / total sum of squares with a right-tail label permutation p."""
    rows = df.where(S.is_finite(value) & F.col(group).isNotNull()).select(
        *keys, *ids, F.col(value).cast("double").alias("v"), F.col(group).alias("g")
    )
    base = positioned(rows, keys, ids, seed)
    total, largest = extent(base)
    totals = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("_m"), (F.var_pop("v") * F.count("v")).alias("_total")
    )
    centred = pinned(
        base.join(totals.select(*keys, "_m"), keys).select(*keys, "pos", "n", "g", (F.col("v") - F.col("_m")).alias("d"))
    )

    def between(frame: DataFrame, by: list[str]) -> DataFrame:
        per_group = frame.groupBy(*by, "g").agg(F.sum("d").alias("_s"), F.count(F.lit(1)).alias("_c"))
        return per_group.groupBy(*by).agg(F.sum(F.col("_s") * F.col("_s") / F.col("_c")).alias("_between"))

    observed = totals.join(between(centred, keys), keys).withColumn(
        "effect", F.try_divide(F.col("_between"), F.col("_total"))
    )
    if _fits(base, largest):
        coded = pinned(replicate.codes(centred.select(*keys, "pos", "g", "d"), keys, "g", "_code").select(*keys, "pos", "d", F.col("_code").alias("g")))
        null = replicate.statistics(coded, keys, ["d", "g"], replicate.permuted_between, permutations, f"{seed}p", "_null", total)
    else:
        shuffled = permuted(centred, keys, ["d"], permutations, f"{seed}p", total, largest)
        labels = lookup(centred.select(*keys, F.col("pos").alias("rn"), "g"), total)
        null = between(shuffled.join(labels, [*keys, "rn"]), [*keys, "rep"]).withColumnRenamed("_between", "_null")
    eta = lambda c: F.round(F.try_divide(F.col(c), F.col("_total")), TIE_DIGITS)
    hits = null.join(observed, keys).groupBy(*keys).agg(F.count_if(eta("_null") >= eta("_between")).alias("_hits"))
    return observed.join(hits, keys, "left").select(
        *keys, "effect", F.when(F.col("effect").isNotNull(), p_value(F.col("_hits"), permutations)).alias("p_value"), "n"
    )
