"""Within-subject comparison of two conditions.

Pairs are all rows of condition A with all rows of condition B of the same entity. Pair counts,
means, variances and the paired t statistic follow from per-entity moments, so they need no pairs
at all. Signed ranks do need pair differences: they are built from distinct values, whatever their
number, so the test never depends on the size of the table. Where values lie on a grid, the
differences of an entity with many distinct values are one exact convolution of its two histograms,
so their cost follows the span of the values and not the number of pairs. Callers who want a cost
that is linear in the rows choose `pairing='mean'`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyspark.functions.coerce import numeric_of
from studyspark.functions.tails import normal_two_sided, student_two_sided
from studyspark.operators.compare import _by_feature, pooled_d
from studyspark.operators.keyed import profile_keys
from studyspark.operators.lineage import cut
from studyspark.operators.order import bucket_depth, even_bucket, average_ranks, long_values

MIN_PAIRS = 5
EXACT_PAIRS = 50
# A hot entity is dealt over a grid: side A to a row of it, side B to a column.
GRID = 8
# Steps of 1, 1/16 and 1/256: differences of such doubles are exact, so any way to build them agrees.
BINARY_SCALES = (1.0, 16.0, 256.0)
# An entity is convolved only if its values span at most so many steps (measured: a task holds up to
# 400 MB for that, input included); wider ones are joined.
GRID_CELLS = 2**20


def _sides(df: DataFrame, entity: str, condition: str, a, b) -> DataFrame:
    cond = F.col(condition)
    return df.where(F.col(entity).isNotNull() & cond.isin(a, b)).withColumn("_in_a", cond == F.lit(a))


def _entity_moments(df: DataFrame, features: Sequence[str], entity: str) -> DataFrame:
    """(feature, na, ma, qa, nb, mb, qb) per entity; q = sum of squared deviations."""
    aggs, fields = [], []
    for i, c in enumerate(features):
        x = numeric_of(df, c)
        parts = [F.lit(c).alias("feature")]
        for side, keep in (("a", F.col("_in_a")), ("b", ~F.col("_in_a"))):
            v = F.when(keep, x)
            aggs += [
                F.count(v).alias(f"n{side}{i}"),
                F.avg(v).alias(f"m{side}{i}"),
                F.var_pop(v).alias(f"v{side}{i}"),
            ]
            n = F.col(f"n{side}{i}").cast("double")
            parts += [
                n.alias(f"n{side}"),
                F.col(f"m{side}{i}").alias(f"m{side}"),
                (n * F.col(f"v{side}{i}")).alias(f"q{side}"),
            ]
        fields.append(F.struct(*parts))
    return (
        df.groupBy(F.col(entity).alias("entity"))
        .agg(*aggs)
        .select("entity", F.inline(F.array(*fields)))
        .where("na > 0 and nb > 0")
    )


def _collapse(moments: DataFrame) -> DataFrame:
    """One pair per entity: the two condition means."""
    one, zero = F.lit(1.0), F.lit(0.0)
    return moments.select(
        "entity",
        "feature",
        one.alias("na"),
        "ma",
        zero.alias("qa"),
        one.alias("nb"),
        "mb",
        zero.alias("qb"),
    )


def _pair_moments(moments: DataFrame, centers: dict[str, float]) -> DataFrame:
    """Pair-level counts, means and squared deviations per feature, in one aggregate.

    Values are measured from a fixed centre, so sums of squares stay small.
    """
    c = _by_feature(centers)
    at = moments.select(
        "feature", "na", "nb", "qa", "qb",
        (F.col("na") * F.col("nb")).alias("w"),
        (F.col("ma") - c).alias("a"),
        (F.col("mb") - c).alias("b"),
        c.alias("c"),
    )
    sums = at.groupBy("feature").agg(
        F.sum("w").alias("pairs"),
        F.count("*").alias("n_entities"),
        F.max("c").alias("c"),
        F.expr("sum(w * a)").alias("wa"),
        F.expr("sum(w * b)").alias("wb"),
        F.expr("sum(w * (a - b))").alias("wd"),
        F.expr("sum(nb * qa + w * a * a)").alias("waa"),
        F.expr("sum(na * qb + w * b * b)").alias("wbb"),
        F.expr("sum(nb * qa + na * qb + w * (a - b) * (a - b))").alias("wdd"),
    )
    return sums.selectExpr(
        "feature",
        "pairs",
        "n_entities",
        "c + wa / pairs AS mean_a",
        "c + wb / pairs AS mean_b",
        "wd / pairs AS mean_diff",
        "greatest(waa - wa * wa / pairs, 0D) AS sa",
        "greatest(wbb - wb * wb / pairs, 0D) AS sb",
        "greatest(wdd - wd * wd / pairs, 0D) AS sd",
    )


@dataclass(frozen=True)
class PairProfile:
    """Per feature: row pairs, value range and mean of both sides, steps a unit (grid values only)."""

    pairs: dict[str, float]
    ranges: dict[str, float]
    centers: dict[str, float]
    scales: dict[str, float]


def profile_pairs(
    sides: DataFrame, features: Sequence[str], entity: str, decimals: int | None = None
) -> PairProfile:
    """One pass: per-entity counts fold to the exact number of pairs."""
    scales = BINARY_SCALES if decimals is None else (10.0**decimals,)
    aggs, out = [], []
    for i, c in enumerate(features):
        x = numeric_of(sides, c)
        aggs += [
            F.count(F.when(F.col("_in_a"), x)).cast("double").alias(f"a{i}"),
            F.count(F.when(~F.col("_in_a"), x)).cast("double").alias(f"b{i}"),
            F.min(x).alias(f"l{i}"),
            F.max(x).alias(f"h{i}"),
            F.sum(x).alias(f"s{i}"),
            F.max(_grid_level(x, scales)).alias(f"g{i}"),
        ]
        out += [
            F.sum(F.col(f"a{i}") * F.col(f"b{i}")).alias(f"p{i}"),
            F.min(f"l{i}").alias(f"l{i}"),
            F.max(f"h{i}").alias(f"h{i}"),
            F.max(f"g{i}").alias(f"g{i}"),
            (F.sum(f"s{i}") / F.sum(F.col(f"a{i}") + F.col(f"b{i}"))).alias(f"m{i}"),
        ]
    got = sides.groupBy(entity).agg(*aggs).agg(*out).first()
    pairs, ranges, centers, steps = {}, {}, {}, {}
    for i, c in enumerate(features):
        pairs[c] = got[f"p{i}"] or 0.0
        ranges[c] = (got[f"h{i}"] or 0.0) - (got[f"l{i}"] or 0.0)
        centers[c] = got[f"m{i}"] or 0.0
        level = got[f"g{i}"]
        if level is not None and level < len(scales):
            steps[c] = scales[level]
    return PairProfile(pairs, ranges, centers, steps)


def _grid_level(x: Column, scales: Sequence[float]) -> Column:
    """Place of the first scale on whose grid `x` lies; the number of scales if there is none."""
    out = F.when(F.lit(False), F.lit(0))
    for i, s in enumerate(scales):
        out = out.when(F.rint(x * s) / s == x, F.lit(i))
    return F.when(x.isNotNull(), out.otherwise(F.lit(len(scales))))


def _exact_w():
    """Exact two-sided signed-rank p of small tie-free features.

    A nested function travels to the workers by value, so they need not have this package.
    """

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf.index[pdf["exact"]]:
                n = int(pdf.at[i, "nz"])
                ways = np.zeros(n * (n + 1) // 2 + 1)
                ways[0] = 1.0
                for r in range(1, n + 1):
                    ways[r:] = ways[r:] + ways[:-r]
                low = int(min(pdf.at[i, "w_pos"], pdf.at[i, "w_neg"]))
                pdf.at[i, "p_w"] = min(1.0, 2.0 * ways[: low + 1].sum() / ways.sum())
            yield pdf

    return step


def _convolved():
    """Differences of one entity and feature: its histograms, one of them reversed, convolved.

    Counts are cut into parts of eight bits. A sum of products of such parts over 2^20 cells stays
    below 2^40, where a transform in doubles errs by less than 0.01; so each rounds to the exact
    whole number, and 64-bit integers hold the total, which is at most the number of pairs.
    A nested function travels to the workers by value.
    """
    bits = 8

    def spectra(counts: np.ndarray, size: int) -> list[np.ndarray]:
        out = []
        while counts.any():
            out.append(np.fft.rfft((counts & ((1 << bits) - 1)).astype(float), size))
            counts = counts >> bits
        return out

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["value"].to_numpy()
        at = np.rint(at - at.min()).astype(np.int64)
        in_a, c = pdf["_in_a"].to_numpy(dtype=bool), pdf["c"].to_numpy(dtype=np.int64)
        span = int(at.max()) + 1
        a, b = np.zeros(span, np.int64), np.zeros(span, np.int64)
        a[at[in_a]], b[span - 1 - at[~in_a]] = c[in_a], c[~in_a]
        size = 1 << (2 * span - 1).bit_length()
        fa, fb = spectra(a, size), spectra(b, size)
        ways = np.zeros(2 * span - 1, np.int64)
        for k in range(len(fa) + len(fb) - 1):
            part = sum(fa[i] * fb[k - i] for i in range(len(fa)) if 0 <= k - i < len(fb))
            ways += np.rint(np.fft.irfft(part, size)[: 2 * span - 1]).astype(np.int64) << (bits * k)
        found = np.flatnonzero(ways)
        d = found - (span - 1)
        return pd.DataFrame(
            {"feature": pdf["feature"].iloc[0], "value": np.abs(d).astype(float), "positive": d > 0, "w": ways[found]}
        )

    return step


def _dense(sides: DataFrame, on_grid: Sequence[str]) -> DataFrame:
    """(entity, feature) whose pairs of distinct values outnumber the differences they can have."""
    a, b = F.col("_in_a"), ~F.col("_in_a")
    per = sides.where(F.col("feature").isin(list(on_grid))).groupBy("entity", "feature").agg(
        F.count_if(a).cast("double").alias("va"),
        F.count_if(b).cast("double").alias("vb"),
        F.sum(F.when(a, F.col("c"))).cast("double").alias("na"),
        F.sum(F.when(b, F.col("c"))).cast("double").alias("nb"),
        (F.max("value") - F.min("value") + 1).alias("span"),
    )
    # the number of pairs has to fit in 64 bits
    return per.where(f"va * vb > 2 * span AND span <= {GRID_CELLS} AND na * nb < 9e18").select("entity", "feature")


def _differences(
    df: DataFrame, features: Sequence[str], entity: str, ranges: dict[str, float], scales: dict[str, float]
) -> DataFrame:
    """(feature, value = |a - b|, positive, w, _bucket) from distinct values of each side.

    Values of features in `scales` are counted in steps of their grid, which keeps order and ties.
    """
    long = long_values(df, features, [entity, "_in_a"]).withColumnRenamed(entity, "entity")
    for name, scale in scales.items():
        unit = F.rint(F.col("value") * scale)
        long = long.withColumn("value", F.when(F.col("feature") == name, unit).otherwise(F.col("value")))
    ranges = {name: width * scales.get(name, 1.0) for name, width in ranges.items()}
    sides = long.groupBy("entity", "feature", "_in_a", "value").agg(F.count("*").alias("c"))
    folded = None
    if scales:
        sides = cut(sides)
        dense = _dense(sides, list(scales))
        shape = "feature string, value double, positive boolean, w bigint"
        folded = (
            sides.join(dense, ["entity", "feature"], "left_semi")
            .groupBy("entity", "feature")
            .applyInPandas(_convolved(), shape)
        )
        sides = sides.join(dense, ["entity", "feature"], "left_anti")
    hot = list(profile_keys(df, [entity], hot_min_rows=10_000).hot)
    left = sides.where("_in_a").select("entity", "feature", "value", "c")
    right = sides.where("not _in_a").select(
        F.col("entity").alias("_e"), F.col("feature").alias("_f"), F.col("value").alias("_v"), F.col("c").alias("_c")
    )
    same = (F.col("entity") == F.col("_e")) & (F.col("feature") == F.col("_f"))
    if hot:
        # each value of side A goes to the cells of one row of the grid, each of side B to those of
        # one column: every pair meets in one cell, and neither side is copied whole
        every = F.sequence(F.lit(0), F.lit(GRID - 1))
        one = F.array(F.lit(0))
        line = F.pmod(F.xxhash64("value"), F.lit(GRID)).cast("int")
        down = F.pmod(F.xxhash64("_v"), F.lit(GRID)).cast("int")
        left = left.withColumn(
            "_s",
            F.explode(
                F.when(F.xxhash64("entity").isin(hot), F.transform(every, lambda k: line * GRID + k)).otherwise(one)
            ),
        )
        right = right.withColumn(
            "_sr",
            F.explode(
                F.when(F.xxhash64("_e").isin(hot), F.transform(every, lambda k: k * GRID + down)).otherwise(one)
            ),
        )
        same = same & (F.col("_s") == F.col("_sr"))
    depth = bucket_depth(df)
    d = F.col("value") - F.col("_v")
    pairs = left.join(right, same).select(
        "feature", F.abs(d).alias("value"), (d > 0).alias("positive"), (F.col("c") * F.col("_c")).alias("w")
    )
    if folded is not None:
        pairs = pairs.unionByName(folded)
    bucket = F.when(F.lit(False), F.lit(0))
    for name, width in ranges.items():
        bucket = bucket.when(F.col("feature") == name, even_bucket(F.col("value"), 0.0, width, depth))
    return pairs.where("value > 0").withColumn("_bucket", F.coalesce(bucket, F.lit(0)))


def _mean_differences(moments: DataFrame, ranges: dict[str, float], depth: int) -> DataFrame:
    d = F.col("ma") - F.col("mb")
    bucket = F.when(F.lit(False), F.lit(0))
    for name, width in ranges.items():
        bucket = bucket.when(F.col("feature") == name, even_bucket(F.col("value"), 0.0, width, depth))
    return (
        moments.select(
            "feature", F.abs(d).alias("value"), (d > 0).alias("positive"), F.lit(1).cast("bigint").alias("w")
        )
        .where("value > 0")
        .withColumn("_bucket", F.coalesce(bucket, F.lit(0)))
    )


def signed_ranks(differences: DataFrame) -> DataFrame:
    """(feature, nz, w_pos, w_neg, p_w, exact): Wilcoxon over non-zero differences."""
    ranked = average_ranks(differences, ["positive"], F.col("w"))
    amount = F.col("n") * F.col("rank")
    per = ranked.groupBy("feature").agg(
        F.sum("n").cast("double").alias("nz"),
        F.coalesce(F.sum(F.when(F.col("positive"), amount)), F.lit(0.0)).alias("w_pos"),
        F.coalesce(F.sum(F.when(~F.col("positive"), amount)), F.lit(0.0)).alias("w_neg"),
        F.sum(F.col("n") * (F.col("t").cast("double") * F.col("t") - 1)).alias("ties"),
    )
    nz = F.col("nz")
    se = F.sqrt(nz * (nz + 1) * (2 * nz + 1) / 24 - F.col("ties") / 48)
    z = F.try_divide(F.least("w_pos", "w_neg") - nz * (nz + 1) / 4, se)
    return per.select("feature", "nz", "w_pos", "w_neg", "ties", normal_two_sided(z).alias("p_w"))


def within_subject(
    df: DataFrame,
    features: Sequence[str],
    entity: str,
    condition: str,
    a,
    b,
    pairing: str = "all",
    decimals: int | None = None,
) -> DataFrame:
    """One row per feature with at least five pairs.

    `pairing='all'` pairs every row of A with every row of B per entity; `'mean'` first averages
    each condition within the entity. A feature whose differences are all zero has no signed ranks
    and gets the paired t row.

    With `decimals`, features whose values have at most so many decimals are ranked by their decimal
    differences: 0.3 - 0.1 and 0.5 - 0.3 are ties, as they are not in doubles. Without it, doubles
    are subtracted as they are.
    """
    features = [c for c in features if c in df.columns]
    sides = _sides(df, entity, condition, a, b)
    seen = profile_pairs(sides, features, entity, decimals)
    moments = _entity_moments(sides, features, entity)
    if pairing == "mean":
        moments = _collapse(moments)
        diffs = _mean_differences(moments, seen.ranges, bucket_depth(df))
        small = features
    else:
        diffs = _differences(sides, features, entity, seen.ranges, seen.scales) if features else None
        small = [c for c in features if seen.pairs[c] <= EXACT_PAIRS]
    out = _pair_moments(moments, seen.centers).where(F.col("pairs") >= MIN_PAIRS)
    if diffs is not None:
        ranks = signed_ranks(diffs).withColumnRenamed("feature", "_rf")
        out = out.join(ranks, F.col("feature") == F.col("_rf"), "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("nz", "w_pos", "w_neg", "ties", "p_w")})
    out = out.selectExpr(
        "*", "try_divide(sd, pairs - 1) AS var_d", "try_divide(sa, pairs - 1) AS va", "try_divide(sb, pairs - 1) AS vb"
    ).withColumn("t_stat", F.expr("try_divide(mean_diff, sqrt(var_d / pairs))"))
    n = F.col("pairs")
    out = out.select(
        "feature",
        "mean_a",
        "mean_b",
        "mean_diff",
        n.cast("bigint").alias("n_pairs"),
        "n_entities",
        F.coalesce("nz", F.lit(0.0)).alias("nz"),
        "w_pos",
        "w_neg",
        "p_w",
        F.when(F.col("var_d") > 0, student_two_sided(F.col("t_stat"), F.least(n - 1, F.lit(2e9)))).alias("p_t"),
        "t_stat",
        pooled_d(F.col("mean_a"), F.col("mean_b"), F.col("va"), F.col("vb"), n, n).alias("d"),
        F.coalesce(
            (F.col("nz") == n) & (n <= EXACT_PAIRS) & (F.col("ties") == 0), F.lit(False)
        ).alias("exact"),
    )
    if small:
        out = out.mapInPandas(_exact_w(), out.schema)
    else:
        out = out.withColumn("exact", F.lit(False))
    use = F.col("nz") > 0
    return out.select(
        "feature",
        F.round("mean_a", 4).alias("mean_a"),
        F.round("mean_b", 4).alias("mean_b"),
        F.round("mean_diff", 4).alias("mean_diff"),
        "n_pairs",
        "n_entities",
        F.when(use, F.lit("Wilcoxon")).otherwise(F.lit("Paired t-test")).alias("test"),
        F.when(use & F.col("exact"), F.lit("exact"))
        .when(use, F.lit("asymptotic"))
        .otherwise(F.lit("paired_t"))
        .alias("method"),
        F.round(F.when(use, F.least("w_pos", "w_neg")).otherwise(F.col("t_stat")), 4).alias("statistic"),
        F.round(F.when(use, F.col("p_w")).otherwise(F.col("p_t")), 4).alias("p_value"),
        F.round("d", 4).alias("effect_size_d"),
    )


def paired_t(
    df: DataFrame, features: Sequence[str], entity: str, condition: str, a, b, pairing: str = "all"
) -> DataFrame:
    """(feature, n_pairs, mean_diff, sd_diff, t, p_value) from per-entity moments alone."""
    sides = _sides(df, entity, condition, a, b)
    seen = profile_pairs(sides, features, entity)
    moments = _entity_moments(sides, features, entity)
    base = _pair_moments(_collapse(moments) if pairing == "mean" else moments, seen.centers)
    out = (
        base.where(F.col("pairs") >= MIN_PAIRS)
        .withColumn("var_d", F.expr("try_divide(sd, pairs - 1)"))
        .withColumn("t", F.expr("try_divide(mean_diff, sqrt(var_d / pairs))"))
    )
    p = student_two_sided(F.col("t"), F.least(F.col("pairs") - 1, F.lit(2e9)))
    return out.select(
        "feature",
        F.col("pairs").cast("bigint").alias("n_pairs"),
        F.round("mean_diff", 4).alias("mean_diff"),
        F.round(F.sqrt("var_d"), 4).alias("sd_diff"),
        F.round("t", 4).alias("t"),
        F.round(F.when(F.col("var_d") > 0, p), 4).alias("p_value"),
    )
