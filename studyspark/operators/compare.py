"""Group comparison: moments, effect sizes and rank tests, one row per feature."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyspark.functions.coerce import numeric_of
from studyspark.functions.guide import expectation
from studyspark.functions.tails import chi2_upper, normal_two_sided
from studyspark.operators.order import average_ranks, long_values, profile_values
from studyspark.operators.standardise import is_categorical

ALPHA = 0.05
# Two groups without ties are tested exactly if the smaller one has at most so many values.
EXACT_MIN = 8
COMPARISON = (
    "feature string, n_groups bigint, n_total bigint, group_a string, group_b string, test string, "
    "method string, statistic double, p_value double, effect_size double, effect_size_type string"
)


def group_moments(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """(feature, group, n, mean, sd, var, m2) for groups with at least two values."""
    aggs, fields = [], []
    for i, c in enumerate(features):
        x = numeric_of(df, c)
        aggs += [
            F.count(x).alias(f"n{i}"),
            F.avg(x).alias(f"m{i}"),
            F.var_samp(x).alias(f"v{i}"),
        ]
        fields.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"n{i}").alias("n"),
                F.col(f"m{i}").alias("mean"),
                F.col(f"v{i}").alias("var"),
            )
        )
    return (
        df.where(F.col(group).isNotNull())
        .groupBy(F.col(group).alias("group"))
        .agg(*aggs)
        .select("group", F.inline(F.array(*fields)))
        .where("n >= 2")
        .select("feature", "group", "n", "mean", F.sqrt("var").alias("sd"), "var")
    )


def comparison_stats(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """Display form of the per-group moments, for features with at least two usable groups."""
    m = group_moments(df, features, group)
    several = m.groupBy("feature").agg(F.count("*").alias("_g")).where("_g >= 2").select("feature")
    # one row per feature
    return m.join(F.broadcast(several), "feature").select(
        "feature",
        "group",
        F.round("mean", 4).alias("mean"),
        F.round("sd", 4).alias("sd"),
        "n",
    )


def pooled_d(
    mean_a: Column,
    mean_b: Column,
    var_a: Column,
    var_b: Column,
    n_a: Column,
    n_b: Column,
    zero_sd: str = "zero",
) -> Column:
    """Cohen's d from moments; NULL below two values, 0 (or NULL) when both groups are constant."""
    pooled = F.sqrt(
        F.try_divide((n_a - 1) * var_a + (n_b - 1) * var_b, (n_a + n_b - 2).cast("double"))
    )
    flat = F.lit(0.0) if zero_sd == "zero" else F.lit(None).cast("double")
    d = F.when(pooled == 0, flat).otherwise(F.try_divide(mean_a - mean_b, pooled))
    return F.when((n_a >= 2) & (n_b >= 2), d)


def _exact_u():
    """Exact two-sided p of the few small tie-free features; others pass unchanged.

    A nested function travels to the workers by value, so they need not have this package.
    """

    listed: dict[int, tuple[int, list[int]]] = {}

    def polynomial(m: int) -> tuple[int, list[int]]:
        """(L, P) with 1 / ((1 - q) (1 - q) (1 - q^2) .. (1 - q^m)) = P(q) / (1 - q^L)^(m + 1)."""
        if m not in listed:
            period = math.lcm(*range(1, m + 1))
            coefs = [1]
            for j in (1, *range(1, m + 1)):
                # a factor (1 - q^L) / (1 - q^j) = 1 + q^j + .. + q^(L - j)
                grown = coefs + [0] * (period - j)
                for i in range(len(grown) - 1, period - 1, -1):
                    grown[i] -= coefs[i - period] if i - period < len(coefs) else 0
                for i in range(j, len(grown)):
                    grown[i] += grown[i - j]
                coefs = grown
            listed[m] = period, coefs
        return listed[m]

    def count_upto(m: int, n: int, u: int) -> int:
        """Placements of m among m + n whose statistic is at most u: sums of the coefficients of
        the Gaussian binomial, whose numerator has 2^m terms at most and whose denominator is a
        polynomial of fixed size over a power; so n costs nothing."""
        period, coefs = polynomial(m)
        terms = {0: 1}  # exponent: sign and number
        for j in range(1, m + 1):
            for e, c in list(terms.items()):
                terms[e + n + j] = terms.get(e + n + j, 0) - c
        total = 0
        for e, c in terms.items():
            if e <= u and c:
                t = u - e
                total += c * sum(
                    coefs[i] * math.comb((t - i) // period + m, m)
                    for i in range(t % period, min(t + 1, len(coefs)), period)
                )
        return total

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf.index[pdf["exact"]]:
                m, n = sorted((int(pdf.at[i, "n_a"]), int(pdf.at[i, "n_b"])))
                low = int(min(pdf.at[i, "u"], m * n - pdf.at[i, "u"]))
                p = Fraction(2 * count_upto(m, n, low), math.comb(m + n, m))
                pdf.at[i, "p_raw"] = float(min(p, 1))
            yield pdf

    return step


def group_sizes(df: DataFrame, features: Sequence[str], group: str) -> dict[str, tuple]:
    """Per feature: usable groups, smallest usable size, groups with a single value."""
    counts = [F.count(numeric_of(df, c)).alias(f"n{i}") for i, c in enumerate(features)]
    pairs = [
        F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"))
        for i, c in enumerate(features)
    ]
    usable = F.col("n") >= 2
    rows = (
        df.where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(*counts)
        .select(F.inline(F.array(*pairs)))
        .groupBy("feature")
        .agg(
            F.count(F.when(usable, 1)).alias("groups"),
            F.min(F.when(usable, F.col("n"))).alias("least"),
            F.count(F.when(F.col("n") == 1, 1)).alias("lonely"),
        )
        .collect()
    )
    return {r["feature"]: (r["groups"], r["least"], r["lonely"]) for r in rows}


def _by_feature(values: dict[str, float]) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for name, v in values.items():
        out = out.when(F.col("feature") == name, F.lit(float(v)))
    return out


def compare_groups(
    df: DataFrame, features: Sequence[str], group: str, reference_group=None
) -> DataFrame:
    """One row per feature: n_groups, test, method, statistic, p_value, effect size and its type.

    Two groups: Mann-Whitney U with Cohen's d of the lower (or `reference_group`) against the other
    group. More groups: Kruskal-Wallis with eta squared. Groups below two values do not take part.

    Two narrow passes fix bucket edges, column means and group sizes; one pass over folded values
    then gives ranks and moments together.
    """
    features = [c for c in features if c in df.columns]
    profile = profile_values(df, features)
    sizes = group_sizes(df, features, group)
    features = [c for c in features if sizes.get(c, (0,))[0] >= 2]
    if not features:
        return df.sparkSession.createDataFrame([], COMPARISON)
    work = df.where(F.col(group).isNotNull()).withColumn("g", F.col(group))
    rows = long_values(work, features, ["g"], profile)
    weight = F.lit(1)
    if any(sizes[c][2] for c in features):
        # single values leave after folding: the join sees distinct values, not rows
        usable = group_moments(df, features, group).select(
            F.col("feature").alias("_f"), F.col("group").alias("_g")
        )
        rows = rows.groupBy("feature", "_bucket", "value", "g").agg(F.count("*").alias("w"))
        same = (F.col("feature") == F.col("_f")) & (F.col("g") == F.col("_g"))
        rows, weight = rows.join(usable, same, "left_semi"), F.col("w")
    n, t = F.col("n").cast("double"), F.col("t").cast("double")
    off = F.col("value") - _by_feature({c: profile.center(c) for c in features})
    per_group = (
        average_ranks(rows, ["g"], weight)
        .select("feature", "g", n.alias("n"), (n * F.col("rank")).alias("nr"), off.alias("x"), t.alias("t"))
        .groupBy("feature", "g")
        .agg(
            F.sum("n").alias("n"),
            F.sum("nr").alias("r"),
            F.sum(F.col("n") * F.col("x")).alias("sx"),
            F.sum(F.col("n") * F.col("x") * F.col("x")).alias("sxx"),
            F.sum(F.col("n") * (F.col("t") * F.col("t") - 1)).alias("ties"),
        )
        .withColumn("ss", F.greatest(F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.lit(0.0)))
    )
    key = F.col("g")
    if reference_group is not None:
        key = F.struct((F.col("g") != F.lit(reference_group)).alias("later"), F.col("g").alias("g"))
    side = F.struct("g", "n", "r", (F.col("sx") / F.col("n")).alias("mean"), "ss")
    # x is measured from the mean of the whole column, the centre eta squared is defined on
    per = per_group.groupBy("feature").agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        F.sum("ties").alias("ties"),
        F.sum(F.col("r") * F.col("r") / F.col("n")).alias("r2n"),
        F.sum("ss").alias("within"),
        F.sum(F.col("sx") * F.col("sx") / F.col("n")).alias("between"),
        F.min_by(side, key).alias("a"),
        F.max_by(side, key).alias("b"),
    )
    flat = per.selectExpr(
        "feature", "k", "n", "ties", "r2n", "within", "between", "k = 2 AS two",
        "CAST(a.g AS STRING) AS ga", "CAST(b.g AS STRING) AS gb", "a.n AS na", "b.n AS nb",
        "a.mean AS ma", "b.mean AS mb", "a.ss / (a.n - 1) AS va", "b.ss / (b.n - 1) AS vb",
        "a.r - a.n * (a.n + 1) / 2 AS u",
        "(12 / (n * (n + 1)) * r2n - 3 * (n + 1)) AS h0",
        "sqrt(a.n * b.n / 12 * (n + 1 - try_divide(ties, n * (n - 1)))) AS sigma",
    ).selectExpr(
        "*",
        "try_divide(h0, 1 - ties / (n * n * n - n)) AS h",
        "try_divide(greatest(u, na * nb - u) - na * nb / 2 - 0.5, sigma) AS z",
    )
    two = F.col("two")
    p_u = F.when(F.col("sigma") > 0, F.least(_two_sided_from_upper(F.col("z")), F.lit(1.0)))
    p = F.when(two, F.coalesce(p_u, F.lit(1.0)))
    if any(sizes[c][0] > 2 for c in features):
        p = p.otherwise(chi2_upper(F.col("h"), F.col("k") - 1))
    d = pooled_d(*[F.col(c) for c in ("ma", "mb", "va", "vb", "na", "nb")])
    eta = F.try_divide(F.col("between"), F.col("between") + F.col("within"))
    small = [c for c in features if sizes[c][0] == 2 and sizes[c][1] <= EXACT_MIN]
    exact = two & (F.least("na", "nb") <= EXACT_MIN) & (F.col("ties") == 0)
    out = flat.select(
        "feature",
        "k",
        "n",
        "two",
        "ga",
        "gb",
        F.col("na").alias("n_a"),
        F.col("nb").alias("n_b"),
        F.when(two, F.col("u")).otherwise(F.col("h")).alias("u"),
        p.alias("p_raw"),
        F.when(two, d).otherwise(eta).alias("effect"),
        (exact & F.col("feature").isin(small) if small else F.lit(False)).alias("exact"),
    )
    if small:
        out = out.mapInPandas(_exact_u(), out.schema)
    return out.select(
        "feature",
        F.col("k").alias("n_groups"),
        F.col("n").cast("bigint").alias("n_total"),
        F.when(two, F.col("ga")).alias("group_a"),
        F.when(two, F.col("gb")).alias("group_b"),
        F.when(two, F.lit("Mann-Whitney U")).otherwise(F.lit("Kruskal-Wallis")).alias("test"),
        F.when(F.col("exact"), F.lit("exact")).otherwise(F.lit("asymptotic")).alias("method"),
        F.round("u", 4).alias("statistic"),
        F.round("p_raw", 4).alias("p_value"),
        F.round("effect", 4).alias("effect_size"),
        F.when(two, F.lit("Cohen's d")).otherwise(F.lit("eta-squared")).alias("effect_size_type"),
    )


def _two_sided_from_upper(z: Column) -> Column:
    """2 P(Z > z), which exceeds 1 for z < 0 and is capped by the caller."""
    return F.when(z >= 0, normal_two_sided(z)).otherwise(2 - normal_two_sided(z))


def effect_label(effect: Column) -> Column:
    size = F.abs(effect)
    return (
        F.when(size >= 0.8, F.lit("LARGE"))
        .when(size >= 0.5, F.lit("medium"))
        .when(size >= 0.2, F.lit("small"))
        .when(size.isNotNull(), F.lit("negligible"))
    )


def significant(p: Column) -> Column:
    return F.coalesce(p < ALPHA, F.lit(False))


def annotate_comparison(cmp: DataFrame) -> DataFrame:
    """Add effect_label, is_significant, expected and note."""
    expected, note = expectation(F.col("feature"))
    return (
        cmp.withColumn("effect_label", effect_label(F.col("effect_size")))
        .withColumn("is_significant", significant(F.col("p_value")))
        .withColumn("expected", expected)
        .withColumn("note", note)
    )


def top_effects(cmp: DataFrame, k: int = 25, by: str = "signed") -> DataFrame:
    size = F.col("effect_size")
    return cmp.orderBy((F.abs(size) if by == "abs" else size).desc_nulls_last(), "feature").limit(k)


def stats_wide(stats: DataFrame, groups: Sequence) -> DataFrame:
    """One row per feature with mean_<g>, sd_<g>, n_<g> for the listed groups."""
    cols = []
    for g in groups:
        for what in ("mean", "sd", "n"):
            value = F.when(F.col("group") == F.lit(g), F.col(what))
            cols.append(F.max(value).alias(f"{what}_{g}"))
    return stats.groupBy("feature").agg(*cols)


def condition_analysis(
    df: DataFrame, time: str, outcome: str, entity: str | None = None
) -> dict[str, DataFrame]:
    """Few-valued time: compare the outcome across conditions; otherwise per-entity slopes."""
    from studyspark.operators.describe import condition_stats
    from studyspark.operators.progression import progression_summary, slopes

    if is_categorical(df, time):
        return {
            "condition_stats": condition_stats(df, time, outcome),
            "comparison": annotate_comparison(compare_groups(df, [outcome], time)),
        }
    if entity is None:
        raise ValueError("slopes need an entity column")
    per = slopes(df, entity, time, outcome)
    return {"slopes": per, "summary": progression_summary(per)}
