"""Exact ranks, quantiles and k-th values without a one-task sort.

Each value falls in one of 2^depth buckets whose edges come from one approximate-percentile pass;
the edges are frozen in the plan as literals, so every branch agrees on them and lost executors
recompute the same buckets. Bucket totals combine on the map side. Quantiles then look only at rows
of the buckets that hold a wanted position; ranks fold equal values first (a value held by a third
of all rows is one line afterwards) and sort inside single buckets. Any edges give exact results;
good edges give even tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyspark.functions.coerce import numeric_of
from studyspark.operators.keyed import profile_keys

# Built-in `percentile` keeps every distinct value of a column in one task: used only when a
# sketch shows there are few of them.
HASH_VALUES = 50_000


@dataclass(frozen=True)
class ValueProfile:
    """Per column: sketched distinct count, mean and bucket edges."""

    distinct: dict[str, int]
    means: dict[str, float | None]
    edges: dict[str, list[float]]
    depth: int

    def center(self, col: str) -> float:
        """A number amid the values, to keep sums of squares small."""
        return self.means[col] or 0.0

    def few_valued(self, cols: Sequence[str], limit: int = HASH_VALUES) -> list[str]:
        """Columns, fewest values first, whose values together stay within `limit`."""
        out, total = [], 0.0
        for c in sorted(cols, key=lambda c: self.distinct[c]):
            total += 1.2 * self.distinct[c]
            if total > limit:
                break
            out.append(c)
        return out


def bucket_depth(df: DataFrame) -> int:
    """Enough buckets to keep every shuffle partition of this session busy.

    Sessions for larger tables have more partitions; up to 2^16 buckets follow them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(math.ceil(math.log2(4 * parts)), 5), 16)


def profile_values(df: DataFrame, cols: Sequence[str], depth: int | None = None) -> ValueProfile:
    """One pass over `cols`; brings back 2^depth edges per column, independent of the row count."""
    depth = depth or bucket_depth(df)
    n = 2**depth
    probs = [i / n for i in range(1, n)]
    aggs = []
    for i, c in enumerate(cols):
        x = numeric_of(df, c)
        aggs.append(F.approx_count_distinct(x).alias(f"d{i}"))
        aggs.append(F.avg(x).alias(f"m{i}"))
        aggs.append(F.percentile_approx(x, probs, max(10000, 4 * n)).alias(f"e{i}"))
    got = df.agg(*aggs).first()
    edges = {c: sorted(set(got[f"e{i}"] or [])) for i, c in enumerate(cols)}
    distinct = {c: got[f"d{i}"] for i, c in enumerate(cols)}
    means = {c: got[f"m{i}"] for i, c in enumerate(cols)}
    return ValueProfile(distinct, means, edges, depth)


def even_bucket(value: Column, low: float, high: float, depth: int) -> Column:
    """Bucket of a value in [low, high] on an even grid (any values give a monotone bucket)."""
    n = 2**depth
    if not high > low:
        return F.lit(0)
    at = F.floor((value - low) / (high - low) * n)
    return F.coalesce(F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)).cast("int"), F.lit(0))


def hash_bucket(h: Column, depth: int) -> Column:
    """Leading bits of a uniform 32-bit hash."""
    return F.shiftright(h, 32 - depth).cast("int")


def long_values(
    df: DataFrame,
    cols: Sequence[str],
    keep: Sequence[str] = (),
    profile: ValueProfile | None = None,
) -> DataFrame:
    """(keep..., feature, value[, _bucket]) with non-null numeric values.

    Buckets are found by the JVM-side binary search of `Bucketizer`, before columns become rows.
    """
    wide = df.select(*keep, *[numeric_of(df, c).alias(f"_v{i}") for i, c in enumerate(cols)])
    cut = [i for i, c in enumerate(cols) if profile and profile.edges.get(c)]
    if cut:
        wide = Bucketizer(
            inputCols=[f"_v{i}" for i in cut],
            outputCols=[f"_b{i}" for i in cut],
            splitsArray=[[-math.inf, *profile.edges[cols[i]], math.inf] for i in cut],
            handleInvalid="keep",
        ).transform(wide)
    pairs = []
    for i, c in enumerate(cols):
        fields = [F.lit(c).alias("feature"), F.col(f"_v{i}").alias("value")]
        if profile:
            bucket = F.coalesce(F.col(f"_b{i}").cast("int"), F.lit(0)) if i in cut else F.lit(0)
            fields.append(bucket.alias("_bucket"))
        pairs.append(F.struct(*fields))
    return wide.select(*keep, F.inline(F.array(*pairs))).where("value is not null")


def _offsets(binned: DataFrame, part: Sequence[str], weight: Column) -> DataFrame:
    """Per bucket: rows in it, rows in all earlier buckets of the part, rows of the part.

    The totals combine on the map side, so only bucket counts are shuffled.
    """
    totals = binned.groupBy(*part, "_bucket").agg(F.sum(weight).alias("_in_bucket"))
    whole = Window.partitionBy(*part)
    upto = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return totals.withColumn(
        "_before", F.sum("_in_bucket").over(upto) - F.col("_in_bucket")
    ).withColumn("_total", F.sum("_in_bucket").over(whole))


def _same(part: Sequence[str], prefix: str) -> Column:
    out = F.col("_bucket") == F.col(f"{prefix}_bucket")
    for p in part:
        out = out & F.col(p).eqNullSafe(F.col(f"{prefix}{p}"))
    return out


def average_ranks(
    rows: DataFrame, carry: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """(feature, value, carry..., n, rank, t) from rows (feature, value, _bucket, carry...).

    `n` rows share the line, `t` rows share the value, and `rank` is their average rank within the
    feature. Lines of one value are adjacent in one bucket, whatever they carry.
    """
    weight = F.lit(1) if weight is None else weight
    # one row per feature and bucket, which may be many: no broadcast is asked for, as the windows
    # below need lines by feature and bucket anyway and Spark still broadcasts a list it finds small
    offs = _offsets(rows, ["feature"], weight).select("feature", "_bucket", "_before")
    lines = rows.groupBy("feature", "_bucket", "value", *carry).agg(F.sum(weight).alias("n"))
    inside = Window.partitionBy("feature", "_bucket").orderBy("value")
    upto = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = inside.rangeBetween(Window.currentRow, Window.currentRow)
    return (
        lines.join(offs, ["feature", "_bucket"])
        .withColumn("t", F.sum("n").over(ties))
        .withColumn("_cum", F.sum("n").over(upto))
        .withColumn("rank", F.col("_before") + F.col("_cum") - (F.col("t") - 1) / 2.0)
        .select("feature", "value", *carry, "n", "rank", "t")
    )


def kth_values(
    rows: DataFrame, part: Sequence[str], asks: Callable[[Column], Column], few_parts: bool
) -> DataFrame:
    """(part..., ask, value, before, ties) at asked 0-based positions of each part.

    `rows` has part..., value and _bucket; `asks` maps the part's row count to an array of structs
    with a position `k`. The first scan counts buckets; the second keeps only rows of buckets with
    an asked position, so full values are never shuffled. `few_parts` says that the number of parts
    was checked and the bucket list may be broadcast.
    """
    part = list(part)

    def within(low: str, count: str) -> Column:
        first, size = F.col(low), F.col(count)
        return F.filter(
            asks(F.col("_total")), lambda a: (a["k"] >= first) & (a["k"] < first + size)
        )

    target = (
        _offsets(rows, part, F.lit(1))
        .where(F.size(within("_before", "_in_bucket")) > 0)
        .select(
            *[F.col(p).alias(f"_t_{p}") for p in part],
            F.col("_bucket").alias("_t__bucket"),
            "_before",
            "_total",
        )
    )
    hits = rows.join(F.broadcast(target) if few_parts else target, _same(part, "_t_"))
    one = hits.groupBy(*part, "_bucket", "value").agg(
        F.count("*").alias("ties"),
        F.max("_before").alias("_before"),
        F.max("_total").alias("_total"),
    )
    upto = (
        Window.partitionBy(*part, "_bucket")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        one.withColumn("before", F.col("_before") + F.sum("ties").over(upto) - F.col("ties"))
        .withColumn("ask", F.explode(asks(F.col("_total"))))
        .where("ask.k >= before and ask.k < before + ties")
        .select(*part, "ask", "value", "before", "ties")
    )


def _prob_name(p: float) -> str:
    return "p" + f"{p * 100:g}".replace(".", "_")


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    mode: str = "exact",
    profile: ValueProfile | None = None,
) -> DataFrame:
    """Long table (by..., feature, p25, p50, ...), linear interpolation between order statistics.

    `exact` uses built-in `percentile` when a sketch shows few distinct values and rank selection
    otherwise; `select` and `approx` force one way. Features without values have no row.
    """
    by, cols = list(by), list(cols)
    names = [_prob_name(p) for p in probs]
    if mode == "approx":
        fn = lambda x: F.percentile_approx(x, list(probs), 10000)
        return _wide_quantiles(df, cols, names, by, fn)
    profile = profile or profile_values(df, cols)
    if mode == "exact" and not by:
        few = profile.few_valued(cols)
        if few:
            fn = lambda x: F.percentile(x, F.array(*[F.lit(float(p)) for p in probs]))
            direct = _wide_quantiles(df, few, names, by, fn)
            rest = [c for c in cols if c not in few]
            if not rest:
                return direct
            return direct.unionByName(quantiles(df, rest, probs, by, "select", profile))
    part = [*by, "feature"]
    if mode == "exact" and len(profile.few_valued(cols)) == len(cols):
        counts = long_values(df, cols, by).groupBy(*part, "value").agg(F.count("*").alias("n"))
        pct = F.percentile("value", F.array(*[F.lit(float(p)) for p in probs]), F.col("n"))
        got = counts.groupBy(*part).agg(pct.alias("_q"))
        return got.select(*part, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])

    def asks(total: Column) -> Column:
        # low + (high - low) * fraction, as one weighted sum of the two neighbours
        out = []
        for i, p in enumerate(probs):
            pos = (total - 1) * float(p)
            share = pos - F.floor(pos)
            for k, w in ((F.floor(pos), 1 - share), (F.floor(pos) + 1, share)):
                k = F.least(k, total - 1).cast("bigint")
                out.append(F.struct(k.alias("k"), F.lit(i).alias("i"), w.alias("w")))
        return F.array(*out)

    # one row for each group, feature and asked position
    few = not by or profile_keys(df, by).fits_broadcast(512 * len(cols) * 2 * len(probs))
    found = kth_values(long_values(df, cols, by, profile), part, asks, few)
    aggs = [
        F.sum(F.when(F.col("ask.i") == i, F.col("ask.w") * F.col("value"))).alias(n)
        for i, n in enumerate(names)
    ]
    return found.groupBy(*part).agg(*aggs)


def _wide_quantiles(df, cols, names, by, fn) -> DataFrame:
    aggs = [fn(numeric_of(df, c)).alias(f"_q{i}") for i, c in enumerate(cols)]
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    rows = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(f"_q{i}").alias("q")) for i, c in enumerate(cols)]
    )
    return (
        wide.select(*by, F.explode(rows).alias("_r"))
        .where("_r.q is not null")
        .select(*by, "_r.feature", *[F.col("_r.q")[i].alias(n) for i, n in enumerate(names)])
    )


def hash_positions(df: DataFrame, order: Sequence[Column], bucket: Column) -> DataFrame:
    """Add `_pos` = 0-based position by (bucket, order...); buckets must be evenly filled."""
    binned = df.withColumn("_bucket", bucket)
    totals = binned.groupBy("_bucket").agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offs = totals.select(
        F.col("_bucket").alias("_b"), (F.sum("_n").over(upto) - F.col("_n")).alias("_off")
    )
    inside = Window.partitionBy("_bucket").orderBy(*order)
    return (
        binned.join(F.broadcast(offs), F.col("_bucket") == F.col("_b"))
        .withColumn("_pos", F.col("_off") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_b", "_off")
    )


