"""Exact decision trees: every value of every feature is tried as a split, in one pass a level.

A split's gain needs sums over the rows on either side. Along the order of values those are prefix
sums: distributed by the buckets of `order`, with bucket totals as offsets, for all features and
nodes at once. Equal values fold first, so a value of a third of the rows is one line.

For classes, the sum of squared class counts left of a split is a prefix sum too: a line of n rows of
a class that has L rows up to and with it adds L^2 - (L - n)^2. So classes stay rows, whatever their
number, and no list of classes is ever made.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyspark.operators.lineage import cut
from studyspark.operators.order import long_values, profile_values

CLASSES, NUMBERS = "classification", "regression"
MOST_DEPTH = 10  # a level's splits are literals of the plan: at most 1023
_KEY = ["_node", "feature"]


def _whole(x: Column) -> Column:
    """Squares of row counts pass 64 bits."""
    return x.cast("decimal(20, 0)")


def _prefixed(lines: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Lines (node, feature, _bucket, value, cols..) with `cols` summed up to each value, and `next`,
    the value after it. A value is one line."""
    along = Window.partitionBy(*_KEY).orderBy("_bucket")
    totals = lines.groupBy(*_KEY, "_bucket").agg(*[F.sum(c).alias(c) for c in cols], F.min("value").alias("least"))
    # one row per bucket of a node's feature
    offsets = totals.select(
        *[F.col(c).alias(f"_b_{c}") for c in (*_KEY, "_bucket")],
        *[F.coalesce(F.sum(c).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_o_{c}") for c in cols],
        F.lead("least").over(along).alias("_beyond"),
    )
    inside = Window.partitionBy(*_KEY, "_bucket").orderBy("value")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.lit(True)
    for c in (*_KEY, "_bucket"):
        same = same & (F.col(c) == F.col(f"_b_{c}"))
    return (
        lines.join(offsets, same)
        .withColumns({f"_s_{c}": F.col(f"_o_{c}") + F.sum(c).over(upto) for c in cols})
        .select(
            *_KEY,
            "value",
            *[F.col(f"_s_{c}").alias(c) for c in cols],
            F.coalesce(F.lead("value").over(inside), F.col("_beyond")).alias("next"),
        )
    )


def _class_lines(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Per value: rows, growth of the squared counts on its left, and the counts' product sum."""
    lines = rows.groupBy(*_KEY, "_bucket", "value", "_y").agg(F.count(F.lit(1)).alias("n"))
    of_class = [*_KEY, "_y"]
    buckets = lines.groupBy(*of_class, "_bucket").agg(F.sum("n").alias("in_bucket"))
    whole = Window.partitionBy(*of_class)
    ahead = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(
        *[F.col(c).alias(f"_c_{c}") for c in (*of_class, "_bucket")],
        F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)).alias("_before"),
        F.sum("in_bucket").over(whole).alias("_all"),
    )
    same = F.lit(True)
    for c in (*of_class, "_bucket"):
        same = same & (F.col(c) == F.col(f"_c_{c}"))
    upto = (
        Window.partitionBy(*of_class, "_bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    left = F.col("_before") + F.sum("n").over(upto)
    counted = lines.join(offsets, same).withColumn("_left", left)
    n = F.col("n")
    return counted.groupBy(*_KEY, "_bucket", "value").agg(
        F.sum("n").alias("n"),
        F.sum(_whole(n) * _whole(2 * F.col("_left") - n)).alias("squares"),
        F.sum(_whole(n) * _whole(F.col("_all"))).alias("cross"),
    ), ["n", "squares", "cross"]


def best_splits(rows: DataFrame, features: Sequence[str], task: str, min_leaf: int = 3) -> DataFrame:
    """The best split of each node and feature of rows (_node, _y, features..).

    (_node, feature, threshold, n, n_left, n_right, gain, score): rows up to the threshold, halfway
    between two neighbouring values, go left. `gain` is the decrease of Gini impurity or of variance
    by the split, of equal ones the lowest threshold counts. Each side has `min_leaf` rows or more. A
    row without a feature's value takes no part in its splits; rows without `_y` take no part at all.
    Nodes and features without a split are left out.
    """
    features = list(features)
    rows = rows.where(F.col("_y").isNotNull())
    profile = profile_values(rows, features)
    kept = ["_node", "_y"]
    if task == CLASSES:
        lines, cols = _class_lines(long_values(rows, features, kept, profile))
    else:
        # numbers from their mean keep the squares small
        mean = rows.agg(F.avg("_y")).first()[0] or 0.0
        centred = rows.withColumn("_y", F.col("_y").cast("double") - F.lit(float(mean)))
        lines = (
            long_values(centred, features, kept, profile)
            .groupBy(*_KEY, "_bucket", "value")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("sum"))
        )
        cols = ["n", "sum"]
    lines = cut(lines)
    ends = lines.groupBy(*[F.col(c).alias(f"_e_{c}") for c in _KEY]).agg(*[F.sum(c).alias(f"all_{c}") for c in cols])
    left = _prefixed(lines, cols).where(F.col("next").isNotNull())
    # one row per node and feature
    both = left.join(ends, (F.col("_node") == F.col("_e__node")) & (F.col("feature") == F.col("_e_feature")))
    n, n_left = F.col("all_n"), F.col("n")
    n_right = n - n_left
    if task == CLASSES:
        # right counts are all less left ones: squares of differences from sums that are prefix sums
        left_squares, all_squares = F.col("squares"), F.col("all_cross")
        right_squares = all_squares - 2 * F.col("cross") + left_squares
        score = left_squares.cast("double") / n_left + right_squares.cast("double") / n_right
        parent = all_squares.cast("double") / n
    else:
        score = F.pow("sum", F.lit(2)) / n_left + F.pow(F.col("all_sum") - F.col("sum"), F.lit(2)) / n_right
        parent = F.pow("all_sum", F.lit(2)) / n
    found = both.where((n_left >= min_leaf) & (n_right >= min_leaf)).select(
        *_KEY,
        F.struct(
            score.alias("score"),
            (-F.col("value")).alias("low"),
            ((F.col("value") + F.col("next")) / 2).alias("threshold"),
            n.alias("n"),
            n_left.alias("n_left"),
            n_right.alias("n_right"),
            ((score - parent) / n).alias("gain"),
        ).alias("split"),
    )
    names = ["threshold", "n", "n_left", "n_right", "gain", "score"]
    best = found.groupBy(*_KEY).agg(F.max("split").alias("split"))
    return best.select(*_KEY, *[F.col(f"split.{c}") for c in names])


@dataclass(frozen=True)
class Split:
    node: int
    feature: str
    threshold: float
    n: int
    n_left: int
    n_right: int
    gain: float


@dataclass(frozen=True)
class ExactTree:
    """Splits by node (1 is the root, 2i and 2i + 1 the children of i) and the value of each leaf."""

    task: str
    splits: tuple[Split, ...]
    leaves: DataFrame

    def node_of(self) -> Column:
        """The leaf of a row; a missing value goes right."""
        return _moved(F.lit(1).cast("bigint"), self.splits)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds `_pred`."""
        # at most 2^MOST_DEPTH leaves
        leaves = F.broadcast(self.leaves.select(F.col("_node").alias("_leaf"), F.col("value").alias("_pred")))
        return df.withColumn("_leaf", self.node_of()).join(leaves, "_leaf", "left").drop("_leaf")

    def importance(self) -> dict[str, float]:
        """Share of each feature in the total decrease of impurity, weighted by rows."""
        sums: dict[str, float] = {}
        for s in self.splits:
            sums[s.feature] = sums.get(s.feature, 0.0) + s.n * s.gain
        total = sum(sums.values())
        return {c: v / total for c, v in sorted(sums.items(), key=lambda kv: (-kv[1], kv[0]))} if total else {}


def _moved(node: Column, splits: Sequence[Split]) -> Column:
    """Where rows of `node` end up after `splits`, which are listed level by level."""
    for level in sorted({s.node.bit_length() for s in splits}):
        step = F.when(F.lit(False), node)
        for s in (s for s in splits if s.node.bit_length() == level):
            left = F.coalesce(F.col(f"`{s.feature}`") <= F.lit(s.threshold), F.lit(False))
            step = step.when(node == s.node, F.when(left, F.lit(2 * s.node)).otherwise(F.lit(2 * s.node + 1)))
        node = step.otherwise(node).cast("bigint")
    return node


def grow_tree(
    df: DataFrame, features: Sequence[str], target: str, task: str, depth: int = 1, min_leaf: int = 3
) -> ExactTree:
    """A tree of numeric features, exact whatever the number of rows, values or classes.

    One job per level finds the splits of all its nodes; only they come to the driver. A node is split
    if that lowers its impurity; of equal features the first listed one is taken. An empty table, or
    one without a split, gives a tree of one leaf or none.
    """
    if not 0 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must be 0 to {MOST_DEPTH}")
    features = list(features)
    y = F.col(f"`{target}`")
    rows = cut(df.where(y.isNotNull()).select(y.alias("_y"), *[F.col(f"`{c}`").cast("double").alias(c) for c in features]))
    splits: list[Split] = []
    rank = F.create_map(*[F.lit(x) for i, c in enumerate(features) for x in (c, i)])
    for level in range(depth):
        node = _moved(F.lit(1).cast("bigint"), splits)
        # nodes that did not split stay on an upper level and are done
        here = rows.withColumn("_node", node).where(F.col("_node") >= 1 << level)
        found = best_splits(here, features, task, min_leaf).where("gain > 1e-12")
        order = F.struct("gain", (-rank[F.col("feature")]).alias("first"))
        chosen = found.groupBy("_node").agg(F.max_by(F.struct("*"), order).alias("s")).select("s.*").collect()
        if not chosen:
            break
        splits += [
            Split(r["_node"], r["feature"], r["threshold"], r["n"], r["n_left"], r["n_right"], r["gain"])
            for r in sorted(chosen, key=lambda r: r["_node"])
        ]
    placed = rows.withColumn("_node", _moved(F.lit(1).cast("bigint"), splits))
    if task == CLASSES:
        counts = placed.groupBy("_node", "_y").agg(F.count(F.lit(1)).alias("n"))
        leaves = _majority(counts)
    else:
        leaves = placed.groupBy("_node").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("value"))
    return ExactTree(task, tuple(splits), cut(leaves))


def _majority(counts: DataFrame) -> DataFrame:
    """(_node, n, value): the most frequent class of each node, of equal ones the smallest."""
    top = counts.groupBy("_node").agg(F.sum("n").alias("n"), F.max("n").alias("_top"))
    return (
        counts.select("_node", "_y", F.col("n").alias("_n"))
        .join(F.broadcast(top), "_node")
        .where("_n = _top")
        .groupBy("_node", "n")
        .agg(F.min("_y").alias("value"))
    )
