"""Exact splits against all splits tried one by one, and against Spark's own tree."""

import random
from collections import Counter

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from studyspark.operators.trees import CLASSES, NUMBERS, best_splits, grow_tree


def impurity(ys, task):
    if task == CLASSES:
        return 1 - sum(c * c for c in Counter(ys).values()) / len(ys) ** 2
    mean = sum(ys) / len(ys)
    return sum((y - mean) ** 2 for y in ys) / len(ys)


def plain_best(pairs, task, least):
    """(gain, threshold, n_left) of (value, y) pairs."""
    pairs = [(v, y) for v, y in pairs if v is not None and y is not None]
    values = sorted({v for v, _ in pairs})
    best = None
    for a, b in zip(values, values[1:]):
        left, right = [y for v, y in pairs if v <= a], [y for v, y in pairs if v > a]
        if min(len(left), len(right)) < least:
            continue
        gain = impurity([y for _, y in pairs], task) - (
            len(left) * impurity(left, task) + len(right) * impurity(right, task)
        ) / len(pairs)
        if best is None or gain > best[0] + 1e-12:
            best = (gain, (a + b) / 2, len(left))
    return best


def plain_tree(rows, features, task, depth, least, node=1):
    """{node: (feature, threshold, n_left, gain)} of rows (y, {feature: value})."""
    found = [(plain_best([(x[f], y) for y, x in rows], task, least), f) for f in features] if depth else []
    found = [(b, f) for b, f in found if b and b[0] > 1e-12]
    if not found:
        return {}
    top = max(b[0] for b, _ in found)
    (gain, threshold, n_left), f = next((b, f) for b, f in found if b[0] > top - 1e-12)
    left = [r for r in rows if r[1][f] is not None and r[1][f] <= threshold]
    right = [r for r in rows if r[1][f] is None or r[1][f] > threshold]
    return {
        node: (f, threshold, n_left, gain),
        **plain_tree(left, features, task, depth - 1, least, 2 * node),
        **plain_tree(right, features, task, depth - 1, least, 2 * node + 1),
    }


def made(seed, task, n=400):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        x = {"a": draw.choice([1.0, 2.0, 2.5, 7.0]), "b": draw.random() if draw.random() < 0.9 else None, "c": 3.0}
        noise = draw.random()
        if task == CLASSES:
            y = "p" if x["a"] > 2 and noise < 0.8 else draw.choice("pqrs") if noise < 0.95 else None
        else:
            y = x["a"] * 2 + (x["b"] or 0) * 5 + noise
        rows.append((y, x))
    return rows


@pytest.mark.parametrize("task", [CLASSES, NUMBERS])
@pytest.mark.parametrize("depth,least", [(1, 3), (3, 1), (3, 20)])
def test_trees_are_exact(spark, task, depth, least):
    rows = made(depth * 7 + least, task)
    kind = "string" if task == CLASSES else "double"
    df = spark.createDataFrame([(y, *x.values()) for y, x in rows], f"y {kind}, a double, b double, c double")
    tree = grow_tree(df, ["a", "b", "c"], "y", task, depth, least)
    known = [r for r in rows if r[0] is not None]
    want = plain_tree(known, ["a", "b", "c"], task, depth, least)
    assert {s.node: (s.feature, pytest.approx(s.threshold), s.n_left, pytest.approx(s.gain)) for s in tree.splits} == want
    assert sum(tree.importance().values()) == pytest.approx(1)
    # leaves: every row's prediction is its leaf's majority or mean
    got = tree.predict(df.where("y IS NOT NULL")).withColumn("leaf", tree.node_of()).collect()
    leaves = {}
    for r in got:
        leaves.setdefault(r["leaf"], []).append(r)
    for group in leaves.values():
        ys = [r["y"] for r in group]
        if task == CLASSES:
            best = min(Counter(ys).items(), key=lambda kv: (-kv[1], kv[0]))[0]
            assert all(r["_pred"] == best for r in group)
        else:
            assert all(r["_pred"] == pytest.approx(sum(ys) / len(ys)) for r in group)
    assert len(got) == len(known) and len(leaves) == len(tree.splits) + 1


def test_root_of_sparks_tree(spark, data):
    items = spark.read.parquet(f"{data}/lineitem.parquet").select("l_returnflag", "l_quantity", "l_discount", "l_tax")
    features = ["l_quantity", "l_discount", "l_tax"]
    ready = VectorAssembler(inputCols=features, outputCol="x").transform(
        StringIndexer(inputCol="l_returnflag", outputCol="label").fit(items).transform(items)
    )
    theirs = DecisionTreeClassifier(featuresCol="x", maxDepth=1, maxBins=64, minInstancesPerNode=3).fit(ready)
    node = theirs._call_java("rootNode")
    ours = grow_tree(items, features, "l_returnflag", CLASSES)
    (root,) = ours.splits
    assert features.index(root.feature) == node.split().featureIndex()
    assert root.threshold == pytest.approx(node.split().threshold())
    assert root.gain == pytest.approx(node.gain(), rel=1e-9)
    assert theirs.featureImportances[features.index(root.feature)] == ours.importance()[root.feature] == 1.0


def test_as_many_classes_as_rows_and_hot_values(spark):
    df = spark.range(5000).select(F.col("id").alias("y"), F.when(F.col("id") < 2000, 1.0).otherwise(F.col("id").cast("double")).alias("a"))
    (root,) = grow_tree(df, ["a"], "y", CLASSES, min_leaf=1).splits
    assert root.n == 5000 and root.gain == pytest.approx(1 / 5000)


def test_nothing_to_split(spark):
    df = spark.createDataFrame([], "y string, a double")
    tree = grow_tree(df, ["a"], "y", CLASSES)
    assert tree.splits == () and tree.importance() == {} and tree.leaves.count() == 0
    flat = spark.createDataFrame([("p", 1.0), ("q", 1.0), ("q", None)], "y string, a double")
    tree = grow_tree(flat, ["a"], "y", CLASSES, depth=3, min_leaf=1)
    assert tree.splits == () and [r["_pred"] for r in tree.predict(flat).collect()] == ["q"] * 3
    assert best_splits(flat.select(F.lit(1).alias("_node"), F.col("y").alias("_y"), "a"), ["a"], CLASSES).count() == 0
    with pytest.raises(ValueError):
        grow_tree(flat, ["a"], "y", CLASSES, depth=30)
