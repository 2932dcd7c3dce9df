import itertools
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from studyspark.operators import compare, paired, progression


def frame(spark, groups):
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs]
    return spark.createDataFrame(rows, "g string, x double")


def test_exact_u_by_enumeration(spark):
    a, b = [1.1, 2.2, 9.0], [3.0, 4.5, 5.5, 8.0]
    r = compare.compare_groups(frame(spark, {"a": a, "b": b}), ["x"], "g").first()
    both = a + b
    u = lambda xs, ys: sum(x > y for x in xs for y in ys)
    top = max(u(a, b), u(b, a))
    ways = [
        u([both[i] for i in pick], [both[i] for i in range(7) if i not in pick])
        for pick in itertools.combinations(range(7), 3)
    ]
    p = min(1.0, 2 * sum(w >= top for w in ways) / len(ways))
    assert r["method"] == "exact" and r["p_value"] == pytest.approx(p, abs=1e-4)
    assert r["statistic"] == u(a, b)


def test_ties_use_the_normal_tail(spark):
    a, b = [1, 2, 2, 3], [2, 3, 4, 5, 5]
    r = compare.compare_groups(frame(spark, {"a": a, "b": b}), ["x"], "g").first()
    rank = pd.Series(a + b, dtype=float).rank()
    u = rank[:4].sum() - 10
    t = pd.Series(a + b).value_counts()
    sigma = math.sqrt(20 / 12 * (10 - (t**3 - t).sum() / 72))
    z = (max(u, 20 - u) - 10 - 0.5) / sigma
    assert r["method"] == "asymptotic"
    assert r["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-4)
    swapped = compare.compare_groups(frame(spark, {"a": a, "b": b}), ["x"], "g", reference_group="b").first()
    assert swapped["effect_size"] == -r["effect_size"]
    assert swapped["statistic"] + r["statistic"] == 20
    assert (swapped["group_a"], swapped["group_b"]) == ("b", "a")


def test_lonely_groups_leave(spark):
    groups = {"a": [1, 2, 3, 9], "b": [4, 5, 6, 7], "one": [2.5], "c": []}
    df = frame(spark, groups).unionByName(spark.createDataFrame([(None, 5.0)], "g string, x double"))
    with_one = compare.compare_groups(df, ["x"], "g").first()
    without = compare.compare_groups(df.where("g in ('a', 'b')"), ["x"], "g").first()
    assert with_one["n_groups"] == 2 and with_one["n_total"] == 8
    assert with_one["statistic"] == without["statistic"] and with_one["p_value"] == without["p_value"]


def test_kruskal_and_eta(spark):
    groups = {"a": [1, 2, 3, 4], "b": [2, 4, 6, 8], "c": [5, 6, 7, 9, 11], "d": [1, 1]}
    r = compare.compare_groups(frame(spark, groups), ["x"], "g").first()
    xs = [x for v in groups.values() for x in v]
    n, rank = len(xs), pd.Series(xs, dtype=float).rank()
    at, h = 0, 0.0
    for v in groups.values():
        h += rank[at : at + len(v)].sum() ** 2 / len(v)
        at += len(v)
    t = pd.Series(xs).value_counts()
    h = (12 / (n * (n + 1)) * h - 3 * (n + 1)) / (1 - (t**3 - t).sum() / (n**3 - n))
    assert r["statistic"] == pytest.approx(h, abs=1e-4)
    p = math.erfc(math.sqrt(h / 2)) + math.sqrt(2 * h / math.pi) * math.exp(-h / 2)  # three degrees
    assert r["p_value"] == pytest.approx(p, abs=1e-4)
    gm = np.mean(xs)
    ssb = sum(len(v) * (np.mean(v) - gm) ** 2 for v in groups.values())
    assert r["effect_size"] == pytest.approx(ssb / sum((x - gm) ** 2 for x in xs), abs=1e-4)


def test_constant_groups(spark):
    r = compare.compare_groups(frame(spark, {"a": [1, 1, 1], "b": [1, 1]}), ["x"], "g").first()
    assert r["effect_size"] == 0.0 and r["p_value"] == 1.0
    row = spark.range(1).select(
        compare.pooled_d(*[F.lit(v) for v in (1.0, 1.0, 0.0, 0.0, 3, 3)], zero_sd="null").alias("d")
    ).first()
    assert row["d"] is None


def test_nothing_to_compare(spark):
    got = compare.compare_groups(frame(spark, {"a": [1, 2]}), ["x", "absent"], "g")
    assert got.count() == 0 and "p_value" in got.columns


def test_far_from_zero_values_keep_their_spread(spark):
    base = 1e9
    groups = {"a": [base + x for x in range(10)], "b": [base + x + 3 for x in range(12)]}
    r = compare.compare_groups(frame(spark, groups), ["x"], "g").first()
    a, b = np.array(groups["a"]), np.array(groups["b"])
    sp = math.sqrt((9 * a.var(ddof=1) + 11 * b.var(ddof=1)) / 20)
    assert r["effect_size"] == pytest.approx((a.mean() - b.mean()) / sp, abs=1e-4)


def test_wide_stats_and_ranking(spark):
    stats = compare.comparison_stats(frame(spark, {"a": [1, 2], "b": [3, 5]}), ["x"], "g")
    row = compare.stats_wide(stats, ["a", "b"]).first()
    assert (row["mean_a"], row["n_b"]) == (1.5, 2)
    cmp = spark.createDataFrame([("p", -0.9), ("q", 0.3), ("r", None)], "feature string, effect_size double")
    assert [r["feature"] for r in compare.top_effects(cmp, 2).collect()] == ["q", "p"]
    assert [r["feature"] for r in compare.top_effects(cmp, 1, by="abs").collect()] == ["p"]


def pairs_frame(spark, rows):
    return spark.createDataFrame(rows, "e string, c string, x double")


def many(seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f"e{i % 7}", "a" if rng.random() < 0.5 else "b", round(float(rng.normal()), 1)) for i in range(80)]
    return rows + [(None, "a", 1.0), ("e0", "other", 3.0), ("e1", "a", None)]


def brute(rows):
    return [
        (e, x, y)
        for e, c, x in rows
        for f, k, y in rows
        if e == f and e is not None and c == "a" and k == "b" and x is not None and y is not None
    ]


def test_many_to_many_pairs(spark):
    rows = many()
    r = paired.within_subject(pairs_frame(spark, rows), ["x"], "e", "c", "a", "b").first()
    ps = brute(rows)
    a, b = np.array([p[1] for p in ps]), np.array([p[2] for p in ps])
    assert r["n_pairs"] == len(ps)
    assert r["mean_diff"] == pytest.approx((a - b).mean(), abs=1e-4)
    sp = math.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2)
    assert r["effect_size_d"] == pytest.approx((a.mean() - b.mean()) / sp, abs=1e-4)
    d = pd.Series(a - b)
    d = d[d != 0]
    rank = d.abs().rank()
    wp, wn, n = rank[d > 0].sum(), rank[d < 0].sum(), len(d)
    t = d.abs().value_counts()
    se = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (t**3 - t).sum() / 48)
    z = (min(wp, wn) - n * (n + 1) / 4) / se
    assert r["test"] == "Wilcoxon"
    assert r["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-4)


def test_hot_entity_is_spread(spark, monkeypatch):
    rows = many(5)
    plain = paired.within_subject(pairs_frame(spark, rows), ["x"], "e", "c", "a", "b").first()
    profile = paired.profile_keys
    monkeypatch.setattr(paired, "profile_keys", lambda df, keys, **kw: profile(df, keys, hot_share=0, hot_min_rows=3))
    assert paired.within_subject(pairs_frame(spark, rows), ["x"], "e", "c", "a", "b").first() == plain


def ranked(differences):
    """Signed rank sums of pair differences, plainly."""
    d = pd.Series(differences)
    d = d[d != 0]
    rank = d.abs().rank()
    return min(rank[d > 0].sum(), rank[d < 0].sum()), len(d)


def folds(monkeypatch):
    """How many (entity, feature) groups were convolved."""
    seen = []
    dense = paired._dense

    def watched(*args):
        out = dense(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(paired, "_dense", watched)
    return seen


def test_convolved_differences_are_exact(spark, monkeypatch):
    """Whole numbers, one hot entity, repeated values, negative ones, and an entity of one side only."""
    rng = np.random.default_rng(3)
    rows = [("hot", "a" if rng.random() < 0.5 else "b", float(rng.integers(-20, 20))) for _ in range(300)]
    rows += [(f"e{i}", c, float(rng.integers(0, 4))) for i in range(5) for c in "ab"]
    rows += [("one", "a", 3.0), (None, "b", 2.0), ("hot", "a", None)]
    seen = folds(monkeypatch)
    r = paired.within_subject(pairs_frame(spark, rows), ["x"], "e", "c", "a", "b").first()
    ps = brute(rows)
    w, _ = ranked([x - y for _, x, y in ps])
    assert seen == [1] and (r["n_pairs"], r["statistic"]) == (len(ps), pytest.approx(w, abs=1e-3))
    monkeypatch.setattr(paired, "GRID_CELLS", 0)
    assert paired.within_subject(pairs_frame(spark, rows), ["x"], "e", "c", "a", "b").first() == r
    assert seen == [1, 0]


def test_decimal_ties(spark, monkeypatch):
    """With decimals, equal decimal differences are ties on either way; values off the grid are joined as they are."""
    rows = many(9)
    seen = folds(monkeypatch)
    exact = [round(10 * x) - round(10 * y) for _, x, y in brute(rows)]
    r = paired.within_subject(pairs_frame(spark, rows), ["x"], "e", "c", "a", "b", decimals=1).first()
    assert r["statistic"] == pytest.approx(ranked(exact)[0], abs=1e-3)
    monkeypatch.setattr(paired, "GRID_CELLS", 0)
    assert paired.within_subject(pairs_frame(spark, rows), ["x"], "e", "c", "a", "b", decimals=1).first() == r
    plain = paired.within_subject(pairs_frame(spark, rows), ["x"], "e", "c", "a", "b").first()
    off = paired.within_subject(pairs_frame(spark, rows), ["x"], "e", "c", "a", "b", decimals=0).first()
    assert len(seen) == 2 and off == plain


def test_large_counts_convolve_exactly():
    """Counts near 2^31 on both sides: totals near 2^62, each exact."""
    rng = np.random.default_rng(11)
    n = 50
    frame = pd.DataFrame(
        {
            "feature": "x",
            "value": np.tile(np.arange(n, dtype=float), 2),
            "_in_a": np.repeat([True, False], n),
            "c": rng.integers(2**24, 2**25, 2 * n),
        }
    )
    got = paired._convolved()(frame)
    a, b = frame["c"][:n].tolist(), frame["c"][n:].tolist()
    want = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            want[i - j] = want.get(i - j, 0) + x * y
    signed = np.where(got["positive"], got["value"], -got["value"]).astype(int)
    assert dict(zip(signed.tolist(), got["w"].tolist())) == want


def test_widest_span_convolves_exactly():
    """As many steps as are convolved, hot cells at both ends: the pairs of some distances, and all of them."""
    n, rng = paired.GRID_CELLS, np.random.default_rng(1)
    a, b = rng.integers(1, 2**10, n), rng.integers(1, 2**10, n)
    a[0], b[-1] = 2**31, 2**30
    value, in_a = np.tile(np.arange(n, dtype=float), 2), np.repeat([True, False], n)
    got = paired._convolved()(pd.DataFrame({"feature": "x", "value": value, "_in_a": in_a, "c": np.concatenate([a, b])}))
    assert int(got["w"].sum()) == int(a.sum()) * int(b.sum())
    signed = np.where(got["positive"], got["value"], -got["value"]).astype(int)
    for d in (0, 1, -1, 500_000, n - 1, 1 - n):
        want = int((a[d:] * b[: n - d]).sum()) if d >= 0 else int((a[: n + d] * b[-d:]).sum())
        assert got["w"][signed == d].tolist() == [want]


def test_exact_signed_ranks(spark):
    a, b = [1.0, 2.5, 3.1, 4.7, 6.0, 9.9], [1.5, 2.2, 5.0, 3.0, 2.0, 3.0]
    rows = [(f"e{i}", c, v) for i, (x, y) in enumerate(zip(a, b)) for c, v in (("a", x), ("b", y))]
    r = paired.within_subject(pairs_frame(spark, rows), ["x"], "e", "c", "a", "b").first()
    d = pd.Series(a) - pd.Series(b)
    rank = d.abs().rank()
    w = min(rank[d > 0].sum(), rank[d < 0].sum())
    sums = [sum(s) for s in itertools.product(*[(0, k) for k in range(1, 7)])]
    p = min(1.0, 2 * sum(s <= w for s in sums) / len(sums))
    assert r["method"] == "exact" and r["p_value"] == pytest.approx(p, abs=1e-4)


def test_equal_pairs_fall_back(spark):
    rows = [(f"e{i}", c, float(i)) for i in range(6) for c in "ab"]
    r = paired.within_subject(pairs_frame(spark, rows), ["x"], "e", "c", "a", "b").first()
    assert (r["test"], r["p_value"], r["mean_diff"]) == ("Paired t-test", None, 0.0)
    assert paired.within_subject(pairs_frame(spark, rows[:8]), ["x"], "e", "c", "a", "b").count() == 0


def test_slopes(spark):
    rows = [("two", 0.0, 1.0), ("two", 1.0, 2.0)]
    rows += [("line", float(t), 3.0 * t + 1) for t in range(4)]
    rows += [("still", 2.0, float(t)) for t in range(3)]
    rows += [("flat", float(t), 5.0) for t in range(5)]
    rows += [("noisy", float(t), y) for t, y in enumerate([1.0, 3.0, 2.0, 5.0, 4.0])]
    rows += [(None, 0.0, 1.0)] * 4 + [("line", 9.0, None), ("line", None, 1.0)]
    got = {r["e"]: r for r in progression.slopes(spark.createDataFrame(rows, "e string, t double, y double"), "e", "t", "y").collect()}
    assert set(got) == {"line", "still", "flat", "noisy"}
    assert (got["line"]["slope"], got["line"]["intercept"], got["line"]["r2"], got["line"]["p_value"]) == (3.0, 1.0, 1.0, 0.0)
    assert got["still"]["slope"] is None and got["still"]["status"] == "constant_time"
    assert (got["flat"]["slope"], got["flat"]["r2"], got["flat"]["p_value"]) == (0.0, 0.0, 1.0)
    # r = 0.8 with three degrees of freedom: published p of t = 2.3094
    assert got["noisy"]["slope"] == pytest.approx(0.8) and got["noisy"]["p_value"] == pytest.approx(0.1041, abs=1e-4)


def test_progression_summary(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 9)], "e int, slope double")
    s = progression.progression_summary(df).first()
    assert (s["n_subjects"], s["mean_slope"], s["median_slope"]) == (8, 4.5, 4.5)
    assert s["fast_progressor_threshold"] == 6.25 and s["n_fast_progressors"] == 2 and s["pct_fast"] == 25.0
    empty = progression.progression_summary(df.where("1 = 0")).first()
    assert empty["n_subjects"] == 0 and empty["mean_slope"] is None


def test_condition_analysis_picks_slopes(spark):
    df = spark.range(100).select((F.col("id") % 4).alias("e"), F.col("id").alias("t"), (F.col("id") * 2.0).alias("y"))
    got = compare.condition_analysis(df, "t", "y", "e")
    assert got["summary"].first()["mean_slope"] == 2.0
    assert set(compare.condition_analysis(df, "e", "y")) == {"condition_stats", "comparison"}


def test_exact_u_at_any_size(spark):
    """Eight tie-free values against thousands take the exact test, equal to a plain count."""
    few = [10.5 + 613 * k for k in range(8)]
    rows = [("a", v) for v in few] + [("b", float(k)) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double")
    r = compare.compare_groups(df, ["x"], "g").first()
    m, n = 8, 3000
    u = int(min(r["statistic"], m * n - r["statistic"]))
    row = [0] * (u + 1)
    row[0] = 1
    for j in range(1, m + 1):
        row = [row[k] - (row[k - n - j] if k >= n + j else 0) for k in range(u + 1)]
        for k in range(j, u + 1):
            row[k] += row[k - j]
    want = min(1.0, 2 * sum(row) / math.comb(m + n, m))
    assert r["method"] == "exact" and r["p_value"] == pytest.approx(want, abs=1e-4)


def gaussian_upto(m, n, u):
    """Placements with statistic at most u, by the product of the Gaussian binomial."""
    chances = [1] + [0] * u
    for j in range(1, m + 1):
        for i in range(u, n + j - 1, -1):
            chances[i] -= chances[i - n - j]
        for i in range(j, u + 1):
            chances[i] += chances[i - j]
    return sum(chances)


@pytest.mark.parametrize("m,n", [(1, 1), (1, 900), (2, 3), (3, 3), (5, 40), (7, 8), (8, 8), (8, 300)])
def test_exact_u_of_any_size(m, n):
    from math import comb

    step = compare._exact_u()
    us = sorted({0, 1, m * n // 3, m * n // 2, m * n - 1 if m * n > 1 else 1, m * n})
    frame = pd.DataFrame({"n_a": float(n), "n_b": float(m), "u": [float(u) for u in us], "exact": True, "p_raw": 0.0})
    (got,) = step(iter([frame]))
    want = [min(1.0, 2 * gaussian_upto(m, n, min(u, m * n - u)) / comb(m + n, m)) for u in us]
    assert got["p_raw"].tolist() == pytest.approx(want, rel=1e-12)


def test_exact_u_of_a_billion_rows():
    step = compare._exact_u()
    frame = pd.DataFrame({"n_a": 8.0, "n_b": 1e9, "u": [4e9, 1e9, 0.0], "exact": True, "p_raw": 0.0})
    start = time.time()
    (got,) = step(iter([frame]))
    assert time.time() - start < 2
    # so many rows stand evenly between the eight: the mean of eight uniform places
    half, eighth = got["p_raw"][0], got["p_raw"][1]
    assert half == pytest.approx(1.0, abs=1e-6)
    assert eighth == pytest.approx(2 / 40320, rel=1e-6)  # volume of a sum of eight uniforms up to 1
    assert 0 < got["p_raw"][2] < 1e-60
