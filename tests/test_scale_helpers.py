"""Skew-safe joins, exact order statistics, forest and components against brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from letterwatch.functions import frames
from letterwatch.operators import components, iforest
from letterwatch.operators.anomaly import feature_names


def test_salted_join_equals_plain_join(spark):
    facts = spark.range(5000).select(F.col("id").alias("mail_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
                                     .otherwise((F.col("id") % 700).cast("string")).alias("k"))
    counts = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    small = frames.spread_join(facts, counts, "k")
    salted = frames.spread_join(facts, counts, "k", broadcast_keys=0)
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, salted.collect()), key=str)
    assert salted.where("n IS NULL").isEmpty() and salted.count() == 5000


def test_salted_join_splits_a_hot_key_that_is_absent(spark):
    facts = spark.range(20_000).select(F.col("id").alias("mail_id"), F.when(F.col("id") % 10 != 0, "absent").otherwise((F.col("id") % 700).cast("string")).alias("k"))
    known = facts.where("k <> 'absent'").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        joined = frames.spread_join(facts, known, "k", broadcast_keys=0)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and joined.where("n IS NULL").count() == 18_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(sizes) < 2 * 20_000 / len(sizes)


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.933, 1.0])
def test_exact_quantile(spark, q):
    values = np.round(np.random.default_rng(1).exponential(size=4001), 3)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert frames.exact_quantile(df, "v", q) == pytest.approx(np.quantile(values, q))


def test_value_at_rank_narrows(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("v"))
    ordered = sorted(i * 7919 % 3001 for i in range(3000))
    for rank in (0, 1, 1499, 2998, 2999):
        assert frames.value_at_rank(df, "v", rank, buckets=5, small=3) == ordered[rank]


def test_rank_is_bracketed_by_a_sketch(spark):
    values = [float(i * 7919 % 30_011) for i in range(30_000)] + [5000.5] * 4000                    # one value holds many ranks
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double").repartition(5)
    for q in (0.0, 0.1, 0.5, 0.1662, 0.9999, 1.0):
        assert frames.exact_quantile(df, "v", q) == pytest.approx(np.quantile(values, q), abs=1e-9)
    near, below, n = frames.around_rank(df.where("v IS NOT NULL AND NOT isnan(v)"), "v", 0.5, lambda n: [n // 2])
    assert n == 34_000 and near.count() < 300 and frames.value_at_rank(near, "v", n // 2 - below) == sorted(values)[n // 2]
    assert frames.exact_quantile(df.limit(0), "v", 0.5) is None
    assert frames.values_at(df.where("v IS NOT NULL AND NOT isnan(v)"), "v", [0, 33_999], small=10) == [min(values), max(values)]


def test_groupings_of_one_scan(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", None, 3), (None, 1, 5), (None, None, 7)], "k string, g int, v int")
    made = frames.rolled(df, {"k": ["k"], "both": ["k", "g"], "odd": {"odd": F.col("v") % 2 == 1}, "all": []}, n=F.count(F.lit(1)), s=F.sum("v"))
    rows = {name: sorted(map(tuple, part.collect()), key=str) for name, part in made.items()}
    assert rows["k"] == [("a", 2, 5), (None, 2, 12)] and rows["all"] == [(4, 17)] and rows["odd"] == [(False, 1, 2), (True, 3, 15)]
    assert rows["both"] == sorted([("a", 1, 1, 2), ("a", None, 1, 3), (None, 1, 1, 5), (None, None, 1, 7)], key=str)
    groups, total = frames.totalled(df.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "n")
    assert {r["t"] for r in groups.select(total.alias("t")).collect()} == {4}
    assert frames.rolled(df.limit(0), {"k": ["k"], "all": []}, n=F.count(F.lit(1)))["k"].collect() == []


def test_arrival_orders_times_then_numbers(spark):
    rows = [(5, "2024-01-02"), (-3, "2024-01-02"), (2, None), (9, "1960-05-05"), (2 ** 62, "2024-01-01"), (1, None)]
    df = spark.createDataFrame(rows, "mail_id long, time string").withColumn("a", frames.arrival())
    got = df.orderBy("a").select(frames.arrived("a").alias("m")).collect()
    assert [r["m"] for r in got] == [9, 2 ** 62, -3, 5, 1, 2]
    plan = df.groupBy("time").agg(F.min("a"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_dense_positions(spark):
    df = spark.createDataFrame([(v,) for v in (40, 10, 30, 20, 99)], "v long")
    got = {r["v"]: r["p"] for r in frames.dense_positions(df, "v", "p").collect()}
    assert got == {10: 0, 20: 1, 30: 2, 40: 3, 99: 4}


def brute_clusters(points, eps):
    """Density clusters with two points enough, numbered by first member."""
    n = len(points)
    near = np.linalg.norm(points[:, None] - points[None], axis=2) <= eps + 1e-12
    label, current = np.full(n, -1), 0
    for i in range(n):
        if label[i] >= 0 or near[i].sum() < 2:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if label[j] < 0:
                label[j] = current
                todo += [k for k in np.flatnonzero(near[j]) if label[k] < 0]
        current += 1
    return label.tolist()


@pytest.mark.parametrize("dims,spread", [(1, 60.0), (2, 14.0), (3, 6.0)])
def test_clusters_equal_brute_force(spark, dims, spread):
    rng = np.random.default_rng(dims)
    points = np.round(rng.uniform(0, spread, size=(220, dims)), 2)
    points[:40] = points[40:80]                                  # exact copies
    points[100:130] = points[100] + rng.normal(0, 0.1, size=(30, dims))    # one dense spot
    rows = [(i, *map(float, p)) for i, p in enumerate(points)]
    columns = [f"f{d}" for d in range(dims)]
    df = spark.createDataFrame(rows, "mail_id long, " + ", ".join(f"{c} double" for c in columns))
    stats = {f"m_{c}": 0.0 for c in columns} | {f"s_{c}": 1.0 for c in columns}
    got = components.cluster_points(df, stats, columns, [], 0.5).orderBy("mail_id").collect()
    assert [r["cluster"] for r in got] == brute_clusters(points, 0.5)


@pytest.mark.parametrize("dims,spread,leaf,block", [(2, 14.0, 16, 64), (3, 6.0, 30, 1 << 17), (1, 60.0, 8, 16)])
def test_clusters_over_many_leaves_equal_brute_force(spark, monkeypatch, dims, spread, leaf, block):
    monkeypatch.setattr(components, "LEAF", leaf)
    monkeypatch.setattr(components, "BLOCK", block)
    test_clusters_equal_brute_force(spark, dims, spread)


def test_leaves_are_cut_by_counts_and_hold_every_point():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.01, size=(3000, 2)), rng.uniform(0, 100, size=(300, 2)), np.full((50, 2), 7.0)])      # a third and more in one spot
    tree = components.Tree(x, 16)
    sizes = np.bincount(tree.place(x), minlength=tree.leaves)
    assert tree.leaves == 16 and sizes.sum() == len(x) and sizes.max() <= 2 * len(x) / 16
    assert components.Tree(np.ones((50, 2)), 8).leaves == 1 and components.halved(np.ones((5, 1))) is None


def test_keys_hold_points_apart(spark):
    df = spark.createDataFrame([(i, float(i // 4) / 10, i % 2) for i in range(12)], "mail_id long, f0 double, k long")
    got = components.cluster_points(df, {"m_f0": 0.0, "s_f0": 1.0}, ["f0"], ["k"], 0.5).orderBy("mail_id").collect()
    assert [r["cluster"] for r in got] == [0, 1] * 6


def test_long_chains_get_one_label(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1003, 1001), (5, 5)]
    labels = {r["node"]: r["label"] for r in components.connected_labels(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert labels == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 1003: 1000}
    assert components.connected_labels(spark.createDataFrame([], "a long, b long")).collect() == []


def test_chain_is_one_cluster(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.4), (2, 0.8), (3, 9.0)], "mail_id long, f0 double")
    got = components.cluster_points(df, {"m_f0": 0.0, "s_f0": 1.0}, ["f0"], [], 0.5).orderBy("mail_id").collect()
    assert [r["cluster"] for r in got] == [0, 0, 0, -1]


def test_forest_finds_planted_mails_and_is_stable(spark):
    names = feature_names()
    usual = spark.range(2000).select(F.col("id").alias("mail_id"), *[
        ((F.col("id") * (i + 3)) % (5 if i < 4 else 2)).alias(c) for i, c in enumerate(names)])
    odd = spark.range(2000, 2020).select(F.col("id").alias("mail_id"), *[F.lit(60 + i).cast("long").alias(c) for i, c in enumerate(names)])
    features = usual.unionByName(odd)
    first = iforest.iforest_scores(features, names, trees=30)
    again = iforest.iforest_scores(features, names, trees=30)
    a = {r["mail_id"]: r["sample_score"] for r in first.collect()}
    assert a == {r["mail_id"]: r["sample_score"] for r in again.collect()}
    cut = np.quantile(list(a.values()), 0.05)
    assert all(a[i] < cut for i in range(2000, 2020))


def test_dense_positions_by_several_columns_with_nulls_and_a_hot_value(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") % 7 == 0, None).otherwise("cold").alias("k"), "id")
    got = frames.dense_positions(df, [F.col("k").asc_nulls_last(), F.col("id").desc()], "p").orderBy("p").collect()
    want = sorted(df.collect(), key=lambda r: (r["k"] is None, r["k"] or "", -r["id"]))
    assert [(r["k"], r["id"]) for r in got] == [tuple(r) for r in want] and [r["p"] for r in got] == list(range(2000))


def test_scratch_copies_lie_under_one_root(spark):
    frames.materialize(spark.range(3))
    assert frames.scratch_dir(spark).startswith(frames.scratch_root(spark) + "/")
    assert frames.scratch_root(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
