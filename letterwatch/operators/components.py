"""Clusters of anomalous mails: connected components of the "closer than eps" graph.

With two points enough for a cluster, density clustering equals these components.  Space is cut into leaves of about equal
numbers of points, by a tree fitted on a bounded sample.  A task joins the points of one leaf, or of two leaves whose boxes are
within eps, and gives back a spanning forest only; boxes decide most of it, so no group is ever paired point by point.
"""
from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.frames import dense_positions, materialize, spread_join
from .anomaly import anomaly_features, feature_names

# the small task functions travel with the job, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF = 16_384                      # points of a leaf, about, as long as there are fewer than MOST_LEAVES leaves
MOST_LEAVES = 4_096                # leaves whose boxes the driver holds
FIT_POINTS = 65_536                # points that the tree is fitted on
BLOCK = 1 << 17                    # pairs of points that are compared at once


class Tree:
    """Cuts of space: inner nodes have a column and a value, leaves a number."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.column, self.value, self.below, self.above, self.leaf, self.leaves = [], [], [], [], [], 0
        self._grow(sample, leaves)
        for name in ("column", "value", "below", "above", "leaf"):
            setattr(self, name, np.array(getattr(self, name)))

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        node = len(self.leaf)
        for part, blank in ((self.column, -1), (self.value, 0.0), (self.below, node), (self.above, node), (self.leaf, -1)):
            part.append(blank)
        cut = halved(x) if leaves > 1 and len(x) > 1 else None
        if cut is None:
            self.leaf[node], self.leaves = self.leaves, self.leaves + 1
            return node
        self.column[node], self.value[node], side = cut
        self.below[node] = self._grow(x[side], (leaves + 1) // 2)
        self.above[node] = self._grow(x[~side], leaves // 2)
        return node

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each point."""
        node = np.zeros(len(x), np.int64)
        while (self.column[node] >= 0).any():
            inner = self.column[node] >= 0
            low = x[np.arange(len(x)), np.maximum(self.column[node], 0)] <= self.value[node]
            node = np.where(inner, np.where(low, self.below[node], self.above[node]), node)
        return self.leaf[node]


def halved(x: np.ndarray):
    """(column, value, side) that cuts the points in about equal halves across their widest column; None if all are equal."""
    lo, hi = x.min(0), x.max(0)
    column = int(np.argmax(hi - lo))
    if not hi[column] > lo[column]:
        return None
    value = np.median(x[:, column])
    value = value if value < hi[column] else x[x[:, column] < value, column].max()
    return column, float(value), x[:, column] <= value


def gap2(lo_a, hi_a, lo_b, hi_b):
    """Squared least distance of boxes."""
    return (np.maximum(0.0, np.maximum(lo_b - hi_a, lo_a - hi_b)) ** 2).sum(-1)


def span2(lo_a, hi_a, lo_b, hi_b):
    """Squared largest distance of points of boxes."""
    return (np.maximum(hi_b - lo_a, hi_a - lo_b) ** 2).sum(-1)


class Forest:
    """Components of local points, as links are found."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def link(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        while (self.parent[self.parent] != self.parent).any():
            self.parent = self.parent[self.parent]
        return self.parent


def join_within(x: np.ndarray, a: np.ndarray, b: np.ndarray | None, near2: float, forest: Forest) -> None:
    """Link the points ``a`` with the points ``b`` within reach (the points ``a`` with each other if ``b`` is None)."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if b is None:
            if len(a) < 2:
                continue
            lo, hi = x[a].min(0), x[a].max(0)
            if span2(lo, hi, lo, hi) <= near2:
                _chain(a, forest)
            elif len(a) ** 2 <= BLOCK:
                _compare(x, a, a, near2, forest)
            else:
                side = halved(x[a])[2]
                todo += [(a[side], None), (a[~side], None), (a[side], a[~side])]
            continue
        lo_a, hi_a, lo_b, hi_b = x[a].min(0), x[a].max(0), x[b].min(0), x[b].max(0)
        if gap2(lo_a, hi_a, lo_b, hi_b) > near2:
            continue
        if span2(lo_a, hi_a, lo_b, hi_b) <= near2:
            forest.link(a[0], b[0])
            _tight(x, a, near2, forest)
            _tight(x, b, near2, forest)
        elif len(a) * len(b) <= BLOCK:
            _compare(x, a, b, near2, forest)
        else:
            swap = len(b) > len(a)
            large, other = (b, a) if swap else (a, b)
            side = halved(x[large])[2] if (x[large] != x[large[0]]).any() else np.arange(len(large)) < len(large) // 2
            todo += [(large[side], other), (large[~side], other)]


def _tight(x, rows, near2, forest) -> None:
    lo, hi = x[rows].min(0), x[rows].max(0)
    if span2(lo, hi, lo, hi) <= near2:
        _chain(rows, forest)


def _chain(rows: np.ndarray, forest: Forest) -> None:
    for root in np.unique(forest.roots()[rows]).tolist():
        forest.link(int(rows[0]), root)


def _compare(x, a, b, near2, forest: Forest) -> None:
    """All pairs of two small sets; labels run along the hits until they settle, so few links are made one by one."""
    apart = np.zeros((len(a), len(b)))
    for d in range(x.shape[1]):
        apart += (x[a, d][:, None] - x[b, d][None, :]) ** 2
    hits = apart <= near2
    if not hits.any():
        return
    none = len(x)
    left, right = forest.roots()[a].copy(), forest.roots()[b].copy()
    while True:
        before = left.copy(), right.copy()
        left = np.minimum(left, np.where(hits, right[None, :], none).min(1))
        right = np.minimum(right, np.where(hits, left[:, None], none).min(0))
        if (left == before[0]).all() and (right == before[1]).all():
            break
    for rows, labels in ((a, left), (b, right)):
        moved = np.flatnonzero(forest.parent[rows] != labels)
        for i, label in {(int(forest.root(rows[k])), int(labels[k])) for k in moved.tolist()}:
            forest.link(i, label)


def local_components(points: DataFrame, dims, eps: float, tolerance: float = 1e-12) -> DataFrame:
    """The points with ``leaf`` and ``root``, the smallest mail_id of their component within the leaf; written once."""
    total = points.count()
    leaves = max(1, min(MOST_LEAVES, -(-total // LEAF)))
    share = min(1.0, FIT_POINTS / max(1, total))
    sample = points.select(*dims) if share >= 1 else points.where(F.pmod(F.xxhash64("mail_id", F.lit("tree")), F.lit(1 << 20)) < int(share * (1 << 20))).select(*dims)
    tree = Tree(sample.toPandas().to_numpy(float), leaves) if leaves > 1 else Tree(np.zeros((0, len(dims))), 1)
    shared, near2, names = points.sparkSession.sparkContext.broadcast(tree), eps * eps + tolerance, list(dims)

    @F.pandas_udf("int")
    def leaf(columns: pd.DataFrame) -> pd.Series:
        return pd.Series(shared.value.place(columns.to_numpy(float)))

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("mail_id", ignore_index=True)
        forest = Forest(len(rows))
        join_within(rows[names].to_numpy(float), np.arange(len(rows)), None, near2, forest)
        return rows.assign(root=rows["mail_id"].to_numpy()[forest.roots()])

    placed = points.withColumn("leaf", leaf(F.struct(*dims)) if leaves > 1 else F.lit(0))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields)
    return materialize(placed.groupBy("leaf").applyInPandas(settle, kinds + ", root long"))


def cross_links(placed: DataFrame, dims, eps: float, tolerance: float = 1e-12) -> DataFrame | None:
    """(a, b): links between the local components of different leaves; None if no two leaves are near."""
    boxes = placed.groupBy("leaf").agg(*[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).orderBy("leaf").toPandas()
    numbers = boxes["leaf"].to_numpy()
    lo, hi = boxes[[f"lo_{d}" for d in dims]].to_numpy(float), boxes[[f"hi_{d}" for d in dims]].to_numpy(float)
    near2, names = eps * eps + tolerance, list(dims)
    partners = {}
    for i, number in enumerate(numbers.tolist()):
        near = np.flatnonzero(gap2(lo[i], hi[i], lo, hi) <= near2)
        partners[number] = [(int(numbers[j]), lo[j], hi[j]) for j in near.tolist() if j != i]
    if not any(partners.values()):
        return None
    shared = placed.sparkSession.sparkContext.broadcast(partners)

    def deal(batches):
        for b in batches:
            x = b[names].to_numpy(float)
            for number, rows in b.groupby("leaf").indices.items():
                for other, low, high in shared.value[number]:
                    near = rows[gap2(x[rows], x[rows], low, high) <= near2]        # only points that may reach the other box
                    if len(near):
                        yield b.iloc[near][["root", *names]].assign(lo=min(number, other), hi=max(number, other), side=int(number > other))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        x, roots, side = rows[names].to_numpy(float), rows["root"].to_numpy(), rows["side"].to_numpy()
        forest = Forest(len(rows))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(a) and len(b):
            join_within(x, a, b, near2, forest)
        made = pd.DataFrame({"a": roots, "b": roots[forest.roots()]})
        return made[made["a"] != made["b"]].drop_duplicates()

    kinds = ", ".join(f"{d} double" for d in dims)
    dealt = placed.select("leaf", "root", *dims).mapInPandas(deal, f"root long, {kinds}, lo int, hi int, side int")
    return dealt.groupBy("lo", "hi").applyInPandas(meet, "a long, b long")


def connected_labels(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge to another: the smallest node of its component.

    The edges are rewritten until they are stars around the smallest nodes: larger neighbours of a node move to its smallest
    neighbour, then the smaller ones; a logarithmic number of rounds, each written out.
    """
    def tops(pairs):
        return pairs.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("top"))

    def written(pairs):
        seen, h = Observation(), F.xxhash64("hi", "lo")
        made = materialize(pairs.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("s")))
        return made, seen.get

    stars, now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while now["n"]:
        both = stars.unionByName(stars.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = tops(both).select("node", F.least("node", "top").alias("top"))
        large = (both.where("lo > hi").join(least, F.col("hi") == F.col("node")).select(F.col("lo").alias("hi"), F.col("top").alias("lo")).distinct())
        small = large.join(tops(large), F.col("hi") == F.col("node"))
        moved = small.where("lo <> top").select(F.col("lo").alias("hi"), F.col("top").alias("lo"))
        before = now
        stars, now = written(moved.unionByName(small.select("hi", F.col("top").alias("lo"))).distinct())
        if now == before:
            break
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(
        stars.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())


def anomaly_clusters(df: DataFrame, eps: float = 0.5) -> DataFrame:
    """(mail_id, cluster) for the mails of ``df``; lonely mails get -1.

    Features are recomputed on these mails and scaled with the population deviation; fewer than three mails are one cluster.
    Clusters are numbered from 0 in the order of their smallest mail_id.
    """
    columns = feature_names()
    features = materialize(anomaly_features(df))
    stats = features.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns],
                         *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    if stats["n"] < 3:
        return features.select("mail_id", F.lit(0).cast("long").alias("cluster"))
    return cluster_points(features, stats, [c for c in columns if stats[f"s_{c}"] > 0], [], eps)


def cluster_points(features: DataFrame, stats, dims, keys, eps: float) -> DataFrame:
    """(mail_id, cluster): components of the mails whose scaled ``dims`` are within ``eps`` and whose ``keys`` are equal."""
    names = [f"x{i}" for i in range(len(dims) + len(keys))]
    cells = [*dims, *keys]
    distinct = features.groupBy(*cells).agg(F.min("mail_id").alias("mail_id"), F.count(F.lit(1)).alias("n"))
    scaled = [(F.col(c).cast("double") - float(stats[f"m_{c}"])) / float(stats[f"s_{c}"]) for c in dims]
    apart = [F.col(c).cast("double") * (2 * eps) for c in keys]                      # whole numbers that differ are out of reach
    points = materialize(distinct.withColumns(dict(zip(names, [*scaled, *apart]))))
    if not names:
        points, names = points.withColumn("x0", F.lit(0.0)), ["x0"]
    placed = local_components(points, names, eps)
    links = cross_links(placed, names, eps)
    named = placed.groupBy("root").agg(F.sum("n").alias("n")).withColumn("label", F.col("root"))
    if links is not None:
        named = materialize(named.drop("label").join(connected_labels(links), F.col("root") == F.col("node"), "left")
                            .select("root", "n", F.coalesce("label", "root").alias("label")))
    many = dense_positions(named.groupBy("label").agg(F.sum("n").alias("size")).where("size > 1").select("label"), "label", "cluster")
    clusters = named.join(many, "label", "left").select("root", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))
    by_cell = placed.select("root", *cells).join(clusters, "root").drop("root")
    if not cells:
        return spread_join(features.select("mail_id", F.lit(0).alias("_all")), by_cell.withColumn("_all", F.lit(0)), "_all").select("mail_id", "cluster")
    return spread_join(features.select("mail_id", *cells), by_cell, cells).select("mail_id", "cluster")
