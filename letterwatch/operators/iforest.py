"""Isolation forest as a Spark job.

Trees are grown in parallel from bounded hash samples (one group per tree), the forest is a few thousand
nodes whatever the size of the log, and scoring is a vectorised Arrow function over all mails.
"""
from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.frames import exact_quantile, materialize
from .anomaly import FEATURE_INPUTS, anomaly_reasons, feature_names, with_features

# the small task functions travel with the job, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES, SAMPLE, SEED, CONTAMINATION = 100, 256, 42, 0.1
UNIT = 1_000_000                   # paths are whole numbers of millionths, so their sums do not depend on the order
NODE_SCHEMA = "tree int, node int, feature int, cut double, path long"


def average_path(n):
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def draw(*key) -> str:
    """A draw that any engine can repeat: the MD5 of the key, as hex text."""
    return hashlib.md5(":".join(map(str, key)).encode()).hexdigest()


def _tree_grower(columns, seed: int, limit: int):
    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(sample["tree"].iloc[0])
        data = sample[columns].to_numpy(dtype=float)
        nodes, todo = [], [(1, np.arange(len(data)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            part = data[rows]
            lo, hi = part.min(axis=0), part.max(axis=0)
            varied = np.flatnonzero(hi > lo).tolist()
            if depth >= limit or len(rows) < 2 or not varied:
                nodes.append((tree, node, -1, 0.0, round((depth + float(average_path(len(rows)))) * UNIT)))
                continue
            k = min(varied, key=lambda f: draw(seed, tree, node, f))
            cut = float(lo[k] + (hi[k] - lo[k]) * (int(draw(seed, tree, node, "cut")[:12], 16) / 2.0 ** 48))
            cut = float(lo[k]) if cut >= hi[k] else cut
            nodes.append((tree, node, k, cut, 0))
            side = part[:, k] <= cut
            todo += [(2 * node, rows[side], depth + 1), (2 * node + 1, rows[~side], depth + 1)]
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "path"])
    return grow


def _share_below(share: float) -> str:
    return f"{min(int(share * 2 ** 64), 2 ** 64 - 1):016x}"


def node_table(features: DataFrame, columns, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED,
               total: int | None = None):
    """(nodes of the forest, sample size, depth limit): node 1 is a tree's root, 2 n and 2 n + 1 are the children of n.

    Each tree draws its sample by the least MD5 of seed, tree and mail; of a large log a hash of the mail picks a pool of bounded
    size first.  A node cuts the varied feature with the least MD5, at a place drawn the same way, so the forest can be
    rebuilt from the log by any engine.
    """
    total = features.count() if total is None else total
    size = min(sample, total)
    pool_share = min(1.0, 2.0 * trees * size / total)
    pool = features if pool_share >= 1 else features.where(
        F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("pool"), "mail_id")), 1, 16) < _share_below(pool_share))
    tickets = (pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
               .withColumn("ticket", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("sample"), "tree", "mail_id"))))
    draw_share = min(1.0, 4.0 * size / max(1.0, pool_share * total))            # far more than are taken
    likely = tickets.where(F.substring("ticket", 1, 16) <= _share_below(draw_share))
    drawn = (likely.withColumn("r", F.row_number().over(Window.partitionBy("tree").orderBy("ticket", "mail_id")))
             .where(F.col("r") <= size).select("tree", "mail_id", *columns))
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    return drawn.groupBy("tree").applyInPandas(_tree_grower(list(columns), seed, limit), NODE_SCHEMA), size, limit


def fit_forest(features: DataFrame, columns, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED, total: int | None = None):
    """The forest as arrays of shape (trees, nodes), the sample size and the depth limit."""
    table, size, limit = node_table(features, columns, trees, sample, seed, total)
    nodes = table.toPandas()                                                 # trees times 2 * sample nodes at most
    forest = {name: np.full((trees, 2 << limit), blank, dtype=kind) for name, kind, blank in
              (("feature", np.int32, -1), ("cut", float, 0.0), ("path", np.int64, 0))}
    at = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
    for name in forest:
        forest[name][at] = nodes[name].to_numpy()
    return forest, size, limit


def _scorer(spark, forest, size: int, limit: int):
    shared = spark.sparkContext.broadcast(forest)
    scale = float(average_path(size)) or 1.0

    @F.pandas_udf("double")
    def score(columns: pd.DataFrame) -> pd.Series:
        data, f = columns.to_numpy(dtype=float), shared.value
        data, back = np.unique(data, axis=0, return_inverse=True)            # equal mails score equally
        rows, path = np.arange(len(data)), np.zeros(len(data), dtype=np.int64)
        for t in range(len(f["feature"])):
            node = np.ones(len(data), dtype=np.int32)
            for _ in range(limit):
                feature = f["feature"][t][node]
                node = np.where(feature < 0, node, 2 * node + (data[rows, feature] > f["cut"][t][node]))
            path += f["path"][t][node]
        return pd.Series((-np.exp2(-(path / UNIT) / len(f["feature"]) / scale))[back.ravel()])
    return score


def iforest_scores(features: DataFrame, columns, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(mail_id, sample_score); lower is more anomalous.  Written once so that later passes do not rescore."""
    return _scored(features.withColumn("_features", F.struct(*columns)), columns, trees, sample, seed).select("mail_id", "sample_score")


def _scored(rows: DataFrame, columns, trees: int, sample: int, seed: int, total: int | None = None) -> DataFrame:
    forest, size, limit = fit_forest(rows.select("mail_id", "_features.*"), columns, trees, sample, seed, total)
    score = _scorer(rows.sparkSession, forest, size, limit)
    return materialize(rows.withColumn("sample_score", score("_features")))


def with_anomalies(df: DataFrame, contamination: float = CONTAMINATION, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """The mails with ``anomaly_score`` and ``is_anomaly``: the lowest ``contamination`` share of scores is flagged.

    The mails are written before they are counted, drawn from and scored, so what they are made of runs once, and carry their
    features along, so nothing is joined back; select the columns that are needed first.
    """
    rows = materialize(df)
    total = rows.count()
    if not total:
        return rows.withColumns({"anomaly_score": F.lit(0.0), "is_anomaly": F.lit(False)})
    scores = _scored(with_features(rows), feature_names(), trees, sample, seed, total)
    decision = F.col("sample_score") - F.lit(exact_quantile(scores, "sample_score", contamination))
    return scores.withColumns({"anomaly_score": decision, "is_anomaly": decision < 0}).drop("_features", "sample_score")


def iforest_detect(df: DataFrame, contamination: float = CONTAMINATION, trees: int = TREES, sample: int = SAMPLE,
                   seed: int = SEED) -> DataFrame:
    """(mail_id, anomaly_score, is_anomaly): the lowest ``contamination`` share of scores is flagged."""
    needed = df.select(*[c for c in FEATURE_INPUTS if c in df.columns])
    return with_anomalies(needed, contamination, trees, sample, seed).select("mail_id", "anomaly_score", "is_anomaly")


def iforest_explained(df: DataFrame, **options) -> DataFrame:
    """Flagged mails with score and explanation."""
    return anomaly_reasons(with_anomalies(df, **options), flagged_only=True)


def iforest_score100(detected: DataFrame) -> DataFrame:
    """Scores rescaled to 0..100; higher is more normal."""
    lo = detected.agg(F.min("anomaly_score").alias("v")).scalar()
    hi = detected.agg(F.max("anomaly_score").alias("v")).scalar()
    return detected.select("mail_id", F.when(hi > lo, (F.col("anomaly_score") - lo) / (hi - lo) * 100)
                           .otherwise(0.0).alias("score100"))
