"""Distributed connected components: alternating large-star and small-star steps on an edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.frames import materialize


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every node that has an edge to another one; ``component`` is the smallest node of its component.

    The edge table is rewritten until it is a set of stars around the smallest nodes.  A large-star step links the larger
    neighbours of a node to its smallest neighbour, a small-star step links the smaller ones; both keep the components and
    need a logarithmic number of rounds.  A step is one hash aggregation with map-side combine and one join, which adaptive
    execution splits for hub nodes; no node's neighbours are gathered.  Each round is written out, so lost executors cost at
    most a round.  Edges with a null end and self-links are ignored; an empty table gives an empty table.
    """
    stars = materialize(edges.where(F.col(u) != F.col(v))
                        .select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo")).distinct())
    state = _checksum(stars)
    while state[0]:
        stars = materialize(_small_star(_large_star(stars)))
        before, state = state, _checksum(stars)
        if state == before:
            break
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _checksum(stars: DataFrame):
    h = F.xxhash64("hi", "lo")
    return tuple(stars.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 16)), F.bit_xor(h)).first())


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.select("hi", "lo").unionByName(stars.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    smallest = both.groupBy(F.col("hi").alias("node")).agg(F.least(F.min("lo"), F.min("hi")).alias("top"))
    return (both.where("lo > hi").join(smallest, F.col("hi") == F.col("node"))
            .select(F.col("lo").alias("hi"), F.col("top").alias("lo")).distinct())


def _small_star(stars: DataFrame) -> DataFrame:
    smallest = stars.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("top"))
    moved = (stars.join(smallest, F.col("hi") == F.col("node")).where("lo <> top")
             .select(F.col("lo").alias("hi"), F.col("top").alias("lo")))
    return moved.unionByName(smallest.select(F.col("node").alias("hi"), F.col("top").alias("lo"))).distinct()
