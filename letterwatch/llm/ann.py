"""Approximate nearest neighbours by inner product: balanced posting lists, a graph over their centroids, distance ratios."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.frames import materialize, spread_join
from .common import bounded_sample, by_value

by_value(__name__)

TOP = 20
LIST = 64                          # vectors of a list, about, as long as there are fewer than MOST_LISTS lists
MOST_LISTS = 8_192                 # centroids that are held in memory
FIT_ROWS = 65_536                  # vectors that the centroids are fitted on
TUNE_ROWS = 256                    # queries that the distance ratio is tuned on, against all vectors
RECALL = 0.96                      # recall that the ratio must reach on these queries
REPLICAS, BOUNDARY = 2, 1.1        # a vector is put into so many lists at most, while their distance is at most so many times the least
DEGREE, ENTRIES = 16, 32           # neighbours of a centroid in the graph; where each search begins
PART = 16_384                      # vectors of lists that one task holds at a time, about
QUERIES = 32_768                   # queries of one part of lists that one task answers; more are dealt to several
AT_ONCE = 256                      # vectors or queries whose distances are held at once, at most
CELLS = 1 << 19                    # distances to centroids, links of a walk or products that are held at once, about
SPARE = 3                          # candidates kept beyond the wanted number, as fast products may differ in the last digits


def balanced_centroids(x: np.ndarray, n_lists: int) -> np.ndarray:
    """Means of ``n_lists`` equal shares of the vectors: halved again and again between two means, so neighbours in order are near."""
    rng, out, todo = np.random.default_rng(7), [], [(np.arange(len(x)), n_lists)]
    while todo:
        rows, lists = todo.pop()
        if lists == 1:
            out.append(x[rows].mean(0))
            continue
        ends = x[rows[rng.choice(len(rows), 2, replace=False)]]
        for _ in range(6):
            along = x[rows] @ (ends[1] - ends[0])
            right = along > np.median(along)
            if not right.any():
                break
            ends = np.stack([x[rows[~right]].mean(0), x[rows[right]].mean(0)])
        rows = rows[np.argsort(x[rows] @ (ends[1] - ends[0]), kind="stable")]
        cut = len(rows) * (lists // 2) // lists
        todo += [(rows[cut:], lists - lists // 2), (rows[:cut], lists // 2)]
    return np.stack(out)


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix, faster if little is set."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


class Graph:
    """Centroids, each linked with its nearest ones, those it is nearest to, and its neighbours in the order of the lists."""

    def __init__(self, centroids: np.ndarray):
        n = len(centroids)
        self.centroids, self.square = centroids, (centroids * centroids).sum(1)
        links = [{(i - 1) % n, (i + 1) % n} for i in range(n)]
        for start in range(0, n, 1024):
            gap = self.square - 2 * centroids[start:start + 1024] @ centroids.T
            near = np.argpartition(gap, min(DEGREE, n - 1), axis=1)[:, :DEGREE + 1]
            for i, js in enumerate(near.tolist(), start):
                for j in js:
                    links[i].add(j)
                    links[j].add(i)
        self.first = np.cumsum([0, *map(len, links)])                  # links of centroid i: from first[i] to first[i + 1]
        self.links = np.array([j for s in links for j in s], np.int32)
        self.entries = np.unique(np.linspace(0, n - 1, min(ENTRIES, n)).astype(int))

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Distances (queries, centroids) of queries (unit vectors)."""
        return np.sqrt(np.maximum(1 + self.square - 2 * (q @ self.centroids.T), 1e-12))

    def linked(self, rows: np.ndarray, lists: np.ndarray, n: int) -> np.ndarray:
        """(n, centroids): whether a link leads there from one of a query's lists.  About CELLS links are held at a time."""
        out = np.zeros((n, len(self.centroids)), bool)
        sizes = self.first[lists + 1] - self.first[lists]
        upto = np.cumsum(sizes)
        cuts = [0, *(np.flatnonzero(np.diff(upto // CELLS)) + 1).tolist(), len(rows)]
        for a, b in zip(cuts, cuts[1:]):
            some = sizes[a:b]
            at = np.repeat(self.first[lists[a:b]] - (np.cumsum(some) - some), some)
            at += np.arange(len(at))
            out[np.repeat(rows[a:b], some), self.links[at]] = True
        return out

    def within(self, q: np.ndarray, ratio: float) -> np.ndarray:
        """Distances (queries, centroids) of those the walk met within ``ratio`` times the least; infinite elsewhere.

        From the entries, all links of every centroid within the ratio are followed until none is left.  The least only falls, so a
        centroid that is too far when it is met stays so.
        """
        gaps = self.distances(q)
        met = np.zeros(gaps.shape, bool)
        met[:, self.entries] = True
        least, (rows, lists) = np.full(len(q), np.inf, gaps.dtype), places(met)
        while len(rows):
            here = gaps[rows, lists]
            np.minimum.at(least, rows, here)
            near = here <= ratio * least[rows]
            new = self.linked(rows[near], lists[near], len(q)) & ~met
            met |= new
            rows, lists = places(new)
        gaps[~met | (gaps > ratio * least[:, None])] = np.inf
        return gaps


@dataclass
class Index:
    """What tasks need to place vectors and to route queries: the graph, the largest norm, the ratio, and sizes and parts of lists."""

    graph: Graph
    norm: float
    ratio: float = 1.0
    sizes: np.ndarray | None = None
    base: np.ndarray | None = None
    parts: np.ndarray | None = None

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors with one more component, whose distances to queries are in the order of falling inner products."""
        x = x / self.norm
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]]).astype(np.float32)

    def asked(self, q: np.ndarray) -> np.ndarray:
        q = q / np.abs(q).max(1)[:, None]
        return np.hstack([q / np.sqrt((q * q).sum(1))[:, None], np.zeros((len(q), 1))]).astype(np.float32)

    @property
    def step(self) -> int:
        """Vectors or queries whose distances to all centroids are held at once."""
        return max(1, min(AT_ONCE, CELLS // len(self.graph.centroids)))

    def lists_of(self, x: np.ndarray):
        """(rows, lists): each vector's nearest lists up to REPLICAS, within BOUNDARY times the least distance."""
        near = self.graph.within(self.lifted(x), BOUNDARY)
        few = min(REPLICAS, near.shape[1])
        picked = np.argpartition(near, few - 1, axis=1)[:, :few]
        keep = np.isfinite(np.take_along_axis(near, picked, 1))
        return np.nonzero(keep)[0], picked[keep]

    def probed(self, q: np.ndarray, least: int) -> np.ndarray:
        """(queries, lists) that are looked through: those within the ratio, or all if these hold fewer than ``least`` entries."""
        probe = np.isfinite(self.graph.within(self.asked(q), self.ratio))
        probe[probe @ self.sizes < least] = True
        return probe & (self.sizes > 0)


def matrix(column) -> np.ndarray:
    """Vectors of one length as rows in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def taking_part(df: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, each id once."""
    v = F.col("v")
    number = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))          # noqa: E731
    rows = df.select("vec_id", F.col("embedding").alias("v")).where(
        F.col("vec_id").isNotNull() & F.forall(v, number) & F.exists(v, lambda x: x != 0))
    rows = materialize(rows.groupBy("vec_id").agg(F.min("v").alias("v")))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(rep, v, copies): each vector once, with the smallest ids of its rows: one more than wanted, as a query is not its own answer."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("_n", place).where(F.col("_n") <= k + 1)
    return few.groupBy("v").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("copies")).select("rep", "v", "copies")


def fit(vectors: DataFrame, rows: int, lists: int | None) -> Index:
    """Centroids of a bounded sample of the vectors; the largest norm is taken over all."""
    n, square = vectors.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
    sample = bounded_sample(vectors.select("rep", "v"), F.col("rep"), rows).select("v").toArrow()
    if not sample.num_rows:
        sample = vectors.select("v").limit(1).toArrow()
    index = Index(None, float(np.sqrt(square)))
    x = index.lifted(matrix(sample["v"]))
    index.graph = Graph(balanced_centroids(x, max(1, min(lists or -(-n // LIST), MOST_LISTS, len(x) // 2))))
    return index


def posted(vectors: DataFrame, shared) -> DataFrame:
    """(list, rep, v): every vector in its lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, shared.value.step):
                b = batch.slice(start, shared.value.step)
                rows, lists = shared.value.lists_of(matrix(b["v"]))
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), b["rep"].take(pa.array(rows)), b["v"].take(pa.array(rows))], ["list", "rep", "v"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.select("rep", "v").mapInArrow(run, f"list int, rep {kinds['rep']}, v {kinds['v']}")


def tune(index: Index, vectors: DataFrame, lists: DataFrame, queries: DataFrame, k: int) -> float:
    """The least ratio with which a bounded sample of queries finds RECALL of its ``k`` nearest vectors, measured against all."""
    sample = bounded_sample(queries, F.col("vec_id"), TUNE_ROWS).select("v").toArrow()
    if not sample.num_rows:
        sample = queries.select("v").limit(TUNE_ROWS).toArrow()
    q = matrix(sample["v"])
    shared, step = vectors.sparkSession.sparkContext.broadcast(q), max(1, CELLS // len(q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, kind = shared.value, None
        square, best, names = (q * q).sum(1), np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
        for b in (b.slice(start, step) for b in batches for start in range(0, b.num_rows, step)):
            kind, x = b["rep"].type, matrix(b["v"])
            dots = q @ x.T
            for i, j in zip(*np.nonzero(np.abs(dots - square[:, None]) <= 1e-9 * square[:, None])):
                if np.array_equal(q[i], x[j]):
                    dots[i, j] = -np.inf                              # the query itself
            best, names = np.hstack([best, dots]), np.hstack([names, np.tile(b["rep"].to_numpy(), (len(q), 1))])
            few = np.argsort(-best, axis=1, kind="stable")[:, :k]
            best, names = np.take_along_axis(best, few, 1), np.take_along_axis(names, few, 1)
        if kind is not None:
            at, spot = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(names[at, spot], kind), pa.array(best[at, spot])], ["q", "rep", "score"])

    kind = vectors.schema["rep"].dataType.simpleString()
    near = vectors.select("rep", "v").mapInArrow(run, f"q int, rep {kind}, score double")
    first = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    truth = materialize(near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).select("q", "rep"))   # TUNE_ROWS * k rows
    held = lists.select("list", "rep").join(F.broadcast(truth), "rep").toPandas()
    if not len(held):
        return 1.0
    asked = index.asked(q)
    gaps = index.graph.distances(asked)
    held["need"] = gaps[held["q"], held["list"]] / gaps.min(1)[held["q"]]
    need = held.groupby(["q", "rep"])["need"].min()
    ratio = float(np.quantile(need, RECALL, method="higher")) * (1 + 1e-6)
    pairs = held[["q", "list", "rep"]].to_numpy()
    while True:                                                       # the walk may miss lists that are not linked within the ratio
        probe = np.isfinite(index.graph.within(asked, ratio))
        met = {(a, r) for a, c, r in pairs.tolist() if probe[a, c]}
        if len(met) >= RECALL * len(need) or probe.all():
            return ratio
        ratio *= 1.01


def dealt(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base, parts) of each list: neighbouring lists share a part of about PART vectors, a longer list has several of its own."""
    base, parts, at, held = [], [], 0, 0
    for size in sizes.tolist():
        own = max(1, -(-size // PART))
        if held and held + size > PART:
            at, held = at + 1, 0
        base.append(at)
        parts.append(own)
        at, held = (at + own, 0) if own > 1 else (at, held + size)
    return np.array(base), np.array(parts)


def routed(queries: DataFrame, shared, k: int) -> DataFrame:
    """(part, vec_id, v, lists): each query once for each part that holds lists it looks through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, index.step):
                b = batch.slice(start, index.step)
                rows, lists = places(index.probed(matrix(b["v"]), (k + 1) * REPLICAS))
                times = index.parts[lists]
                part = np.repeat(index.base[lists], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                rows, lists = np.repeat(rows, times), np.repeat(lists, times)
                order = np.lexsort((lists, part, rows))
                rows, part, lists = rows[order], part[order], lists[order]
                first = np.flatnonzero(np.diff(rows, prepend=-1) | np.diff(part, prepend=-1))
                held = pa.ListArray.from_arrays(pa.array(np.append(first, len(lists)), pa.int32()), pa.array(lists, pa.int32()))
                at = pa.array(rows[first])
                yield pa.RecordBatch.from_arrays([pa.array(part[first], pa.int64()), b["vec_id"].take(at), b["v"].take(at), held], ["part", "vec_id", "v", "lists"])

    kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    return queries.select("vec_id", "v").mapInArrow(run, f"part long, vec_id {kinds['vec_id']}, v {kinds['v']}, lists array<int>")


class Part:
    """The vectors of one part of lists, each once, and the lists that hold them."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches)
        lists = rows["lists"].combine_chunks().flatten().to_numpy()
        self.ids, first, at = np.unique(rows["vec_id"].to_numpy(), return_index=True, return_inverse=True)
        self.vectors = matrix(rows["v"])[first]
        self.lists, number = np.unique(lists, return_inverse=True)
        order, held = np.argsort(at, kind="stable"), np.bincount(at)
        place = np.arange(len(at)) - np.repeat(np.cumsum(held) - held, held)
        self.spots = np.full((held.max(), len(self.ids)), len(self.lists))     # numbers of a vector's lists; the last one is never opened
        self.spots[place, at[order]] = number[order]

    @property
    def step(self) -> int:
        """Queries whose products with all vectors are held at once."""
        return max(1, min(AT_ONCE, CELLS // len(self.ids)))

    def best(self, queries: pa.RecordBatch, few: int):
        """(query, vector, score) of the ``few`` largest inner products of each query with the vectors of its lists."""
        asked, wanted = matrix(queries["v"]), queries["lists"]
        opened = np.zeros((len(asked), len(self.lists) + 1), bool)
        lists = wanted.flatten().to_numpy()
        spot = np.minimum(np.searchsorted(self.lists, lists), len(self.lists) - 1)
        row = np.repeat(np.arange(len(asked)), wanted.value_lengths().to_numpy())
        there = self.lists[spot] == lists
        opened[row[there], spot[there]] = True
        seen = opened[:, self.spots[0]]
        for more in self.spots[1:]:
            seen |= opened[:, more]
        far = -asked @ self.vectors.T
        far[~seen] = np.inf
        few = min(few, far.shape[1])
        picked = np.argpartition(far, few - 1, axis=1)[:, :few]
        row, place = np.nonzero(np.isfinite(np.take_along_axis(far, picked, 1)))
        picked = picked[row, place]
        return row, self.ids[picked], (asked[row] * self.vectors[picked]).sum(1)


def looked_through(lists: DataFrame, queries: DataFrame, few: int) -> DataFrame:
    """(query_id, rep, score): the best of each part for each query.  A task holds one part and streams its queries past it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting, part = None, [], None
        for b in batches:
            keys = np.stack([b[c].to_numpy() for c in ("part", "salt", "asks")])
            cuts = [0, *(np.flatnonzero(np.diff(keys, axis=1).any(0)) + 1).tolist(), b.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                key = tuple(keys[:2, start].tolist())
                if key != current:
                    current, waiting, part = key, [], None
                if not keys[2, start]:
                    waiting.append(b.slice(start, stop - start))
                    continue
                if waiting:
                    part, waiting = Part(waiting), []
                for at in range(start, stop, part.step) if part else ():
                    asked = b.slice(at, min(part.step, stop - at))
                    row, ids, scores = part.best(asked, few)
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([asked["vec_id"].take(row), pa.array(ids, asked["vec_id"].type), pa.array(scores)],
                                                     ["query_id", "rep", "score"])

    hot = materialize(queries.groupBy("part").count().where(F.col("count") > QUERIES).select(
        F.col("part").alias("_p"), F.ceil(F.col("count") / QUERIES).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    left = lists.join(hot, F.col("part") == F.col("_p"), "left").select(
        "part", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("asks"), F.col("rep").alias("vec_id"), "v",
        F.array("list").alias("lists"))
    right = queries.join(hot, F.col("part") == F.col("_p"), "left").select(
        "part", F.pmod(F.xxhash64("vec_id"), salts).cast("int").alias("salt"), F.lit(1).alias("asks"), "vec_id", "v", "lists")
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = left.unionByName(right).repartition(n, "part", "salt").sortWithinPartitions("part", "salt", "asks")
    kind = lists.schema["rep"].dataType.simpleString()
    return met.mapInArrow(run, f"query_id {kind}, rep {kind}, score double")


def nearest(df: DataFrame, is_query: Column, k: int = TOP, fit_rows: int = FIT_ROWS, lists: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` the ``k`` rows found with the largest inner product.

    ``df`` has ``vec_id`` and ``embedding``; other columns are ignored, whatever their names.  Queries and candidates are all rows
    but those whose vector is null, empty, zero or holds a null or non-finite component, those without an id, and those
    whose vector has another length than most (such products are not defined).  Nearest first, ties to the smaller id;
    ``score`` is the inner product of the original vectors in double precision.  Fewer than ``k`` candidates: all of them are
    found.  Repeated rows count once; an id names one vector, of several different ones the first in the order of their
    components.  An empty table gives an empty table.

    Inner products become distances by one more component, which makes all vectors equally long.  Centroids are fitted on a
    bounded sample (``fit_rows``), halved evenly, so lists are balanced; there is one for LIST vectors, MOST_LISTS at
    most.  Every distinct vector is put into its nearest list and, near a boundary, also into the next one.  A walk on
    the graph of centroids finds the lists whose distance is within a ratio of the least; the ratio is tuned on a
    bounded sample of queries until it finds RECALL of their true neighbours among all vectors.

    Copies of a vector are indexed once and come back in at the end, the smallest ids first, so a group of copies costs nothing.
    A task holds about PART vectors of neighbouring lists and streams the queries routed there past them; long lists are
    dealt to several tasks, and so are the queries of a part that very many look through.
    """
    context = df.sparkSession.sparkContext
    rows = taking_part(df)
    queries = rows.where(is_query)
    vectors = materialize(distinct_vectors(rows, k))
    kind = rows.schema["vec_id"].dataType.simpleString()
    if vectors.isEmpty() or queries.isEmpty():
        return df.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    index = fit(vectors, fit_rows, lists)
    entries = materialize(posted(vectors, context.broadcast(index)))
    index.sizes = np.zeros(len(index.graph.centroids), np.int64)
    for number, size in entries.groupBy("list").count().collect():                                # at most MOST_LISTS rows
        index.sizes[number] = size
    index.base, index.parts = dealt(index.sizes)
    index.ratio = tune(index, vectors, entries, queries, k)
    places = df.sparkSession.createDataFrame([(i, int(b), int(p)) for i, (b, p) in enumerate(zip(index.base, index.parts))], "list int, _base long, _parts int")
    placed = entries.join(F.broadcast(places), "list").withColumn("part", F.col("_base") + F.pmod(F.xxhash64("rep"), F.col("_parts")))
    sent = materialize(routed(queries, context.broadcast(index), k))
    found = looked_through(placed, sent, k + 1 + SPARE).repartition("query_id").groupBy("query_id", "rep").agg(F.max("score").alias("score"))
    each = Window.partitionBy("query_id")
    best = materialize(found.withColumn("_n", F.row_number().over(each.orderBy(F.desc("score"), "rep"))).where(F.col("_n") <= k + 1).drop("_n"))
    copies = vectors.where(F.size("copies") > 1).select("rep", "copies")
    named = spread_join(best, copies, "rep", row_id="query_id").select(
        "query_id", F.explode(F.coalesce("copies", F.array("rep"))).alias("vec_id"), "score").where("vec_id <> query_id")
    ranks = named.withColumn("rank", F.row_number().over(each.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranks.select("query_id", "rank", "vec_id", "score")
