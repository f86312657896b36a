"""Nearest neighbours by inner product against brute force: recall, order, scores, copies and odd vectors."""
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from letterwatch.llm import ann


def brute(rows, k, every):
    """{query: [(score, id)]} over all rows that take part."""
    ok = {(i, tuple(v)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    size = max({len(v) for _, v in ok}, key=lambda n: (sum(len(v) == n for _, v in ok), -n), default=0)
    ok = sorted({i: v for i, v in sorted(ok, reverse=True)}.items())                # of several vectors of an id the first
    ok = [(i, v) for i, v in ok if len(v) == size]
    out = {}
    for i, v in ok:
        if i % every == 0 and len(ok) > 1:
            found = sorted((-float(np.dot(np.float64(v), np.float64(w))), j) for j, w in ok if j != i)
            out[i] = [(-s, j) for s, j in found[:k]]
    return out


def search(spark, rows, k=5, every=4, kind="float", **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, rank string").repartition(3)
    made = ann.nearest(df, F.pmod("vec_id", F.lit(every)) == 0, k, **more).orderBy("query_id", "rank").collect()
    got = {}
    for r in made:
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    return got


def single(x):
    return [float(np.float32(v)) for v in x]


@pytest.mark.parametrize("n, spread", [(1500, 1.0), (900, 40.0)])
def test_recall_and_order(spark, n, spread):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16)) * (spread > 1)
    x = rng.normal(size=(n, 16)) + centres[rng.integers(12, size=n)]
    x *= rng.uniform(1, spread, size=(n, 1)) ** 0.5                       # norms differ
    rows = [(i, single(v)) for i, v in enumerate(x)]
    want, got = brute(rows, 10, 20), search(spark, rows, 10, 20)
    hits = sum(len({j for _, j in want[q]} & {j for _, _, j in got[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * sum(len(want[q]) for q in want)
    vectors = {i: np.float64(v) for i, v in rows}
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 11)) and q not in [j for _, _, j in found]
        assert [(-s, j) for _, s, j in found] == sorted((-s, j) for _, s, j in found)
        assert all(abs(s - vectors[q] @ vectors[j]) < 1e-9 for _, s, j in found)


def test_few_rows_copies_and_odd_vectors_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, single(v)) for i, v in enumerate(rng.normal(size=(12, 4)))]
    rows += [(100 + i, rows[3][1]) for i in range(40)]                     # more copies than wanted, queries among them
    rows += [(200, None), (204, []), (208, [0.0] * 4), (212, [1.0, None, 2.0, 3.0]), (216, [1.0, float("nan"), 0.0, 0.0]), (220, [float("inf"), 0.0, 0.0, 1.0]),
             (224, [1.0, 2.0]), (None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1]), (4, rows[5][1]), (7, rows[8][1]), (-8, single([-1, -1, 0, 2]))]
    want, got = brute(rows, 50, 4), search(spark, rows, 50, 4)
    assert set(got) == set(want)
    for q, found in want.items():
        assert [(j, round(s, 9)) for _, s, j in got[q]] == [(j, round(s, 9)) for s, j in sorted(found, key=lambda x: (-round(x[0], 9), x[1]))], q


def test_long_lists_are_dealt_and_doubles_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 16)
    monkeypatch.setattr(ann, "QUERIES", 8)
    monkeypatch.setattr(ann, "AT_ONCE", 7)
    rng = np.random.default_rng(3)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(rng.normal(size=(300, 6)) / 3)]
    got, want = search(spark, rows, 5, 3, "double", lists=3), brute(rows, 5, 3)
    hits = sum(len({j for _, j in want[q]} & {j for _, _, j in got[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want) and all(len(v) == 5 for v in got.values())


def test_lone_and_empty_tables(spark):
    assert search(spark, []) == {} and search(spark, [(1, [1.0, 2.0])]) == {} and search(spark, [(4, [1.0, 2.0])]) == {}
    assert search(spark, [(4, [1.0, 2.0]), (5, [3.0, 1.0])]) == {4: [(1, 5.0, 5)]}


def test_walk_meets_what_a_full_scan_meets():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 8))
    index = ann.Index(None, float(np.sqrt((x * x).sum(1).max())))
    index.graph = ann.Graph(ann.balanced_centroids(index.lifted(x), 60))
    q = index.asked(rng.normal(size=(40, 8)))
    full = np.sqrt(np.maximum(1 + index.graph.square - 2 * q @ index.graph.centroids.T, 1e-12))
    near = np.isfinite(index.graph.within(q, 1.3))
    wanted = full <= 1.3 * full.min(1)[:, None]
    assert (near & wanted).sum() >= 0.98 * wanted.sum() and not (near & ~(full <= 1.301 * full.min(1)[:, None])).any()
    rows, lists = index.lists_of(x)
    sizes = np.bincount(lists, minlength=60)
    assert set(rows) == set(range(4000)) and np.bincount(rows).max() <= ann.REPLICAS and sizes.max() <= 4 * sizes.mean()


def test_memory_of_a_walk_through_most_lists_is_bounded():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 24))
    index = ann.Index(None, float(np.sqrt((x * x).sum(1).max())), ratio=2.0)
    index.graph = ann.Graph(ann.balanced_centroids(index.lifted(x), 2000))
    index.sizes = np.ones(2000, np.int64)
    tracemalloc.start()
    probed = index.probed(x[:256], 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert probed.mean() > 0.5 and most < 100 << 20


def test_links_followed_in_pieces_lead_to_the_same_lists(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 12))
    index = ann.Index(None, float(np.sqrt((x * x).sum(1).max())))
    index.graph = ann.Graph(ann.balanced_centroids(index.lifted(x), 90))
    q = index.asked(rng.normal(size=(30, 12)))
    for ratio in (1.0, 1.1, 1.3):
        whole = index.graph.within(q, ratio)
        with monkeypatch.context() as m:
            m.setattr(ann, "CELLS", 17)
            assert np.array_equal(index.graph.within(q, ratio), whole)
        for i in range(len(q)):                                           # one query, one list at a time
            gaps, met = index.graph.distances(q)[i], set(index.graph.entries.tolist())
            new = met
            while new:
                least = min(gaps[list(met)])
                links = [index.graph.links[index.graph.first[c]:index.graph.first[c + 1]].tolist() for c in new if gaps[c] <= ratio * least]
                new = {c for some in links for c in some} - met
                met |= new
            assert set(np.flatnonzero(np.isfinite(whole[i])).tolist()) == {c for c in met if gaps[c] <= ratio * min(gaps[list(met)])}
