"""Ranked lexical search against a plain count of every document, and against its SQL."""
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from letterwatch.llm import lexical, oracle

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(items, docs, k):
    counts = [Counter(terms(t)) for _, t in docs]
    n = sum(bool(c) for c in counts)
    total = sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        asked, rows = Counter(terms(text)), []
        for (doc, _), c in zip(docs, counts):
            if not c:
                continue
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
                        for t, times in asked.items() if c[t])
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, r[3], -r[0]) for i, r in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def corpus(n=300, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "été", "ÄB1", "x_y", "Q-7", "日本"]
    weights = np.array([1 / (i + 1) for i in range(len(words))])
    draw = lambda size: " ".join(rng.choice(words, size, p=weights / weights.sum()))          # noqa: E731
    docs = [(i, draw(int(rng.integers(1, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "  ,;\x00\x7f"), (n + 3, "W1 w1\x00W2"), (n + 4, "W1 " * 4000), (7, docs[7][1]), (7, docs[7][1]), (None, docs[9][1]),
             (5, "rare onlyhere"), (n + 9, "w1 " * 30 + "onlyhere")]
    items = [(i, draw(int(rng.integers(1, 25)))) for i in range(12)] + [(20, None), (21, ""), (22, "absent"), (23, "onlyhere ONLYHERE rare w1"), (3, "w1 w2"), (None, "w3")]
    return items, docs


def found(spark, items, docs, k):
    left = spark.createDataFrame([(*x, "r", 1) for x in items], "item_id long, text string, rank string, place int")
    right = spark.createDataFrame([(*x, 1, "n") for x in docs], "doc_id long, text string, SCORE int, n string").repartition(4)
    return sorted(map(tuple, lexical.lexical_search(left, right, k).collect()), key=str)


@pytest.mark.parametrize("k, rows", [(20, 32_768), (3, 16), (1000, 64)])
def test_equals_plain_count(spark, monkeypatch, k, rows):
    monkeypatch.setattr(lexical, "SHARD_ROWS", rows)
    monkeypatch.setattr(lexical, "ITEMS", 7)
    items, docs = corpus()
    assert found(spark, items, docs, k) == brute(items, docs, k)


def test_equals_sql(spark):
    items, docs = corpus(120, 5)
    con = duckdb.connect()
    for name, cols, data in (("benchmark", "item_id", items), ("documents", "doc_id", docs)):
        con.execute(f"CREATE TABLE {name} ({cols} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", [(i, t if t is None else t.replace("\x00", " ")) for i, t in data])
    docs = [(i, t if t is None else t.replace("\x00", " ")) for i, t in docs]
    assert found(spark, items, docs, 20) == sorted(con.execute(oracle.op12()).fetchall(), key=str)


def test_accumulators_stop_early_and_scores_stay_exact():
    rng = np.random.default_rng(0)
    lists = {0: (np.arange(30), np.full(30, 9000)), 1: (np.sort(rng.choice(5000, 2000, False)), np.full(2000, 10)), 2: (np.arange(5000), np.full(5000, 1))}
    places, scores = lexical.ranked(lists, [(0, 1), (1, 2), (2, 1)], 5000, 20, 0)
    full = np.zeros(5000, np.int64)
    for t, times in ((0, 1), (1, 2), (2, 1)):
        full[lists[t][0]] += times * lists[t][1]
    best = np.lexsort((np.arange(5000), -full))[:20]
    assert places.tolist() == best.tolist() and scores.tolist() == full[best].tolist()
    assert lexical.ranked(lists, [(1, 2), (2, 1)], 5000, 20, 10_000)[0].size == 0


def test_ties_at_the_bound_are_kept():
    # after the first term the kth partial score equals what is left: a document that only has the second one can still tie with a smaller id
    lists = {0: (np.array([5, 6]), np.array([4, 4])), 1: (np.array([1, 2]), np.array([4, 4]))}
    places, scores = lexical.ranked(lists, [(0, 1), (1, 1)], 10, 2, 0)
    assert places.tolist() == [1, 2] and scores.tolist() == [4, 4]


def test_empty_tables(spark):
    items, docs = corpus(10)
    assert found(spark, [], docs, 5) == [] and found(spark, items, [], 5) == [] and found(spark, [], [], 5) == []
