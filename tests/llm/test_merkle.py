"""The Merkle manifest against trees built with hashlib, whole level by whole level."""
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from letterwatch.llm import merkle


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(row, n_chars):
    values = [row["doc_id"], row["source"], row["lang"], n_chars, row["text"]]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        nodes = levels[-1]
        levels.append([h(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)])
    return levels


def up(levels, place, value, fanout):
    """Root from a value at a place with the original siblings, and the siblings."""
    siblings = []
    for nodes in levels[:-1]:
        start = place // fanout * fanout
        run = nodes[start:start + fanout]
        siblings += run[:place - start] + run[place - start + 1:]
        value = h(*run[:place - start], value, *run[place - start + 1:])
        place //= fanout
    return value, siblings


def brute(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["n_chars"])))
        trees[name] = tree([leaf_of(r, r["n_chars"]) for r in groups[name]], fanout)
    crown = tree([trees[n][-1][0] for n in names], fanout)
    out = []
    for g, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            n = r["n_chars"]
            if r["doc_id"] is not None and n is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                n += 1
            sub, below = up(trees[name], i, leaf_of(r, n), fanout)
            folded, above = up(crown, g, sub, fanout)
            out.append((r["doc_id"], leaf_of(r, r["n_chars"]), trees[name][-1][0], crown[-1][0], h(*below, *above), folded, folded == crown[-1][0]))
    return sorted(out, key=str)


def rows_of(n, langs, seed=1):
    rng = np.random.default_rng(seed)
    rows = [{"doc_id": int(i * 3), "source": ("s", None, "é")[i % 3], "lang": langs[int(rng.integers(len(langs)))], "n_chars": (None, 5, int(i))[i % 3],
             "text": (None, "", "naïve text ", "x" * 3000)[i % 4]} for i in range(n)]
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, GID string, pos int"


@pytest.mark.parametrize("n, fanout, levels", [(1, 2, 12), (97, 2, 2), (64, 2, 3), (130, 3, 2), (41, 2, 12)])
def test_equals_trees_of_hashlib(spark, n, fanout, levels):
    rows = rows_of(n, ["en", None, "de", "", "zz"][:max(1, n // 12)])
    if n > 90:
        rows += rows[:4] + [dict(rows[5], doc_id=None), dict(rows[6], doc_id=None), dict(rows[7], doc_id=rows[8]["doc_id"])]
    df = spark.createDataFrame([(*r.values(), 7, "g", 1) for r in rows], SCHEMA)
    made = merkle.manifest(df, merkle.tampered(df), fanout=fanout, levels=levels)
    got = sorted(map(tuple, made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)
    assert got == brute(rows, fanout)


def test_folds_resume_any_slot_and_empty_table_is_empty(spark):
    rows = rows_of(50, ["en"])
    df = spark.createDataFrame([(*r.values(), 7, "g", 1) for r in rows], SCHEMA)
    same = merkle.manifest(df, {}, fanout=4, levels=1)
    assert {r["verified"] for r in same.collect()} == {True}
    changed = merkle.manifest(df, {"text": F.concat(F.coalesce("text", F.lit("")), F.lit("!"))}, fanout=4, levels=1)
    assert {r["verified"] for r in changed.collect()} == {False}
    assert merkle.manifest(df.limit(0), merkle.tampered(df)).collect() == []


def test_largest_number_can_be_raised(spark):
    df = spark.createDataFrame([(i, "s", "en", 2 ** 63 - 1, "t", 0, "", 0) for i in range(40)], SCHEMA)
    rows = [{"doc_id": i, "source": "s", "lang": "en", "n_chars": 2 ** 63 - 1, "text": "t"} for i in range(40)]
    assert sorted(map(tuple, merkle.manifest(df, merkle.tampered(df)).collect()), key=str) == brute(rows, 2)


def test_batches_are_cut_between_blocks(monkeypatch):
    import pandas as pd
    monkeypatch.setattr(merkle, "GATHER", 10)
    rows = pd.DataFrame({"gid": [0] * 23 + [1] * 20, "pos": [*range(23), *range(20)]})
    parts = list(merkle.whole_blocks(iter(np.array_split(rows, 9)), 4))
    assert len(parts) > 1 and pd.concat(parts)[["gid", "pos"]].values.tolist() == rows.values.tolist()
    seen = [set(map(tuple, p.assign(b=p["pos"] // 4)[["gid", "b"]].values.tolist())) for p in parts]
    assert sum(map(len, seen)) == len(set().union(*seen))
