"""Near-duplicates by SimHash: fingerprints within a bit distance are linked, linked groups are components."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..functions.frames import materialize
from .common import by_value, whole_documents, whole_text, without
from .components import connected_components

by_value(__name__)

HASH_SEED = 42
BITS = 64
SHINGLES_AT_ONCE = 1 << 16         # shingle hashes whose bits are counted together
TILE = 2048                        # fingerprints on each side of one exclusive-or
GATHER = 32_768                    # candidates that a task takes up at a time
SPLIT = 16_384                     # candidates of one key that a single task compares


def text_fingerprint(text: str, shingle: int) -> int:
    """The majority of each bit over the hashes of all word shingles, repeats included; 0 without a word."""
    words = text.encode().lower().split()      # on bytes: lower-cases A-Z only, splits at the six ASCII blanks only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed=HASH_SEED)
    n, ones = len(words) - shingle + 1, np.zeros(BITS, np.int64)
    for start in range(0, n, SHINGLES_AT_ONCE):
        part = words[start:start + SHINGLES_AT_ONCE + shingle - 1]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), HASH_SEED) for s in zip(*(part[i:] for i in range(shingle)))], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, shingle: int = 3) -> DataFrame:
    """Add ``fp``, the 64-bit SimHash as a signed long, to rows with a ``text``."""
    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([text_fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return without(whole_documents(df), "fp").withColumn("fp", prints(whole_text()))


def blocks(distance: int, n_blocks: int) -> list[tuple[int, ...]]:
    """Bit masks: prints that differ in at most ``distance`` bits agree on all bits of one of them."""
    edges = [BITS * i // n_blocks for i in range(n_blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n_blocks)]
    whole = [sum(masks[i] for i in chosen) for chosen in combinations(range(n_blocks), n_blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in whole]


def forest(values: np.ndarray, side: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over prints within ``distance``; pairs of one side other than 0 are left to other tasks.

    Exact comparison in tiles over prints sorted by their number of ones: a pair of tiles is skipped if the numbers differ
    by more than the distance everywhere.
    """
    ones = np.bitwise_count(values)
    order = np.argsort(ones, kind="stable")
    values, side, ones = values[order], side[order], ones[order].astype(np.int64)
    parent = np.arange(len(values))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for a in range(0, len(values), TILE):
        left, left_side = values[a:a + TILE], side[a:a + TILE]
        for b in range(a, len(values), TILE):
            if ones[b] - ones[min(a + TILE, len(values)) - 1] > distance:
                break
            right = values[b:b + TILE]
            for i in range(len(left)):
                first = i + 1 if a == b else 0
                near = np.flatnonzero(np.bitwise_count(left[i] ^ right[first:]) <= distance) + first
                if left_side[i]:
                    near = near[side[b + near] != left_side[i]]
                for j in near:
                    p, q = root(a + i), root(b + j)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        links.append((int(left[i]), int(right[j])))
    return links


def small_groups(keys: np.ndarray, values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """All links inside runs of equal keys, by comparing the column with itself shifted by 1, 2, ... rows."""
    found, shift = [], 1
    while shift < len(keys):
        same = np.flatnonzero(keys[shift:] == keys[:-shift])
        if not len(same):
            break
        near = same[np.bitwise_count(values[same] ^ values[same + shift]) <= distance]
        found.append((values[near], values[near + shift]))
        shift += 1
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (values[:0], values[:0])


def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows in batches of at least GATHER rows but for the last; none is empty."""
    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += len(batch)
        if n >= GATHER:
            yield pd.concat(waiting, ignore_index=True)
            waiting, n = [], 0
    if n:
        yield pd.concat(waiting, ignore_index=True)


def links(prints: DataFrame, distance: int, n_blocks: int) -> DataFrame:
    """(u, v): links whose components are those of all pairs of distinct prints ``fp`` within ``distance`` bits.

    Prints within the distance agree on all but ``distance`` of ``n_blocks`` blocks of bits, so only prints that agree there
    are compared.  A key with more than SPLIT prints is dealt out as pairs of parts: each part meets each other part in a task.
    """
    masks = blocks(distance, n_blocks)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("band", "key"))
    hot = keyed.groupBy(F.col("band").alias("_b"), F.col("key").alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SPLIT)
    parts = F.coalesce(F.ceil(F.col("_n") / SPLIT), F.lit(1)).cast("int")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = (keyed.join(hot, (F.col("band") == F.col("_b")) & (F.col("key") == F.col("_k")), "left").withColumn("parts", parts)
             .select("fp", "band", "key", part.alias("part"), other.alias("other"))
             .select("fp", "band", "key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"),
                     F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2).alias("side")))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in gathered(batches):
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            columns = batch[["band", "key", "lo", "hi"]]
            group = (columns != columns.shift()).any(axis=1).cumsum().to_numpy()
            open_from = int(np.searchsorted(group, group[-1]))
            rest = batch.iloc[open_from:]
            yield from _groups(batch.iloc[:open_from], group[:open_from])
        if rest is not None:
            yield from _groups(rest, np.ones(len(rest), np.int64))

    def _groups(rows: pd.DataFrame, group: np.ndarray) -> Iterator[pd.DataFrame]:
        if not len(rows):
            return
        values, side = rows["fp"].to_numpy().view(np.uint64), rows["side"].to_numpy()
        starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        sizes = np.diff(np.append(starts, len(group)))
        large = sizes > 64
        small = ~np.repeat(large, sizes)
        small &= np.repeat((np.maximum.reduceat(side, starts) == 0), sizes)
        pairs = [small_groups(group[small], values[small], distance)]
        for start, size in zip(starts, sizes):
            if not small[start]:
                found = forest(values[start:start + size], side[start:start + size], distance)
                pairs.append(tuple(np.array(x, np.uint64) for x in zip(*found)) if found else (values[:0], values[:0]))
        yield pd.DataFrame({"u": np.concatenate([p[0] for p in pairs]).view(np.int64), "v": np.concatenate([p[1] for p in pairs]).view(np.int64)})

    keys = ["band", "key", "lo", "hi"]
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *keys).sortWithinPartitions(*keys).mapInPandas(compare, "u long, v long")


def grouped(df: DataFrame, shingle: int, distance: int, n_blocks: int) -> DataFrame:
    """(doc_id, key, fp, label, component_id) of every row: ``key`` is the same for rows of equal id and text only (but for hash
    collisions within one id), ``label`` is the same for rows of one component."""
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64("text")))
    prints = materialize(fingerprints(df.select("doc_id", "text").withColumn("key", key), shingle).select("doc_id", "key", "fp"))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = materialize(connected_components(links(distinct.select("fp"), distance, n_blocks)))
    labelled = distinct.join(labels.withColumnRenamed("node", "fp"), "fp")
    tops = labelled.groupBy("component").agg(F.min("first").alias("top"))
    linked = labelled.join(tops, "component").select(F.col("fp").alias("_fp"), "component", "top")
    named = materialize(distinct.join(linked, F.col("fp") == F.col("_fp"), "left").select(     # written, so that the join below can be split
        "fp", F.coalesce("component", "fp").alias("label"), F.coalesce("top", "first").alias("component_id")))
    return prints.join(named, "fp")


def near_duplicates(df: DataFrame, shingle: int = 3, distance: int = 2, n_blocks: int = 4) -> DataFrame:
    """(``doc_id``, ``fingerprint``, ``component_id``) of every row of a table with ids and texts.

    Words are lower-cased (A-Z only) and joined to ``shingle``-word shingles; a text with fewer words is one shingle, and one
    without words (null, empty, blank) has fingerprint 0 and is linked like any other.  Rows whose fingerprints differ in at
    most ``distance`` bits are linked; ``component_id`` is the smallest id reachable.  Equal fingerprints are compared once,
    so copies cost nothing.  Repeated rows stay repeated; a null id belongs to its component without naming it (null if the
    component has no other id).  Other columns are ignored; an empty table gives an empty table.
    """
    return grouped(df, shingle, distance, n_blocks).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, shingle: int = 3, distance: int = 2, n_blocks: int = 4) -> DataFrame:
    """The input's columns, one row of each group of near-duplicates: that with the smallest id, of equal ids any one text.

    Rows without an id are groups' last choice.  Other cases are those of ``near_duplicates``.
    """
    rows = grouped(df, shingle, distance, n_blocks)
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m"))
    kept = materialize(first.select(F.col("m.key").alias("_key")))
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64("text")))
    return without(df, "_key").withColumn("_key", key).join(kept, "_key", "left_semi").dropDuplicates(["_key"]).drop("_key")
