"""Merkle manifest of a table: parents keep the hash state before each child slot, so a changed leaf is folded up from there."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.frames import dense_positions, materialize, spread_join
from .common import by_value

by_value(__name__)

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2                         # children of a parent
LEVELS = 12                        # levels that one task climbs at once; a block has FANOUT ** LEVELS nodes at most
GATHER = 16_384                    # nodes that a task takes up at a time, at least: whole blocks


def root_bits(n: int, power: int) -> int:
    """The first 32 bits behind the point of the square or cube root of ``n``."""
    low, high = 0, n << 32
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle ** power <= n << 32 * power else (low, middle - 1)
    return low & 0xFFFFFFFF


PRIMES = [n for n in range(2, 312) if all(n % d for d in range(2, n))]
ROUND = [np.uint32(root_bits(p, 3)) for p in PRIMES]
START = np.array([root_bits(p, 2) for p in PRIMES[:8]], np.uint32)
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256 states (8, n) after one more block (16, n) of 64 bytes each, for n messages side by side."""
    w = [block[i] for i in range(16)]
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        if i >= 16:
            x, y = w[i - 15], w[i - 2]
            w.append(w[i - 16] + w[i - 7] + (turned(x, 7) ^ turned(x, 18) ^ (x >> np.uint32(3)))
                     + (turned(y, 17) ^ turned(y, 19) ^ (y >> np.uint32(10))))
        one = h + (turned(e, 6) ^ turned(e, 11) ^ turned(e, 25)) + ((e & f) ^ (~e & g)) + ROUND[i] + w[i]
        two = (turned(a, 2) ^ turned(a, 13) ^ turned(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def ending(blocks: np.ndarray) -> np.ndarray:
    """The closing block (16, n) of messages that were ``blocks`` whole blocks long."""
    out = np.zeros((16, len(blocks)), np.uint32)
    out[0], out[14], out[15] = 0x80000000, blocks.astype(np.uint64) >> 23, blocks.astype(np.uint64) << 9 & 0xFFFFFFFF
    return out


def written(digests: np.ndarray) -> np.ndarray:
    """Blocks (16, n) that hold the hex text of digests (8, n): one digest fills one block."""
    raw = np.ascontiguousarray(digests.T).astype(">u4").view(np.uint8)
    text = HEX[np.stack([raw >> 4, raw & 15], axis=2).reshape(len(raw), 64)]
    return np.ascontiguousarray(text.view(">u4").astype(np.uint32).T)


def parsed(texts) -> np.ndarray:
    """Digests (8, n) of hex texts."""
    raw = bytes.fromhex("".join(texts))
    return np.ascontiguousarray(np.frombuffer(raw, ">u4").astype(np.uint32).reshape(-1, 8).T)


def shown(digests: np.ndarray) -> list[str]:
    raw = np.ascontiguousarray(digests.T).astype(">u4").tobytes().hex()
    return [raw[i:i + 64] for i in range(0, len(raw), 64)]


def put(target: np.ndarray, where: np.ndarray, made) -> np.ndarray:
    """``target`` with the columns ``where`` replaced by what ``made`` gives for them."""
    if where.any():
        target = target.copy()
        target[:, where] = made(where)
    return target


class Level:
    """The parents of one level of many blocks side by side, with the states they keep before each child slot."""

    def __init__(self, nodes: np.ndarray, place: np.ndarray, grows: np.ndarray, fanout: int):
        """``place``: place of a node in its block; a node that does not grow is its own parent."""
        self.fanout, self.slot = fanout, np.where(grows, place % fanout, 0)
        self.first = np.flatnonzero(self.slot == 0)
        self.parent = np.cumsum(self.slot == 0) - 1
        self.children = np.bincount(self.parent, minlength=len(self.first))
        self.grows, self.texts = grows[self.first], written(nodes)
        state = np.repeat(START[:, None], len(self.first), axis=1)
        self.before = []
        for k in range(fanout):
            self.before.append(state)
            state = put(state, self.grows & (k < self.children), lambda at: absorb(state[:, at], self.texts[:, self.first[at] + k]))
        self.nodes = put(nodes[:, self.first], self.grows, lambda at: absorb(state[:, at], ending(self.children[at])))

    def step(self, node: np.ndarray):
        """(slot, children of the parent or 0 if it does not grow, kept state, texts of the children) of each given node."""
        parent, slot = self.parent[node], self.slot[node]
        children = np.where(self.grows[parent], self.children[parent], 0)
        state = np.stack(self.before)[slot, :, parent].T
        at = np.minimum(self.first[parent] + np.arange(self.fanout)[:, None], self.texts.shape[1] - 1)
        return slot, children, state, self.texts[:, at]


def fold(leaf: np.ndarray, slot, children, state, texts) -> np.ndarray:
    """Digests of the parents with ``leaf`` in their slot: the kept state goes on with it and the siblings to its right."""
    def made(at):
        now, last = absorb(state[:, at], written(leaf[:, at])), children[at]
        for k in range(1, texts.shape[1]):
            now = put(now, (slot[at] < k) & (k < last), lambda some: absorb(now[:, some], texts[:, k][:, at][:, some]))
        return absorb(now, ending(last))
    return put(leaf, children > 0, made)


def list_siblings(state: np.ndarray, count: np.ndarray, slot, children, texts):
    """State and length of the running hash over all siblings of the path, after those of one more level."""
    for k in range(texts.shape[1]):
        more = (slot != k) & (k < children)
        state, count = put(state, more, lambda at: absorb(state[:, at], texts[:, k][:, at])), count + more
    return state, count


def heights(n: np.ndarray, fanout: int, levels: int) -> np.ndarray:
    """Levels that a block climbs: to a lone node if it is the whole sequence of ``n`` nodes, else all."""
    height, left = np.zeros(len(n), np.int64), n.copy()
    for _ in range(levels):
        height += left > 1
        left = -(-left // fanout)
    return height


def climb(rows: pd.DataFrame, fanout: int, levels: int):
    """Levels of the whole blocks in ``rows`` (sorted by gid and pos): yields each level, and at last the top of each row."""
    size = fanout ** levels
    place, n = rows["pos"].to_numpy() % size, rows["n"].to_numpy()
    height = heights(n, fanout, levels)
    nodes, of = parsed(rows["node"]), np.arange(len(rows))
    for t in range(levels):
        grows = height > t
        level = Level(nodes, place, grows, fanout)
        yield level, of, nodes
        nodes, of = level.nodes, level.parent[of]
        place, height = np.where(grows, place // fanout, place)[level.first], height[level.first]
    yield None, of, nodes


def whole_blocks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The same rows in batches of at least GATHER rows but for the last, cut between blocks."""
    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += len(batch)
        if n < GATHER + size:
            continue
        rows = pd.concat(waiting, ignore_index=True)
        last = rows.iloc[-1]
        cut = int(np.argmax(((rows["gid"] == last["gid"]) & (rows["pos"] // size == last["pos"] // size)).to_numpy()))
        if cut:
            yield rows.iloc[:cut].reset_index(drop=True)
        waiting, n = [rows.iloc[cut:]], len(rows) - cut
    if n:
        yield pd.concat(waiting, ignore_index=True)


def by_block(nodes: DataFrame, size: int) -> DataFrame:
    """Whole blocks in one task each, in order."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.floor(F.col("pos") / size).cast("long")
    return nodes.repartition(parts, "gid", block).sortWithinPartitions("gid", "pos")


def folded_leaves(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Bottom blocks: each leaf with the ``top`` of its block, the top ``folded`` from its changed value, and the running hash of its siblings."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_blocks(batches, fanout ** levels):
            folded = parsed(rows["changed"].where(rows["changed"].notna(), rows["node"]))
            state, count = np.repeat(START[:, None], len(rows), axis=1), np.zeros(len(rows), np.int64)
            for level, of, nodes in climb(rows, fanout, levels):
                if level is None:
                    top = shown(nodes)
                else:
                    slot, children, kept, texts = level.step(of)
                    folded = fold(folded, slot, children, kept, texts)
                    state, count = list_siblings(state, count, slot, children, texts)
            yield pd.DataFrame({"gid": rows["gid"], "pos": rows["pos"], "n": rows["n"], "doc_id": rows["doc_id"], "node": rows["node"],
                                "top": [top[i] for i in of], "folded": shown(folded), "state": shown(state), "count": count})

    return by_block(nodes, fanout ** levels).mapInPandas(
        run, f"gid long, pos long, n long, doc_id {nodes.schema['doc_id'].dataType.simpleString()}, node string, top string, folded string, "
             "state string, count long")


def paths(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Upper blocks: each node with its ``top`` and its ``path``: of each level the slot, the children, the kept state and their texts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_blocks(batches, fanout ** levels):
            path = []
            for level, of, nodes in climb(rows, fanout, levels):
                if level is None:
                    top = shown(nodes)
                else:
                    slot, children, kept, texts = level.step(of)
                    path.append(np.concatenate([np.stack([slot, children]).astype(np.uint32), kept, texts.transpose(1, 0, 2).reshape(-1, len(slot))]))
            steps = np.ascontiguousarray(np.concatenate(path).T.astype("<u4"))
            yield pd.DataFrame({"gid": rows["gid"], "pos": rows["pos"], "n": rows["n"], "top": [top[i] for i in of], "path": [s.tobytes() for s in steps]})

    return by_block(nodes, fanout ** levels).mapInPandas(run, "gid long, pos long, n long, top string, path binary")


def layer_above(layer: DataFrame, size: int) -> DataFrame:
    """The tops of a layer's blocks as nodes of the next one."""
    return layer.where(F.col("pos") % size == 0).select(
        "gid", F.floor(F.col("pos") / size).cast("long").alias("pos"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("top").alias("node"))


def upper_paths(nodes: DataFrame, most: int, fanout: int, levels: int) -> DataFrame:
    """(gid, pos, path, top) of the nodes: the path to the last top of their sequence; ``most``: nodes of the longest one."""
    size, layers = fanout ** levels, []
    while True:
        layers.append(materialize(paths(nodes, fanout, levels)))
        if most <= size:
            break
        nodes, most = layer_above(layers[-1], size), -(-most // size)
    whole = layers.pop()
    while layers:
        above = whole.select(F.col("gid").alias("_g"), F.col("pos").alias("_p"), F.col("path").alias("_path"), F.col("top").alias("_top"))
        below = layers.pop()
        whole = below.join(above, (F.col("gid") == F.col("_g")) & (F.floor(F.col("pos") / size) == F.col("_p"))).select(
            "gid", "pos", "n", F.col("_top").alias("top"), F.concat("path", "_path").alias("path"))
    return whole.select("gid", "pos", "path", "top")


def finished(rows: DataFrame, fanout: int) -> DataFrame:
    """Fold the bottom tops and the running hashes along the upper path."""
    width = 2 + 8 + 16 * fanout

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            spot, distinct = pd.factorize(b["block"] + "/" + b["folded"])          # an unchanged block folds up once
            place = np.zeros(len(distinct), np.int64)
            place[spot] = np.arange(len(b))
            steps = np.stack([np.frombuffer(x, "<u4") for x in b["path"]]).astype(np.uint32).reshape(len(b), -1, width)
            folded, state, count = parsed(b["folded"].iloc[place]), parsed(b["state"]), b["count"].to_numpy()
            for t in range(steps.shape[1]):
                one = np.ascontiguousarray(steps[:, t].T)
                slot, children, kept = one[0].astype(np.int64), one[1].astype(np.int64), one[2:10]
                texts = one[10:].reshape(fanout, 16, -1).transpose(1, 0, 2)
                folded = fold(folded, slot[place], children[place], kept[:, place], texts[:, :, place])
                state, count = list_siblings(state, count, slot, children, texts)
            made = np.array(shown(folded), object)[spot]
            yield pd.DataFrame({"doc_id": b["doc_id"], "leaf": b["node"], "subroot": b["subroot"], "root": b["root"],
                                "proof_sha256": shown(absorb(state, ending(count))), "folded_root": made, "verified": made == b["root"].to_numpy(object)})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, "
                                 "proof_sha256 string, folded_root string, verified boolean")


def leaf(fields: dict[str, Column]) -> Column:
    """Digest of a row: of each value ``-`` if it is null, else its length in UTF-8 bytes, a colon and the value."""
    texts = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def manifest(df: DataFrame, changed: dict[str, Column] | None = None, fields=FIELDS, group: str = "lang", order: str = "doc_id",
             fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row: a Merkle tree per ``group``, and one over them.

    A row's leaf is the digest of its ``fields``.  The leaves of a group ascend by ``order``; ``fanout`` consecutive nodes (the last
    ones of a level may be fewer, even one) become the digest of their hex texts, until one is left, the subroot; the subroots, by
    group, become the root likewise.  ``proof_sha256`` is the digest of all siblings on the way up.  ``folded_root`` is the root
    that follows from the row with its ``changed`` values (columns by field, where not equal to the row's own) and the original
    siblings; ``verified`` says whether it is the root.

    A hex digest fills one block of SHA-256, so the state before a child slot is eight words.  A parent keeps them for each slot;
    folding goes on from the state of the matching slot with the new child and its right siblings only.  A task climbs blocks of
    ``fanout ** levels`` neighbouring nodes; their tops are the nodes of the next layer, so a group of any size is spread over
    tasks, and leaves and upper paths meet in one join by block.  Texts are hashed where they are read and not shuffled.

    Nulls count as values: a null group is a group of its own (the first), a null order comes first.  Of equal orders the smaller
    leaf is first; equal rows have equal results but for their place.  Empty texts have length 0, a single row is its own
    subroot, an empty table gives an empty table.  Other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    own = {c: F.col(c) for c in fields}
    other = leaf({c: (changed or {}).get(c, own[c]) for c in fields})
    first = df.select(F.col(order).alias("doc_id"), F.col(group).alias("_group"), leaf(own).alias("node"), other.alias("_other"))
    leaves = first.select("doc_id", "_group", "node", F.when(F.col("_other") != F.col("node"), F.col("_other")).alias("changed"))
    placed = dense_positions(leaves, ["_group", "doc_id", "node", "changed"], "_place")
    groups = dense_positions(placed.groupBy("_group").agg(F.min("_place").alias("_base"), F.count(F.lit(1)).alias("n")), "_group", "gid")
    n_groups, most = groups.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    nodes = spread_join(placed, groups, "_group", row_id="node").select(
        "gid", (F.col("_place") - F.col("_base")).alias("pos"), "n", "doc_id", "node", "changed")
    size = fanout ** levels
    bottom = materialize(folded_leaves(nodes, fanout, levels))
    upper = upper_paths(layer_above(bottom, size), -(-most // size), fanout, levels)
    subroots = materialize(upper.where("pos = 0").select("gid", F.col("top").alias("subroot")))
    tops = subroots.select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("pos"), F.lit(n_groups).cast("long").alias("n"), F.col("subroot").alias("node"))
    top = upper_paths(tops, n_groups, fanout, levels).select(F.col("pos").alias("gid"), F.col("path").alias("_path"), F.col("top").alias("root"))
    whole = spread_join(upper, materialize(top.join(subroots, "gid")), "gid", row_id="pos").select(
        F.col("gid").alias("_g"), F.col("pos").alias("_block"), F.concat("path", "_path").alias("path"), "subroot", "root")
    rows = bottom.join(materialize(whole), (F.col("gid") == F.col("_g")) & (F.floor(F.col("pos") / size) == F.col("_block")))
    return finished(rows.withColumn("block", F.concat_ws(":", "gid", "_block")), fanout)


def tampered(df: DataFrame, every: int = 7) -> dict[str, Column]:
    """One more in ``n_chars`` where ``every`` divides the crc32 of the id as text; nulls stay."""
    return {"n_chars": F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(every)) == 0,
                              F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)")).cast("decimal(20,0)")}
