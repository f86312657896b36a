"""Ranked lexical search: term at a time over shards of the documents, rarest terms first, with limited accumulators."""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.frames import dense_positions, materialize
from .common import by_value, whole_documents

by_value(__name__)

TOP = 20
SHARD_ROWS, SHARD_POSTINGS = 32_768, 4_000_000     # a task searches its documents in shards of about so many at most
ITEMS, ITEM_BYTES = 1_000, 32 << 20                # items are searched in blocks of so many, and of so many bytes of text (or one item)
# Digits, letters of ASCII in lower case and all bytes of other characters are kept; what is left separates terms.
KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(KEPT).split()


def counted(items: DataFrame) -> DataFrame:
    """(place, words, times): distinct terms of each item and how often it holds them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [Counter(terms_of(t)) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["place"], pa.array([[*c.keys()] for c in counts], pa.list_(pa.binary())),
                                              pa.array([[*c.values()] for c in counts], pa.list_(pa.int64()))], ["place", "words", "times"])

    return items.select("place", "text").mapInArrow(run, "place long, words array<binary>, times array<long>")


def postings(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: all its terms counted, those of the vocabulary by number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for b in batches:
            lengths, ends, terms, tfs = [], [0], [], []
            for text in b["text"].to_pylist():
                words = terms_of(text) if text else []
                found = Counter(map(number, words))
                found.pop(None, None)
                lengths.append(len(words))
                terms.extend(found.keys())
                tfs.extend(found.values())
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            made = pa.RecordBatch.from_arrays([b["doc_id"], pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                                               pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])
            yield made.filter(pc.greater(made["n"], 0))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


def ranked(lists, query, n_docs: int, k: int, least: int):
    """(places, scores) of the ``k`` best documents of a shard, in order; only scores that can reach ``least`` matter.

    ``lists``: of each term the ascending places of its documents and its part of their scores; ``query``: (term, repeats),
    rarest first.  New accumulators are made until what the remaining terms can add at most lies below the kth partial score
    (or ``least``): a document without an accumulator can then no longer be among the best, even by a tie.  The survivors get
    the parts of all remaining terms, so their scores are exact.
    """
    query = [(*lists[t], times) for t, times in query if t in lists]
    rest = [0]
    for _, parts, times in reversed(query):
        rest.append(rest[-1] + times * int(parts.max()))
    rest.reverse()
    scores, at = np.zeros(n_docs, np.int64), 0
    while at < len(query):
        kth = least
        if at:
            made = scores[scores > 0]
            if len(made) >= k:
                kth = max(kth, int(np.partition(made, len(made) - k)[len(made) - k]))
        if rest[at] < kth:
            break
        places, parts, times = query[at]
        scores[places] += times * parts
        at += 1
    alive = np.flatnonzero(scores)
    totals = scores[alive]
    for places, parts, times in query[at:]:
        spot = np.minimum(np.searchsorted(places, alive), len(places) - 1)
        totals += np.where(places[spot] == alive, times * parts[spot], 0)
    best = np.lexsort((alive, -totals))[:k]
    return alive[best], totals[best]


def shard_lists(terms: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, weights: np.ndarray, n: int, total: int):
    """Inverted lists of a shard: places and parts of scores by term."""
    norm = 100 - 25 + (25 * lengths * n) // total
    place = np.repeat(np.arange(len(sizes)), sizes)
    parts = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * norm[place]))
    order = np.argsort(terms, kind="stable")
    terms, place, parts = terms[order], place[order], parts[order]
    starts = np.flatnonzero(np.diff(terms, prepend=-1))
    return dict(zip(terms[starts].tolist(), zip(np.split(place, starts[1:]), np.split(parts, starts[1:])))) if len(terms) else {}


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    waiting, rows, entries = [], 0, 0
    for b in batches:
        waiting.append(b)
        rows, entries = rows + b.num_rows, entries + len(b["terms"].flatten())
        if rows >= SHARD_ROWS or entries >= SHARD_POSTINGS:
            yield pa.Table.from_batches(waiting)
            waiting, rows, entries = [], 0, 0
    if rows:
        yield pa.Table.from_batches(waiting)


def search(index: DataFrame, shared, k: int) -> DataFrame:
    """(item, doc_id, score): the best documents of each task for each item, numbered as in the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, n, total = shared.value
        best, kind = [([], []) for _ in queries], None
        for shard in shards(batches):
            shard = shard.take(pc.sort_indices(shard, [("doc_id", "ascending")], null_placement="at_end")).combine_chunks()
            kind = shard.schema.field("doc_id").type
            terms, tfs = (shard[c].combine_chunks() for c in ("terms", "tfs"))
            sizes = pc.list_value_length(terms).to_numpy()
            lists = shard_lists(terms.flatten().to_numpy(), tfs.flatten().to_numpy(), sizes, shard["n"].to_numpy(), weights, n, total)
            names = shard["doc_id"]
            for i, query in enumerate(queries):
                scores, docs = best[i]
                places, found = ranked(lists, query, len(sizes), k, scores[-1] if len(scores) >= k else 0)
                if len(places):
                    both = sorted([*zip(scores, docs), *zip(found.tolist(), names.take(pa.array(places)).to_pylist())],
                                  key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[:k]
                    best[i] = ([x[0] for x in both], [x[1] for x in both])
        if kind is not None:
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, (s, _) in enumerate(best) for _ in s], pa.int32()), pa.array([d for _, docs in best for d in docs], kind),
                pa.array([s for scores, _ in best for s in scores], pa.int64())], ["item", "doc_id", "score"])

    return index.mapInArrow(run, f"item int, doc_id {index.schema['doc_id'].dataType.simpleString()}, score long")


def blocks(items: DataFrame) -> list[tuple[int, int]]:
    """Ranges of item places: at most ITEMS items and ITEM_BYTES bytes of text each, or a single item."""
    todo, done = [(0, items.count())], []
    while todo:
        lo, hi = todo.pop()
        if hi - lo > ITEMS or hi - lo > 1 and items.where(F.col("place").between(lo, hi - 1)).agg(
                F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] > ITEM_BYTES:
            todo += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
        elif hi > lo:
            done.append((lo, hi))
    return done


def lexical_search(items: DataFrame, docs: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item, with a score above 0.

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, in whole texts; only A-Z is lower-cased.
    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))) with N documents that hold any term, df those that hold this one.  A
    document of n terms has m = 100 - 25 + 25 n N div L, L being all terms; its score sums weight * (10^9 tf div (1000 tf + 12 m))
    over the item's terms, repeats included.

    Documents are read once per block of items (ITEMS, ITEM_BYTES), whose terms are broadcast, and only counts of their terms
    are written.  A task searches shards of its documents and keeps the best ``k`` of each item, which also limit the
    accumulators of its next shard; only these go to the merge.  N, L and df are counted over all documents first.

    A null or empty text has no term: such a document is not counted, such an item has no rows.  Equal scores are in the order
    of doc_id, a null id last; repeated documents are ranked each, and each row of a repeated item gives its own rows.  A very long
    text is counted in one task.  Empty tables give no rows; other columns are ignored, whatever their names.
    """
    items = materialize(items.select("item_id", "text").where("text IS NOT NULL"))
    placed = dense_positions(items, ["item_id", "text"], "place")
    parts = [_block(placed.where(F.col("place").between(lo, hi - 1)), docs, k) for lo, hi in blocks(placed)]
    if not parts:
        parts = [items.select("item_id", F.lit(0).alias("rank")).limit(0).join(docs.select("doc_id", F.lit(0).cast("long").alias("score")).limit(0))]
    return reduce(DataFrame.unionByName, parts)


def _block(items: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    rows = counted(items).orderBy("place").collect()                  # one block of items
    number = {w: i for i, w in enumerate(dict.fromkeys(bytes(w) for r in rows for w in r["words"]))}
    index = materialize(postings(whole_documents(docs), context.broadcast(number)))
    n, total = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(number), np.int64)
    for term, count in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():     # terms of the block
        df[term] = count
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    queries = []
    for r in rows:
        terms = sorted((int(df[number[bytes(w)]]), number[bytes(w)], t) for w, t in zip(r["words"], r["times"]))
        queries.append([(term, times) for d, term, times in terms if d])
    found = search(index, context.broadcast((queries, weights, n, total)), k)
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranks = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = F.broadcast(items.select("item_id", (F.col("place") - rows[0]["place"]).cast("int").alias("item")))
    return ranks.join(names, "item").select("item_id", "rank", "doc_id", "score")
