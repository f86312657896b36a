"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are built."""
from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import Remembered, by_value, whole_documents, whole_text, without

by_value(__name__)

MARK = "▁"                    # stands for a blank inside pieces
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
REMEMBERED_CHARS = 48              # counts of segments up to this length are remembered,
REMEMBERED = 150_000               # in two generations of so many each per Python worker
NORMAL = 1                         # the piece type that merging can reach


def load_ranks(path: str) -> dict[str, float]:
    """Rank of every piece of a byte-pair model with byte fallback, smaller is merged earlier.

    The model must put a mark before the text, keep blanks as they are, and hold no piece with a mark behind another
    character: then no merge crosses the start of a run of marks, and segments can be counted one by one.
    """
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    ranks = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
    if (model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix
            or not model.trainer_spec.byte_fallback or any(MARK in p.lstrip(MARK) for p in ranks)):
        raise ValueError("not a byte-pair model of the supported kind")
    return ranks


def merged_length(segment: str, ranks: dict[str, float]) -> int:
    """Number of tokens of one segment: its initial symbols minus the merges.

    Adjacent pairs wait in a heap by rank, then place.  A popped pair is stale if one of its sides was merged meanwhile.
    A character without a piece starts as its UTF-8 bytes, which never merge.
    """
    n = len(segment)
    symbols, after, before = list(segment), list(range(1, n + 1)), list(range(-1, n - 1))
    count = n
    for c in symbols:
        if c not in ranks:
            count += len(c.encode()) - 1
    heap = []
    for i in range(n - 1):
        rank = ranks.get(segment[i:i + 2])
        if rank is not None:
            heap.append((rank, i, 2))
    heapq.heapify(heap)
    while heap:
        rank, i, size = heapq.heappop(heap)
        left = symbols[i]
        if not left:
            continue
        j = after[i]
        if j >= n or len(left) + len(symbols[j]) != size:
            continue
        merged = left + symbols[j]
        symbols[i], symbols[j] = merged, ""
        count -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = ranks.get(merged + symbols[k])
            if rank is not None:
                heapq.heappush(heap, (rank, i, size + len(symbols[k])))
        h = before[i]
        if h >= 0:
            rank = ranks.get(symbols[h] + merged)
            if rank is not None:
                heapq.heappush(heap, (rank, h, len(symbols[h]) + size))
    return count


def remembered_lengths(ranks: dict[str, float]) -> Remembered:
    return Remembered(lambda segment: merged_length(segment, ranks), REMEMBERED_CHARS, REMEMBERED)


def text_length(text: str, lengths: Remembered) -> int:
    if not text:
        return 0
    marked = MARK + text.replace(" ", MARK)
    return sum(map(lengths.__getitem__, SEGMENT.findall(marked)))


def token_counts(df: DataFrame, model: str | None = None, limit: int = 4096) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to rows with a ``text``.

    Counts equal those of the sentencepiece library for the same model file, without begin, end or other added tokens;
    strings of special tokens inside a text are ordinary text.  ``model`` is a path on the driver; the ranks (some tens of
    thousands) are broadcast.  A null text counts as empty (0 bytes, 0 tokens).  A very long text is read whole; only its
    segments between blanks are held in the heap.  Repeated rows are counted again, an empty table gives an empty table, and
    input columns named like the added ones are replaced.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_ranks(model or public_tokenizers.path("piece_bpe_32k.model")))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = remembered_lengths(shared.value)
        for texts in batches:
            yield pd.Series([text_length(t, lengths) for t in texts], dtype="int64")

    out = without(whole_documents(df), "n_bytes", "n_tokens", "over_limit")
    return (out.withColumn("n_bytes", F.octet_length(whole_text()).cast("long")).withColumn("n_tokens", count(whole_text()))
            .withColumn("over_limit", F.col("n_tokens") > limit))
