"""Token counts and SentencePiece codes against the library, brute force and round trips."""
import pickle
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as library
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from letterwatch.llm import common
from letterwatch.llm import sentencepiece as S
from letterwatch.llm import token_count as T

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "a", "the cat sat on the mat", "  two  blanks   here ", "tabs\tand\nlines\r\n", "▁ mark ▁▁x", "<s> </s> <unk> <0x0A>",
         "漢字とかな é ü ß 😀", "x" * 3000, "aaaa bbbb " * 900, "internationalization" * 50, "a b", "The the THE"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7, "old") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], 7, "old"), (None, "no id", 7, "old")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, IDS string")


def test_counts_equal_the_library(docs):
    sp = library.SentencePieceProcessor(model_file=MODEL)
    got = T.token_counts(docs, limit=100).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        n = len(sp.encode(r["text"] or ""))
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 100, len((r["text"] or "").encode())), r["text"]


def test_memory_of_counts_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 3)
    lengths = T.remembered_lengths(T.load_ranks(MODEL))
    assert [T.text_length(t, lengths) for t in ("a b c d e f", "a b c d e f")] == [6, 6] and len(lengths) <= 3 >= len(lengths.older)


def scanned(v, text, size):
    """Chunks cut anywhere: matrices, states at the cuts, and each chunk traced back."""
    whole = " " + text
    chunks = []
    for cut in range(0, len(whole), size):
        begin = max(0, cut - v.longest)
        chunks.append((whole[begin:cut + size + v.longest], cut - begin, min(cut + size, len(whole)) - begin))
    states = S.states_at_cuts([S.transfer(v, *c) for c in chunks])
    return np.frombuffer(b"".join(S.traced(v, *c, x, y) for c, x, y in zip(chunks, states, states[1:])), "<i4").tolist()


@pytest.mark.parametrize("size", [1, 3, 16, 61, 500])
def test_chunks_cut_anywhere_give_the_ids_of_the_library(size):
    sp, v = library.SentencePieceProcessor(model_file=MODEL), S.Vocabulary(MODEL)
    more = ["internationalization of abbreviations " * 9, "$" * 300, "=-" * 120, " " * 90, "withoutanyblanksatall" * 20, "dies und, das; $$$ " * 9]
    for text in [t[:700] for t in TEXTS if t and S.MARK not in t] + more:
        assert scanned(v, text, size) == sp.encode(text), text


def test_an_encoding_is_the_one_path_of_fitting_pieces():
    v = S.Vocabulary(MODEL)
    for text in (" abbreviations", "$$$$$$$", "aaaaaaaaa", "Wettbewerbsfähigkeit", " 12345,67", "xyzzyx"):
        pieces = v.pieces(text)
        assert v._merged_by_heap(text) == pieces
        assert all(v.fits(a, b) for a, b in zip(pieces, pieces[1:]))
        ways = [{} for _ in range(len(text) + 1)]                     # number of paths by last piece
        for e in range(1, len(text) + 1):
            for s in range(max(0, e - v.longest), e):
                if text[s:e] in v.ids:
                    n = 1 if not s else sum(k for p, k in ways[s].items() if v.fits(p, text[s:e]))
                    if n:
                        ways[e][text[s:e]] = n
        assert ways[-1] == {pieces[-1]: 1}


def test_products_are_associative():
    v = S.Vocabulary(MODEL)
    whole = " internationalizationofabbreviationsandeverythingelse"
    cuts = [0, 9, 20, 31, len(whole)]
    a, b, c, d = (S.transfer(v, whole, x, y) for x, y in zip(cuts, cuts[1:]))
    left, right = S.combine(S.combine(S.combine(a, b), c), d), S.combine(a, S.combine(b, S.combine(c, d)))
    assert left == right and S.combine(S.combine(a, b), S.combine(c, d)) == left and len(b) > 1


def test_what_is_remembered_is_bounded_and_stays_at_home(monkeypatch):
    monkeypatch.setattr(S, "REMEMBERED", 3)
    monkeypatch.setattr(S, "FITS", 2)
    v = S.Vocabulary(MODEL)
    assert v.whole(" a b c d e f") == v.whole(" a b c d e f") and len(v.segments) <= 3 >= len(v.segments.older)
    assert [v.fits("a", x) for x in "bcde"] == [v.fits("a", x) for x in "bcde"] and len(v.fitting) <= 2
    again = pickle.loads(pickle.dumps(v))
    assert not again.segments and again.whole(" a b") == v.whole(" a b")


def test_new_words_of_many_texts_are_merged_together(monkeypatch):
    monkeypatch.setattr(S, "TOGETHER", 7)
    monkeypatch.setattr(S, "PORTION", 5000)
    sp, v, draw = library.SentencePieceProcessor(model_file=MODEL), S.Vocabulary(MODEL), random.Random(4)
    words = ["".join(draw.choices("etaoinshrdlu.,$=éß漢0", k=n)) for n in range(1, 60) for _ in range(9)] + ["a" * n for n in range(1, 50)]
    texts = ["", *("  ".join(draw.choices(words, k=40)) for _ in range(9)), "", *words, " ", "", "\U000103a0 of \U000103a0s"]
    alone = []
    monkeypatch.setattr(v, "pieces", lambda segment: alone.append(segment) or S.Vocabulary.pieces(v, segment))
    ends, ids = v.wholes([" " + t if t else "" for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [sp.encode(t) for t in texts] and len(texts) == len(ends) - 1
    assert alone and all(len(s) > S.SCANNED or not set(s) <= set(v.ids) for s in alone)
    assert [x.tolist() for x in v.wholes([])] == [[0], []] and [x.tolist() for x in v.wholes(["", ""])] == [[0, 0, 0], []]


def test_segments_without_a_piece_are_merged_with_the_others_and_leave_nothing_behind():
    v, draw = S.Vocabulary(MODEL), random.Random(6)
    odd = [c for c in map(chr, [0, 1, 7, 0x7F, 0x85, 0x301, 0x2581, 0xFFFD, 0x103A0, 0x1F9FF]) if c not in v.ids]
    texts = [" " + " ".join("".join(draw.choices(odd + list("internation"), k=n)) for n in range(1, 40)) for _ in range(60)] + ["", " " + odd[0], " " + "".join(odd)]
    ends, ids = v.wholes(texts)
    assert len(odd) > 3 and not v.segments and not v.segments.older
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [np.frombuffer(v.whole(t), "<i4").tolist() for t in texts]


def test_memory_of_fits_does_not_grow():
    v, pieces = S.Vocabulary(MODEL), [p for p in S.Vocabulary(MODEL).ids if len(p) == 2][:150]
    want = {(a, b): v.pieces(a + b) == [a, b] for a in pieces[::10] for b in pieces}
    tracemalloc.start()
    got = {(a, b): v.fits(a, b) for a in pieces[::10] for b in pieces}
    some = tracemalloc.get_traced_memory()[0]
    for a in pieces:
        for b in pieces:
            v.fits(a, b)
    grown = tracemalloc.get_traced_memory()[0] - some
    tracemalloc.stop()
    assert got == want == {x: v.fits(*x) for x in want} and len(set(want.values())) == 2 and grown < 200_000


def test_a_character_that_is_only_part_of_pieces(tmp_path):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    next(p for p in proto.pieces if p.piece == "u").type = 5
    (tmp_path / "less.model").write_bytes(proto.SerializeToString())
    v, texts = S.Vocabulary(str(tmp_path / "less.model")), [" the unusual queue of unique tubs", "", " a u", " thus"]
    ends, ids = v.wholes(texts)
    assert "u" not in v.ids and any("u" in p for p in v.ids)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [np.frombuffer(v.whole(t), "<i4").tolist() for t in texts]


def test_batches_of_long_documents_are_bounded_by_bytes(spark):
    @F.pandas_udf("long")
    def together(texts):
        return texts.str.len().sum() + 0 * texts.str.len()

    df = common.whole_documents(spark.range(100).coalesce(1).select(F.repeat(F.lit("words "), 20_000).alias("text")))
    assert max(r[0] for r in df.select(together("text")).collect()) <= common.BATCH_BYTES + 120_000


def test_other_kinds_of_models_are_refused(tmp_path):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    (tmp_path / "unigram.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="byte-pair"):
        S.Vocabulary(str(tmp_path / "unigram.model"))


def test_round_trip_short_and_giant(docs):
    plain = {r["doc_id"]: r for r in S.decode(S.encode(docs.where("doc_id IS NOT NULL"))).collect()}
    cut = S.decode(S.encode(docs, giant=64)).collect()
    assert len(cut) == len(TEXTS) + 2 and "IDS" not in S.encode(docs).columns
    for r in cut:
        assert r["decoded"] == (r["text"] or "")
        if r["doc_id"] is not None:
            assert r["ids"] == plain[r["doc_id"]]["ids"]
    assert plain[0]["ids"] == [] == plain[1]["ids"]


@pytest.mark.parametrize("giant", [64, 1 << 20])
def test_ids_equal_the_library(docs, giant, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 20)
    sp = library.SentencePieceProcessor(model_file=MODEL)
    more = docs.select("text").union(docs.sparkSession.createDataFrame([("dies und, das; $$$ " * 30,), ("$$$$$ " * 40,)], "text string"))
    for r in S.encode(more.where("text IS NULL OR NOT contains(text, '▁')"), giant=giant).collect():
        assert r["ids"] == sp.encode(r["text"] or ""), r["text"]


def test_giants_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 100)
    df = spark.createDataFrame([(i, ("some words of a long text, " * 40 + "x" * 250) * 3) for i in (1, 1, 2)], "doc_id long, text string")
    rows = S.decode(S.encode(df, giant=150)).collect()
    sp = library.SentencePieceProcessor(model_file=MODEL)
    assert len(rows) == 3 and all(r["decoded"] == r["text"] and r["ids"] == sp.encode(r["text"]) for r in rows)


def test_empty_table(docs):
    none = docs.where(F.lit(False)).withColumn("decoded", F.lit("old"))
    assert T.token_counts(none).count() == 0 and S.decode(S.encode(none)).count() == 0
