"""Document fingerprints by order MinHash. DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import let, whole_text, without, words

K = 2                              # words of a k-mer
PICKED = 2                         # k-mers of one signature entry
ENTRIES = 64                       # entries of a fingerprint, a power of two
ENTRY_BITS = 6
ENTRY_HEX = 4                      # hexadecimal digits of an entry
# Neighbouring documents meet in one window group; groups have about this many rows until there are so many of them.
GROUP_ROWS = 200
MOST_GROUPS = 20_000
LAST = (1 << 63) - 1               # null ids come last


def _kmers(w: Column) -> Column:
    """64-bit hashes of the k-mers of a word array; all words are one k-mer if there are fewer than K, none if there is no word."""
    whole = F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - K, F.lit(0)))
    return F.when(F.size(w) < K, whole).otherwise(F.transform(starts, lambda i: F.xxhash64(*[w[i + j] for j in range(K)])))


def _numbered(h: Column) -> Column:
    """(hash of k-mer and occurrence number, place), in order of the hash.

    Only in texts with a repeated k-mer are the occurrences counted: after sorting by k-mer and place, a run of equal k-mers
    numbers itself.
    """
    plain = F.transform(h, lambda x, i: F.struct(F.xxhash64(x, F.lit(0)).alias("h"), i.alias("i")))

    def count(s):
        # The run number of place j is j minus the place where its run starts; runs start where the neighbour differs.
        begins = F.filter(F.transform(s, lambda x, j: F.when((j == 0) | (F.get(s, j - 1)["h"] != x["h"]), j)), lambda j: j.isNotNull())
        runs = let(begins, lambda b: F.flatten(F.transform(
            b, lambda j, r: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(b, r + 1), F.size(s)) - j - 1), lambda n: n))))
        return F.zip_with(s, runs, lambda x, n: F.struct(F.xxhash64(x["h"], n).alias("h"), x["i"].alias("i")))

    repeated = F.size(F.array_distinct(h)) < F.size(h)
    return F.sort_array(F.when(repeated, let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), count))
                        .otherwise(plain))


def _entries(s: Column) -> Column:
    """The entries of a fingerprint from the sorted (hash, place) pairs.

    The circle of hashes has ENTRIES starting points.  An entry takes the PICKED minimal k-mers at or after its point, puts
    them in the order of the text and hashes that tuple.  Entries without a k-mer of their own share the next one, so a text
    of any length fills all of them.
    """
    slot = lambda x: F.shiftright(x["h"], 64 - ENTRY_BITS).cast("int") + ENTRIES // 2
    n = F.size(s)

    def tuple_hash(x, y):
        first, last = F.when(x["i"] <= y["i"], x).otherwise(y), F.when(x["i"] <= y["i"], y).otherwise(x)
        return F.xxhash64(first["h"], last["h"])

    onwards = F.concat(F.slice(s, 2, F.greatest(n - 1, F.lit(0))), F.slice(s, 1, 1))
    before = F.concat(F.array(F.lit(-1)), F.transform(F.slice(s, 1, F.greatest(n - 1, F.lit(0))), slot))
    pairs = F.zip_with(s, onwards, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    own = F.flatten(F.zip_with(pairs, before, lambda p, b: F.when(slot(p["x"]) > b, F.array_repeat(
        tuple_hash(p["x"], p["y"]), slot(p["x"]) - b)).otherwise(F.array().cast("array<bigint>"))))
    return F.when(n == 0, F.array_repeat(F.lit(0).cast("bigint"), ENTRIES)).otherwise(
        let(own, lambda o: F.concat(o, F.array_repeat(o[0], ENTRIES - F.size(o)))))


def fingerprint(text: Column) -> Column:
    """Order MinHash of a text that is not null: ENTRIES x ENTRY_HEX hexadecimal digits."""
    digits = lambda e: F.right(F.lpad(F.hex(e), 16, "0"), F.lit(ENTRY_HEX))
    entries = let(let(let(words(text), _kmers), _numbered), _entries)
    return F.lower(F.array_join(F.transform(entries, digits), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries of two fingerprints."""
    at = lambda f, i: F.substring(f, i * ENTRY_HEX + 1, F.lit(ENTRY_HEX))
    same = F.filter(F.sequence(F.lit(0), F.lit(ENTRIES - 1)), lambda i: at(a, i) == at(b, i))
    return F.size(same) / F.lit(ENTRIES).cast("double")


def _grouped(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the number of their group of neighbouring ids; each group also gets a copy of the row that follows it.

    Groups are ranges of ``_id`` between ids that a hash picks, found in one scan over the ids alone.  The row at such an id
    opens a group and is copied to the group before it (``_own`` false); the very first row follows the last one.
    """
    ids = df.select("_id")
    rows = ids.count()
    every = max(1, GROUP_ROWS, -(-rows // MOST_GROUPS))
    picked = [r[0] for r in ids.where((F.pmod(F.xxhash64("_id"), F.lit(every)) == 0) & (F.col("_id") < LAST)).distinct().collect()]
    lowest = ids.agg(F.min("_id")).first()[0]
    bounds = sorted({*picked, lowest} - {None})
    width = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i:i + width] for i in range(0, len(bounds), width)]
    heads = F.lit([b[0] for b in blocks]).cast("array<bigint>")
    inner = F.array(*[F.lit(b).cast("array<bigint>") for b in blocks])
    if not blocks:
        return df.withColumns({"_group": F.lit(0), "_own": F.lit(True)})
    upto = lambda a: F.size(F.filter(a, lambda x: x <= F.col("_id")))
    block = upto(heads) - 1
    group = block * width + upto(inner[block]) - 1
    placed = df.withColumn("_group", group.cast("int"))
    opens = F.array_contains(inner[block], F.col("_id"))
    previous = F.pmod(F.col("_group") - 1, F.lit(len(bounds))).cast("int")
    both = F.when(opens, F.array(F.struct(F.col("_group").alias("_group"), F.lit(True).alias("_own")),
                                 F.struct(previous.alias("_group"), F.lit(False).alias("_own")))).otherwise(
        F.array(F.struct(F.col("_group").alias("_group"), F.lit(True).alias("_own"))))
    return placed.withColumn("_at", F.explode(both)).drop("_group").select("*", "_at._group", "_at._own").drop("_at")


def order_minhash(df: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likeness, for rows with a long ``doc_id`` and a ``text``.

    The edited text has its last floor(n / 2) of n code points replaced by as many of the next document in order of the id (the
    first document follows the last).  A fingerprint entry hashes a tuple of minimal occurrence-numbered 2-word k-mers in
    text order, so likeness falls with edits that insert, delete or reorder, not only with lost words.

    The texts are dealt out once, in groups of neighbouring ids, and the next row is found inside its group.

    A null text counts as empty: its fingerprint is 64 zero entries.  A text of one word is one k-mer.  Rows with equal ids
    follow each other in order of their texts' hashes; null ids come last.  A single row is followed by itself.  An empty
    table gives an empty table; other columns are left out.
    """
    rows = df.select(F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), whole_text().alias("text"))
    dealt = _grouped(rows).withColumn("_tie", F.xxhash64("text")).withColumn("fingerprint", fingerprint(F.col("text")))
    following = Window.partitionBy("_group").orderBy(F.col("_own").desc(), "_id", "_tie")
    paired = dealt.withColumns({"_next": F.lead("text").over(following), "_next_print": F.lead("fingerprint").over(following)}).where("_own")
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), F.length("text") - half), F.left(F.coalesce("_next", F.lit("")), half))
    made = paired.withColumns({"n_chars": n, "_edited": edited})
    made = made.withColumns({"edited_sha256": F.sha2("_edited", 256), "edited_fingerprint": fingerprint(F.col("_edited"))})
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("_next_print")).alias("near_next"))
