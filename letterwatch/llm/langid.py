"""Language identification: TF-IDF n-gram vectors against several clustered centroids per language."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.frames import materialize
from .common import by_value, fold, whole_documents, whole_text, without

by_value(__name__)

FIT_PER_LANGUAGE = 1_500           # documents of a language that are fitted on, at most about
CENTROIDS = 3                      # per language
BUCKETS = 1 << 13                  # features that n-grams of one to three letters are hashed to
CHARS_AT_ONCE = 1 << 20
ROUNDS = 10
SHARPNESS = 20.0                   # of the score, which compares the best cosine of each language
LEFT_OUT = 5                       # every fifth of these documents is left out of the clusters and shows how near such texts are
NEAR = 0.4                         # a text is rejected below this share of the low quantile of their cosines
LOW_QUANTILE = 0.01
MOST_LANGUAGES = 2_000             # that a model can hold
UNKNOWN = "und"


class Letters:
    """Code points of the letters of a lower-cased text, 0 for everything else."""

    def __init__(self):
        self.plain = np.array([c if chr(c).isalpha() else 0 for c in range(0x10000)], np.uint32)

    def of(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points) and points.max() >= 0x10000:
            rare = np.unique(points[points >= 0x10000])
            kept = rare[[chr(c).isalpha() for c in rare]]
            return np.where(points < 0x10000, self.plain[np.minimum(points, 0xFFFF)], np.where(np.isin(points, kept), points, 0))
        return self.plain[points]


def counts(text: str, letters: Letters) -> np.ndarray | None:
    """Hashed counts of n-grams within and at the edges of words over the whole text; None without a letter.

    A long text is read in pieces; the last two symbols of a piece are carried into the next one, so no n-gram is lost or made up.
    """
    total, found, carry, low = np.zeros(BUCKETS, np.float32), False, np.zeros(1, np.uint32), text.lower()
    for start in range(0, len(low), CHARS_AT_ONCE):
        end = np.zeros(int(start + CHARS_AT_ONCE >= len(low)), np.uint32)
        seq = np.concatenate([carry, letters.of(low[start:start + CHARS_AT_ONCE]), end])
        keep = np.append(True, (seq[1:] != 0) | (seq[:-1] != 0))                 # one gap between words
        keep[:len(carry)] = True
        seq, old = seq[keep], len(carry)
        carry = seq[-2:]
        if not seq.any():
            continue
        found = found or bool(seq[old:].any())
        first, second = seq * np.uint32(0x9E3779B1), seq * np.uint32(0x85EBCA77)
        grams = [first[old:][seq[old:] != 0], ((first[:-1] ^ np.left_shift(second[1:], 1)) * np.uint32(0xC2B2AE3D))[old - 1:],
                 ((first[:-2] ^ np.left_shift(second[1:-1], 1) ^ (seq[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1))[max(0, old - 2):]]
        for g in grams:
            total += np.bincount(g >> np.uint32(32 - 13), minlength=BUCKETS)
    return total if found else None


def vector(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    return v / (np.linalg.norm(v) or 1.0)


def clustered(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of unit vectors by cosine, started from rows that lie farthest from those chosen before."""
    chosen = [int(np.argmax(x @ x.mean(0)))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
    centres = x[chosen]
    for _ in range(ROUNDS):
        at = (x @ centres.T).argmax(1)
        new = np.array([x[at == j].mean(0) if (at == j).any() else centres[j] for j in range(len(centres))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return centres


class Model:
    def __init__(self, idf, languages, owner, centroids, floors):
        self.idf, self.languages, self.owner, self.centroids, self.floors = idf, languages, owner, centroids, floors

    def predict(self, tf: np.ndarray) -> tuple[str, float, float, bool]:
        """(language, score, cosine, rejected) of a text with letters."""
        cos = self.centroids @ vector(tf, self.idf)
        best = np.full(len(self.languages), -1.0)
        np.maximum.at(best, self.owner, cos)
        at = int(best.argmax())
        weight = np.exp(SHARPNESS * (best - best[at]))
        return self.languages[at], float(1 / weight.sum()), float(max(0.0, best[at])), bool(best[at] < self.floors[at])


def training_rows(docs: DataFrame, folds: int = 4, held_out: int = 2, per_language: int = FIT_PER_LANGUAGE) -> DataFrame:
    """(lang, text) of about ``per_language`` documents at most of each known language, none of the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != held_out)
                       & F.col("text").rlike("\\p{L}"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    picked = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) * F.col("_n") < F.lit(per_language << 20)
    return known.select("doc_id", "lang", "text").join(materialize(sizes), "lang").where(picked).select("lang", "text")


def fit(rows: DataFrame) -> Model | None:
    """A model from bounded rows (lang, text): frequencies are added up over the cluster, each language is clustered in a task.

    What a task holds is bounded by the sample of one language; the driver gets CENTROIDS vectors per language.
    """
    rows = materialize(whole_documents(rows))
    if rows.select("lang").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: set lang to null where it is no language")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, df, n = Letters(), np.zeros(BUCKETS), 0
        for batch in batches:
            for text in batch["text"]:
                tf = counts(text, letters)
                if tf is not None:
                    df, n = df + (tf > 0), n + 1
        yield pd.DataFrame({"df": [df], "n": [n]})

    spread = rows.repartition(8).mapInPandas(frequencies, "df array<double>, n long").toPandas()
    n = int(spread["n"].sum())
    if not n:
        return None
    idf = (np.log((1 + n) / (1 + np.sum(spread["df"].tolist(), axis=0))) + 1).astype(np.float32)

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        letters = Letters()
        x = np.array([vector(tf, idf) for t in sorted(group["text"]) if (tf := counts(t, letters)) is not None], np.float32)
        out = np.arange(len(x)) % LEFT_OUT == LEFT_OUT - 1
        centres = clustered(x[~out], CENTROIDS)
        low = float(np.quantile((x[out] @ centres.T).max(1), LOW_QUANTILE)) if out.any() else 0.0
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": list(centres.astype(float)), "low": low})

    made = rows.groupBy("lang").applyInPandas(cluster, "lang string, centre array<double>, low double").toPandas().sort_values("lang", kind="stable")
    languages = sorted(made["lang"].unique())
    owner = np.array([languages.index(x) for x in made["lang"]])
    floors = np.array([NEAR * made.loc[made["lang"] == x, "low"].iloc[0] for x in languages])
    return Model(idf, languages, owner, np.array(made["centre"].tolist(), np.float32), floors)


def identify(df: DataFrame, model: Model | None) -> DataFrame:
    """Add ``lang_pred``, ``score``, ``cosine`` and ``rejected`` to rows with a ``text``.

    The language of the nearest centroid is predicted.  A text is rejected if its cosine to it is below NEAR times the low quantile of
    that language's documents that were left out of the clusters (with fewer than LEFT_OUT documents none is); so is one without a letter (null and empty ones included), which is ``und`` with score 0.
    Without a model all are ``und``.  Whole texts are read.  Repeated rows are judged alike, an empty
    table gives an empty table, and input columns named like added ones are replaced.
    """
    @F.pandas_udf("lang_pred string, score double, cosine double, rejected boolean")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = Letters()
        for texts in batches:
            rows = []
            for text in texts:
                tf = counts(text, letters) if model else None
                rows.append((UNKNOWN, 0.0, 0.0, True) if tf is None else model.predict(tf))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "cosine", "rejected"])

    names = ["lang_pred", "score", "cosine", "rejected"]
    out = without(whole_documents(df), *names, "_judged").withColumn("_judged", judged(whole_text()))
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c != "_judged"], *[F.col(f"_judged.{n}").alias(n) for n in names])
