"""Toxicity by a weighted finite-state grammar: transducers are composed, and matched clauses are scored, not single words."""
from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from math import exp, log

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import by_value, whole_documents, whole_text, without

by_value(__name__)

FIT_ROWS = 12_000                  # labelled documents that are fitted on, at most about
STEM_CHARS = (4, 10)               # lengths of the stems that can become insults
MIN_DOCS = 4                       # toxic documents, and settings in them, that a stem must occur in
MIN_PRECISION = 0.9                # share of toxic documents among those with the stem
MIN_SURPRISE = 12.0                # its toxic share against chance, as settings x divergence in nats: six in a million
COUNTED_AT_ONCE = 300_000          # stems that a task holds before it passes their counts on

# Word classes of the grammar. Fixed values.
TARGETS = frozenset("""you your yours yourself u he him his she her hers they them their we us people guy guys man woman
du dich dir dein deine ihr euch er ihn ihm sie man leute tu te toi ton ta vous votre il lui elle ils elles gens
tú usted ustedes te ti tu vos él ella ellos ellas gente this these those is are bist sind ist es eres son est sont""".split())
THREATS = frozenset("""kill murder strangle stab shoot burn destroy hurt beat punch töten umbringen ermorden erschießen schlagen
tuer frapper égorger buter détruire matar asesinar golpear destruir quemar""".split())
NEGATIONS = frozenset("not never nor neither isn't aren't don't didn't nicht kein keine niemals jamais nunca jamás tampoco".split())
REPORTS = frozenset("""said says say called calls told wrote writes quoted allegedly according sagte sagt nannte schrieb laut
dit disait appelé écrit selon dijo dice llamó escribió según""".split())
QUOTES = frozenset("\"“”„«»")

# Classes that the transducers read and write.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = "o", "i", "h", "t", "n", "r", "q"
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”„«»]")
ENDS = re.compile("[.!?;\n]")
WORD = re.compile(r"[^\W\d_]+")


class Transducer:
    """A deterministic transducer that writes one symbol for each symbol read and adds up scores along its path.

    ``arcs`` maps (state, symbol) to (next state, symbol written, score of an insult, score of a threat); a missing arc reads the
    symbol unchanged, scores nothing and goes to ``default(state)``.
    """

    def __init__(self, arcs, default, start=0):
        self.arcs, self.default, self.start = arcs, default, start

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or (self.default(state), symbol, 0.0, 0.0)

    def compose(self, after: "Transducer") -> "Transducer":
        """The transducer that feeds what this one writes into ``after``."""
        return Composed(self, after)


class Composed(Transducer):
    """Two transducers in a row; the arcs of the states that texts reach are kept as a table."""

    def __init__(self, first: Transducer, after: Transducer):
        super().__init__({}, None, (first.start, after.start))
        self.first, self.after = first, after

    def step(self, state, symbol):
        known = self.arcs.get((state, symbol))
        if known is None:
            p, written, insult, threat = self.first.step(state[0], symbol)
            q, out, more_insult, more_threat = self.after.step(state[1], written)
            known = self.arcs[state, symbol] = ((p, q), out, insult + more_insult, threat + more_threat)
        return known


def countdown(state):
    return max(0, state - 1)


REPORTED, NEGATED, AIMED = "r", "n", "t"         # marks that a transducer adds to the symbol of an insult or a threat
DISCOUNT = {REPORTED: 0.6, NEGATED: 0.5}
AIM = 0.5                                         # what a target nearby adds to an insult
THREAT_WEIGHT = 4.0
MARKS = ["", REPORTED, NEGATED, REPORTED + NEGATED]


def discount(marks: str) -> float:
    out = 1.0
    for mark in marks:
        out *= DISCOUNT.get(mark, 1.0)
    return out


def grammar() -> Transducer:
    """Reported speech, then negation, then target, then insult, then threat, composed.

    Each keeps how many tokens ago its cue was.  The first three only mark insults and threats: as reported (up to four tokens after
    a reporting verb, or within quotes), as negated (up to two tokens after a negation), as aimed (up to three tokens after a
    target).  The insult transducer scores an insult by its marks, and more if it is aimed or a target follows within three
    tokens.  The threat transducer scores a threat by its marks when it is aimed or as soon as a target follows within three
    tokens, and nothing without one.  Marks stay with a pending insult or threat, so discounts hold in either order.
    """
    reach = {"report": 4, "quote": 12, "negation": 2, "target": 3}
    report = {(s, REPORT): (reach["report"], REPORT, 0.0, 0.0) for s in range(13)}
    report |= {(s, QUOTE): (0 if s > reach["report"] else reach["quote"], QUOTE, 0.0, 0.0) for s in range(13)}
    report |= {(s, x): (countdown(s), x + REPORTED, 0.0, 0.0) for s in range(1, 13) for x in (INSULT, THREAT)}
    negation = {(s, NEGATION): (reach["negation"], NEGATION, 0.0, 0.0) for s in range(3)}
    negation |= {(s, x + m): (countdown(s), x + m + NEGATED, 0.0, 0.0) for s in range(1, 3) for x in (INSULT, THREAT) for m in ("", REPORTED)}
    target = {(s, TARGET): (reach["target"], TARGET, 0.0, 0.0) for s in range(4)}
    target |= {(s, x + m): (countdown(s), x + m + AIMED, 0.0, 0.0) for s in range(1, 4) for x in (INSULT, THREAT) for m in MARKS}

    pending = [(k, m) for k in range(1, 4) for m in MARKS]             # tokens left, and the marks
    insult = {(s, INSULT + m): ((3, m), OTHER, discount(m), 0.0) for s in [0, *pending] for m in MARKS}
    insult |= {(s, INSULT + m + AIMED): (0, OTHER, (1 + AIM) * discount(m), 0.0) for s in [0, *pending] for m in MARKS}
    insult |= {((k, m), TARGET): (0, TARGET, AIM * discount(m), 0.0) for k, m in pending}
    threat = {(s, THREAT + m): ((3, m), OTHER, 0.0, 0.0) for s in [0, *pending] for m in MARKS}
    threat |= {(s, THREAT + m + AIMED): (0, OTHER, 0.0, discount(m)) for s in [0, *pending] for m in MARKS}
    threat |= {((k, m), TARGET): (0, OTHER, 0.0, discount(m)) for k, m in pending}

    def waits(state):
        return (state[0] - 1, state[1]) if state and state[0] > 1 else 0
    return (Transducer(report, countdown).compose(Transducer(negation, countdown)).compose(Transducer(target, countdown))
            .compose(Transducer(insult, waits)).compose(Transducer(threat, waits)))


class Matcher:
    """Finds the clauses of a text that hold an insult stem or a threat and runs the grammar over them."""

    def __init__(self, stems: dict[str, float]):
        self.stems, self.table = stems, grammar()
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        self.cues = ahocorasick.Automaton()
        for word in [*stems, *THREATS]:
            self.cues.add_word(word, len(word))
        self.cues.make_automaton()

    def insult(self, word: str) -> float:
        for n in self.lengths:
            if len(word) >= n and (w := self.stems.get(word[:n])):
                return w
        return 0.0

    def clause(self, text: str) -> float:
        state, total, last = self.table.start, 0.0, 0.0
        for token in TOKEN.findall(text):
            weight = self.insult(token)
            symbol = (INSULT if weight else THREAT if token in THREATS else TARGET if token in TARGETS else NEGATION if token in NEGATIONS
                      else REPORT if token in REPORTS else QUOTE if token in QUOTES else OTHER)
            last = weight or last
            state, _, insult, threat = self.table.step(state, symbol)
            total += insult * last + threat * THREAT_WEIGHT
        return total

    def evidence(self, text: str) -> float:
        """Sum of the scores of all matched clauses of the whole text; a clause reaches from one end of a sentence part to the next."""
        low, total, done, ends = text.lower(), 0.0, -1, None
        if not len(self.cues):
            return 0.0
        for last, size in self.cues.iter(low):
            at = last - size + 1
            if at < done or at and low[at - 1].isalpha():
                continue
            if ends is None:
                ends = [m.start() for m in ENDS.finditer(low)]
            k = bisect.bisect_left(ends, at)
            start, done = ends[k - 1] + 1 if k else 0, ends[k] if k < len(ends) else len(low)
            total += self.clause(low[start:done])
        return total


def starts(word: str) -> list[str]:
    return [word[:k] for k in range(STEM_CHARS[0], min(len(word), STEM_CHARS[1]) + 1)]


def stem_counts(sample: DataFrame) -> DataFrame:
    """(stem, toxic, clean): labelled documents with a word that starts so; counted in parts, then added up."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                words = set(WORD.findall((text or "").lower()))
                found[label].update({s for w in words for s in starts(w)})
            if sum(map(len, found)) > COUNTED_AT_ONCE:
                yield counted(found)
                found = (Counter(), Counter())
        if any(found):
            yield counted(found)

    def counted(found):
        stems = sorted(found[0].keys() | found[1].keys())
        return pd.DataFrame({"stem": stems, "toxic": [found[1][s] for s in stems], "clean": [found[0][s] for s in stems]})

    return (whole_documents(sample).select("text", "label").mapInPandas(count, "stem string, toxic long, clean long")
            .groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def setting_counts(sample: DataFrame, stems: set[str]) -> DataFrame:
    """(stem, toxic, clean): in how many different settings, a word between its neighbours, a stem occurs.

    In copies of one document a word always has the same neighbours, so copies count once.
    """
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        short = {s[:STEM_CHARS[0]] for s in stems}
        for batch in batches:
            rows = set()
            for text, label in zip(batch["text"], batch["label"]):
                words = ["", *WORD.findall((text or "").lower()), ""]
                for i in range(1, len(words) - 1):
                    if words[i][:STEM_CHARS[0]] in short:
                        setting = " ".join(words[i - 1:i + 2])
                        rows.update((s, setting, label) for s in starts(words[i]) if s in stems)
            if rows:
                yield pd.DataFrame(sorted(rows), columns=["stem", "setting", "label"])

    return (whole_documents(sample).select("text", "label").mapInPandas(find, "stem string, setting string, label int")
            .groupBy("stem", "setting").agg(F.max("label").alias("label")).groupBy("stem")
            .agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")))


def telling(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """The stems of (stem, toxic, clean) counts that are frequent and precise enough and that chance does not explain.

    Surprise: settings times the divergence of their toxic share from that of the labels, in nats.
    """
    prior = min(max(n_toxic / max(1, n_toxic + n_clean), 1e-9), 1 - 1e-9)
    n = F.col("toxic") + F.col("clean")
    share = F.col("toxic") / n
    def part(p, q):
        return F.when(p > 0, p * F.log(p / F.lit(q))).otherwise(0.0)
    return counts.where((F.col("toxic") >= MIN_DOCS) & (F.col("toxic") >= MIN_PRECISION * n)
                        & (n * (part(share, prior) + part(1 - share, 1 - prior)) >= MIN_SURPRISE))


def choose_stems(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Stem -> weight (log odds), from (stem, toxic, clean) counts of settings of telling stems.

    Of a stem and its extensions the longest that loses no toxic setting is taken.
    """
    counts = {s: (t, c) for s, t, c in rows}
    chosen: dict[str, float] = {}
    for stem in sorted(counts, key=lambda s: (len(s), s)):
        if any(stem.startswith(s) or s.startswith(stem) for s in chosen):
            continue
        best = max((s for s in counts if s.startswith(stem) and counts[s][0] >= 0.98 * counts[stem][0]), key=lambda s: (len(s), s))
        t, c = counts[best]
        chosen[best] = log((t + 0.5) / (n_toxic + 1)) - log((c + 0.5) / (n_clean + 1))
    return {s: w for s, w in chosen.items() if w > 0}


def calibrate(pairs: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope of a ridge logistic regression of the label on log(1 + evidence); pairs: (evidence, toxic, rows)."""
    x = np.array([log(1 + e) for e, _, _ in pairs])
    y, n = np.array([t for _, t, _ in pairs], float), np.array([k for _, _, k in pairs], float)
    design, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - n * p) - 0.5 * beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 0.5 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


class Model:
    def __init__(self, stems, intercept=-4.0, slope=3.0):
        self.stems, self.intercept, self.slope = stems, intercept, slope

    def probability(self, evidence: float) -> float:
        return 1 / (1 + exp(-max(-30.0, min(30.0, self.intercept + self.slope * log(1 + evidence)))))


def fit(sample: DataFrame) -> Model:
    """Learn insult stems and the calibration from a bounded sample with ``text`` and ``label`` (0 or 1).

    Stems are counted by document, then, for those that are frequent and precise, by distinct setting, so that copies weigh nothing;
    only then is the choice made, on the cluster.  Nothing is cut: the candidates are bounded by the sample, as each
    occurs in MIN_DOCS toxic documents of it.  Without labelled rows only the threats of the grammar are left.
    """
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    frequent = stem_counts(sample).where((F.col("toxic") >= MIN_DOCS) & (F.col("toxic") >= MIN_PRECISION * (F.col("toxic") + F.col("clean"))))
    candidates = {r["stem"] for r in frequent.select("stem").collect()}
    counts = telling(setting_counts(sample, candidates), totals.get(1, 0), totals.get(0, 0))
    rows = [tuple(r) for r in counts.select("stem", "toxic", "clean").collect()]
    model = Model(choose_stems(rows, totals.get(1, 0), totals.get(0, 0)))
    seen = (with_evidence(sample, model).groupBy(F.round("_evidence", 1).alias("e"))
            .agg(F.sum("label").alias("t"), F.count(F.lit(1)).alias("n")).collect())
    if totals.get(0) and totals.get(1):
        model.intercept, model.slope = calibrate([(r["e"], r["t"], r["n"]) for r in seen])
    return model


def with_evidence(df: DataFrame, model: Model) -> DataFrame:
    stems = model.stems

    @F.pandas_udf("double")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(stems)
        for texts in batches:
            yield pd.Series([matcher.evidence(t) for t in texts], dtype="float64")

    return whole_documents(df).withColumn("_evidence", evidence(whole_text()))


def toxicity(df: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 if the score reaches the threshold) to rows with a ``text``.

    Whole texts are searched; only clauses with an insult stem or a threat are run through the grammar.  A null or empty text
    has no clause and gets the lowest score.  Repeated rows score alike, an empty table gives an empty table, and input columns
    named like added ones are replaced.
    """
    scored = with_evidence(without(df, "score", "predicted", "_evidence"), model)
    logit = F.lit(model.intercept) + F.lit(model.slope) * F.log1p(F.col("_evidence"))
    return (scored.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit)))))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("_evidence"))
