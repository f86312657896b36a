"""Learned operators on planted data, SimHash against brute force, and the pipeline."""
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from letterwatch.llm import common, langid, quality, simhash, toxicity

SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or nt ea ti to it".split(), "de": "ch ei sch ge un ung ich ver ei ste ie ß ü ö pf tz".split(),
             "fr": "eau oi eux ou ai é è que ç le ment tre on re ch".split()}


def prose(lang, n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang], 1 + rng.integers(3))) + ("." if rng.random() < 0.1 else "") for _ in range(n)).capitalize()


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows, labels = np.random.default_rng(3), [], []
    for i in range(900):
        lang = ("en", "de", "fr")[i % 3]
        words = prose(lang, 40 + i % 50, i).split()
        toxic = int(i % 10 == 0)
        if toxic:
            for at in rng.integers(0, len(words), 3):
                words.insert(at, {"en": "dolt", "de": "trottel", "fr": "cretin"}[lang] + ("", "s", "x")[int(rng.integers(3))])
        bad = int(i % 7 == 0)
        rows.append((i, " | ".join(words).upper() if bad else " ".join(words), lang, "s%d" % (i % 4), 1))
        labels.append((i, 1 - bad, toxic))
    rows += [(1000, None, None, None, 0), (1001, "", "en", "s0", 0), (1002, "123 !!", "en", "s0", 0), (1003, "ab " * 100_000, "en", "s0", 0), (5, rows[5][1], "fr", "s1", 1)]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"),
            spark.createDataFrame(labels + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int"))


def held(r, folds, rest):
    return zlib.crc32(str(r["doc_id"]).encode()) % folds == rest


def test_fold_is_crc32_of_the_text(spark):
    df = spark.range(50).withColumn("f", common.fold(F.col("id"), 5))
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in df.collect())


def test_samples_are_bounded_and_leave_out_the_held_fold(corpus):
    docs, labels = corpus
    rows = common.labelled_sample(docs, labels, "toxic", 5, 0, 200).collect()
    assert 100 < len(rows) < 300 and not any(held(r, 5, 0) for r in rows)


def test_quality_on_held_out_rows(corpus):
    docs, labels = corpus
    model = quality.fit(common.labelled_sample(docs, labels, "quality", 5, 0, 2000))
    out = quality.quality(docs.withColumn("SCORE", F.lit("old")), model).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    tested = [r for r in out if r["doc_id"] in truth and held(r, 5, 0)]
    assert len(tested) > 100 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in tested]) > 0.98
    assert len(out) == 905 and all(0 <= r["score"] <= 1 for r in out)


def test_discriminant_equals_densities():
    rng = np.random.default_rng(1)
    x, y = np.vstack([rng.normal(0, 1, (200, 3)), rng.normal(1, 2, (100, 3))]), np.repeat([0, 1], [200, 100])
    model = quality.Model(x, y)
    z = (x - model.middle) / model.scale
    density = []
    for k in (0, 1):
        cov = np.linalg.inv(model.factors[k] @ model.factors[k].T)
        cov = np.linalg.inv(np.linalg.inv(cov))
        d = z - model.means[k]
        density.append(np.log((y == k).mean()) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(density[0] - density[1])))


def test_language_on_held_out_rows(corpus):
    docs, _ = corpus
    model = langid.fit(langid.training_rows(docs))
    out = langid.identify(docs.withColumn("Lang_Pred", F.lit("old")), model).collect()
    tested = [r for r in out if r["doc_id"] < 900 and held(r, 4, 2)]
    assert len(tested) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in tested]) > 0.98
    odd = {r["doc_id"]: r for r in out if r["doc_id"] >= 1000}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 and odd[i]["rejected"] for i in (1000, 1001, 1002))
    assert odd[1003]["lang_pred"] in model.languages and sum(r["rejected"] for r in out if r["doc_id"] < 900) == 0


def test_far_texts_with_letters_are_rejected(corpus):
    docs, _ = corpus
    model = langid.fit(langid.training_rows(docs))
    rng = np.random.default_rng(12)
    gibberish = " ".join("".join(rng.choice(list("zxqvwkyj"), 5)) for _ in range(60))
    other = "Быстрая коричневая лиса прыгает через ленивую собаку и бежит дальше по дороге. " * 3
    rows = docs.sparkSession.createDataFrame([(0, gibberish), (1, other), (2, prose("de", 60, 77)), (3, prose("en", 300, 78))], "doc_id long, text string")
    assert [r["rejected"] for r in langid.identify(rows, model).orderBy("doc_id").collect()] == [True, True, False, False]


def test_vectors_and_nearest_centroid_by_brute_force(corpus):
    docs, _ = corpus
    model, letters = langid.fit(langid.training_rows(docs)), langid.Letters()
    for r in docs.limit(40).collect():
        word_grams = {}
        for word in "".join(c if c.isalpha() else " " for c in (r["text"] or "").lower()).split():
            for gram in [*word, *(f" {word} "[i:i + 2] for i in range(len(word) + 1))]:
                word_grams[gram] = word_grams.get(gram, 0) + 1
        tf = langid.counts(r["text"] or "", letters)
        if tf is None:
            assert not word_grams
            continue
        trigrams = tf.sum() - sum(word_grams.values())                # a gap between words is in the trigrams of both
        text = " " + " ".join("".join(c if c.isalpha() else " " for c in r["text"].lower()).split()) + " "
        assert trigrams == len(text) - 2
        v = np.log1p(tf) * model.idf
        cos = model.centroids @ (v / np.linalg.norm(v))
        assert model.predict(tf)[0] == model.languages[model.owner[int(cos.argmax())]]


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    rows = spark.createDataFrame([(str(i), "text") for i in range(3)], "lang string, text string")
    with pytest.raises(ValueError, match="languages"):
        langid.fit(rows)


def test_language_of_pieces_equals_whole(monkeypatch):
    letters, text = langid.Letters(), prose("de", 300, 1)
    whole = langid.counts(text, letters)
    monkeypatch.setattr(langid, "CHARS_AT_ONCE", 500)
    for size in (1, 2, 3, 7, 500, 10_000):
        monkeypatch.setattr(langid, "CHARS_AT_ONCE", size)
        assert (langid.counts(text, letters) == whole).all()
        assert (langid.counts("  a  b.. cd ", letters) == langid.counts("a-b cd", letters)).all()
    assert langid.counts("12 .. ", letters) is None and langid.counts("\U00010400 x", letters) is not None


def test_toxicity_on_held_out_rows(corpus):
    docs, labels = corpus
    model = toxicity.fit(common.labelled_sample(docs, labels, "toxic", 5, 0, 2000))
    assert {"dolt", "trottel", "cretin"} == set(model.stems)
    out = toxicity.toxicity(docs.withColumn("Score", F.lit("old")), model).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    assert all(r["predicted"] == truth[r["doc_id"]] for r in out if r["doc_id"] in truth)
    assert len(out) == 905 and all(r["predicted"] == 0 for r in out if r["doc_id"] >= 1000)


def test_grammar_weighs_clauses():
    m = toxicity.Matcher({"idiot": 4.0})
    plain, aimed, denied, told = (m.evidence(t) for t in ("some idiot.", "you idiot.", "not an idiot.", "someone said idiot."))
    assert plain == 4 and aimed == 6 and denied == 2 and told == pytest.approx(2.4)
    assert m.evidence("I will kill you") == toxicity.THREAT_WEIGHT == m.evidence("you kill") and m.evidence("kill time") == 0
    assert m.evidence("skidiot. Idiots! idiot; idiot") == 12 and m.evidence("") == 0
    assert m.evidence("“you idiot” is a quote") < aimed


def plain_score(tokens, weight):
    """The five rules restated by positions (reports and quotes by a plain count)."""
    kinds = ["i" if t == "idiot" else "h" if t == "kill" else "t" if t == "you" else "n" if t == "not" else "r" if t == "said" else "q" if t == '"' else "o" for t in tokens]
    total, left, insult, threat = 0.0, 0, None, None              # pending: (position, discount)
    for p, kind in enumerate(kinds):
        off = (0.6 if left else 1) * (0.5 if "n" in kinds[max(0, p - 2):p] else 1)
        aimed = "t" in kinds[max(0, p - 3):p]
        if kind == "i":
            total += weight * off * (1.5 if aimed else 1)
            insult = None if aimed else (p, off)
        elif kind == "h":
            total += toxicity.THREAT_WEIGHT * off * aimed
            threat = None if aimed else (p, off)
        elif kind == "t":
            if insult and p - insult[0] <= 3:
                total, insult = total + 0.5 * weight * insult[1], None
            if threat and p - threat[0] <= 3:
                total, threat = total + toxicity.THREAT_WEIGHT * threat[1], None
        left = 4 if kind == "r" else (0 if left > 4 else 12) if kind == "q" else max(0, left - 1)
    return total


def test_all_transducers_equal_the_rules_restated():
    m, rng = toxicity.Matcher({"idiot": 3.0}), np.random.default_rng(11)
    words = ["idiot", "kill", "you", "not", "said", '"', "plain", "words"]
    for _ in range(3000):
        tokens = rng.choice(words, int(rng.integers(1, 16))).tolist()
        assert m.evidence(" ".join(tokens)) == pytest.approx(plain_score(tokens, 3.0)), tokens


def test_discounts_hold_in_either_order():
    m = toxicity.Matcher({"idiot": 4.0})
    threat = toxicity.THREAT_WEIGHT
    assert m.evidence("i will kill you") == threat == m.evidence("you they kill")
    assert m.evidence("never kill you") == threat / 2 == m.evidence("you never kill") == m.evidence("not kill him")
    assert m.evidence("someone said kill you") == pytest.approx(0.6 * threat) == m.evidence("you said kill") == m.evidence('"kill you"')
    assert m.evidence("he said never kill you") == pytest.approx(0.3 * threat)
    assert m.evidence("an idiot idea") == 4 and m.evidence("idiot, you") == 6 == m.evidence("you idiot") and m.evidence("not idiot you") == 3


def test_clauses_have_no_reach_but_their_own_ends():
    m = toxicity.Matcher({"idiot": 4.0})
    far = "word " * 600
    assert m.evidence(f"{far} idiot {far}") == 4 and m.evidence(f"not{' ' * 900}idiot") == 2 and m.evidence(f"you{' ' * 900}idiot") == 6
    assert m.evidence("not.idiot") == 4 and m.evidence("idiot" + "!" * 3000 + "idiot") == 8 and m.evidence(("idiot " * 5000)) == 20_000


def test_copies_teach_nothing(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("bcdfglmnprst")) + rng.choice(list("aeiou")) for _ in range(3)) for _ in range(800)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))                                         # noqa: E731
    copied = [" ".join(f"kopie{k}x{i}wort" for i in range(400)) for k in range(3)]                 # many stems, no insult
    rows = [(prose(60) + f" {w} vordulig {v}", 1) for w, v in zip(rng.choice(vocabulary, 60), rng.choice(vocabulary, 60))]
    rows += [(copied[k], 1) for k in range(3) for _ in range(40)] + [(prose(60), 0) for _ in range(300)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int"))
    assert any("vordulig".startswith(s) for s in model.stems) and not any(s.startswith("kopi") for s in model.stems)
    counts = spark.createDataFrame([("idiot", 60, 0), ("copied", 2, 0), ("thing", 40, 300)], "stem string, toxic long, clean long")
    assert [r["stem"] for r in toxicity.telling(counts, 100, 900).collect()] == ["idiot"]
    assert set(toxicity.choose_stems([("idio", 60, 0), ("idiot", 60, 0), ("idiots", 9, 0)], 100, 900)) == {"idiot"}


def brute_components(prints, distance):
    label = {p: p for p in prints}
    def root(p):
        while label[p] != p:
            p = label[p]
        return p
    for p in prints:
        for q in prints:
            if bin(p ^ q).count("1") <= distance:
                a, b = root(p), root(q)
                label[max(a, b)] = min(a, b)
    return {p: root(p) for p in prints}


@pytest.mark.parametrize("split,tile", [(16_384, 2048), (10, 4)])
def test_links_equal_all_pairs(spark, split, tile, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", split)
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(5)
    centres = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    prints = {0, (1 << 64) - 1}
    for c in centres:
        for _ in range(40):
            flips = 0
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                flips |= 1 << int(b)
            prints.add(c ^ flips)
    prints |= {centres[0] ^ (b << 4) for b in range(90)}                       # a crowd that agrees on most blocks
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    edges = simhash.links(df, 2, 4).collect()
    want = brute_components(prints, 2)
    graph = {p: p for p in prints}
    def root(p):
        while graph[p] != p:
            p = graph[p]
        return p
    for u, v in ((r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in edges):
        assert bin(u ^ v).count("1") <= 2
        a, b = root(u), root(v)
        graph[max(a, b)] = min(a, b)
    groups = lambda f: sorted(sorted(p for p in prints if f(p) == k) for k in {f(p) for p in prints})
    assert groups(root) == groups(want.get)


def test_near_duplicates_cases(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(3, base), (2, base.upper()), (9, base.replace("w7 ", "w7x ")), (4, None), (6, ""), (8, " \n"), (None, ""), (7, "one two"), (7, "one two"), (5, "zz")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, FP string")
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()]
    by = {d: c for d, _, c in got}
    assert len(got) == 10 and by[3] == by[2] == 2 and by[4] == by[6] == by[8] == by[None] == 4 and by[7] == 7 and by[5] == 5
    assert {f for d, f, _ in got if d in (4, 6, 8, None)} == {"0" * 16}
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] != 9) == [2, 4, 5, 7]
    assert simhash.near_duplicates(df.where(F.lit(False))).count() == 0 and simhash.one_of_each(df.where(F.lit(False))).count() == 0


def test_no_rows_no_labels(spark, corpus):
    docs, labels = (x.where(F.lit(False)) for x in corpus)
    sample = common.labelled_sample(docs, labels, "toxic", 5, 0, 10)
    assert toxicity.toxicity(docs, toxicity.fit(sample)).count() == 0
    assert quality.quality(docs, quality.fit(sample)).count() == 0
    assert langid.identify(docs, langid.fit(langid.training_rows(docs))).count() == 0
    untaught = toxicity.toxicity(corpus[0], toxicity.fit(sample))
    assert untaught.count() == 905 and quality.quality(corpus[0], None).where("score <> 0.5").isEmpty()


def test_pipeline_stage_by_stage(spark, corpus, tmp_path):
    docs, labels = corpus
    copy = docs.where("doc_id = 11").withColumn("doc_id", F.lit(2000).cast("long"))
    docs.unionByName(copy).withColumn("Row", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    at, names = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns, seen = at.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        path = str(tmp_path / f"out{k}")
        out.write.parquet(path)
        at = spark.read.parquet(path)
        seen[name] = [r["doc_id"] for r in at.select("doc_id").collect()]
        names.append(name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == columns
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    first, second, third, fourth, last = (seen[n] for n in names)
    assert sorted(first) == sorted(r["doc_id"] for r in docs.unionByName(copy).collect() if r["doc_id"] not in toxic)
    assert set(first) - set(second) == {1000, 1001, 1002}
    assert 2000 not in third and 11 in third and third.count(5) == 1 and set(third) == set(second) - {2000}
    assert set(fourth) <= set(third) and max(map(fourth.count, set(fourth))) <= 3
    assert sorted(last) == sorted(fourth) and at.where("NOT round_trip").isEmpty()


def test_queries_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
