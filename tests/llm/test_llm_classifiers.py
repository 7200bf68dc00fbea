"""Language identification and toxicity: held-out accuracy and edge cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from tablewarden.llm import characters, language, toxicity
from tablewarden.llm.common import fold
from tablewarden.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"  # has enough toxic documents in each language
ODD = [(1, ""), (2, None), (3, "12 !!"), (4, "ñ"), (None, "the of and to"), (5, "the of " * 60_000), (5, "the of " * 60_000)]


def _held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op2_language_id"](spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert got.keys() == truth.keys() and all(r.held_out == _held_out(i) and 0 <= r.score <= 1 for i, r in got.items())
    aside = [i for i in truth if _held_out(i)]
    assert np.mean([got[i].lang_pred == truth[i] for i in aside]) > 0.97


def test_language_edges(spark):
    train = spark.createDataFrame(
        [(i, "der und die das ist", "de") for i in range(20)] + [(100 + i, "the of and to is", "en") for i in range(20)]
        + [(200 + i, "le de la et un", "fr") for i in range(20)] + [(300, None, "xx"), (301, "some", None), (302, "123", "yy")],
        "doc_id long, text string, lang string",
    )
    model = language.fit(train, fold(F.col("doc_id"), 3) != 1)
    assert sorted(model.members) == ["germanic", "romance"] and model.members["germanic"] == ["de", "en"]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in ODD], "doc_id long, text string, language double")
    got = [(r.doc_id, r.language_.lang_pred) for r in language.identify(docs, model).collect()]
    assert [p for _, p in got[:3]] == ["und"] * 3 and [p for _, p in got[4:]] == ["en"] * 3
    assert language.identify(docs.limit(0), model).count() == 0
    assert language.keep_identified(docs, model, 0.3).columns == docs.columns
    nothing = language.fit(train.limit(0), F.lit(True))
    assert language.identify(docs, nothing).where("language_.lang_pred != 'und'").count() == 0


def test_one_against_one_votes():
    draw = np.random.default_rng(1)
    x = np.vstack([draw.normal(0, 0.05, (30, 3)) + np.eye(3)[k] for k in range(3)]).astype(np.float32)
    model = language.train(x, ["en"] * 30 + ["de"] * 30 + ["nl"] * 30)
    assert len(model.pair_weights) == 3 and model.family_weights is None
    assert [model._within("germanic", np.eye(3, dtype=np.float32)[k], 1.0)[0] for k in range(3)] == ["en", "de", "nl"]


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, LARGER).collect()}
    assert all(r.held_out == _held_out(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    aside = [i for i in labels if _held_out(i)]
    toxic, clean = [got[i].score for i in aside if labels[i]], [got[i].score for i in aside if not labels[i]]
    assert np.mean([[t > c for c in clean] for t in toxic]) > 0.95
    assert np.mean([c < 0.7 for c in clean]) > 0.98 and np.mean([t >= 0.7 for t in toxic]) > 0.85


def test_toxicity_edges(spark):
    docs = spark.createDataFrame(
        [(i, "you are scum and trash" if i % 2 else "a nice clean day for all") for i in range(60)], "doc_id long, text string"
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, fold(F.col("doc_id"), 3) != 1)
    odd = spark.createDataFrame([(i, t, "a") for i, t in ODD] + [(9, "today you are scum and trash", "b")], "doc_id long, text string, toxicity string")
    got = toxicity.score_toxicity(odd, model).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r.toxicity_.score <= 1 for r in got)
    assert [r.toxicity_.predicted for r in got if r.doc_id == 9] == [1] and got[0].toxicity_.score == got[1].toxicity_.score
    flat = toxicity.fit(docs.limit(0), labels, F.lit(True))
    assert toxicity.score_toxicity(odd, flat).where("toxicity_.score = 0.5").count() == len(odd.collect())
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0


def test_grams():
    stream = characters.letter_stream("Ab,, C1d")
    assert "".join(map(chr, stream)) == " ab c d"
    buckets = characters.hashed_grams(stream, (2, 3), 18)
    assert len(buckets) == 6 + 5
    repeated = np.concatenate((buckets, buckets))
    assert sorted(characters.distinct(repeated, np.full(1 << 18, 7, np.int32))) == sorted(set(buckets.tolist()))


def test_language_sample_is_bounded_with_repeated_ids(spark, monkeypatch):
    rows = [(i % 2, f"words of text {i % 9}", "en") for i in range(200)] + [(7, "der eine Satz", "de")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language, "train", lambda x, languages: seen.extend(languages) or language.LanguageModel())
    language.fit(docs, F.lit(True), per_language=4)
    assert 1 <= seen.count("en") <= 4 and seen.count("de") == 1


def test_toxicity_sample_is_bounded_with_repeated_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 40, f"words of text {i % 400}") for i in range(1200)] + [(3, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda sets, toxic: seen.extend(toxic.tolist()))
    toxicity.fit(docs, labels, F.lit(True), per_class=5)
    assert sorted(seen) == [False] * 5 + [True] * 5


def test_toxicity_ratios_and_machine_by_plain_loops():
    """The model is the same as one over dictionaries of n-grams' buckets, solved by projected gradient steps."""
    texts = ["you are scum and trash here", "what trash you scum", "scum of the trash", "you trash, scum", "scum and trash again"] * 2
    texts += ["a nice clean day for all", "the day is clean and nice", "all is nice here", "what a day for you", "clean and nice again"] * 2
    toxic = np.array([True] * 10 + [False] * 10)
    scratch = toxicity.new_scratch()
    sets = [toxicity.gram_set(t, scratch) for t in texts]
    counts = {kind: {} for kind in (True, False)}
    for own, kind in zip(sets, toxic):
        for g in own.tolist():
            counts[kind][g] = counts[kind].get(g, 0) + 1
    ratio = {}
    for g in counts[True].keys() | counts[False].keys():
        t, c = counts[True].get(g, 0), counts[False].get(g, 0)
        r = np.log((t + 1) / 12) - np.log((c + 1) / 12)
        if t + c >= toxicity.LEAST_DOCUMENTS and abs(r) >= toxicity.LEAST_RATIO:
            ratio[g] = r
    got = toxicity._ratios(sets, toxic)
    assert {int(g): round(got[g], 9) for g in np.flatnonzero(got)} == {g: round(r, 9) for g, r in ratio.items()}
    weights, bias = toxicity._machine(sets, toxic, got, 400, 0.003)
    names = sorted(ratio)
    x = np.array([[ratio[g] if g in set(own.tolist()) else 0.0 for g in names] + [1.0] for own in sets])
    sign, w = np.where(toxic, 1.0, -1.0), np.zeros(len(names) + 1)
    for _ in range(20_000):
        short = np.maximum(1 - sign * (x @ w), 0)
        w -= 0.002 * (w - 2 * 0.003 * (x.T @ (sign * short)))
    assert np.allclose([weights[g] for g in names], w[:-1] * [ratio[g] for g in names], atol=2e-3) and abs(bias - w[-1]) < 2e-3


def test_language_votes_by_plain_loops(spark):
    """Predictions of the registered query's model: family by the largest margin, then all pairs of the family vote."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs, fold(F.col("doc_id"), 3) != 1)
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r.lang_pred for r in QUERIES["op2_language_id"](spark, "/root/testdata/sf0.001").collect()}
    for r in rows:
        x = language.features(r.text)
        if x is None:
            assert got[r.doc_id] == "und"
            continue
        margins = [sum(a * b for a, b in zip(x.tolist(), w[:-1].tolist())) + w[-1] for w in model.family_weights.T]
        family = max(zip(margins, model.families))[1]
        votes = {own: 0 for own in model.members[family]}
        strength = dict.fromkeys(votes, 0.0)
        for (a, b), weights in model.pair_weights.items():
            if a in votes and b in votes:
                margin = float(x @ weights[:-1] + weights[-1])
                votes[a if margin > 0 else b] += 1
                strength[a] += margin
                strength[b] -= margin
        assert got[r.doc_id] == max(votes, key=lambda own: (votes[own], strength[own]))
