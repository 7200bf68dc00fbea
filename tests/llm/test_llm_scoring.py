import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tablewarden.llm import hashing, lm_scoring, recurrent
from tablewarden.llm.common import fold

COUNTS = np.array([5, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1], float)


def _model(width=4, noise=0.3):
    draw = np.random.default_rng(0)
    model = recurrent.LanguageModel(COUNTS, 2, 0, width=width)
    model.p = {k: v.astype(np.float64) + draw.normal(0, noise, v.shape) for k, v in model.p.items()}
    return model, draw


def test_slopes_are_those_of_the_loss():
    model, draw = _model()
    texts = [draw.integers(0, 12, n).astype(np.int32) for n in (7, 3, 5, 2)]
    inputs, target, first, there, _ = next(recurrent.Lanes(texts, 2, 0).windows(100))
    _, slopes = model._slopes(inputs, target, first, there, np.zeros((2, 4)))
    loss = lambda: -model.score(texts).sum() * np.log(10) / sum(map(len, texts))
    for name, values in model.p.items():
        for _ in range(4):
            at = tuple(draw.integers(0, s) for s in values.shape)
            values[at] += 1e-5
            above = loss()
            values[at] -= 2e-5
            below = loss()
            values[at] += 1e-5
            assert abs((above - below) / 2e-5 - slopes[name][at]) < 1e-5


def test_probabilities_sum_to_one_and_lanes_do_not_matter():
    model, draw = _model()
    total = sum(10 ** model.score([np.array([3, w], np.int32)])[0] for w in range(12))
    assert abs(total - 10 ** model.score([np.array([3], np.int32)])[0]) < 1e-9
    texts = [draw.integers(0, 12, n).astype(np.int32) for n in (700, 1, 30, 260, 257, 5, 5)]
    alone = [model.score([t])[0] for t in texts]
    assert np.allclose(model.score(texts), alone) and np.allclose(model.score(texts[::-1]), alone[::-1])
    assert model.score([]).shape == (0,)


def test_one_long_text_is_scored_in_few_windows(monkeypatch):
    """Where few lanes are left their windows get longer, so a long text costs no window for every few words."""
    model, draw = _model()
    texts = [draw.integers(0, 12, n).astype(np.int32) for n in (100_000, *[40] * 300)]
    windows, own = [], recurrent.LanguageModel._losses
    monkeypatch.setattr(recurrent.LanguageModel, "_losses", lambda self, h, *more: windows.append(len(h)) or own(self, h, *more))
    scores = model.score(texts)
    assert sum(windows) == sum(map(len, texts))
    assert len(windows) < 30 and max(windows) <= recurrent.SCORE_LANES * recurrent.SCORE_STEPS
    assert np.allclose(scores[1:20], [model.score([t])[0] for t in texts[1:20]])


def test_untrained_model_gives_shares_of_counts():
    model = recurrent.LanguageModel(COUNTS, 2, 0)
    want = np.log10((COUNTS + 1) / (COUNTS + 1).sum())
    assert np.allclose([model.score([np.array([w], np.int32)])[0] for w in range(12)], want, atol=1e-5)


def test_training_learns_what_follows_what():
    texts = [np.array([2, 3, 4, 5] * 6 + [0], np.int32) for _ in range(60)]
    model = recurrent.LanguageModel(COUNTS, 2, 0)
    before = model.score(texts[:1])[0]
    model.train(texts, rounds=30)
    assert model.score(texts[:1])[0] > before / 3


def test_words_are_cut_as_bytes_split_and_named_as_xxhash_names_them():
    texts = ["  a\tB\x0b c\x0c\r\n", "", None, " \n ", "É é x\x1cy\x85z w\xa0w", "İ ẞ \0 \0\0 K", " ".join("A" * n for n in range(1, 80)), "a b A"]
    whole = [(t or "").encode().lower().split() for t in texts]
    for low, high in ((0, 8), (1, 7), (2, 3), (3, 4), (0, 0)):
        lengths, codes, places = lm_scoring._split(pa.array(texts, pa.string())[low:high])
        words = [w for own in whole[low:high] for w in own]
        assert lengths.tolist() == [len(own) for own in whole[low:high]]
        assert len(codes) == len(set(words))
        assert codes[places].view(np.uint64).tolist() == [xxhash.xxh64_intdigest(w) for w in words]
    draw = np.random.default_rng(3)
    words = [draw.bytes(n) for n in [*range(70)] * 5]
    got = hashing.xxh64(b"".join(words), np.cumsum([0, *map(len, words)]))
    assert got.tolist() == [xxhash.xxh64_intdigest(w) for w in words]


ROWS = [(i, t) for i, t in enumerate(["the cat sat", "The dog sat on the mat", "", None, "new words only", "x " * 30_000, "the"] * 6)]


@pytest.mark.parametrize("frequent", [2, 65_536])
def test_base_score_against_counts(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    rows = ROWS + [(None, "the cat"), (0, "the cat sat")]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double")
    fold_of = {i: r.f for i, r in enumerate(spark.createDataFrame([(i,) for i, _ in rows], "i long").select(fold(F.col("i"), 7).alias("f")).collect())}
    tokens = [[*(t or "").lower().split(), None] for _, t in rows]
    learned = [fold_of[n] is not None and fold_of[n] != 2 for n in range(len(rows))]
    counts = Counter(w for own, yes in zip(tokens, learned) if yes for w in own)
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), fold_of[k] == 2, len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 4))
        for k, ((i, _), own) in enumerate(zip(rows, tokens))
    )
    got = lm_scoring.score_documents(docs, fold(F.col("doc_id"), 7) != 2).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm_scoring.score_documents(docs, F.lit(False)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in got] == [(0, 0, 0.0)] * 2
    assert lm_scoring.score_documents(docs.limit(0), F.lit(True)).count() == 0


def test_every_training_document_trains_the_model(spark, monkeypatch):
    """Each document is trained on once, also those of one repeated id, and none that is held out."""
    rows = [(i if i % 3 else 1, f"word{i} " * (i % 5 + 1), i % 7 != 2) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, yes boolean").repartition(5)
    monkeypatch.setattr(lm_scoring, "SHARD_WORDS", 700)
    seen = spark.sparkContext.accumulator(0)
    own = recurrent.LanguageModel.train

    def counted(self, texts, *more):
        seen.add(sum(map(len, texts)))
        own(self, texts, *more)

    class Counting(recurrent.LanguageModel):
        train = counted

    monkeypatch.setattr(lm_scoring, "LanguageModel", Counting)
    corpus, model, _, _ = lm_scoring.learn(docs, F.col("yes"))
    assert seen.value == corpus.tokens == sum(i % 5 + 2 for i, (_, _, yes) in enumerate(rows) if yes)
    untrained = recurrent.LanguageModel(COUNTS, 2, 0)
    untrained.set_weights(untrained.weights())
    assert all(np.isfinite(v).all() for v in model.p.values()) and untrained.p["enter"].shape == (16, 48)


def test_scores_do_not_follow_the_splits_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD_WORDS", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    scores = []
    for parts in (4, 16):
        found = lm_scoring.score_documents(docs.repartition(parts), fold(F.col("doc_id"), 7) != 2).collect()
        scores.append({r.doc_id: (r.score, r.base_score) for r in found})
    assert scores[0].keys() == scores[1].keys()
    assert all(np.allclose(scores[0][k], scores[1][k], rtol=1e-4) for k in scores[0])


def score_by_loops(p, classes, text):
    """One word at a time: the state, then the probability of the word's class and of the word within it."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, before, total, w = np.zeros(p["embed"].shape[1]), 0, 0.0, p["embed"].shape[1]
    for word in text:
        entered, carried = p["embed"][before] @ p["enter"] + p["enter_bias"], h @ p["carry"]
        z, r = sigmoid(entered[:w] + carried[:w]), sigmoid(entered[w : 2 * w] + carried[w : 2 * w])
        n = np.tanh(entered[2 * w :] + r * carried[2 * w :])
        h = (1 - z) * n + z * h
        c = next(i for i, own in enumerate(classes) if word in own)
        of_class = np.exp(h @ p["class"] + p["class_bias"])
        of_word = {v: np.exp(p["word"][v] @ h + p["word_bias"][v]) for v in classes[c]}
        total += math.log10(of_class[c] / of_class.sum() * of_word[word] / sum(of_word.values()))
        before = word
    return total


def test_trained_scores_by_plain_loops(spark):
    """The whole operator on a small corpus: its model's weights, used word by word, give every score."""
    rows = [(i, " ".join(["the cat sat", "a dog ran far", "the dog sat"][(i + j) % 3] for j in range(i % 4))) for i in range(60)]
    rows += [(100, "unseen words here the cat"), (101, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learnable = F.col("doc_id") < 50
    corpus, model, counts, _ = lm_scoring.learn(docs, learnable)
    got = {r.doc_id: r.score for r in lm_scoring.score_documents(docs, learnable).collect()}
    classes = [range(a, b) for a, b in zip(model.starts, model.ends)]
    weights = {k: v.astype(float) for k, v in model.p.items()}
    code = lambda w: lm_scoring._code(w.encode())
    number = dict(zip(corpus.codes.tolist(), corpus.numbers.tolist()))
    for key, text in rows:
        words = (text or "").lower().split()
        numbers = [number.get(code(w), lm_scoring.OTHER) for w in words] + [lm_scoring.END]
        want = score_by_loops(weights, classes, numbers)
        want += sum(math.log10(1 / (corpus.other_tokens + corpus.other_distinct + 1)) for n in numbers if n == lm_scoring.OTHER)
        assert abs(got[key] - want) < 1e-3 * max(1, abs(want))


def test_a_million_words_beside_short_texts_take_little_memory():
    model = recurrent.LanguageModel(COUNTS, 2, 0)
    draw = np.random.default_rng(1)
    texts = [draw.integers(0, 12, n).astype(np.uint16) for n in (1_000_000, *[5] * 2000)]
    tracemalloc.start()
    laid = recurrent.Lanes(texts, recurrent.SCORE_LANES, 0)
    seen = sum(int(window[3].sum()) for _, window in zip(range(400), laid.windows(recurrent.SCORE_STEPS)))
    model.train(texts[:1] + texts[1:9])
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    assert seen == sum(min(len(t), 400 * recurrent.SCORE_STEPS) for t in texts)


def test_average_weighs_tasks_by_their_words():
    batch = pa.RecordBatch.from_pydict({
        "piece": [0, 0, 1], "shard": [0, 1, 0], "tokens": [1, 3, 5], "weights": [np.float32([0, 4]).tobytes(), np.float32([4, 0]).tobytes(), np.float32([7]).tobytes()],
    })
    got = [r for b in lm_scoring._averaged(iter([batch])) for r in b.to_pylist()]
    assert [(r["piece"], np.frombuffer(r["weights"], np.float32).tolist()) for r in got] == [(0, [3.0, 1.0]), (1, [7.0])]
