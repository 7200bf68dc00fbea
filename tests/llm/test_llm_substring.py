import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tablewarden.llm import substring


def brute(docs):
    """(key, n_words, n_removed, kept) by all windows of all documents."""
    first = {}
    for key, text in docs:
        words = (text or "").encode().split()
        if key is not None and text is not None:
            for i in range(len(words) - 12):
                run = tuple(words[i : i + 13])
                first[run] = min(first.get(run, key), key)
    out = []
    for key, text in docs:
        words = (text or "").encode().split()
        gone = set()
        if key is not None and text is not None:
            for i in range(len(words) - 12):
                if first[tuple(words[i : i + 13])] < key:
                    gone.update(range(i, i + 13))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((key, len(words), len(gone), b" ".join(kept).decode()))
    return out


def _spark(spark, docs):
    found = substring.deduplicate(spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id long, text string, result int"))
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found.collect()], key=str)


def test_against_all_windows(spark):
    draw = random.Random(5)
    passage = [[f"p{k}_{i}" for i in range(draw.choice([12, 13, 14, 20, 60]))] for k in range(6)]
    docs = []
    for key in range(70):
        words = []
        for _ in range(draw.randint(0, 5)):
            words += draw.choice(passage)[draw.randint(0, 2) :] if draw.random() < 0.6 else [f"w{draw.randint(0, 3)}" for _ in range(draw.randint(1, 30))]
        docs.append((key, draw.choice([" ", "\n", "\u00a0 "]).join(words)))
    docs += [(key, docs[3][1]) for key in (200, 201, 201)] + [(5, docs[9][1]), (5, docs[5][1]), (None, docs[4][1]), (300, None), (301, "")]
    docs += [(400, "a " * 40), (401, "a " * 13), (402, "a " * 12), (-7, " ".join(passage[5]))]
    docs += [(500, " ".join(f"z{i % 997}" for i in range(30_000))), (501, "x " + " ".join(f"z{i % 997}" for i in range(20_000)))]
    assert _spark(spark, docs) == sorted(brute(docs), key=str)


def test_common_anchors_change_nothing(spark, monkeypatch):
    draw = random.Random(6)
    shared = " ".join(f"s{i}" for i in range(30))
    docs = [(key, " ".join(f"w{draw.randint(0, 9)}" for _ in range(20)) + " " + shared + f" end{key}") for key in range(40)]
    docs += [(100 + i, "again and again " * 12 + f"tail{i} " + shared + " " + shared) for i in range(5)]
    docs += [(-1, shared), (200, "x " * 30), (201, "x " * 31 + "y"), (202, "y " + "x " * 40)]
    want = sorted(brute(docs), key=str)
    assert _spark(spark, docs) == want
    monkeypatch.setattr(substring, "SAMPLE", 10)
    rows = spark.createDataFrame([(k, t, k) for k, t in docs], "doc long, text string, mark long")
    common = substring.common_runs(rows)
    assert len(common.anchors) > 0 and len(common.windows) > 0 and (common.smallest == -1).any()
    assert _spark(spark, docs) == want


@given(st.integers(0, 200), st.integers(0, 200))
def test_equal_windows_share_an_anchor(i, j):
    starts = [d for d in range(substring.PERIOD) if (i + d) % 7 in substring.COVER and (j + d) % 7 in substring.COVER]
    assert starts and max(starts) + substring.ANCHOR <= substring.WINDOW + substring.PERIOD - 1
    assert min(starts) + substring.ANCHOR <= substring.WINDOW


def test_windows_around():
    assert substring.around(np.array([8]), 30).tolist() == list(range(2, 9))
    assert substring.around(np.array([0, 20]), 30).tolist() == [0, 14, 15, 16, 17]


def test_drop_repeats_keeps_columns_and_drops_the_emptied(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame(
        [(1, text, 9, "a"), (2, text, 9, "b"), (3, text + " more\n words", 9, "c"), (None, text, 9, "d"), (4, None, None, "e")],
        "doc_id long, text string, n_chars long, substring string",
    )
    got = {r.substring: (r.text, r.n_chars) for r in substring.drop_repeats(docs).collect()}
    assert got == {"a": (text, len(text)), "c": ("more words", 10), "d": (text, len(text)), "e": (None, None)}
    assert substring.drop_repeats(docs.limit(0)).count() == 0


def test_texts_hashed_together_are_told_apart():
    """Anchors and windows of several texts in one stretch are those of each text alone."""
    draw = random.Random(8)
    texts = [" ".join(f"w{draw.randint(0, 30)}" for _ in range(n)) for n in (0, 6, 7, 12, 13, 40, 0, 90)]
    (s,) = substring._stretches(iter(texts))
    named, at = s.anchors()
    starts = s.starts(substring.WINDOW)
    codes = s.windows(starts)
    for n, text in enumerate(texts):
        words = substring.hash_texts([text])[0]
        own, places = substring.anchors(words)
        mine = s.text[at] == n
        assert np.array_equal(named[mine] & ((1 << substring.ANCHOR_BITS) - 1), own) and np.array_equal(s.place[at[mine]], places)
        assert np.array_equal(codes[s.text[starts] == n], substring.windows(words))


def test_words_are_hashed_as_they_are_split():
    draw = random.Random(9)
    texts = ["".join(draw.choice([" ", "\n", "\x0b", "\x1c", "\u00a0", "a", "b", "é", "日", "\0", "\ud800", "x" * 9, "y" * 70]) for _ in range(n)) for n in (0, 1, 5, 300, 900)]
    texts += [None, "", " ", "a", "a\0", "a\0\0", "abcdefgh", "abcdefghi", "abcdefgh\0", "z" * 64, "z" * 65, "z" * 64 + "\0"]
    codes, lengths = substring.hash_texts(texts)
    words = [substring.split_words(t) for t in texts]
    assert lengths.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    by_word = {}
    for word, code in zip(flat, codes.tolist(), strict=True):
        assert by_word.setdefault(word, code) == code
    assert len(set(by_word.values())) == len(by_word) > 50
    assert substring.hash_texts([])[0].size == 0
