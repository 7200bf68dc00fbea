import re
from collections import Counter

from tablewarden.llm import quality



def good(i):
    return " ".join(f"word{chr(97 + i)}{k}" for k in range(8)) + "."


TEXTS = [
    "\n".join(map(good, range(12))),
    "\n".join(map(good, range(12))) + "\nHome\nno end here\n\n \nSubscribe to us now.\na | b | c | d.",
    "a b c a b c x " * 20,
    "ab### cd$$ " * 60,
    "\n".join(["same line of words."] * 30),
    "",
    None,
    " \t\n\x0b\x0c\r ",
    "a b c a b c",
    "one",
    "x y x y x",
    "é ü 漢字。" * 3,
    " " .join(f"w{i % 7000}" for i in range(60_000)),
]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed)


def test_base_counts_and_clashes(spark):
    rows = [(i if i else None, t, 1) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = [r.quality_ for r in quality.measure(docs).collect()]
    fields = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    assert [tuple(q[f] for f in fields) for q in got] == [brute(t) for _, t, _ in rows]
    assert got[0].kept and got[0].chars_lost == 0
    assert got[1].kept and got[1].n_lines_removed == 4 and got[1].clean_text == TEXTS[0] + "\n\n "
    assert not any(q.kept for q in got[2:12])


def test_documents_that_lose_too_much_go(spark):
    text = "\n".join([good(i) for i in range(6)] + [good(i)[:-1] for i in range(6, 18)])
    docs = spark.createDataFrame([(1, text, 5, "x"), (2, TEXTS[1], 7, "y")], "doc_id long, text string, n_chars long, note string")
    got = quality.clean(docs).collect()
    assert [(r.doc_id, r.n_chars, r.note) for r in got] == [(2, len(TEXTS[0]) + 3, "y")]
    assert quality.clean(docs.limit(0)).columns == docs.columns and quality.clean(docs.limit(0)).count() == 0


def test_runs_without_python(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = quality.clean(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
