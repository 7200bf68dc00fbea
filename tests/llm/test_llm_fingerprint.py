import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tablewarden.llm import fingerprint as fp


def test_chosen_by_the_edge_rule():
    draw = random.Random(1)
    for n in (0, 3, 11, 12, 13, 40, 400):
        text = "".join(draw.choices("abcd é漢😀", k=n))
        _, places = fp.closed_syncmers(text)
        if n < fp.K:
            assert len(places) == min(n, 1)
            continue
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        inner = points[: n - fp.S + 1].copy()
        for j in range(1, fp.S):
            inner = inner * fp._A + points[j : n - fp.S + 1 + j]
        inner, width = fp._mixed(inner), fp.K - fp.S + 1
        want = [i for i in range(n - fp.K + 1) if min(inner[i : i + width]) in (inner[i], inner[i + width - 1])]
        assert places.tolist() == want


def test_choice_has_no_context():
    draw = random.Random(2)
    text = "".join(draw.choices("abcdefgh ", k=300))
    whole = dict(zip(*(x.tolist() for x in fp.closed_syncmers(text)[::-1])))
    for start, end in ((10, 80), (100, 250), (50, 62)):
        hashes, places = fp.closed_syncmers(text[start:end])
        assert dict(zip((places + start).tolist(), hashes.tolist())) == {p: h for p, h in whole.items() if start <= p <= end - fp.K}


def test_likeness():
    draw = random.Random(3)
    text = "".join(draw.choices("abcdefghijklmnop ", k=3000))
    other = "".join(draw.choices("abcdefghijklmnop ", k=3000))
    own = fp.sketch(text)
    assert fp.likeness(own, own) == 1 and fp.likeness(own, fp.sketch(other)) < 0.1
    assert fp.likeness(own, fp.sketch(text[:2000] + other[:1000])) > 0.4
    assert fp.likeness(own, fp.sketch("zz" * 40 + text)) > 0.8  # one shift for all
    assert fp.likeness(fp.sketch(""), fp.sketch("")) == 1 and fp.likeness(own, fp.sketch("")) == 0
    kept = max((own[0] < fp.BOUND).sum(), fp.LEAST)
    back = fp.read(fp.written(own))
    assert (back[0] == own[0][:kept]).all() and (back[1] == own[1][:kept]).all()
    assert len(fp.read(fp.written(fp.sketch("".join(draw.choices("abcdefghijklmnop ", k=100_000)))))[0]) > 10 * fp.LEAST


def test_a_shared_passage_of_long_texts_is_seen():
    draw = random.Random(5)
    passage = "".join(draw.choices("abcdefghij ", k=300))
    long = ["".join(draw.choices("abcdefghijklmnop ", k=20_000)) for _ in range(2)]
    a, b = fp.sketch(long[0] + passage), fp.sketch(passage + long[1])
    shared = len(set(a[0].tolist()) & set(b[0].tolist()))
    assert shared > 40 and abs(fp.likeness(a, b) - 2 * shared / (len(a[0]) + len(b[0]))) < 1e-3


def test_written_fingerprints_estimate_likeness(spark):
    draw = random.Random(6)
    text = "".join(draw.choices("abcdefghijklmnop ", k=30_000))
    edited = text[:20_000] + "".join(draw.choices("abcdefghijklmnop ", k=10_000))
    pairs = spark.createDataFrame([(fp.written(fp.sketch(text)), fp.written(fp.sketch(edited)))], "a string, b string")
    estimate = pairs.select(fp.similarity(pairs.a, pairs.b).alias("s")).first().s
    assert abs(estimate - fp.likeness(fp.sketch(text), fp.sketch(edited))) < 0.06


def brute(rows):
    order = sorted([(k is not None, k or 0, t or "", k) for k, t in rows], reverse=True)
    out = []
    for i, (_, _, text, key) in enumerate(order):
        following = order[(i + 1) % len(order)][2]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        a, b, c = fp.sketch(text), fp.sketch(edited), fp.sketch(following)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.written(a), fp.written(b), fp.likeness(a, b), fp.likeness(a, c)))
    return out


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_next_documents_in_spark(spark, partitions):
    draw = random.Random(4)
    rows = [(draw.randint(0, 10**12), "".join(draw.choices("abc é漢😀\n", k=draw.choice([0, 1, 5, 30, 200])))) for _ in range(60)]
    rows += [(5, "same id, other text"), (5, "same id"), (5, "same id"), (None, "null id"), (7, None), (-3, "x" * 50_000), (8, "abcdefgh" * 9000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = spark.createDataFrame([(k, t, True) for k, t in rows], "doc_id long, text string, tail boolean").repartition(5)
        got = [tuple(r) for r in fp.compare_with_next(docs).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("rows", [[], [(1, "alone here with some text")], [(1, "same text of all"), (2, "same text of all")]])
def test_few_documents(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, fp.compare_with_next(docs).collect())) == sorted(brute(rows))


def test_columns(spark):
    docs = spark.createDataFrame([("some text to look at",), (None,)], "text string")
    got = [r.f for r in docs.select(fp.fingerprint(docs.text).alias("f")).collect()]
    assert got == [fp.written(fp.sketch("some text to look at")), ""]
    pairs = spark.createDataFrame([(got[0], got[0]), (got[0], None), (None, "")], "a string, b string")
    assert [r.s for r in pairs.select(fp.similarity(pairs.a, pairs.b).alias("s")).collect()] == [1.0, 0.0, 1.0]


def test_many_null_and_repeated_ids_are_spread(spark):
    draw = random.Random(8)
    rows = [(None, "".join(draw.choices("abcdefg ", k=draw.choice([0, 3, 20, 40])))) for _ in range(10_000)]
    rows += [(7, f"{draw.random()} text") for _ in range(3000)] + [(i, f"own {i}") for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        sizes = fp._beside_next(docs, "doc_id", "text").groupBy(F.spark_partition_id()).count().collect()
        got = [tuple(r) for r in fp.compare_with_next(docs).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert max(r["count"] for r in sizes) < 3 * len(rows) / 16
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_other_ids_are_refused(spark):
    with pytest.raises(TypeError, match="whole number"):
        fp.compare_with_next(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    got = [tuple(r) for r in entry.queries()["op10_fingerprint"](spark, sf).collect()]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
