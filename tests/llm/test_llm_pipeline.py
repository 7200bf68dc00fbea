"""Registered queries against DuckDB, and the pipeline against plain Python."""

import sys
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from tablewarden.llm import language, packing, quality
from tablewarden.llm.common import fold
from tablewarden.llm.oracles import ORACLES
from tablewarden.llm.queries import QUERIES

sys.path.insert(0, str(Path(__file__).parent))
import test_llm_jaccard  # noqa: E402
import test_llm_packing  # noqa: E402
import test_llm_substring  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_queries_against_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.select(*columns).collect())


def test_every_operator_is_registered():
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []


def test_pipeline_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_rules", "ngram_jaccard_join", "substring_dedup", "best_fit_packing"]
    model = language.fit(docs, fold(docs.doc_id, 3) != 1)
    rows = {}
    for r in docs.collect():
        told, score = model.predict(r.text)
        if told != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE:
            rows[r.doc_id] = r.text
    judged = quality.measure(docs.select("doc_id", "text")).collect()  # itself tested against SQL
    rows = {r.doc_id: r.quality.clean_text for r in judged if r.doc_id in rows and r.quality.kept}
    rows = {k: rows[k] for k, _, smallest in test_llm_jaccard.brute(list(rows.items())) if k == smallest}
    for key, n_words, n_removed, kept in test_llm_substring.brute(list(rows.items())):
        if n_removed and n_removed == n_words:
            del rows[key]
        elif n_removed:
            rows[key] = kept
    got = corpus_pipeline.run(spark, SF).collect()
    want = set()
    for key, text in rows.items():
        n = len(test_llm_packing.LIBRARY.encode(text, add_special_tokens=False).ids) + 1
        want |= {(key, i, s, size) for i, (s, size) in enumerate(packing.cut(n, 1024))}
    assert {tuple(r)[:4] for r in got} == want and len(got) == len(want)
    used = defaultdict(int)
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024 and len(used) <= -(-sum(used.values()) // 1024) + 2


def test_stages_keep_columns_and_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "the " * 30_000, "en", None, 5), (2, "the of and " * 20, "de", "s", 1)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns and out.count() <= len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= len(rows)
