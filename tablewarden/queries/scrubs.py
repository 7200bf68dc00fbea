"""Queries on scrubbing and on tokens fit for output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden import fixed_values as fixed
from tablewarden.functions import names, redaction
from tablewarden.operators import settings
from tablewarden.queries import common as c

KEYS = (*fixed.SECRET_ASSIGNMENT_KEYS, "token")
SECRETS = ("example", "example.com", "track(0)", "track", "DOCTYPE html")


def dirty_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and pages, some with control sequences, secrets and line breaks planted."""
    documents = c.table(spark, sf, "documents").select(
        F.lit("document").alias("source"), F.col("doc_id").alias("id"), "text"
    )
    pages = c.table(spark, sf, "pages").select(
        F.lit("page").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text")
    )
    key = F.col("id")
    esc, bel = F.lit("\x1b"), F.lit("\x07")
    dirty = (
        F.when(key % 7 == 0, F.concat(esc, F.lit("[31m"), "text", esc, F.lit("[0m PassWord : 'a b' x")))
        .when(key % 7 == 1, F.concat("text", F.lit("\r\npwd=k1,passwd: k2;"), esc, F.lit("]0;t"), bel, F.lit("z")))
        .when(key % 7 == 2, F.concat("text", F.lit(' password="q \r\n r" tail')))
        .when(key % 7 == 3, F.concat(esc, F.lit("c"), "text", esc, F.lit("( Bx"), esc, F.lit("7pwd"), esc, F.lit("(B=k3 y")))
        .when(key % 7 == 4, F.concat("text", esc, F.lit("]8;;link"), F.lit("\x9c"), F.lit("pass"), esc, F.lit("8word: k4")))
        .otherwise(F.col("text"))
    )
    return documents.unionByName(pages).withColumn("text", dirty)


def summary(cleaned: Column) -> list[Column]:
    without = F.replace(cleaned, F.lit(fixed.REDACTED), F.lit(""))
    hits = (F.length(cleaned) - F.length(without)) / len(fixed.REDACTED)
    return [
        F.md5(cleaned).alias("cleaned_md5"),
        F.length(cleaned).cast("long").alias("cleaned_chars"),
        hits.cast("long").alias("hits"),
    ]


def scrub_text(spark: SparkSession, sf: str) -> DataFrame:
    texts = dirty_texts(spark, sf)
    cleaned = texts.withColumn("cleaned", redaction.clean(F.col("text"), SECRETS, KEYS))
    return cleaned.select("source", "id", *summary(F.col("cleaned")))


DIRTY = r"""
SELECT source, id, CASE id % 7
  WHEN 0 THEN chr(27) || '[31m' || text || chr(27) || '[0m PassWord : ''a b'' x'
  WHEN 1 THEN text || chr(13) || chr(10) || 'pwd=k1,passwd: k2;' || chr(27) || ']0;t' || chr(7) || 'z'
  WHEN 2 THEN text || ' password="q ' || chr(13) || chr(10) || ' r" tail'
  WHEN 3 THEN chr(27) || 'c' || text || chr(27) || '( Bx' || chr(27) || '7pwd' || chr(27) || '(B=k3 y'
  WHEN 4 THEN text || chr(27) || ']8;;link' || chr(156) || 'pass' || chr(27) || '8word: k4' ELSE text END AS text
FROM (SELECT 'document' AS source, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages) t
"""
SCRUB_TEXT = rf"""
WITH a AS (SELECT source, id, regexp_replace(text, '\x1B\[[0-9]*m|\x1B\]0;t\x07|\x1B\]8;;link\x{{9C}}|\x1B\( ?B|\x1B[c78]', '', 'g') AS t FROM ({DIRTY}) d),
b AS (SELECT source, id, replace(replace(replace(replace(replace(t, 'DOCTYPE html', '[redacted]'), 'example.com', '[redacted]'),
      'track(0)', '[redacted]'), 'example', '[redacted]'), 'track', '[redacted]') AS t FROM a),
k AS (SELECT source, id, regexp_replace(regexp_replace(t,
        '((?:password|passwd|pwd|token)\s*[=:]\s*)(?:"[^"]*"|''[^'']*''|[^\s,;]+)', '\1[redacted]', 'gi'),
        '[\r\n]+', ' ', 'g') AS t FROM b)
SELECT source, id, md5(t) AS cleaned_md5, length(t) AS cleaned_chars,
       (length(t) - length(replace(t, '[redacted]', ''))) // 10 AS hits
FROM k
"""


def scrub_records(spark: SparkSession, sf: str) -> DataFrame:
    """Nested records of customers and events, scrubbed by their schema, as JSON."""
    key = F.col("c_custkey")
    customers = c.table(spark, sf, "customer").select(
        key.alias("id"),
        F.named_struct(
            F.lit("id"), key,
            F.lit("nation"), F.col("c_nationkey"),
            F.lit("note"), F.concat(F.lit("pwd="), "c_mktsegment", F.lit(" name "), "c_name"),
            F.lit("account"), F.named_struct(
                F.lit("userPassword"), F.concat(F.lit("pw-"), key.cast("string")),
                F.lit("segment"), F.col("c_mktsegment"),
                F.lit("API_Key"), F.col("c_nationkey"),
                F.lit("since"), F.to_date(F.lit("2024-02-03")),
            ),
            F.lit("sessions"), F.array(F.named_struct(F.lit("host"), F.lit("h"), F.lit("authorization"), F.col("c_name"))),
            F.lit("extra"), F.create_map(F.lit("credentials"), F.col("c_name"), F.lit("plain"), F.col("c_name")),
            F.lit("numbered"), F.create_map(F.col("c_nationkey"), F.concat(F.lit("pwd="), "c_name")),
            F.lit("raw"), F.col("c_name").cast("binary"),
            F.lit("free"), F.parse_json(F.concat(F.lit('{"n":1,"password":"'), "c_name", F.lit('"}'))),
        ).alias("record"),
        F.when(key % 3 != 0, F.lit("x")).alias("password"),
    )
    hidden = redaction.clean_value(F.col("record"), customers.schema["record"].dataType)
    public = redaction.public_projection(customers, "password").withColumn(
        "record", F.to_json(hidden)
    )
    events = c.table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.named_struct(
            F.lit("props"), F.from_json("props", "map<string,int>"),
            F.lit("secretSauce"), F.col("event_type"),
            F.lit("user"), F.col("user_id"),
        ).alias("record"),
    )
    shown = events.select(
        "id",
        F.to_json(redaction.clean_value(F.col("record"), events.schema["record"].dataType)).alias("record"),
        F.lit(False).alias("passwordConfigured"),
    )
    return public.select("id", "record", "passwordConfigured").unionByName(shown)


SCRUB_RECORDS = """
SELECT c_custkey AS id, '{"id":"' || c_custkey || '","nation":' || c_nationkey || ',"note":"pwd=[redacted] name ' || c_name ||
       '","account":{"userPassword":"[redacted]","segment":"' || c_mktsegment || '","API_Key":"[redacted]","since":"2024-02-03"}' ||
       ',"sessions":[{"host":"h","authorization":"[redacted]"}],"extra":{"credentials":"[redacted]","plain":"' || c_name || '"},"numbered":{"' || c_nationkey ||
       '":"pwd=[redacted]"},"raw":"[binary]","free":"{\\"n\\":1,\\"password\\":\\"[redacted]\\"}"}'
       AS record, c_custkey % 3 <> 0 AS "passwordConfigured"
FROM customer
UNION ALL
SELECT event_id, '{"props":{"k":"' || replace(replace(props, '{"k": ', ''), '}', '') || '"},"secretSauce":"[redacted]","user":"' ||
       user_id || '"}', false
FROM events
"""


def public_registry(spark: SparkSession, sf: str) -> DataFrame:
    """A registry of servers by nation, each entry without its password."""
    key = F.col("s_suppkey")
    entry = F.struct(
        F.concat(F.lit("h"), key.cast("string")).alias("host"),
        F.when(key % 3 != 0, F.concat(F.lit("pw-"), "s_name")).alias("password"),
        F.struct(F.col("s_nationkey").alias("port"), F.when(key % 4 != 0, F.lit("x")).alias("password")).alias("replica"),
    )
    suppliers = c.table(spark, sf, "supplier")
    entries = F.array_sort(F.collect_list(F.struct(F.lpad(key.cast("string"), 9, "0").alias("k"), entry.alias("v"))))
    registry = suppliers.groupBy("s_nationkey").agg(F.map_from_entries(entries).alias("servers"))
    public = redaction.public_value(F.col("servers"), registry.schema["servers"].dataType, "password")
    return registry.select(F.col("s_nationkey").alias("nation"), F.to_json(public).alias("servers"))


PUBLIC_REGISTRY = """
SELECT s_nationkey AS nation, '{' || string_agg('"' || lpad(cast(s_suppkey AS varchar), 9, '0') || '":{"host":"h' || s_suppkey ||
       '","replica":{"port":' || s_nationkey || ',"passwordConfigured":' || (s_suppkey % 4 <> 0) || '},"passwordConfigured":' ||
       (s_suppkey % 3 <> 0) || '}', ',' ORDER BY s_suppkey) || '}' AS servers
FROM supplier GROUP BY s_nationkey
"""


def error_tokens(spark: SparkSession, sf: str) -> DataFrame:
    fallback = "DATABASE_ERROR"
    codes = c.table(spark, sf, "events").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("subject"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
        .otherwise(F.upper("event_type"))
        .alias("code"),
    ).unionByName(
        c.table(spark, sf, "part").select(
            F.concat(F.lit("type-"), F.col("p_type")).alias("subject"),
            F.when(F.col("p_size") % 2 == 0, F.upper(F.replace("p_brand", F.lit("#"), F.lit("_"))))
            .otherwise(F.col("p_brand"))
            .alias("code"),
        )
    )
    tokens = codes.withColumn("detail", names.safe_token(F.col("code"), fallback))
    return settings.issue_list(tokens)


ERROR_TOKENS = """
WITH t AS (
  SELECT 'user-' || user_id AS subject, CASE WHEN event_id % 3 = 0 THEN 'DATABASE_ERROR' ELSE upper(event_type) END AS d FROM events
  UNION ALL
  SELECT 'type-' || p_type, CASE WHEN p_size % 2 = 0 THEN upper(replace(p_brand, '#', '_')) ELSE 'DATABASE_ERROR' END FROM part)
SELECT DISTINCT subject, d AS issue FROM t
"""

QUERIES = {
    "scrub_text": scrub_text,
    "scrub_records": scrub_records,
    "public_registry": public_registry,
    "error_tokens": error_tokens,
}
ORACLES = {
    "scrub_text": SCRUB_TEXT,
    "scrub_records": SCRUB_RECORDS,
    "public_registry": PUBLIC_REGISTRY,
    "error_tokens": ERROR_TOKENS,
}
