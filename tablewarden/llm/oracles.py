"""DuckDB SQL of the queries that SQL can say, over the same tables."""

from __future__ import annotations

from tablewarden.llm import quality
from tablewarden.llm.rules import URL_RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_RULE_ROWS = ", ".join(f"({_text(h)}, {_text(p)}, {_text(v)})" for h, p, v in URL_RULES)

OP1 = f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {_RULE_ROWS}),
     urls AS (SELECT row_number() OVER () AS n, page_id,
                     translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
              FROM pages),
     fits AS (SELECT n, rule_host || rule_path AS rule, verdict,
                     row_number() OVER (PARTITION BY n ORDER BY length(rule_host) + length(rule_path) DESC,
                                        length(rule_host) DESC, verdict DESC) AS place
              FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM urls LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (n)
"""

OP3 = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS words FROM documents),
     windows AS (SELECT n, doc_id, i, array_to_string(words[i:i + 12], ' ') AS run
                 FROM (SELECT *, unnest(range(1, len(words) - 11)) AS i FROM docs)),
     first AS (SELECT run, min(doc_id) AS smallest FROM windows GROUP BY run),
     covered AS (SELECT DISTINCT n, unnest(range(i, i + 13)) AS i FROM windows JOIN first USING (run) WHERE smallest < doc_id),
     placed AS (SELECT n, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM docs),
     kept AS (SELECT n, string_agg(word, ' ' ORDER BY i) AS words, count(*) AS n_kept
              FROM placed ANTI JOIN covered USING (n, i) GROUP BY n)
SELECT doc_id, len(docs.words) AS n_words, len(docs.words) - coalesce(n_kept, 0) AS n_removed,
       sha256(coalesce(kept.words, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (n)
"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ENDS = ", ".join(map(_text, quality.SENTENCE_ENDS))
_MENU = ", ".join(map(_text, quality.NAVIGATION))
_PHRASES = " OR ".join(f"contains(lower(bare), {_text(p)})" for p in quality.BOILERPLATE)

OP4 = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
     windows AS (SELECT n, i, words[i:i + 2] AS run FROM (SELECT *, unnest(range(1, len(words) - 1)) AS i FROM docs)),
     twice AS (SELECT n, run FROM windows GROUP BY n, run HAVING count(*) > 1),
     repeats AS (SELECT n, count(DISTINCT j) AS n_repeat_words
                 FROM (SELECT n, unnest(range(i, i + 3)) AS j FROM windows SEMI JOIN twice USING (n, run)) GROUP BY n),
     lines AS (SELECT n, line, trim(line, {_BLANKS}) AS bare FROM (SELECT n, unnest(string_split(text, chr(10))) AS line FROM docs)),
     judged AS (SELECT n, line, right(bare, 1) NOT IN ({_ENDS})
                       OR len(regexp_extract_all(bare, {_text(quality.MARKS)})) * 100 > length(bare) * {quality.MAX_MARK_PERCENT}
                       OR len(regexp_extract_all(bare, {_text(quality.SEPARATORS)})) > {quality.MAX_SEPARATORS}
                       OR lower(bare) IN ({_MENU}) OR {_PHRASES} AS fails
                FROM lines WHERE bare <> ''),
     by_lines AS (SELECT n, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (fails) AS n_lines_removed,
                         sum(length(line)) AS chars, coalesce(sum(length(line)) FILTER (fails), 0) AS chars_lost
                  FROM judged GROUP BY n),
     counts AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                       CAST(len(regexp_extract_all(text, {_text(quality.SYMBOLS)})) AS BIGINT) AS n_symbols,
                       coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                       coalesce(n_lines_removed, 0) AS n_lines_removed,
                       CAST(coalesce(chars_lost, 0) AS BIGINT) AS chars_lost, CAST(coalesce(chars, 0) AS BIGINT) AS chars
                FROM docs LEFT JOIN repeats USING (n) LEFT JOIN by_lines USING (n)),
     based AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed
               FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND chars_lost * 100 <= chars * {quality.MAX_LOST_PERCENT} AS kept, n_lines_removed, chars_lost
FROM based
"""

OP7 = rf"""
WITH RECURSIVE
     docs AS (SELECT row_number() OVER () AS n, doc_id,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS words FROM documents),
     shingles AS (SELECT DISTINCT n, array_to_string(words[i:i + 4], ' ') AS shingle
                  FROM (SELECT *, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM docs WHERE len(words) > 0)),
     sizes AS (SELECT n, count(*) AS size FROM shingles GROUP BY n),
     shared AS (SELECT a.n AS a, b.n AS b, count(*) AS common FROM shingles a JOIN shingles b USING (shingle) WHERE a.n <> b.n GROUP BY ALL),
     links AS (SELECT a, b FROM shared JOIN sizes x ON x.n = a JOIN sizes y ON y.n = b WHERE 100 * common >= 75 * (x.size + y.size - common)),
     reach(n, m) AS (SELECT n, n FROM docs UNION SELECT reach.n, b FROM reach JOIN links ON a = m)
SELECT docs.doc_id, coalesce(any_value(size), 0) AS n_shingles, min(other.doc_id) AS component_id
FROM docs JOIN reach USING (n) JOIN docs other ON other.n = m LEFT JOIN sizes ON sizes.n = docs.n
GROUP BY docs.n, docs.doc_id
"""

OP11 = r"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
     totals AS (SELECT count(*) FILTER (len(terms) > 0) AS documents, CAST(sum(len(terms)) AS BIGINT) AS length FROM docs),
     held AS (SELECT n, term, count(*) AS tf FROM (SELECT n, unnest(terms) AS term FROM docs) GROUP BY ALL),
     weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
                 FROM held, totals GROUP BY term),
     sizes AS (SELECT n, doc_id, 100 - 90 + ((90 * len(terms) * documents) // length) AS m FROM docs, totals WHERE len(terms) > 0),
     asked AS (SELECT row_number() OVER () AS i, item_id,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
     wanted AS (SELECT DISTINCT i, item_id, unnest(terms) AS term FROM asked),
     scored AS (SELECT i, item_id, n, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
                FROM wanted JOIN weights USING (term) JOIN held USING (term) JOIN sizes USING (n) GROUP BY ALL),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP12 = """
WITH vectors AS (SELECT row_number() OVER () AS n, vec_id,
                        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS parts
                 FROM embeddings
                 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     parts AS (SELECT n, vec_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM vectors),
     products AS (SELECT q.n AS q, c.n AS c, CAST(sum(q.part * c.part) AS BIGINT) AS score
                  FROM parts q JOIN parts c USING (place) WHERE q.vec_id % 50 = 0 AND q.n <> c.n GROUP BY ALL),
     ranked AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(score, 0) AS score,
                       row_number() OVER (PARTITION BY q.n ORDER BY coalesce(score, 0) DESC, c.vec_id NULLS LAST) AS rank
                FROM vectors q JOIN vectors c ON q.n <> c.n LEFT JOIN products p ON p.q = q.n AND p.c = c.n WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _repair_steps() -> tuple[str, str, str]:
    """The recursion over a conversation's rows from the last to the first, for the grammar states 1 to 4.

    A value is a struct of cost, audit and repaired text, so the least value is the cheapest, then ASCII-least.
    States: nothing yet, after a system, a user, an assistant row.
    """
    fits, role = {1: 3, 2: 3, 3: 4, 4: 3}, {1: "user", 2: "user", 3: "assistant", 4: "user"}
    kept = {1: {"s": 2, "u": 3}, 2: {"u": 3}, 3: {"a": 4}, 4: {"u": 3}}

    def line(cost: str, edit: str, head: str, below: str) -> str:
        rest = f"CASE {below}.t WHEN '' THEN '' ELSE chr(10) || {below}.t END"
        return f"{{'c': {cost} + {below}.c, 'a': '{edit}' || {below}.a, 't': {head} || {rest}}}"

    def insert(state: int, below: str) -> str:
        return line("3", "I", f"'{role[state]}:'", below)

    plain = []
    for state in fits:
        options = [f"{{'c': 4 + b{state}.c, 'a': 'D' || b{state}.a, 't': b{state}.t}}"]
        options.append(f"CASE WHEN NOT gone THEN {line('3 + extra', 'R', f"'{role[state]}:' || text", f'b{fits[state]}')} END")
        options += [
            f"CASE WHEN NOT gone AND left(role, 1) = '{first}' THEN {line('extra', 'K', "role || ':' || text", f'b{after}')} END"
            for first, after in kept[state].items()
        ]
        plain.append(f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1] AS v{state}")
    once = ", ".join(f"list_sort([v{s}, {insert(s, f'v{fits[s]}')}])[1] AS w{s}" for s in fits)
    twice = ", ".join(f"list_sort([w{s}, {insert(s, f'w{fits[s]}')}])[1] AS b{s}" for s in fits)
    return ", ".join(plain), once, twice


_PLAIN, _ONCE, _TWICE = _repair_steps()

OP13 = f"""
WITH RECURSIVE
     table_of(t) AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), i))),
     keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
     summed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                       xor(4294967295, list_reduce(list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT)),
                           lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), CAST(4294967295 AS BIGINT))) % 20 AS fault
                FROM keyed, table_of),
     damaged AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
                        CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                        unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
                 FROM summed WHERE fault <> 0),
     placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM damaged),
     seen AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
                     lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair,
                     row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM placed),
     judged AS (SELECT *, bare = '' AS blank, bare <> '' AND again AS duplicate,
                       bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated FROM seen),
     counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
                        count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
                        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
                 FROM judged GROUP BY conv_id),
     steps(conv_id, i, b1, b2, b3, b4) AS (
         SELECT conv_id, n + 1, {{'c': 0, 'a': '', 't': ''}}, {{'c': 6, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}},
                {{'c': 3, 'a': 'I', 't': 'assistant:'}}, {{'c': 0, 'a': '', 't': ''}} FROM counted
         UNION ALL
         SELECT conv_id, i, {_TWICE} FROM (SELECT conv_id, i, v1, v2, v3, v4, {_ONCE} FROM (
             SELECT steps.conv_id, r.i, {_PLAIN}
             FROM steps JOIN (SELECT *, blank OR duplicate AS gone, CASE WHEN truncated THEN 3 ELSE 0 END AS extra FROM judged) r
                  ON r.conv_id IS NOT DISTINCT FROM steps.conv_id AND r.i = steps.i - 1))),
     solved AS (SELECT conv_id, b1 FROM steps WHERE i = 1)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b1.c, 0) AS BIGINT) AS cost,
       coalesce(b1.a, '') AS audit, sha256(coalesce(b1.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
     LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM ids.conv_id
     LEFT JOIN solved ON solved.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

ORACLES = {
    "op1_url_filter": OP1,
    "op3_substring_dedup": OP3,
    "op4_quality_rules": OP4,
    "op7_ngram_jaccard_join": OP7,
    "op11_ranked_search": OP11,
    "op12_exact_search": OP12,
    "op13_conversation_repair": OP13,
}
