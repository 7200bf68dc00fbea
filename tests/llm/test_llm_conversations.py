"""Conversation repair against all cheapest edits found by a plain search, and the registered query by hand."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tablewarden.llm import conversation_repair as repair

SF = "/root/testdata/sf0.001"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, repaired rows) of (role, text, fault) rows: from the end, for every role that may have come before."""
    order = {"": "su", "s": "u", "u": "a", "a": "u"}
    done = {"": (0, "", []), "a": (0, "", [])}
    table = dict(done)

    def insert(table):
        for _ in range(3):
            for before in order:
                for role in ("user", "assistant"):
                    if role[0] in order[before] and role[0] in table:
                        cost, audit, rest = table[role[0]]
                        new = (cost + 3, "I" + audit, [(role, "")] + rest)
                        if before not in table or new[:2] < table[before][:2]:
                            table[before] = new
        return table

    insert(table)
    for role, text, fault in reversed(rows):
        here = {}
        for before, follows in order.items():
            options = []
            if before in table:
                cost, audit, rest = table[before]
                options.append((cost + 4, "D" + audit, rest))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                choices = [(0, "K", role)] + [(3, "R", r) for r in ("user", "assistant")]
                for own, letter, new_role in choices:
                    if new_role[:1] and new_role[0] in follows and new_role[0] in table:
                        cost, audit, rest = table[new_role[0]]
                        options.append((cost + own + extra, letter + audit, [(new_role, text)] + rest))
            if options:
                here[before] = min(options, key=lambda o: o[:2])
        table = insert(here)
    return table[""]


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def by_hand(rows):
    """Of (conv, turn, role, text) rows after damage: what the operator says of each conversation."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, " " if role is None else role, " " if text is None else text))
    found = {}
    for conv, own in convs.items():
        name = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest())
        own.sort(key=name)
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        judged = faults_of([r[1:] for r in own])
        letters = [r[:1] for r, _, _ in judged]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        count = [sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")]
        cost, audit, fixed = cheapest(judged)
        assert GRAMMAR.fullmatch("".join(r[0] for r, _ in fixed))
        text = "\n".join(f"{r}:{t}" for r, t in fixed)
        found[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return found


EMPTY = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def run(spark, rows, parts=3):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("letters", F.lit("clash"))
    own = repair.rows_of(table.repartition(parts))
    judged = repair.judge(own, table.select(F.col("conv_id").alias("conv")).distinct())
    return {r[0]: tuple(r)[1:] for r in repair.with_digests(own, judged).collect()}


def test_random_conversations(spark):
    draw = random.Random(11)
    texts = ["One.", "Two!", "Three?", "four", "  ", "", "Two!\n", "five \t", "Ünï.", "…"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "uncle"]
    rows = []
    for conv in range(120):
        for turn in range(draw.choice([0, 1, 2, 3, 5, 9, 14])):
            turn = draw.choice([turn, turn, turn, turn + 3, None])
            rows.append((conv, turn, draw.choice(roles), draw.choice([*texts, f"text {draw.random()}.", None])))
    rows += draw.sample(rows, 40)
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (None, 2, "assistant", "b.")]
    assert run(spark, rows) == by_hand(rows)


def test_a_conversation_over_many_tasks(spark):
    draw = random.Random(3)
    rows = [(7, i // 2, draw.choice(["user", "assistant", "system"]), draw.choice([f"t{i}.", "same.", "cut", ""])) for i in range(3000)]
    rows += [(8, i, ("user", "assistant")[i % 2], f"x{i}.") for i in range(6)]
    found = run(spark, rows, 8)
    assert found == by_hand(rows)
    assert found[8][5:7] == (0, "KKKKKK")


def test_empty_table_and_very_long_texts(spark):
    assert run(spark, []) == {}
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "." * 500_000 + " " * 500_000)]
    assert run(spark, rows) == by_hand(rows)


@pytest.mark.parametrize(
    ("word", "cost", "audit"),
    [("", 0, ""), ("s", 4, "D"), ("ua", 0, "KK"), ("sua", 0, "KKK"), ("u", 3, "KI"), ("a", 3, "IK"), ("uu", 3, "KR"), ("x", 4, "D"),
     ("uU", 6, "KR"), ("uaU", 4, "KKD"), ("o", 4, "D"), ("uo", 3, "KR")],
)
def test_small_words(word, cost, audit):
    found = list(repair.shared_endings(iter([word[::-1]])))
    assert [f[1] for f in found] == [cost]
    assert found[0][2] == audit


def test_endings_are_made_once(monkeypatch):
    made = []

    class Counted(repair.Node):
        def __init__(self, letter, below):
            made.append(letter)
            super().__init__(letter, below)

    monkeypatch.setattr(repair, "Node", Counted)
    words = sorted({"".join(w)[::-1] for w in ("ua", "sua", "uaua", "suaua", "aua")})
    list(repair.shared_endings(iter(words)))
    assert len(made) == 1 + len({w[:i] for w in words for i in range(1, len(w) + 1)})


def damage(rows):
    for conv, turn, role, text in rows:
        conv_text, turn_text = (" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        for _ in range(2 if kind == 3 else 1):
            yield conv, turn, "user" if kind == 4 else role, text


def test_damage_and_registered_query(spark):
    got = {r[0]: tuple(r)[1:] for r in entry.queries()["op13_conversation_repair"](spark, SF).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: EMPTY for c, *_ in rows} | by_hand(list(damage(rows)))
    assert got == want
    odd = [(None, None, None, None), (1, None, "user", None), (1, 5, None, "a.b!c?"), (2, 1, "user", "x.")] * 2
    table = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    rows = repair.damaged(repair.rows_of(table)).collect()
    spread = [(r.conv, r.turn, r.role, r.text) for r in rows for _ in range(r.copies)]
    assert sorted(spread, key=str) == sorted(damage(odd), key=str)


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "a."), (1, 1, "user", "b"), (1, 2, "user", " ")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    own = repair.rows_of(table)
    judged = repair.judge(own, table.select(F.col("conv_id").alias("conv")).distinct())
    fixed = repair.repaired(own, judged).orderBy("conv", "place").collect()
    cost, audit, want = cheapest(faults_of([(r, t) for _, _, r, t in rows]))
    assert [(r.role, r.text) for r in fixed] == want
    assert judged.first().audit == audit and judged.first().cost == cost
