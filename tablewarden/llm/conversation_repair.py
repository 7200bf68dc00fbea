"""Conversation structure repair: cheapest edits that make a conversation's roles follow the grammar.

A conversation's roles must read, by their first letters, `(s?(ua)+)?`. Rows may be kept (0), get the role
user or assistant (3), be deleted (4, as blank and repeated rows must be), and rows without text may be put
in (3); a row that breaks off costs 3 more unless it is deleted. Of equally cheap edits the ASCII-least
audit, the edits' first letters in order, is chosen.

A row is one letter, by its role's first letter and its first fault; a conversation is a word of them. Words
are shared from their ends: in the order of the reversed words, equal endings are next to each other, and each
ending is a node of the automaton, made once for all conversations that end so. For every node and grammar
state the cheapest cost to the end and the first edit of its best audit are found once, from those of
the node below; audits are read off by following first edits.

Rows of one turn come by role and by a digest of their text, null turns first. A null role or text is one
space. A role without a first letter of the grammar cannot be kept. Null ids are one conversation. A number
of gaps beyond 64 bits is null. Other columns are not read. A long conversation's rows are named, counted
and ordered in many tasks; only its word (a byte a row) and the stream of its repaired rows stay together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.llm.common import prepare, stored

# Blanks, what ends a text, and the letters of rows: by role s, u, a or other; first sound
# ones, then those that break off, blank ones and repeated ones.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
LETTERS, ROLES, MUST_GO = "suaoSUAO01234567", "suaosuaosuaosuao", "x"
#: What deleting, changing a role, putting in a row and keeping one that breaks off cost.
DELETE, REROLE, INSERT, BROKEN = 4, 3, 3, 3

# Grammar states: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: The state, and the role, that a row made to fit leads to.
FITTING = (USER, USER, ASSISTANT, USER)
FITTING_ROLE = (b"user", b"user", b"assistant", b"user")
#: Where a row that is kept leads to, by its role's first letter and the state before.
KEPT = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
    "o": {},
    MUST_GO: {},
}


class Node:
    """An ending of a word: its first letter, and by grammar state the cost to the end and the first edit."""

    __slots__ = ("cost", "edit", "letter")

    def __init__(self, letter: str, below: Node | None):
        self.letter = letter
        best = [self._without_insert(state, below) for state in STATES]
        for _ in range(2):  # never more than a user and an assistant are put in before a row
            best = [min(best[s], (INSERT + best[FITTING[s]][0], "I")) for s in STATES]
        self.cost, self.edit = zip(*best)

    def _without_insert(self, state: int, below: Node | None) -> tuple[float, str]:
        if below is None:
            return (0, "") if state in (START, ASSISTANT) else (float("inf"), "")
        options = [(DELETE + below.cost[state], "D")]
        if self.letter != MUST_GO:
            broken = BROKEN if self.letter.isupper() else 0
            options.append((broken + REROLE + below.cost[FITTING[state]], "R"))
            kept = KEPT[self.letter.lower()].get(state)
            if kept is not None:
                options.append((broken + below.cost[kept], "K"))
        return min(options)

    def after(self, state: int, edit: str) -> int:
        return state if edit == "D" else FITTING[state] if edit in "IR" else KEPT[self.letter.lower()][state]


def shared_endings(words: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(word, cost, audit) of words given and returned last letter first, in rising order.

    The nodes of the last word's endings are at hand, so an ending that the next word has too is not made again.
    """
    path, last = [Node("", None)], ""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        del path[common + 1 :]
        for letter in word[common:]:
            path.append(Node(letter, path[-1]))
        last, audit, at, state = word, [], len(word), START
        while edit := path[at].edit[state]:
            audit.append(edit)
            state = path[at].after(state, edit)
            at -= edit != "I"
        yield word, path[-1].cost[START], "".join(audit)


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found(rows: list) -> pa.RecordBatch:
        word, cost, audit = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(cost, pa.int64()), pa.array(audit)], names=["word", "cost", "audit"])

    rows, size = [], 0
    for row in shared_endings(w.as_py() for batch in batches for w in batch.column("word")):
        rows.append(row)
        size += len(row[0])
        if size >= 1 << 20:
            yield found(rows)
            rows, size = [], 0
    if rows:
        yield found(rows)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, part, letters) of rows in order: for each conversation the letters of its rows in this task."""
    part = TaskContext.get().partitionId()
    kind, conv, letters, some = None, None, [], False

    def string() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], kind), pa.array([part], pa.int32()), pa.array(["".join(letters)])], names=["conv", "part", "letters"]
        )

    for batch in batches:
        kind = batch.schema.field("conv").type
        for own, run in zip(batch.column("conv").to_pylist(), batch.column("letters").to_pylist()):
            if some and own != conv:
                yield string()
                letters = []
            conv, some = own, True
            letters.append(run)
    if some:
        yield string()


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which two nulls are equal."""
    right = right.withColumnsRenamed({k: f"other_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"other_{k}")) for k in keys]
    return left.join(right, on, how).drop(*[f"other_{k}" for k in keys])


def rows_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies) of a table: what the functions below take."""
    blank = F.lit(" ")
    return conversations.select(
        F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), blank).alias("role"),
        F.coalesce(F.col(text), blank).alias("text"), F.lit(1).cast("long").alias("copies"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by a checksum of conversation and turn: dropped, emptied, cut, repeated, of role user."""
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")])
    fault = F.crc32(named.cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return rows.where(fault != 0).select(
        "conv", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(fault == 3, 2 * F.col("copies")).otherwise(F.col("copies")).alias("copies"),
    )


def _order() -> list[Column]:
    return [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("name")]


def _lettered(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, name, letters) of different rows, with a letter for each of their copies."""
    bare = F.rtrim("text", F.lit(BLANKS))
    slim = rows.select(
        "conv", "turn", "role", F.md5(F.col("text").cast("binary")).alias("name"), (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(*ENDS)).alias("broken"), "copies",
    )
    # Equal rows are counted before they are shuffled, so a row that is there a million times is one.
    counted = slim.groupBy("conv", "turn", "role", "name", "blank", "broken").agg(F.sum("copies").alias("copies"))
    said = ["conv", "role", "name"]
    first = counted.groupBy(*said).agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("at_null"))
    joined = _joined(counted, first, said)
    new = F.when(F.col("at_null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("first"))
    kind = F.instr(F.lit("sua"), F.left("role", F.lit(1)))
    kind = F.when((kind == 0) | (F.col("role") == ""), 4).otherwise(kind)

    def letter(fault: int) -> Column:
        return F.substring(F.lit(LETTERS), kind + 4 * fault, F.lit(1))

    later = F.repeat(letter(3), (F.col("copies") - 1).cast("int"))
    letters = (
        F.when(F.col("blank"), F.repeat(letter(2), F.col("copies").cast("int")))
        .when(~new, F.repeat(letter(3), F.col("copies").cast("int")))
        .when(F.col("broken"), F.concat(letter(1), later))
        .otherwise(F.concat(letter(0), later))
    )
    return joined.select("conv", "turn", "role", "name", letters.alias("letters"))


def judge(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """For each of the ids (column conv): gaps, blank, duplicate, truncated, illegal, cost and audit."""
    prepare(rows.sparkSession)
    lettered = stored(_lettered(rows), "lettered")
    conv = rows.schema["conv"].dataType
    # By ranges, not by conversation, so that a long conversation is read by several tasks.
    ordered = lettered.select("conv", "turn", "role", "name", "letters").repartitionByRange(*_order()).sortWithinPartitions(*_order())
    schema = T.StructType([T.StructField("conv", conv), *T.StructType.fromDDL("part int, letters string").fields])
    strings = ordered.select("conv", "letters").mapInArrow(_strings, schema)
    whole = strings.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "letters"))).alias("strings"))
    letters = whole.select("conv", F.array_join(F.transform("strings", lambda s: s["letters"]), "").alias("letters"))

    def count(which: slice) -> Column:
        return F.length("letters") - F.length(F.translate("letters", LETTERS[which], ""))

    roles = F.translate("letters", LETTERS, ROLES)
    counted = letters.select(
        "conv", count(slice(8, 12)).alias("blank"), count(slice(12, 16)).alias("duplicate"), count(slice(4, 8)).alias("truncated"),
        (F.length("letters") - 1 - F.regexp_count(roles, F.lit("s(?=u)|u(?=a)|a(?=u)"))).alias("illegal"),
        F.reverse(F.translate("letters", LETTERS, LETTERS[:8] + MUST_GO * 8)).alias("word"),
    )
    counted = stored(counted, "words")
    words = counted.select("word").distinct().repartitionByRange("word").sortWithinPartitions("word")
    repairs = words.mapInArrow(_repairs, "word string, cost long, audit string")
    turns = lettered.select("conv", "turn").distinct().groupBy("conv").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("n"))
    span = F.col("high").cast("decimal(38,0)") - F.col("low").cast("decimal(38,0)") + 1 - F.col("n")
    gaps = turns.select("conv", F.coalesce(span, F.lit(0)).alias("gaps"))
    whole = counted.join(repairs, "word").drop("word")
    found = _joined(_joined(ids, whole, ["conv"], "left"), gaps, ["conv"], "left")
    zeros = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    all_gaps = F.when(F.col("gaps").isNull(), F.lit(0)).otherwise(F.expr("try_cast(gaps AS BIGINT)"))
    return found.select("conv", all_gaps.cast("long").alias("gaps"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"))


_EDITED = "place long, edit string, role string, text string"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows of conversations that come one after the other, each led by its audit."""
    conv, audit, at, last, state, place = None, "", 0, 0, START, 0
    for batch in batches:
        made: list[tuple] = []

        def put(edit: str, role: bytes, text: bytes) -> None:
            nonlocal place
            place += 1
            made.append((conv, place, edit, role, text))

        def inserts() -> None:
            nonlocal at, state
            while audit[at : at + 1] == "I":
                put("I", FITTING_ROLE[state], b"")
                at, state = at + 1, FITTING[state]

        columns = [batch.column("conv").to_pylist(), batch.column("copies").to_pylist()]
        columns += [batch.column(c).cast(pa.binary()) for c in ("role", "text")]
        for own, copies, role, text in zip(*columns):
            text = text.as_py()
            if copies is None:  # the next conversation's audit
                conv, audit, at, state, place = own, text.decode(), 0, START, 0
                last = len(audit.rstrip("I"))
                continue
            role = role.as_py()
            for _ in range(copies):
                inserts()
                edit, at = audit[at], at + 1
                if edit == "R":
                    put(edit, FITTING_ROLE[state], text)
                    state = FITTING[state]
                elif edit == "K":
                    put(edit, role, text)
                    state = KEPT[role[:1].decode()][state]
            if at == last:
                inserts()
        types = [batch.schema.field("conv").type, pa.int64(), pa.string(), pa.binary(), pa.binary()]
        arrays = [pa.array(c, t) for c, t in zip(list(zip(*made)) or [()] * 5, types)]
        arrays[3:] = [a.cast(pa.string()) for a in arrays[3:]]
        yield pa.RecordBatch.from_arrays(arrays, names=["conv", "place", "edit", "role", "text"])


def repaired(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text): the repaired conversations, rows of each together and in order within a task."""
    prepare(rows.sparkSession)
    audits = judged.where("audit <> ''").select(
        "conv", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"),
        F.lit(None).cast("long").alias("copies"), F.lit("").alias("name"),
    )
    named = rows.withColumn("name", F.md5(F.col("text").cast("binary")))
    by_conversation, *by_row = _order()
    order = [by_conversation, F.asc_nulls_first(F.col("copies").isNotNull()), *by_row]
    together = audits.unionByName(named).repartition("conv").sortWithinPartitions(*order)
    schema = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), *T.StructType.fromDDL(_EDITED).fields])
    return together.select("conv", "role", "text", "copies").mapInArrow(_edited, schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, conv, digest = None, None, None

    def result(found: list[tuple]) -> pa.RecordBatch:
        convs, digests = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(digests, pa.string())], names=["conv", "sha256"])

    for batch in batches:
        kind, found = batch.schema.field("conv").type, []
        columns = [batch.column(c).cast(pa.binary()) for c in ("role", "text")]
        for own, place, role, text in zip(batch.column("conv").to_pylist(), batch.column("place").to_pylist(), *columns):
            if place == 1:
                if digest is not None:
                    found.append((conv, digest.hexdigest()))
                conv, digest = own, hashlib.sha256()
            else:
                digest.update(b"\n")
            for part in (role.as_py(), b":", text.as_py()):
                digest.update(part)
        yield result(found)
    if digest is not None:
        yield result([(conv, digest.hexdigest())])


def with_digests(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """What `judge` says of each conversation, and the SHA-256 of its repaired `role:text` lines."""
    kept = stored(judged, "judged")
    texts = repaired(rows, kept)
    schema = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), T.StructField("sha256", T.StringType())])
    hashes = texts.mapInArrow(_hashed, schema)
    return _joined(kept, hashes, ["conv"], "left").withColumn("sha256", F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())))
