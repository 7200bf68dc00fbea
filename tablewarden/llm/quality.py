"""Quality rules, line first: lines are judged and removed, then documents that lost too much text.

Everything is column expressions on the row itself: no shuffle, no Python. Arrays that later steps look
into by position are put behind a one-element generator, so that the optimizer does not copy their
computation into the lambdas that read them, where it would run once per element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import SPACE, free_name

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50  # words in repeated 3-word windows
MAX_LOST_PERCENT = 50  # code points in removed lines
MAX_MARK_PERCENT = 5  # code points of a line that are marks
MAX_SEPARATORS = 2  # of a line that is no navigation bar

SYMBOLS = "[#*$%&|<>]"
MARKS = "[#*$%&|<>!=_~^{}]"
SEPARATORS = "[|>»›·•]"
SENTENCE_ENDS = tuple(".!?:;\"')]…»”’。！？")
# Phrases of page furniture, lower case.
BOILERPLATE = (
    "accept cookies",
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "sign up for",
    "subscribe to",
    "terms of use",
)
NAVIGATION = ("home", "menu", "login", "log in", "sign in", "next", "previous", "back to top", "skip to content")


def _barrier(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """`keep` and new columns; the optimizer moves nothing across."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def line_fails(line: Column) -> Column:
    """Punctuation: no sentence end, or too many marks. Navigation: separators or a bare menu word. Boilerplate: a known phrase."""
    bare = _trimmed(line)
    low = F.lower(bare)
    unended = ~F.right(bare, F.lit(1)).isin(*SENTENCE_ENDS)
    marked = F.regexp_count(bare, F.lit(MARKS)) * 100 > F.length(bare) * MAX_MARK_PERCENT
    bar = F.regexp_count(bare, F.lit(SEPARATORS)) > MAX_SEPARATORS
    phrase = low.isin(*NAVIGATION)
    for known in BOILERPLATE:
        phrase = phrase | low.contains(known)
    return unended | marked | bar | phrase


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with a struct column `quality`; its name gets underscores where the table has one already.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed, chars_lost,
    clean_text, base_failed, kept. Blank lines are neither judged nor counted as text and stay as they
    are. Null and empty texts have no words: base_failed, clean_text empty. Rows stand alone, so ids may
    be null or repeated, and other columns pass unread.
    """
    out = free_name(docs, "quality")
    keep = docs.columns
    step = _barrier(
        docs,
        keep,
        **{f"{out}__w": F.when(_trimmed(_text(text)) == "", F.array().cast("array<string>")).otherwise(F.split(_trimmed(_text(text)), f"{SPACE}+"))},
        **{f"{out}__l": F.split(_text(text), "\n")},
    )
    words, lines = F.col(f"{out}__w"), F.col(f"{out}__l")
    step = _barrier(
        step,
        keep,
        **{
            f"{out}__n": F.size(words).cast("long"),
            f"{out}__c": F.length(F.array_join(words, "")).cast("long"),
            f"{out}__l": F.filter(lines, lambda x: _trimmed(x) != ""),
            f"{out}__k": F.filter(lines, lambda x: (_trimmed(x) == "") | ~line_fails(x)),
            f"{out}__g": F.when(
                F.size(words) >= 3,
                F.transform(
                    F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))),
                    lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
                ),
            ).otherwise(F.array().cast("array<bigint>")),
        },
    )
    grams, full, kept = F.col(f"{out}__g"), F.col(f"{out}__l"), F.col(f"{out}__k")
    counted = [f"{out}__{x}" for x in "ncl"]
    repeats = F.size(F.array_distinct(grams)) < F.size(grams)
    in_order = F.when(repeats, F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    step = _barrier(step, [*keep, *counted, f"{out}__k"], **{f"{out}__s": in_order})
    ordered = F.col(f"{out}__s")
    places = F.transform(
        F.filter(
            ordered,
            lambda x, k: (F.get(ordered, k + 1)["g"] == x["g"]).eqNullSafe(True)
            | ((k > 0) & (F.get(ordered, k - 1)["g"] == x["g"])).eqNullSafe(True),
        ),
        lambda x: x["i"],
    )
    # A window covers three words, of which those before the next window's start are new.
    covered = F.aggregate(
        F.array_sort(places),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total")),
        lambda a, x: F.struct(x.alias("last"), (a["total"] + F.least(F.lit(3), x - a["last"])).alias("total")),
        lambda a: a["total"],
    )
    blank = lambda x: _trimmed(x) != ""
    left = F.filter(kept, blank)
    step = _barrier(
        step,
        [*keep, f"{out}__n", f"{out}__c"],
        **{
            f"{out}__r": F.coalesce(covered, F.lit(0)).cast("long"),
            f"{out}__y": F.regexp_count(_text(text), F.lit(SYMBOLS)).cast("long"),
            f"{out}__d": (F.size(full) - F.size(F.array_distinct(full))).cast("long"),
            f"{out}__m": (F.size(full) - F.size(left)).cast("long"),
            f"{out}__a": F.length(F.array_join(full, "")).cast("long"),
            f"{out}__b": F.length(F.array_join(left, "")).cast("long"),
            f"{out}__t": F.array_join(kept, "\n"),
        },
    )
    col = lambda x: F.col(f"{out}__{x}")
    failed = (col("n") < MIN_WORDS) | (col("r") * 100 > col("n") * MAX_REPEAT_PERCENT)
    lost = col("a") - col("b")
    return step.select(
        *keep,
        F.struct(
            col("n").alias("n_words"),
            col("c").alias("word_chars"),
            col("y").alias("n_symbols"),
            col("d").alias("n_dup_lines"),
            col("r").alias("n_repeat_words"),
            col("m").alias("n_lines_removed"),
            lost.alias("chars_lost"),
            col("t").alias("clean_text"),
            failed.alias("base_failed"),
            (~failed & (lost * 100 <= col("a") * MAX_LOST_PERCENT)).alias("kept"),
        ).alias(out),
    )


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def clean(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The documents that are kept, without the lines that failed; `length`, if there, is counted anew."""
    columns = docs.columns
    measured = measure(docs, text)
    found = F.col(measured.columns[-1])
    new = {text: found["clean_text"]} | ({length: F.length(found["clean_text"]).cast("long")} if length in columns else {})
    return measured.where(found["kept"]).withColumns(new).select(*columns)
