"""Quality rules: a threshold table compiled into one projection over whole texts.

Every measure is a built-in Spark expression, so a scan evaluates all rules without a shuffle and
without Python. Array work runs in higher-order functions inside the row: no row is exploded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, text_of

#: Fixed by the contract: what counts as a symbol, the window length, and the limits of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Shares of stop words mean little in a text shorter than this; such a text passes that rule.
STOP_MIN_WORDS = 50

#: Frequent function words of the languages at hand; a parameter of `quality`.
STOP_WORDS = (
    "the of and to in is for on as that with by at it was be are from this or an "
    "der die das und zu den von ist für auf mit im dem nicht ein eine sich des als "
    "de la le et les des un une du en est pour que dans qui par sur pas au "
    "el los las y se del con no una su por lo es para"
).split()


class Rule(NamedTuple):
    """`low` <= measure <= `high`; an open end is None. A measure without a value passes."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Production thresholds. Measures are the keys of `_measures`.
RULES: tuple[Rule, ...] = (
    Rule("mean_word_length", "mean_word_length", 1.5, 20),
    Rule("symbols_per_word", "symbols_per_word", None, 0.3),
    Rule("stop_words", "stop_words_per_word", 0.02, None),
    Rule("duplicate_lines", "duplicate_lines", None, 0.7),
    Rule("bullet_lines", "bullet_lines", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_lines", None, 0.3),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` bound to a lambda variable: evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: _without(line, SPACES) != "")


def _repeated(words: Column) -> Column:
    """Words inside a window of five words that the text holds at least twice.

    Window hashes that all differ prove that the windows differ, which settles most texts; the
    others sort the windows themselves, so no hash decides that two windows are equal.
    """
    def window(w: Column, i: Column) -> list[Column]:
        return [F.get(w, i + k) for k in range(WINDOW)]

    def starts(w: Column) -> Column:
        return F.sequence(F.lit(0), F.size(w) - WINDOW)

    def all_differ(w: Column) -> Column:
        return _let(
            F.transform(starts(w), lambda i: F.xxhash64(*window(w, i))),
            lambda h: F.size(F.array_distinct(h)) == F.size(h),
        )

    def covered(w: Column) -> Column:
        found = F.sort_array(F.transform(
            starts(w), lambda i: F.struct(F.concat_ws(" ", *window(w, i)).alias("t"), i.alias("i"))))
        again = _let(found, lambda s: F.sort_array(F.transform(
            F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (
                (F.get(s, j)["t"] == F.get(s, j - 1)["t"]) | (F.get(s, j)["t"] == F.get(s, j + 1)["t"]))),
            lambda j: F.get(s, j)["i"])))
        return F.aggregate(
            again,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(
        _let(words, lambda w: F.when(all_differ(w), F.lit(0).cast("long")).otherwise(covered(w))))


def _measures() -> dict[str, Column]:
    words, lines = F.col("n_words"), F.col("_n_lines")
    return {
        "mean_word_length": F.try_divide(F.col("word_chars"), words),
        "symbols_per_word": F.try_divide(F.col("n_symbols"), words),
        "stop_words_per_word": F.when(words >= STOP_MIN_WORDS, F.try_divide(F.col("n_stop_words"), words)),
        "duplicate_lines": F.try_divide(F.col("n_dup_lines"), lines),
        "bullet_lines": F.try_divide(F.col("_n_bullets"), lines),
        "ellipsis_lines": F.try_divide(F.col("_n_ellipses"), lines),
    }


def _failures(rules: Sequence[Rule]) -> Column:
    """The table as one expression: the names of the rules that a row breaks."""
    measures = _measures()
    broken = []
    for rule in rules:
        value = measures[rule.measure]
        outside = F.lit(False)
        if rule.low is not None:
            outside = outside | (value < rule.low)
        if rule.high is not None:
            outside = outside | (value > rule.high)
        broken.append(F.when(outside, F.lit(rule.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES, stop_words: Sequence[str] = tuple(STOP_WORDS),
            text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Measures and verdict of every row of `docs`; the columns in `keep` are passed on.

    A null text counts as empty: no words, so it fails the base rules. Rows are judged one by one:
    repeated rows and repeated ids give repeated results, an empty table an empty one, and only the
    named columns are read, so other columns may have any name.

    Returns `keep`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed,
    kept (boolean), n_stop_words (long) and failed_rules (array of rule names).
    """
    t = F.col("_t")
    measured = (
        docs.select(*keep, text_of(text).alias("_t"))
        .select(*keep, "_t", _words(t).alias("_words"), _lines(t).alias("_lines"))
        .select(
            *keep,
            F.size("_words").cast("long").alias("n_words"),
            F.length(_without(t, SPACES)).cast("long").alias("word_chars"),
            (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            _repeated(F.col("_words")).alias("n_repeat_words"),
            F.size(F.filter("_words", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(*stop_words)))
            .cast("long").alias("n_stop_words"),
            F.size("_lines").alias("_n_lines"),
            F.size(F.filter("_lines", lambda line: F.ltrim(line).rlike(r"^[-*•]"))).alias("_n_bullets"),
            F.size(F.filter("_lines", lambda line: F.rtrim(line).rlike(r"(\.\.\.|…)$"))).alias("_n_ellipses"),
        )
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & (F.size(_failures(rules)) == 0)).alias("kept"),
        "n_stop_words", _failures(rules).alias("failed_rules"),
    )
