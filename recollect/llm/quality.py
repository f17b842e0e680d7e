"""Quality rules: a threshold table compiled into one Spark projection.

Length, symbol, stop-word and line measures are built-in expressions, so the operator has no user
function and no shuffle. Texts are read whole; a null text counts as empty. A long text costs
n log n in its own words: repeated windows are found by sorting 64-bit keys inside the row, and a row in
which two different windows share a key sorts the windows themselves.
Repeated rows are measured each on their own, an empty table gives an empty result, further
columns of the input are not read and so cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, kept_struct, let, unkept

#: Function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that it for on was with as be by this are or an at from not have "
    "de la le et les des en un une que du dans est pour qui sur pas au "
    "der die und das den von zu mit ist im nicht ein eine auf dem für "
    "el los y las del se por con una su al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject a document when ``measure`` is under ``least`` or over ``most``; ``per`` divides it."""

    name: str
    measure: str
    per: str | None = None
    least: float | None = None
    most: float | None = None


#: The threshold table. The first two rules are the base; ratios are compared by multiplication.
RULES = (
    Rule("words", "n_words", least=50),
    Rule("repeated_words", "n_repeat_words", "n_words", most=0.5),
    Rule("long_words", "word_chars", "n_words", most=25),
    Rule("symbols", "n_symbols", "n_words", most=0.25),
    Rule("stop_words", "n_stop_words", "n_words", least=0.08),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=0.5),
    Rule("repeated_line_chars", "dup_line_chars", "line_chars", most=0.5),
    Rule("bullets", "n_bullet_lines", "n_lines", most=0.9),
    Rule("ellipses", "n_ellipsis_lines", "n_lines", most=0.3),
)
BASE_RULES = ("words", "repeated_words")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN, -1), "")


def _repeat_words(words: Column, hashed: Callable[[Column], Column] = F.xxhash64) -> Column:
    """Words inside 3-word windows that occur twice or more: sort window keys, look at neighbours.

    A key holds a hash of the window above the window's position, so one sort of longs brings equal
    windows together; neighbours with one hash are compared word by word, and if any two differ the
    windows themselves are sorted.
    """
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<bigint>")

    def either(at, first, second):
        """The sorted positions of both ends of the neighbours that ``at`` counts."""
        ends = F.array_union(F.transform(at, first), F.transform(at, second))
        return F.when(F.size(at) == 0, none).otherwise(F.sort_array(ends))

    def same(w, p, q):
        return (F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1)) & (F.get(w, p + 2) == F.get(w, q + 2))

    def starts(w, low):
        n = F.size(w)
        windows = F.arrays_zip(F.slice(w, 1, n - 2), F.slice(w, 2, n - 2), F.slice(w, 3, n - 2))
        keys = F.transform(windows, lambda x, i: hashed(x).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))

        def exact():
            placed = F.transform(windows, lambda x, i: F.struct(x["0"].alias("a"), x["1"].alias("b"), x["2"].alias("c"), i.cast("long").alias("i")))

            def neighbours(s):
                def equal(j):
                    x, y = F.get(s, j), F.get(s, j + 1)
                    return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

                return let(F.filter(F.sequence(F.lit(0), n - 4), equal), lambda at: either(at, lambda j: F.get(s, j)["i"], lambda j: F.get(s, j + 1)["i"]))

            return let(F.array_sort(placed), neighbours)

        def twins(s):
            place = lambda j: F.get(s, j).bitwiseAND(low)

            def met(j):
                differ = F.get(s, j).bitwiseXOR(F.get(s, j + 1))
                return (differ <= low) & (differ >= zero)

            def settled(at):
                true = F.forall(at, lambda j: same(w, place(j).cast("int"), place(j + 1).cast("int")))
                return F.when(true, either(at, place, lambda j: place(j + 1))).otherwise(exact())

            return let(F.filter(F.sequence(F.lit(0), n - 4), met), settled)

        return let(F.sort_array(keys), twins)

    def covered(at):
        three = F.lit(3).cast("long")
        gaps = F.transform(at, lambda p, j: F.least(three, F.coalesce(F.get(at, j + 1) - p, three)))
        return F.aggregate(gaps, zero, lambda a, x: a + x)

    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(words).cast("long")))) - F.lit(1).cast("long")
    return F.when(F.size(words) < 4, zero).otherwise(let(low, lambda m: let(starts(words, m), covered)))


def measure(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The measures of every row beside the columns named in ``keep``."""
    keep = ["doc_id"] if keep is None else keep
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    split = docs.select(
        kept_struct(docs, keep).alias("kept_columns"), _words(text).alias("w"), lines.alias("l"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    stops = [*dict.fromkeys([*STOP_WORDS, *(x.capitalize() for x in STOP_WORDS)])]
    long_chars = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return split.select(
        "kept_columns",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w")).alias("n_repeat_words"),
        F.size(F.filter("w", lambda x: x.isin(stops))).cast("long").alias("n_stop_words"),
        long_chars(F.col("l")).alias("line_chars"),
        (long_chars(F.col("l")) - long_chars(F.array_distinct("l"))).alias("dup_line_chars"),
        F.size(F.filter("l", lambda x: x.rlike("^[ \\t]*[-*\u2022]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("l", lambda x: x.rlike("(\\.\\.\\.|\u2026)[ \\t\\r]*\\z"))).cast("long").alias("n_ellipsis_lines"),
    )


def failed(rule: Rule) -> Column:
    value = F.col(rule.measure)
    unit = F.col(rule.per) if rule.per else F.lit(1)
    bad = F.lit(False)
    if rule.least is not None:
        bad = bad | (value < F.lit(rule.least) * unit)
    if rule.most is not None:
        bad = bad | (value > F.lit(rule.most) * unit)
    return bad


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Measures, the base verdict, the names of the rules that failed, and ``kept``.

    ``kept_columns`` is a struct of the columns in ``keep`` (the id only, by default) as c0, c1, ..., so that
    a column of the input may have any name.
    """
    measured = measure(docs, text_col, keep)
    names = F.array_compact(F.array(*[F.when(failed(r), F.lit(r.name)) for r in rules]))
    base = [failed(r) for r in rules if r.name in BASE_RULES]
    verdict = F.lit(False)
    for b in base:
        verdict = verdict | b
    # the row number is no condition: it makes the verdict non-deterministic in Catalyst's eyes, so that a filter on it
    # stays above the projection; pushed below, it would repeat the window search inside every lambda
    kept = (F.size("failed_rules") == 0) & (F.monotonically_increasing_id() >= 0)
    return measured.select("*", names.alias("failed_rules"), verdict.alias("base_failed")).withColumn("kept", kept)


def quality_rows(docs: DataFrame) -> DataFrame:
    """The digest rows of the query."""
    return judge(docs).select(
        F.col("kept_columns.c0").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that pass every rule, with the input's columns."""
    judged = judge(docs, keep=docs.columns)
    return judged.filter("kept").select(*unkept(docs))
