"""Personal data: patterns propose spans, checksums confirm them, nearby context words move the score.

Everything is a built-in expression over one row, without a shuffle. Positions come from pairing the
matches of a pattern with the pieces between them and summing lengths in blocks, so a text is scanned twice per
kind however many matches it has. Patterns are written with possessive repeats and anchored starts, so that they find the
same leftmost non-overlapping matches in linear time and without deep recursion on very long texts.

A span's score is its kind's own, more beside a word of the kind's context, less beside a word of its
counter-context (an order number is no account number). Context is whole words, or their plurals, within CONTEXT_CHARS code points of
either end, whatever stands there, other matches included. What ends under the threshold is no span. The base kinds
start high enough to stay reported whatever stands beside them; context decides for the others.

Whole texts are read; a null text counts as empty and has no spans. Repeated rows are handled each on
their own, an empty table gives an empty result, and only the id and the text are read, so further
columns of any name are harmless (``keep`` carries them along in a struct).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import before_each, kept_struct, let, named, unkept

_LOCAL = "[A-Za-z0-9._%+-]"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def _digit_at(digits: Column, i: Column) -> Column:
    return F.ascii(F.substring(digits, i, F.lit(1))) - 48


def luhn(match: Column) -> Column:
    """12 to 19 digits whose Luhn sum is divisible by ten."""

    def total(d):
        def add(acc, i):
            x = _digit_at(d, F.length(d) + 1 - i)
            twice = x * 2
            return acc + F.when(i % 2 == 1, x).when(twice > 9, twice - 9).otherwise(twice)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0

    return let(_digits(match), lambda d: F.when(F.length(d).between(12, 19), total(d)).otherwise(F.lit(False)))


def mod97(match: Column) -> Column:
    """The ISO 7064 check of an account number: rotated by four, letters as 10 to 35, remainder 1."""

    def check(s):
        turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, F.lit(1), F.lit(4)))

        def add(acc, i):
            c = F.ascii(F.substring(turned, i, F.lit(1)))
            return F.when(c < 58, acc * 10 + c - 48).otherwise(acc * 100 + c - 55) % 97

        return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add) == 1

    return let(F.replace(match, F.lit(" "), F.lit("")), lambda s: F.when(F.length(s).between(15, 34), check(s)).otherwise(F.lit(False)))


def _octets(match: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


@dataclass(frozen=True)
class Kind:
    """A pattern, its check, a score when the check holds, and words nearby that raise or lower it."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    needs: str | None = None  # a character that any match holds
    bonus: float = 0.2
    counter: str = "order|invoice|ticket|serial|part no|version|isbn"
    malus: float = 0.1


_SSN_BAD = "^(?:000|666|9)|-00-|0000$"

#: In this order at equal starts; the first four are the base kinds and always clear the threshold.
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.8, "e?mail|contact|write|courriel|correo|kontakt", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", _octets, 0.7, "host|server|addr|address|adresse|ip|from", "."),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", luhn, 0.7, "card|visa|master|mastercard|credit|pay|payment|carte|karte|kreditkarte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), 0.6, "phone|telephone|telefon|téléphone|teléfono|call|tel|mobile|fax|ruf|rufnummer", "+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod97, 0.55, "iban|account|bank|konto|kontonummer|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike(_SSN_BAD), 0.3, "ssn|social security", "-", 0.4),
    Kind("mac", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Za-z:])", lambda m: F.lit(True), 0.45, "mac|device|wlan|wifi|ethernet", ":"),
    Kind("passport", r"(?<![A-Za-z0-9])[A-Z][A-Z0-9][0-9]{7}(?![A-Za-z0-9])", lambda m: F.lit(True), 0.25, "passport|passeport|reisepass|pasaporte", bonus=0.3),
)
BASE_KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.5
CONTEXT_CHARS = 40

_plus = lambda a, x: a + x
_most = lambda a, x: F.greatest(a, x)


#: Matches before and after one that a window is put together from: any two are a sign or more long, with one between.
_NEAR = CONTEXT_CHARS // 3 + 1


def _words(pattern: str) -> str:
    """Whole words, singular or plural, of a lower-cased text."""
    return rf"(?U)(?<![\p{{L}}\p{{N}}])(?:{pattern})(?:e?s)?(?![\p{{L}}\p{{N}}])"


def _beside(matches: Column, gaps: Column, i: Column, left: bool) -> Column:
    """The CONTEXT_CHARS code points before or after match ``i``. Only pieces that reach into them are put together."""
    edge = F.right if left else F.left
    cut = lambda x: edge(x, F.lit(CONTEXT_CHARS))
    gap = F.get(gaps, i if left else i + 1)
    if left:
        first = F.greatest(i - _NEAR, F.lit(0))
        more = F.transform(F.slice(matches, first + 1, i - first), lambda m, n: F.concat(cut(F.get(gaps, first + n)), cut(m)))
        pieces = F.concat(F.array_join(more, ""), gap)
    else:
        more = F.transform(F.slice(matches, i + 2, F.lit(_NEAR)), lambda m, n: F.concat(cut(m), cut(F.get(gaps, i + n + 2))))
        pieces = F.concat(gap, F.array_join(more, ""))
    return F.when(F.length(gap) >= CONTEXT_CHARS, cut(gap)).otherwise(cut(pieces))


def _all_spans(text: Column, kinds: tuple[Kind, ...]) -> Column:
    """Spans of every kind in one array. What follows the patterns is one expression over (kind, matches, gaps) for all kinds."""
    none = F.array().cast("array<string>")

    def found(order: int, kind: Kind) -> Column:
        some = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
        some = F.when(F.contains(text, F.lit(kind.needs)), some).otherwise(none) if kind.needs else some
        both = lambda m: F.struct(F.lit(order).alias("order"), m.alias("matches"), F.when(F.size(m) == 0, none).otherwise(F.split(text, kind.pattern, -1)).alias("gaps"))
        return let(some, both)

    def by_kind(order: Column, value: Callable[[Kind], Column]) -> Column:
        out = F.when(order == 0, value(kinds[0]))
        for n, kind in enumerate(kinds[1:], 1):
            out = out.when(order == n, value(kind))
        return out

    def score(order: Column, near: Column) -> Column:
        bonus = by_kind(order, lambda k: F.when(near.rlike(_words(k.context)), k.bonus).otherwise(0.0))
        malus = by_kind(order, lambda k: F.when(near.rlike(_words(k.counter)), k.malus).otherwise(0.0))
        return F.round(by_kind(order, lambda k: F.lit(k.score)) + bonus - malus, 3)

    def placed(k: Column) -> Column:
        order, matches, gaps = k["order"], k["matches"], k["gaps"]
        steps = F.transform(matches, lambda m, i: (F.length(m) + F.length(F.get(gaps, i))).cast("long"))

        def spans(before: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                start = (F.get(before, i) + F.length(F.get(gaps, i))).cast("int")
                near = F.lower(F.concat_ws(" ", _beside(matches, gaps, i, True), _beside(matches, gaps, i, False)))
                whole = lambda at, n: F.struct(
                    at.alias("start"), order.alias("order"), (at + F.length(m)).alias("end"), by_kind(order, lambda x: F.lit(x.name)).alias("kind"), score(order, n).alias("score"),
                )
                return F.when(by_kind(order, lambda x: x.valid(m)), let(near, lambda n: let(start, lambda at: whole(at, n))))

            return F.filter(F.transform(matches, span), lambda s: s.isNotNull())

        empty = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,score:double>>")
        return F.when(F.size(matches) == 0, empty).otherwise(let(before_each(steps, _plus, F.lit(0).cast("long")), spans))

    return F.flatten(F.transform(F.array(*[found(n, k) for n, k in enumerate(kinds)]), placed))


def find(
    docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, threshold: float = THRESHOLD, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``kept_columns`` (``keep`` as a struct c0, c1, ...), ``text`` and ``spans``: start, order, end, kind, score, sorted by start and kind."""
    keep = ["doc_id"] if keep is None else keep
    base = docs.select(kept_struct(docs, keep).alias("kept_columns"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    spans = F.array_sort(F.filter(_all_spans(F.col("text"), kinds), lambda s: s["score"] >= threshold))
    return base.select("kept_columns", "text", spans.alias("spans"))


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_rows(docs: DataFrame) -> DataFrame:
    """The digest rows of the query."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of(k) for k in BASE_KINDS]
    surest = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    return find(docs).select(
        F.col("kept_columns.c0").alias("doc_id"), *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), surest.alias("score"),
    )


def _marked(text: Column, spans: Column) -> Column:
    """The text with runs of overlapping spans replaced by the mark of the first.

    ``reach`` is where the spans before one end; one that starts there or later is a head. A substring is counted from
    its text's start, so heads are taken in stretches of about the root of their number, and each cuts from its stretch.
    """
    top = F.lit(0).cast("long")
    ends = F.transform(spans, lambda s: s["end"].cast("long"))

    def cut(of, start, end):
        return F.substring(of, (start + 1).cast("int"), (end - start).cast("int"))

    def from_heads(heads):
        def stretches(width):
            def piece(i):
                def within(own):
                    first, last = F.get(own, F.lit(0))["reach"], F.get(own, F.size(own) - 1)["start"]
                    mark = lambda h: F.concat(F.lit("<"), F.upper(h["kind"]), F.lit(">"))
                    return let(cut(text, first, last), lambda t: F.array_join(F.transform(own, lambda h: F.concat(cut(t, h["reach"] - first, h["start"] - first), mark(h))), ""))

                return let(F.slice(heads, i * width + 1, width), within)

            return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(heads) - 1) / width).cast("int")), piece), "")

        return let(F.ceil(F.sqrt(F.size(heads))).cast("int"), stretches)

    def all_heads(reach):
        each = F.transform(spans, lambda s, i: F.struct(F.get(reach, i).alias("reach"), s["start"].cast("long").alias("start"), s["kind"].alias("kind")))
        return F.filter(each, lambda h: h["start"] >= h["reach"])

    marked = let(let(before_each(ends, _most, top), lambda reach: all_heads(reach)), from_heads)
    return F.concat(marked, F.substring(text, F.array_max(ends).cast("int") + 1, F.length(text)))


def redact(docs: DataFrame) -> DataFrame:
    """The input's columns with every span replaced by its kind in angle brackets; n_chars follows the text.

    Overlapping spans give the mark of the first only. A null text stays null.
    """
    found = find(docs, keep=docs.columns)
    old = F.col(f"kept_columns.c{docs.columns.index('text')}")
    done = found.select("kept_columns", F.when(F.size("spans") == 0, old).otherwise(_marked(F.col("text"), F.col("spans"))).alias("clean"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        n = F.col(f"kept_columns.c{docs.columns.index('n_chars')}")
        new["n_chars"] = F.when(F.col("clean").isNull(), n).otherwise(F.length("clean")).cast(docs.schema["n_chars"].dataType)
    return done.select(*unkept(docs, new))
