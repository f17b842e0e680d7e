"""Full text: tokens with positions, an English stemmer, a web-style query parser, matching and cover density.

Tokens are runs of letters and digits of the lower-cased text. The English leg drops stop words (their positions
still count) and stems; the simple leg takes tokens as they are. A query is an OR of groups; a group is an AND of
words and quoted phrases, some of them negated. Parsing never fails: unbalanced quotes close at the end.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = r"[\p{L}\p{N}]+"

#: English words that carry no meaning of their own.
STOP_WORDS = frozenset(
    "i me my we our ours you your yours he him his she her hers it its they them their theirs what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below to from up down in out on off "
    "over under again further then once here there when where why how all any both each few more most other some such no nor "
    "not only own same so than too very s t can will just don should now".split()
)

_VOWELS = frozenset("aeiouy")
_DOUBLES = frozenset(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"))
_LI_ENDINGS = frozenset("cdeghkmnrt")
#: Suffix tables of the published English (Porter2) algorithm.
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_FIXED = frozenset(("sky", "news", "howe", "atlas", "cosmos", "bias", "andes", "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _VOWELS and w[i - 1] in _VOWELS:
                return i + 1
        return len(w)

    head = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if head is None else head
    return r1, after(r1)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-3] not in _VOWELS and w[-2] in _VOWELS and w[-1] not in _VOWELS and w[-1] not in "wxY"


def stem(word: str) -> str:
    """The stem of a lower-case English word by the published Porter2 rules."""
    if len(word) <= 2 or not word.isascii():
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    if word in _FIXED:
        return word
    w = word[1:] if word[0] == "'" else word
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _VOWELS) else c for i, c in enumerate(w))
    r1, r2 = _regions(w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _FIXED:
        return w
    # past forms
    if w.endswith(("eedly", "eed")):
        cut = 5 if w.endswith("eedly") else 3
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                if any(c in _VOWELS for c in w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w[-2:] in _DOUBLES:
                        w = w[:-1]
                    elif r1 >= len(w) and _short_end(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # suffixes, the longest first
    for table in (_STEP2, _STEP3):
        end = next((e for e in sorted(table, key=len, reverse=True) if w.endswith(e)), None)
        if end is not None:
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + table[end]
        elif table is _STEP2:
            if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
                w = w[:-1]
            elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in _LI_ENDINGS:
                w = w[:-2]
        elif w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    end = next((e for e in sorted((*_STEP4, "ion"), key=len, reverse=True) if w.endswith(e)), None)
    if end is not None and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.lower()


@dataclass(frozen=True)
class Term:
    """Words that follow each other (one word, or a quoted phrase)."""

    words: tuple[str, ...]
    negated: bool = False


@dataclass(frozen=True)
class Query:
    """An OR of ANDs."""

    groups: tuple[tuple[Term, ...], ...] = field(default_factory=tuple)


def parse(query: str) -> Query:
    groups: list[list[Term]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query):
        if word.lower() == "or" and not minus:
            groups.append([])
            continue
        tokens = tuple(re.findall(r"[^\W_]+", (phrase or word).lower()))
        if tokens:
            groups[-1].append(Term(tokens, bool(minus)))
    return Query(tuple(tuple(g) for g in groups if g))


def english(query: Query) -> Query:
    """Stems for words; stop words go, and groups that only had stop words."""

    def term(t: Term) -> Term | None:
        words = tuple(stem(w) for w in t.words if w not in STOP_WORDS)
        return Term(words, t.negated) if words else None

    groups = [tuple(x for t in g if (x := term(t))) for g in query.groups]
    return Query(tuple(g for g in groups if g))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({_TOKEN})"), F.lit(1))


#: Kinds of token: name and pattern. Written for leftmost-first engines without look-around; repeats of groups are bounded, so that no
#: engine recurses deeply (a path of more than 100 steps is two tokens).
TOKEN_KINDS = {
    "email": r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+){1,30}",
    "url": r"(?:https?|ftp)://[^ \t-\r<>]*[\p{L}\p{N}/]",
    "version": r"[0-9]+(?:\.[0-9]+){2,30}",
    "host": r"[\p{L}\p{N}][\p{L}\p{N}-]*(?:\.[\p{L}\p{N}][\p{L}\p{N}-]*){0,30}\.\p{L}\p{L}+",
    "path": r"(?:~|\.\.?|[\p{L}\p{N}_-]+)?(?:/[\p{L}\p{N}._-]*[\p{L}\p{N}_]){1,100}",
    "number": r"[-+]?[0-9]+(?:\.[0-9]+)?(?:e[-+]?[0-9]+)?",
    "compound": r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+){1,100}",
    "word": r"[\p{L}\p{N}]+",
}
#: The first that fits at a place is the longest: what may start with digits and go on with letters or hyphens comes before numbers.
ANY_TOKEN = "|".join([*(f"(?:{TOKEN_KINDS[k]})" for k in ("email", "url", "version", "host", "path", "compound")), r"(?:[0-9]*\p{L}[\p{L}\p{N}]*)", f"(?:{TOKEN_KINDS['number']})", f"(?:{TOKEN_KINDS['word']})"])


#: The same for an engine with look-ahead: letters that nothing joins to what follows are a word at once.
_ANY_TOKEN_FAST = rf"\p{{L}}+(?![\p{{L}}\p{{N}}._%+@:/-])|{ANY_TOKEN}"


def whole_tokens(text: Column) -> Column:
    """Tokens of the lower-cased text by maximal munch."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({_ANY_TOKEN_FAST})"), F.lit(1))


def token_kind(token: Column) -> Column:
    """The kind of a token, which does not depend on where it stands."""
    out = F.lit("word")
    for name in reversed([k for k in TOKEN_KINDS if k != "word"]):
        out = F.when(token.rlike(f"^(?:{TOKEN_KINDS[name]})$"), name).otherwise(out)
    return F.when(token.rlike(r"^\p{L}+$"), "word").otherwise(out)  # most tokens


def typed_tokens(text: Column) -> Column:
    """``whole_tokens`` with their kinds: array of struct(pos, kind, token).

    Links, addresses, hosts, paths and compounds stay whole, and the words they are made of stand at the same position as kind part;
    numbers keep their sign and fraction.
    """

    def named(token: Column, i: Column) -> Column:
        return F.struct(i.alias("pos"), token_kind(token).alias("kind"), token.alias("token"))

    def entries(e: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(e["token"], F.lit(f"({_TOKEN})"), F.lit(1)), lambda w: F.struct(e["pos"].alias("pos"), F.lit("part").alias("kind"), w.alias("token")))
        return F.when(e["kind"].isin("number", "version", "word"), F.array(e)).otherwise(F.concat(F.array(e), parts))

    return F.flatten(F.transform(F.transform(whole_tokens(text), named), entries))


def kinds_counted(text: DataFrame, parts: bool = False) -> DataFrame:
    """kind, n, different and least of the ``typed_tokens`` of the one column, of every row; the words inside them are counted with ``parts``."""
    each = text.select(F.explode(typed_tokens(F.col(text.columns[0]))).alias("x")).select("x.token", "x.kind")
    if not parts:
        each = each.where("kind <> 'part'")
    each = each.groupBy("token", "kind").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different"), F.min("token").alias("least"))


def _stemmer() -> Callable[[str], str | None]:
    """Stems from a table of bounded size; null for a stop word."""
    known: dict[str, str | None] = {w: None for w in STOP_WORDS}

    def one(word: str) -> str | None:
        if word not in known:
            if len(known) > 500_000:
                known.clear()
                known.update({w: None for w in STOP_WORDS})
            known[word] = stem(word)
        return known[word]

    return one


@F.pandas_udf(T.ArrayType(T.StringType()))
def english_lexemes(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems by position; null where a stop word stands."""
    one = _stemmer()
    for column in columns:
        yield column.map(lambda words: [one(w) for w in words])


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable: a filter is pushed below the projection that made it, and would make it anew
    wherever it is named, for every place of a phrase's first word too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _at(lexemes: Column, words: tuple[str, ...]) -> Column:
    """Positions (from 0) where the words stand one after the other."""
    here = F.filter(F.transform(lexemes, lambda x, i: F.when(x == words[0], i)), lambda p: p.isNotNull())
    for n, w in enumerate(words[1:], 1):
        here = _followed(here, lexemes, n, w)
    return here


def _followed(here: Column, lexemes: Column, n: int, word: str) -> Column:
    return F.filter(here, lambda p: F.coalesce(F.get(lexemes, p + n) == word, F.lit(False)))


def matches(lexemes: Column, query: Query) -> Column:
    def met(held: Column) -> Column:
        return satisfied(query, lambda words: F.coalesce(F.array_contains(held, words[0]), F.lit(False)) if len(words) == 1 else F.size(_at(held, words)) > 0)

    return _bound(lexemes, met)


def satisfied(query: Query, hit: Callable[[tuple[str, ...]], Column]) -> Column:
    """Whether a row meets the query, given what tells whether words stand in it one after the other."""
    out = F.lit(False)
    for group in query.groups:
        every = F.lit(True)
        for t in group:
            every = every & (~hit(t.words) if t.negated else hit(t.words))
        out = out | every
    return out


def cover_density(lexemes: Column, query: Query) -> Column:
    return _bound(lexemes, lambda held: density(query, lambda words: _at(held, words)))


def density(query: Query, at: Callable[[tuple[str, ...]], Column]) -> Column:
    """Sum over groups and their minimal covers of 0.1 / (1 + words inside a cover that are not needed), from the places of terms.

    A cover is a shortest stretch that holds every positive term of a group; each starts at another place.
    """
    total = F.lit(0.0)
    for group in query.groups:
        wanted = [t for t in group if not t.negated]
        if not wanted:
            continue
        places = F.concat(*[F.transform(at(t.words), _tagged(n, len(t.words))) for n, t in enumerate(wanted)])
        size = len(wanted)
        blank = F.struct(
            F.array_repeat(F.lit(-1), size).alias("last"), F.lit(-1).alias("start"), F.lit(0.0).alias("sum"),
        )
        total = total + F.aggregate(F.array_sort(places), blank, _cover(size, sum(len(t.words) for t in wanted)), lambda acc: acc["sum"])
    return total


def _tagged(n: int, width: int):
    return lambda p: F.struct(p.alias("p"), F.lit(n).alias("t"), F.lit(width).alias("w"))


def _cover(size: int, needed: int):
    def step(acc, x):
        last = F.transform(acc["last"], lambda v, i: F.when(i == x["t"], x["p"]).otherwise(v))
        start = F.array_min(last)
        noise = F.greatest(x["p"] + x["w"] - start - F.lit(needed), F.lit(0))
        new = start > acc["start"]
        return F.struct(
            last.alias("last"),
            F.when(new, start).otherwise(acc["start"]).alias("start"),
            (acc["sum"] + F.when(new, F.lit(0.1) / (F.lit(1) + noise)).otherwise(F.lit(0.0))).alias("sum"),
        )

    return step


def _may_stem(word: Column, stems: list[str]) -> Column:
    """False only for words that stem to none of these: the rules change endings, and leave the first two letters unless they are listed by word."""
    listed = [w for w, s in _WHOLE.items() if s in stems]
    out = word.isin(listed) if listed else F.lit(False)
    for head in sorted({s[:2] for s in stems}):
        out = out | word.startswith(head)
    return out


def with_query_stems(rows: DataFrame, query: Query) -> DataFrame:
    """Rows with ``english_lexemes`` from ``lexemes`` as far as ``query`` (of stems) asks: null wherever another stem stands.

    Python gets the different words of a row that may have one of the stems, not its text.
    """
    stems = sorted({w for g in query.groups for t in g for w in t.words})

    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def asked(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one, wanted = _stemmer(), frozenset(stems)
        for column in columns:
            yield column.map(lambda words: {w: made for w in words if (made := one(w)) in wanted})

    rows = rows.withColumn("_asked", asked(F.array_distinct(F.filter("lexemes", lambda w: _may_stem(w, stems)))))
    return rows.withColumn("english_lexemes", F.transform("lexemes", lambda w: F.col("_asked")[w])).drop("_asked")


def with_lexemes(rows: DataFrame) -> DataFrame:
    """Rows with ``lexemes`` and ``english_lexemes`` from ``content``: store them once and searches need not make them."""
    return rows.withColumn("lexemes", tokens(F.col("content"))).withColumn("english_lexemes", english_lexemes("lexemes"))


def ranked(rows: DataFrame, query: Query, with_english: bool = True) -> DataFrame:
    """The matching rows with ``text_rank``: cover density of the simple leg plus that of the English leg."""
    if "lexemes" not in rows.columns:
        rows = rows.withColumn("lexemes", tokens(F.col("content")))
    legs = [("lexemes", query)]
    if with_english and english(query).groups:
        if "english_lexemes" not in rows.columns:
            rows = with_query_stems(rows, english(query))
        legs.append(("english_lexemes", english(query)))
    hit, rank = F.lit(False), F.lit(0.0)
    for column, q in legs:
        found = matches(F.col(column), q)
        hit = hit | found
        rank = rank + F.when(found, cover_density(F.col(column), q)).otherwise(F.lit(0.0))
    return rows.where(hit).withColumn("text_rank", rank)
