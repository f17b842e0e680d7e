"""Secret scans by grammar inference.

Base rules (a keyword with an assigned value, access key ids, long hexadecimal runs) label credentials in the
corpus itself. For every label the prefix tree of a bounded sample of distinct values is folded into a
probabilistic automaton, in two passes of the ALERGIA test (symbol and end frequencies within a Hoeffding bound, here
and in all states reached by the same symbols): first states of one depth, which pools the evidence of a tree whose
leaves are all different, then states of any depth, which makes loops where a format has no fixed length.
A text's tokens are scored by log10 of their likelihood under each format's automaton over their likelihood in
ordinary text; what passes ODDS is reported as like_<label>. Ordinary text is a chain of character pairs, counted over
all rows outside base spans. Base spans are always reported.

Every token of LEAST symbols or more is scored (the base rules' own least length), however long it is and of whatever
symbols; an automaton's end frequencies say how much a length counts. Past what a format has shown, symbols cost
as the format's symbols do at large, after one price for leaving it.

The sample takes, per label, the PER_BUCKET smallest hashes in each of BUCKETS hash buckets, among values of
at most LONGEST symbols: at most BUCKETS * PER_BUCKET * LONGEST symbols reach the driver per label, whatever the size of
the input; the pair counts are a table of fixed size. A label without values has no automaton. Null texts count
as empty; whole texts are scanned; repeated rows are scanned each on their own; an empty table gives an empty
result; only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, map_texts

#: The base patterns of the contract, in its order.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters and more
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
#: Symbols of candidates; a value is an unbroken run of them.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
LEAST = 6
_EDGE = ".=-_"
CANDIDATE = re.compile(rf"[{re.escape(SYMBOLS)}]{{{LEAST},}}")

BUCKETS, PER_BUCKET, LONGEST = 32, 16, 1024
ODDS = 5.0  # log10 of how much likelier a format must be than ordinary text
MEMO_LIMIT = 300_000

#: The number of a symbol, 0 for all other bytes, which end a token.
_CODE = np.zeros(256, np.int64)
_CODE[[ord(c) for c in SYMBOLS]] = np.arange(1, len(SYMBOLS) + 1)
_SIDE = len(SYMBOLS) + 1


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """start, kind, end and the secret itself, by start and kind."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, spans: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Tokens that no base span touches, without punctuation at their ends."""
    ends = sorted((a, b) for a, _, b, _ in spans)
    at = 0
    for m in CANDIDATE.finditer(text):
        token = m[0].strip(_EDGE)
        if len(token) < LEAST:
            continue
        start = m.start() + m[0].index(token)
        end = start + len(token)
        while at < len(ends) and ends[at][1] <= start:
            at += 1
        if not any(a < end and start < b for a, b in ends[at : at + len(BASE)]):
            yield start, end, token


def pair_counts(texts: Iterable[str]) -> np.ndarray:
    """How often each symbol follows each in texts, the start and end of a token being 0."""
    codes = _CODE[np.frombuffer("\n".join(["", *texts, ""]).encode("utf-8", "surrogatepass"), np.uint8)]
    return np.bincount(codes[:-1] * _SIDE + codes[1:], minlength=_SIDE * _SIDE)


class Ordinary:
    """A chain of character pairs: log10 likelihood of a token, its end included."""

    def __init__(self, counts: np.ndarray):
        table = counts.reshape(_SIDE, _SIDE).astype(float)
        table[0, 0] = 0  # what lies between tokens
        alone = (table.sum(axis=0) + 0.5) / (table.sum() + 0.5 * _SIDE)
        log = np.log10((table + 20 * alone) / (table.sum(axis=1, keepdims=True) + 20))
        names = ["", *SYMBOLS]
        self.log = {a: dict(zip(names, log[n].tolist())) for n, a in enumerate(names)}

    def score(self, token: str) -> float:
        total, row = 0.0, self.log[""]
        for c in token:
            total += row[c]
            row = self.log[c]
        return total + row[""]


class Automaton:
    """Symbol and end frequencies by state; built as a prefix tree, then folded."""

    def __init__(self, values: Iterable[str], alpha: float = 0.05, leave: float = 1.0):
        self.edge: list[dict[str, int]] = [{}]
        self.times: list[dict[str, int]] = [{}]
        self.end = [0]
        self._gone: dict[int, int] = {}
        for v in sorted(values):
            self._grow(v)
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._fold_depths(bound)
        self._fold_all(bound)
        self._weigh(leave)

    def _grow(self, value: str) -> None:
        at = 0
        for c in value:
            self.times[at][c] = self.times[at].get(c, 0) + 1
            if c not in self.edge[at]:
                self.edge[at][c] = len(self.edge)
                self.edge.append({})
                self.times.append({})
                self.end.append(0)
            at = self.edge[at][c]
        self.end[at] += 1

    def _total(self, state: int) -> int:
        return self.end[state] + sum(self.times[state].values())

    def _agree(self, a: int, b: int, bound: float) -> bool:
        """Hoeffding tests of the end and of every symbol, here and in all states reached by the same symbols."""
        todo, seen = [(a, b)], set()
        while todo:
            pair = todo.pop()
            if pair in seen:
                continue
            seen.add(pair)
            x, y = pair
            nx, ny = self._total(x), self._total(y)
            if not nx or not ny:
                continue
            limit = bound * (nx**-0.5 + ny**-0.5)
            if abs(self.end[x] / nx - self.end[y] / ny) > limit:
                return False
            for c in self.times[x].keys() | self.times[y].keys():
                if abs(self.times[x].get(c, 0) / nx - self.times[y].get(c, 0) / ny) > limit:
                    return False
            todo += [(self.edge[x][c], self.edge[y][c]) for c in self.edge[x].keys() & self.edge[y].keys()]
        return True

    def _fold(self, into: int, state: int) -> None:
        """Add the tree under ``state`` to ``into``."""
        todo = [(into, state)]
        while todo:
            x, y = todo.pop()
            self.end[x] += self.end[y]
            for c, n in self.times[y].items():
                self.times[x][c] = self.times[x].get(c, 0) + n
                if c in self.edge[x]:
                    todo.append((self.edge[x][c], self.edge[y][c]))
                else:
                    self.edge[x][c] = self.edge[y][c]

    def _fold_depths(self, bound: float) -> None:
        """Fold states of one depth, the most frequent first, into the first that agrees."""
        level = [0]
        while level:
            below = []
            for s in level:
                below += [t for t in self.edge[s].values() if t not in below[-1:]]
            kept, into = [], {}
            for t in sorted(set(below), key=lambda t: (-self._total(t), t)):
                for k in kept:
                    if self._agree(k, t, bound):
                        into[t] = k
                        self._fold(k, t)
                        break
                else:
                    kept.append(t)
            for s in level:
                self.edge[s] = {c: into.get(t, t) for c, t in self.edge[s].items()}
            level = kept

    def _fold_all(self, bound: float) -> None:
        """Fold states of any depth into settled ones, as far as they agree; the fringe is taken by frequency."""
        settled, is_settled = [0], {0}
        while True:
            fringe = {self.edge[s][c] for s in settled for c in self.edge[s]} - is_settled
            if not fringe:
                break
            state = min(fringe, key=lambda t: (-self._total(t), t))
            for s in settled:
                if self._agree(s, state, bound):
                    self._join(s, state)
                    break
            else:
                settled.append(state)
                is_settled.add(state)
            settled = list(dict.fromkeys(self._now(s) for s in settled))
            is_settled = set(settled)
            for s in settled:
                self.edge[s] = {c: self._now(t) for c, t in self.edge[s].items()}
        number = {s: n for n, s in enumerate(settled)}
        self.edge = [{c: number[self._now(t)] for c, t in self.edge[s].items()} for s in settled]
        self.times = [self.times[s] for s in settled]
        self.end = [self.end[s] for s in settled]

    def _now(self, state: int) -> int:
        """What a state has been joined into."""
        while state in self._gone:
            state = self._gone[state]
        return state

    def _join(self, into: int, state: int) -> None:
        """One state of two, and of every two that one symbol then leads to: the automaton stays deterministic."""
        todo = [(into, state)]
        while todo:
            x, y = map(self._now, todo.pop())
            if x == y:
                continue
            self._gone[y] = x
            self.end[x] += self.end[y]
            for c, n in self.times[y].items():
                self.times[x][c] = self.times[x].get(c, 0) + n
            for c, t in self.edge[y].items():
                if c in self.edge[x]:
                    todo.append((self.edge[x][c], t))
                else:
                    self.edge[x][c] = t

    def _weigh(self, leave: float) -> None:
        """log10 weights: of symbols and ends by state, of leaving a state's symbols, and of symbols and ends at large."""
        whole: dict[str, int] = {}
        for t in self.times:
            for c, n in t.items():
                whole[c] = whole.get(c, 0) + n
        ends = sum(self.end) + 0.5
        total = sum(whole.values()) + ends + 0.5 * len(SYMBOLS)
        self.large = {c: math.log10((whole.get(c, 0) + 0.5) / total) for c in SYMBOLS}
        self.large_end = math.log10(ends / total)
        self.weight, self.out, self.stop = [], [], []
        for s in range(len(self.edge)):
            n = self._total(s) + leave
            self.weight.append({c: math.log10(k / n) for c, k in self.times[s].items()})
            self.out.append(math.log10(leave / n))
            self.stop.append(math.log10(self.end[s] / n) if self.end[s] else self.out[-1] + self.large_end)

    def score(self, value: str) -> float:
        """log10 likelihood of a value, its end included."""
        at, total = 0, 0.0
        for n, c in enumerate(value):
            if c not in self.weight[at]:
                large = self.large
                return total + self.out[at] + sum(large[x] for x in value[n:]) + self.large_end
            total += self.weight[at][c]
            at = self.edge[at][c]
        return total + self.stop[at]


class Formats:
    """The automata of the labels and the chain of ordinary text."""

    def __init__(self, samples: dict[str, list[str]], ordinary: np.ndarray, odds: float = ODDS):
        self.ordinary = Ordinary(ordinary)
        self.formats = {k: Automaton(samples[k]) for k in BASE if samples.get(k)}
        self.odds = odds
        self._dull: set[str] = set()

    def any_in(self, text: str) -> bool:
        """Whether any token of a text passes, base spans or not. Runs that hold none are remembered in a set of bounded size."""
        if len(self._dull) >= MEMO_LIMIT:
            self._dull.clear()
        for run in set(CANDIDATE.findall(text)) - self._dull:
            if self.best(run.strip(_EDGE)):
                return True
            if len(run) <= 64:
                self._dull.add(run)
        return False

    def best(self, token: str) -> tuple[str, float] | None:
        """The likeliest format and log10 of its odds against ordinary text, if they pass; none for less than LEAST symbols."""
        if len(token) < LEAST:
            return None
        found = max(((a.score(token), k) for k, a in self.formats.items()), default=None)
        if found and (margin := found[0] - self.ordinary.score(token)) >= self.odds:
            return found[1], margin
        return None


def labelled(docs: DataFrame) -> DataFrame:
    """kind and value of base matches of at most LONGEST symbols; kind null: pair (as text) and how often it stands in ordinary text.

    One row per batch and pair, and one per match.
    """
    ddl = "kind string, value string, n long"
    out = arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(_SIDE * _SIDE, np.int64)
        for batch in batches:
            found, plain = set(), []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text or "")
                at = 0
                for start, k, end, value in spans:
                    plain.append(text[at:start])
                    at = max(at, end)
                    if len(value) <= LONGEST:
                        found.add((BASE[k], value))
                plain.append((text or "")[at:])
            pairs += pair_counts(plain)
            if found:
                kinds, values = zip(*sorted(found))
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(values), pa.array([1] * len(kinds), pa.int64())], schema=out)
        some = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.string()), pa.array(some.astype(str).tolist(), pa.string()), pa.array(pairs[some])], schema=out)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, ddl).groupBy("kind", "value").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, buckets: int = BUCKETS, per_bucket: int = PER_BUCKET) -> Formats:
    seen = labelled(docs)
    hashed = seen.withColumn("h", F.xxhash64("value")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    order = Window.partitionBy("kind", "bucket").orderBy("h", "value")
    sample = hashed.withColumn("r", F.row_number().over(order)).where(F.col("kind").isNull() | (F.col("r") <= per_bucket)).select("kind", "value", "n")
    samples: dict[str, list[str]] = {}
    ordinary = np.zeros(_SIDE * _SIDE, np.int64)
    for r in sample.collect():  # at most buckets * per_bucket a kind, and the pairs of symbols there are
        if r.kind is None:
            ordinary[int(r.value)] = r.n
        else:
            samples.setdefault(r.kind, []).append(r.value)
    return Formats(samples, ordinary)


def scan(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """doc_id, spans (start, end, kind, score) by start and kind; base spans have score 1."""
    formats = formats or learn(docs)

    def make():
        def rows(ids, texts):
            return [ids, [[{"start": s, "end": e, "kind": k, "score": p} for s, _, e, k, p in _found(t, formats)] for t in texts]]

        return rows

    return map_texts(docs, make, "doc_id long, spans array<struct<start:long,end:long,kind:string,score:double>>")


def _found(text: str, formats: Formats) -> list[tuple[int, int, int, str, float]]:
    spans = base_spans(text)
    out = [(s, k, e, BASE[k], 1.0) for s, k, e, _ in spans]
    for start, end, token in candidates(text, spans) if formats.any_in(text) else ():
        if best := formats.best(token):
            kind, margin = best
            out.append((start, len(BASE) + BASE.index(kind), end, f"like_{kind}", 1 - 10 ** -margin))
    return sorted(out)


def secret_rows(docs: DataFrame) -> DataFrame:
    """The digest rows of the query."""
    formats = learn(docs)

    def make():
        def rows(ids, texts):
            counts = {k: [] for k in BASE}
            digests, listed = [], []
            for t in texts:
                found = _found(t, formats)
                names = [(f"{k}:{s}:{e}", k) for s, _, e, k, _ in found]
                for k in BASE:
                    counts[k].append(sum(x == k for _, x in names))
                digests.append(hashlib.sha256(",".join(n for n, x in names if x in BASE).encode()).hexdigest())
                listed.append(",".join(n for n, _ in names))
            return [ids, *counts.values(), digests, listed]

        return rows

    return map_texts(docs, make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
