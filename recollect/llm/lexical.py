"""Ranked lexical search over a bit-sliced impact index.

The impact of a term on a document is a whole number, and a document's score the sum of the impacts of a query's terms.
Documents lie in blocks, by ascending id. For every term the index holds one bitmap over the block for each bit of the
impacts: bit d of bitmap b is bit b of the term's impact on document d. A query's terms are added bitmap by bitmap with
carries, for all documents of a block at once. The k best come from going down the bitmaps of the sum: documents with the
slice's bit come before those without, as long as no more than k are certain; those still level at the end have one score
and are taken in order of id.

Terms that few documents of a block hold are stored as places and impacts and laid out as bitmaps when a query asks for them.

Three passes over the documents or the index: counts (documents, terms, and the documents that hold each term, summed by
Spark), the blocks (made where the documents lie, without a shuffle, and written), the search (a task keeps k rows for each
query; those are ranked first within SALTS groups of tasks, then for each query).

The index covers the terms the items ask for. Items are dealt by hash and gathered into groups whose texts stay
under ``group_bytes``; a group's items are what each task is given. Items of one hash beyond eight times that raise an error.

Null texts hold no term. Rows of one item id are one item, with the terms of all; items without id are one item too.
Every document row ranks on its own, also one whose id is repeated; rows without id come last among equal scores. A term
that occurs very often in a very long text has an impact under a million times its weight. An empty table gives
an empty result. Only ids and texts are read, so further columns cannot clash.
"""

from __future__ import annotations

import math
import struct
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_AZ, arrow_schema, materialise, named, scratch


@dataclass(frozen=True)
class Params:
    k: int = 50
    block: int = 8192  # documents
    block_postings: int = 500_000  # a block also ends here
    sparse: int = 3  # terms in fewer documents of a block than one in so many are stored as places: there that is shorter
    group_bytes: int = 8_000_000
    cache_bytes: int = 64_000_000  # of bitmaps that a task keeps between items
    salts: int = 64


#: Bytes that end terms become blanks, capitals small letters; bytes from 128 on stay.
_TERM_BYTES = frozenset((*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)))
_FOLD = bytes(LOWER_AZ[b] if b in _TERM_BYTES else 32 for b in range(256))

#: Weights of the formula, shared with the SQL.
SCALE, STEEP, FLAT, SLOPE = 1_000_000_000, 1000, 20, 50


def terms(text: str | None) -> list[bytes]:
    """Runs of letters, digits and code points beyond ASCII, A-Z made small, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int, w: int) -> np.ndarray:
    """The whole-number impacts of a term of weight ``w``, by its occurrences and the documents' lengths."""
    m = 100 - SLOPE + np.array([SLOPE * int(x) * n_docs // n_terms for x in length.tolist()], np.int64)
    return w * ((SCALE * tf.astype(np.int64)) // (STEEP * tf.astype(np.int64) + FLAT * m))


# counting ------------------------------------------------------------------------------

_COUNTS = "term int, n long"  # term -1: documents with a term; -2: terms; else documents that hold the term


def _counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    out = arrow_schema(docs.sparkSession, _COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for b in batches:
            for text in b.column(1).to_pylist():
                words = terms(text)
                if words:
                    found[-1] += 1
                    found[-2] += len(words)
                    found.update(vocabulary[w] for w in set(words) & vocabulary.keys())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip((found.keys(), found.values()), out)], schema=out)

    return docs.mapInArrow(run, _COUNTS).groupBy("term").agg(F.sum("n").alias("n"))


# the index -----------------------------------------------------------------------------

INDEX = "ids binary, known binary, terms binary, starts binary, slices binary"


def to_slices(places: np.ndarray, values: np.ndarray, n: int) -> bytes:
    """Bitmaps over ``n`` documents, the lowest bit first: their number (one byte), then the bitmaps."""
    bits = max(1, int(values.max()).bit_length())
    flags = np.zeros((bits, n), bool)
    flags[:, places] = (values[None, :] >> np.arange(bits)[:, None]) & 1
    return bytes([bits]) + np.packbits(flags, axis=1, bitorder="little").tobytes()


def to_places(places: np.ndarray, values: np.ndarray) -> bytes:
    """A zero byte, the bytes of an impact, the number of places, the places, their impacts."""
    kind = "<u4" if int(values.max()) < 2**32 else "<u8"
    return bytes([0, int(kind[2])]) + struct.pack("<I", len(places)) + places.astype("<u4").tobytes() + values.astype(kind).tobytes()


def from_slices(raw: bytes, n: int) -> list[int]:
    """One integer to a bitmap, the lowest bit first."""
    if not raw[0]:
        (count,) = struct.unpack_from("<I", raw, 2)
        places = np.frombuffer(raw, "<u4", count, 6).astype(np.int64)
        raw = to_slices(places, np.frombuffer(raw, f"<u{raw[1]}", count, 6 + 4 * count).astype(np.int64), n)
    width = -(-n // 8)
    return [int.from_bytes(raw[1 + b * width : 1 + (b + 1) * width], "little") for b in range(raw[0])]


def _block(held: list[tuple], n_docs: int, n_terms: int, weights: dict[int, int], p: Params) -> tuple:
    """A row of the index. ``held``: (id, length, {term: occurrences}) of each document."""
    held.sort(key=lambda x: (x[0] is None, x[0] or 0))
    n = len(held)
    lengths = np.array([x[1] for x in held], np.int64)
    found: dict[int, tuple[list[int], list[int]]] = {}
    for place, (_, _, tf) in enumerate(held):
        for t, c in tf.items():
            at, times = found.setdefault(t, ([], []))
            at.append(place)
            times.append(c)
    names, starts, parts, total = [], [0], [], 0
    for t in sorted(found):
        if weights[t] <= 0:
            continue  # adds nothing to any score
        places = np.array(found[t][0], np.int64)
        values = impacts(np.array(found[t][1], np.int64), lengths[places], n_docs, n_terms, weights[t])
        part = to_places(places, values) if len(places) * p.sparse < n else to_slices(places, values, n)
        names.append(t)
        parts.append(part)
        total += len(part)
        starts.append(total)
    ids = np.array([x[0] or 0 for x in held], np.int64)
    known = np.packbits(np.array([x[0] is not None for x in held], bool), bitorder="little")
    return ids.tobytes(), known.tobytes(), np.array(names, np.int32).tobytes(), np.array(starts, np.int64).tobytes(), b"".join(parts)


def index(docs: DataFrame, vocabulary: dict[bytes, int], totals: dict[int, int], p: Params) -> DataFrame:
    """INDEX rows of all documents that hold a term of the vocabulary. ``totals``: what ``_counts`` found."""
    out = arrow_schema(docs.sparkSession, INDEX)
    n_docs, n_terms = totals.get(-1, 0), totals.get(-2, 0)
    weights = {t: weight(n_docs, df) for t, df in totals.items() if t >= 0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        postings = 0

        def made() -> pa.RecordBatch:
            row = _block(held, n_docs, n_terms, weights, p)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, out)], schema=out)

        for b in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                words = terms(text)
                tf = Counter(map(vocabulary.__getitem__, filter(vocabulary.__contains__, words)))
                if tf:
                    held.append((doc_id, len(words), tf))
                    postings += len(tf)
                if len(held) >= p.block or postings >= p.block_postings:
                    yield made()
                    held, postings = [], 0
        if held:
            yield made()

    return docs.mapInArrow(run, INDEX)


# the search ----------------------------------------------------------------------------


def add(total: list[int], other: list[int]) -> list[int]:
    """The sum of two numbers for every document at once: full adders over bitmaps."""
    out, carry = [], 0
    for b in range(max(len(total), len(other))):
        x = total[b] if b < len(total) else 0
        y = other[b] if b < len(other) else 0
        half = x ^ y
        out.append(half ^ carry)
        carry = (x & y) | (half & carry)
    if carry:
        out.append(carry)
    return out


def top(total: list[int], k: int) -> int:
    """A bitmap of the k documents with the greatest sums above 0, of equal ones the first; all that are above 0, if fewer."""
    level = reduce(int.__or__, total, 0)
    if level.bit_count() <= k:
        return level
    certain = 0
    for s in reversed(total):
        tried = certain | (level & s)
        n = tried.bit_count()
        if n > k:
            level &= s
        else:
            certain = tried
            level &= ~s
            if n == k:
                return certain
    for _ in range(k - certain.bit_count()):  # what is level has one sum
        lowest = level & -level
        certain |= lowest
        level ^= lowest
    return certain


def read_out(total: list[int], chosen: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and sums of the chosen documents."""
    width = -(-n // 8)
    bits = lambda x: np.unpackbits(np.frombuffer(x.to_bytes(width, "little"), np.uint8), bitorder="little")
    places = np.flatnonzero(bits(chosen))
    sums = np.zeros(len(places), np.int64)
    for b, s in enumerate(total):
        sums += bits(s)[places].astype(np.int64) << b
    return places, sums


class _Block:
    """An index row with the bitmaps of terms asked for lately."""

    def __init__(self, row: dict, limit: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.n, self.limit = len(self.ids), limit
        self.known = np.unpackbits(np.frombuffer(row["known"], np.uint8), count=self.n, bitorder="little").astype(bool)
        starts = np.frombuffer(row["starts"], np.int64).tolist()
        self.where = {t: (starts[i], starts[i + 1]) for i, t in enumerate(np.frombuffer(row["terms"], np.int32).tolist())}
        self.raw, self.kept, self.size = row["slices"], OrderedDict(), 0

    def slices(self, term: int) -> list[int]:
        if term in self.kept:
            self.kept.move_to_end(term)
            return self.kept[term]
        a, b = self.where[term]
        got = self.kept[term] = from_slices(self.raw[a:b], self.n)
        self.size += len(got) * self.n // 8
        while self.size > self.limit and len(self.kept) > 1:
            self.size -= len(self.kept.popitem(last=False)[1]) * self.n // 8
        return got

    def best(self, wanted: list[int], k: int) -> list[tuple[int, int | None]]:
        """(score, id) of the k best documents of the block."""
        here = [t for t in wanted if t in self.where]
        if not here:
            return []
        total = reduce(add, (self.slices(t) for t in here), [])
        places, sums = read_out(total, top(total, k), self.n)
        return [(s, i if known else None) for s, i, known in zip(sums.tolist(), self.ids[places].tolist(), self.known[places].tolist())]


FOUND = "item int, task int, doc_id long, score long"


def _order(x: tuple[int, int | None]) -> tuple:
    return -x[0], x[1] is None, x[1] or 0


def search(blocks: DataFrame, items: list[list[int]], p: Params) -> DataFrame:
    """FOUND rows: for every item (a list of terms) at most k of every task, the best k of each query among them."""
    out = arrow_schema(blocks.sparkSession, FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items]
        for b in batches:
            for r in range(b.num_rows):
                block = _Block({n: b.column(i)[r].as_py() for i, n in enumerate(b.schema.names)}, p.cache_bytes)
                for i, wanted in enumerate(items):
                    if got := block.best(wanted, p.k):
                        best[i] = sorted(best[i] + got, key=_order)[: p.k]
        task = TaskContext.get().partitionId()
        rows = [(i, task, doc_id, score) for i, found in enumerate(best) for score, doc_id in found]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 10_000]), out)], schema=out)

    return blocks.mapInArrow(run, FOUND)


def _groups(items: DataFrame, p: Params) -> Iterator[list[tuple]]:
    """(item id, terms) of each group of items. What a task is given is bounded by the group's size, which is known before its items are read."""
    size = F.octet_length("text") + 16
    total = items.agg(F.sum(size)).first()[0] or 0
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(8 * max(1, -(-total // p.group_bytes)))))
    groups: list[list[int]] = []
    held = 0
    for r in dealt.groupBy("part").agg(F.sum(size).alias("size")).orderBy("part").collect():  # eight numbers a group
        if r["size"] > 8 * p.group_bytes:
            raise ValueError(f"an item's terms take {r['size']} bytes; the bound is {8 * p.group_bytes}")
        if not groups or held + r["size"] > p.group_bytes:
            groups.append([])
            held = 0
        groups[-1].append(r.part)
        held += r["size"]
    for parts in groups:
        found: dict = {}
        for r in dealt.where(F.col("part").isin(parts)).collect():
            found.setdefault(r.item_id, set()).update(terms(r.text))
        yield list(found.items())


def rank(docs: DataFrame, items: DataFrame, params: Params | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents of each item, by score, then id."""
    p = params or Params()
    spark = docs.sparkSession
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))
    asked = items.select(named(item_col).cast("long").alias("item_id"), F.coalesce(named(item_text).cast("string"), F.lit("")).alias("text")).distinct()
    results = []
    with scratch(spark) as keep:
        for group in _groups(asked, p):
            vocabulary = {t: n for n, t in enumerate(sorted(set().union(*(x for _, x in group))))}
            totals = {r.term: r.n for r in _counts(rows, vocabulary).collect()}  # the group's terms and two more
            blocks = materialise(index(rows, vocabulary, totals, p), "bit-slices")
            wanted = [sorted(vocabulary[t] for t in x) for _, x in group]
            found = keep(search(blocks, wanted, p), "found")
            names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(group)], "item int, item_id long")
            results.append(found.join(F.broadcast(names), "item").drop("item"))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    every = reduce(DataFrame.unionByName, results).withColumn("salt", F.pmod("task", F.lit(p.salts)))
    some = every.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= p.k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= p.k)
    return ranked.select("item_id", "rank", "doc_id", "score")
