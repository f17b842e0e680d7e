"""An inverted positional index: searches read the postings of their words and no content.

Documents are numbered, and a chunk is CHUNK numbers in a row. A posting block holds one word in one chunk (or a part of it): the
documents that have it (numbers within the chunk), the word's positions in all of them as one list with the ends of each document's, and the most often it stands in any. Blocks lie in folders by a hash of the word,
sorted by word, so a search reads a few folders and in them the row groups of its words. Numbers and positions are ascending integers, which
Parquet's delta encoding packs.

A search goes by chunks, on the blocks' short columns first: a chunk where no group of the query has all of its words goes. Then the
chunks with the greatest bounds are ranked exactly; whatever cannot reach the k-th best score found there (0.1 for each time a wanted word can stand in one document) is
not read. The others are ranked likewise, and both give the result, which equals that of a scan.

Two legs: plain words, and English stems (made once, when the index is built). A query that only excludes words has no postings to go
by and is left to the scan: ``search`` raises.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fts
from ..plans.storage import materialise, scratch
from .search import Scope

CHUNK = 4096
BUCKETS = 64
#: Of contents whose words of one folder are sorted together; a task may be dealt a few such shares.
STRETCH_BYTES = 8_000_000
#: Chunks ranked first, to find a score that others must reach.
FIRST = 16

_DELTA = {"parquet.writer.version": "v2", "compression": "zstd"}


def bucket(word: Column) -> Column:
    return (F.crc32(word.cast("binary")) % BUCKETS).cast("int")


_BLOCK = "leg tinyint, word string, chunk long, n int, most int, docs array<int>, ends array<int>, places array<int>"


def _blocks(lexed: DataFrame) -> DataFrame:
    """Posting blocks of the rows of each Arrow batch: doc, then a list of lexemes for each leg. A chunk that several batches hold has a block for each."""
    schema = pa.schema([("leg", pa.int8()), ("word", pa.string()), ("chunk", pa.int64()), ("n", pa.int32()), ("most", pa.int32()), ("docs", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("places", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            chunks = whole.column(0).to_numpy() // CHUNK
            cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
            for batch in (whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a):
                yield from blocks_of(batch)

    def blocks_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Of documents of one chunk."""
        numbers = batch.column(0).to_pylist()
        chunk = numbers[0] // CHUNK
        for leg in range(batch.num_columns - 1):
            held: dict[str, dict[int, list[int]]] = {}
            for doc, words in zip(numbers, batch.column(leg + 1)):
                for at, word in enumerate(words.as_py() or ()):
                    if word is not None:
                        held.setdefault(word, {}).setdefault(doc - chunk * CHUNK, []).append(at)
            keys = list(held)
            for first in range(0, len(keys), 4096):
                some = keys[first : first + 4096]
                lists = [held[k] for k in some]
                ends = [list(accumulate(map(len, x.values()))) for x in lists]
                places = [list(chain.from_iterable(x.values())) for x in lists]
                columns = [[leg] * len(some), some, [chunk] * len(some), [len(x) for x in lists], [max(map(len, x.values())) for x in lists], [list(x) for x in lists], ends, places]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return lexed.mapInArrow(run, _BLOCK)


class TextIndex:
    """An index in a folder: ``documents`` (number, id and the columns a scope asks for) and ``postings``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def build(rows: DataFrame, path: str, english: bool = True) -> TextIndex:
        """Index ``content`` of memories; a null content has no word."""
        spark = rows.sparkSession
        wanted = [c for c in ("id", "created_at", "archived", "type", "project", "created_by", "topics", "metadata") if c in rows.columns]
        # numbered where they lie: the rows of a task follow each other, and nothing is shuffled for it
        rows.select(*wanted, "content").withColumn("doc", F.monotonically_increasing_id()).write.options(**_DELTA).parquet(f"{path}/numbered")
        stored = spark.read.parquet(f"{path}/numbered")
        lexed = stored.select("doc", fts.tokens(F.col("content")).alias("words"))
        if english:
            lexed = lexed.withColumn("stems", fts.english_lexemes("words"))
        blocks = _blocks(lexed).withColumn("bucket", bucket(F.col("word")))
        # a folder's blocks go by stretches of chunks, so a word of every document is not one task's, and what a task sorts does not grow with the input
        octets = stored.agg(F.sum(F.octet_length("content"))).first()[0] or 0
        stretches = max(1, -(-octets // (BUCKETS * STRETCH_BYTES)))
        stretch = F.pmod(F.xxhash64(F.floor(F.col("chunk") / 16)), F.lit(stretches))
        ordered = blocks.repartition(BUCKETS * stretches, "bucket", stretch).sortWithinPartitions("bucket", "word", "leg", "chunk")
        ordered.write.partitionBy("bucket").options(**_DELTA).parquet(f"{path}/postings")
        return TextIndex(spark, path)

    def documents(self) -> DataFrame:
        """Everything but the content."""
        return self.spark.read.parquet(f"{self.path}/numbered").drop("content")

    def postings(self, words: list[str]) -> DataFrame:
        """The blocks of some words: a filter on the folders and one that reaches the row groups."""
        read = self.spark.read.schema(_BLOCK + ", bucket int").parquet(f"{self.path}/postings")
        folders = sorted({zlib.crc32(w.encode()) % BUCKETS for w in words})
        return read.where(F.col("bucket").isin(folders) & F.col("word").isin(words))

    # ranking -----------------------------------------------------------------------------

    def _legs(self, query: fts.Query, english: bool) -> list[tuple[int, fts.Query]]:
        legs = [(0, query)] + ([(1, fts.english(query))] if english else [])
        legs = [(leg, q) for leg, q in legs if q.groups]
        if any(all(t.negated for t in g) for _, q in legs for g in q.groups):
            raise ValueError("a group of excluded words only needs a scan")
        return legs

    def _chunks(self, legs: list[tuple[int, fts.Query]]) -> DataFrame:
        """chunk and bound: what a document there can score at most; chunks that lack a word of every group are left out."""
        wanted = sorted({(leg, w) for leg, q in legs for g in q.groups for t in g if not t.negated for w in t.words})
        heads = self.postings(sorted({w for _, w in wanted})).select("leg", "word", "chunk", "most")
        most = lambda leg, w: F.max(F.when((F.col("leg") == leg) & (F.col("word") == w), F.col("most")))
        table = heads.groupBy("chunk").agg(*[most(leg, w).alias(f"m{n}") for n, (leg, w) in enumerate(wanted)])
        total, any_ = F.lit(0), F.lit(False)
        for leg, q in legs:
            for g in q.groups:
                places = [F.col(f"m{wanted.index((leg, w))}") for t in g if not t.negated for w in t.words]
                every, sum_ = F.lit(True), F.lit(0)
                for p in places:
                    every, sum_ = every & p.isNotNull(), sum_ + p
                any_ = any_ | every
                total = total + F.when(every, sum_).otherwise(F.lit(0))
        return table.where(any_).select("chunk", (total * 0.1).alias("bound"))

    def _ranked(self, legs: list[tuple[int, fts.Query]], chunks: DataFrame) -> DataFrame:
        """doc and text_rank of the documents of some chunks that match."""
        named = sorted({(leg, w) for leg, q in legs for g in q.groups for t in g for w in t.words})
        blocks = self.postings(sorted({w for _, w in named})).join(chunks.select("chunk"), "chunk", "left_semi")
        # a document's positions lie between the end before its own and its own
        def entry(end: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get("ends", i - 1)).otherwise(0)
            return F.struct((F.col("chunk") * CHUNK + F.get("docs", i)).alias("docs"), F.slice("places", before + 1, end - before).alias("places"))

        each = blocks.select("leg", "word", F.explode(F.transform("ends", entry)).alias("x")).select("leg", "word", "x.docs", "x.places")
        mine = lambda leg, w: F.max(F.when((F.col("leg") == leg) & (F.col("word") == w), F.col("places")))
        by_doc = each.groupBy(F.col("docs").alias("doc")).agg(*[F.coalesce(mine(leg, w), F.array().cast("array<int>")).alias(f"p{n}") for n, (leg, w) in enumerate(named)])
        hit, rank = F.lit(False), F.lit(0.0)
        for leg, q in legs:
            at = _places(leg, named)
            found = fts.satisfied(q, lambda words, at=at: F.size(at(words)) > 0)
            hit = hit | found
            rank = rank + F.when(found, fts.density(q, at)).otherwise(F.lit(0.0))
        return by_doc.where(hit).select("doc", rank.alias("text_rank"))

    def search(self, query: str, k: int = 50, scope: Scope | None = None, english: bool = True) -> DataFrame:
        """id, text_rank and created_at of the k best matches, by rank and id, as ``search.textual`` gives them."""
        legs = self._legs(fts.parse(query), english)
        visible = self.documents().where((scope or Scope()).condition())
        columns = ("id", "text_rank", "created_at")
        if not legs:
            return visible.select("id", F.lit(0.0).alias("text_rank"), "created_at").limit(0)
        order = (F.col("text_rank").desc(), F.col("id"))
        best = lambda hits: hits.join(visible, "doc").select(*columns).orderBy(*order).limit(k)
        with scratch(self.spark) as keep:
            chunks = materialise(self._chunks(legs), "chunks")
            some = materialise(chunks.orderBy(F.col("bound").desc(), "chunk").limit(FIRST), "first-chunks")
            first = keep(best(self._ranked(legs, some)), "first-hits")
            found = first.agg(F.count(F.lit(1)).alias("n"), F.min("text_rank").alias("least")).first()
            rest = chunks.join(F.broadcast(some.select("chunk")), "chunk", "left_anti")
            if found.n == k:
                rest = rest.where(F.col("bound") >= found.least - 1e-9)
            if rest.isEmpty():
                return first.orderBy(*order)
            return keep(first.unionByName(best(self._ranked(legs, rest))).orderBy(*order).limit(k), "hits").orderBy(*order)


def _places(leg: int, named: list[tuple[int, str]]):
    """Where words stand one after the other, from the columns of their positions."""

    def at(words: tuple[str, ...]) -> Column:
        column = lambda w: F.col(f"p{named.index((leg, w))}")
        here = column(words[0])
        for n, w in enumerate(words[1:], 1):
            here = F.filter(here, _after(column(w), n))
        return here

    return at


def _after(places: Column, n: int):
    return lambda p: F.array_contains(places, p + n)
