"""Packing by best-fit decreasing.

A document's tokens are cut into full windows; what is left of it goes, longest first, into the open window
with the least room that still fits. A segment tree over room sizes finds that window in log(window) steps.

Windows are packed in groups dealt by a hash of the row, whose number follows the count of documents and, where token
ids are asked for, the bytes of their texts; the full windows of a long document are dealt one by one. So a task holds a bounded
number of pieces. Only the last few windows of a group stay partly empty.

Null texts count as empty and hold the end token only. Repeated rows are packed each on their own; ties in
length are taken by id and start. An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import arrow_schema

WINDOW = 2048
END_TOKEN = 1
#: Documents to a group, on average.
GROUP_DOCUMENTS, GROUP_BYTES = 8192, 64_000_000
MEMO_LIMIT = 1_500_000

#: Fixed value: the published split pattern of the vocabulary; what lies between matches is dropped.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+").findall
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
_LATIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+").findall


class WordTokenizer(dict):
    """Packed ids by word. New words go to the tokenizers library; known ones are remembered, up to a bound."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.model = tokenizer.model
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.specials = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)))

    def __missing__(self, word: str) -> bytes:
        letters = self.letters
        spelt = "".join([letters[b] for b in word.encode("utf-8", "surrogatepass")])
        got = np.array([t.id for t in self.model.tokenize(spelt)], "<u4").tobytes()
        if len(self) >= MEMO_LIMIT:
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got

    def _plain(self, text: str) -> list[bytes]:
        try:
            text.encode("latin-1")
            words = _LATIN_WORDS(text.lower())  # Latin-1 texts are in composed form already
        except UnicodeEncodeError:
            # the library lowers letter by letter, without the final form of sigma
            words = _WORDS(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        return list(map(self.__getitem__, words))

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned words."""
        if "<|" not in text:
            return b"".join(self._plain(text))
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        return b"".join(out + self._plain(text[at:]))


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class RoomTree:
    """A segment tree indexed by room: which sizes of room some open window has."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, which: int) -> None:
        if room <= 0:
            return
        self.open[room].append(which)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The window with the smallest room of at least ``least``, taken out, with that room."""
        count, at = self.count, least + self.size
        if not count[at]:
            # climb until a subtree to the right has an entry, then go down on its left
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at <<= 1
                if not count[at]:
                    at += 1
        room = at - self.size
        which = self.open[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return which, room


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """For pieces in decreasing length: window number and offset of each."""
    tree, places, offsets, opened = RoomTree(window), [], [], 0
    for n in lengths:
        found = tree.take(n) if n < window else None
        if found is None:
            which, room = opened, window
            opened += 1
        else:
            which, room = found
        places.append(which)
        offsets.append(window - room)
        tree.add(room - n, which)
    return places, offsets


PIECES = "row_key long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_token: int = END_TOKEN, with_ids: bool = True) -> DataFrame:
    """Full windows and a remainder for every row; ``ids`` (packed) only if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = word_tokenizer(path), end_token.to_bytes(4, "little")
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packed = tokens.packed(text or "") + end
                total = len(packed) // 4
                for start in range(0, total, window):
                    part = packed[4 * start : 4 * (start + window)]
                    rows.append((key, doc_id, start, len(part) // 4, zlib.crc32(part), total, part if with_ids else None))
                key += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, out)], schema=out)

    out = arrow_schema(docs.sparkSession, PIECES)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_token: int = END_TOKEN, with_ids: bool = True) -> DataFrame:
    """Pieces with sequence_id and offset; ``ids`` holds the packed token ids where asked for."""
    size = F.sum(F.octet_length(F.col("text").cast("string"))) if with_ids else F.lit(0)
    n, held = docs.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    groups = max(1, -(-n // GROUP_DOCUMENTS), -(-held // GROUP_BYTES))
    cut = pieces(docs, path, window, end_token, with_ids)
    # full windows need no neighbour: the windows of a long document are spread over all groups
    spread = F.when(F.col("length") == window, F.col("start")).otherwise(F.lit(0))
    dealt = cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "row_key", spread), F.lit(groups)).cast("long"))

    def place(table: pa.Table) -> pa.Table:
        order = sorted(zip(table["length"].to_pylist(), table["doc_id"].to_pylist(), table["row_key"].to_pylist(), table["start"].to_pylist(), range(len(table))), key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2], x[3]))
        where, offsets = best_fit([x[0] for x in order], window)
        table = table.take(pa.array([x[4] for x in order], pa.int64()))
        base = table["g"][0].as_py() << 32
        columns = [table[c] for c in names] + [pa.array([base + w for w in where], pa.int64()), pa.array(offsets, pa.int64())]
        return pa.Table.from_arrays(columns, [*names, "sequence_id", "offset"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + (["ids"] if with_ids else [])
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    return dealt.groupBy("g").applyInArrow(place, schema + ", sequence_id long, offset long")


def packing_rows(docs: DataFrame, path: str) -> DataFrame:
    """The digest rows of the query."""
    return pack(docs, path, with_ids=False)
