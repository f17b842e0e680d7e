"""Token counts of whole texts, huge ones in overlapping chunks that are spliced where their encodings provably agree.

A text of up to ``chunk`` code points is encoded where it lies. A longer one is cut into chunks that overlap, the
chunks are dealt to tasks, and each is encoded with offsets. Two neighbours A and B are spliced inside their overlap, at
one of two kinds of place; the document's count is the sum of the chunks' less what a splice drops on either side.

* Word end: in A and in B a word (a match of the split pattern) ends at the same code point. The pattern has no memory
  from one match to the next and looks at most three code points past a match, so behind that point both go on as the
  whole text does. Words are encoded each on its own.
* Common token: inside a run longer than the overlap, A and B hold the same token at the same place, not the last of
  its word. A sequence of tokens is the encoding of its letters exactly if every pair of neighbours is (a merge that
  crossed a border would cross it in the pair alone as well); the pairs up to the token are A's and those from it on B's.

Both kinds must lie MARGIN code points inside either chunk, further than a special string or a contraction reaches,
and stand before a code point that Unicode composition never joins to what precedes it.

Where a border has no such place (a run of one sign, say, whose tokens fall out of step), the document is cut anew into
chunks and overlaps WIDEN times as long, until one chunk holds all of it. So every count is exact.

Null texts count as empty (no tokens, no bytes). Special strings inside texts are special tokens, as the library has it by
default. Repeated rows are counted each on their own; rows without id stay; an empty table gives an empty result. Only the
id and the text are read, so further columns cannot clash.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, materialise, scratch
from .packing import word_tokenizer

LIMIT = 2048
CHUNK, OVERLAP, MARGIN, WIDEN = 16384, 256, 40, 8

_PIECE = "doc_id long, key string, n_bytes long, no int, chunks int, piece string"
_EDGE = "array<struct<place:string,after:int>>"
_CODED = f"doc_id long, key string, n_bytes long, no int, chunks int, n_tokens long, head {_EDGE}, tail {_EDGE}"


@lru_cache(maxsize=2)
def library(path: str):
    """The tokenizers library's own encoder, once per worker process, for files of the supported build."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [p["type"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
    if spec["model"]["type"] != "BPE" or steps != ["Split", "ByteLevel"] or not spec["model"].get("end_of_word_suffix"):
        raise ValueError(f"{path}: the proofs of splices hold for BPE with word ends after a split pattern")
    if any(len(t["content"]) >= MARGIN for t in spec["added_tokens"]):
        raise ValueError(f"{path}: a special string reaches over the margin of {MARGIN}")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def stands_alone(text: str, at: int) -> bool:
    """Whether composition never joins the code point at ``at`` to those before it: no mark, no Hangul vowel or final."""
    return at >= len(text) or not (unicodedata.category(text[at]).startswith("M") or 0x1160 <= ord(text[at]) <= 0x11FF)


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of every chunk; each but the first begins ``overlap`` before the end of the one before."""
    n = max(1, -(-len(text) // chunk))
    return [(max(0, i * chunk - overlap), min(len(text), (i + 1) * chunk)) for i in range(n)]


def places(text: str, coded, start: int, low: int, high: int) -> list[tuple[str, int]]:
    """Places within [low, high) of ``text`` (which begins at ``start`` of its document) fit for a splice, and the tokens up to each."""
    offsets, ids, words = coded.offsets, coded.ids, coded.word_ids
    out, n = [], len(ids)
    for i, (s, e) in enumerate(offsets):
        if s < low or e > high:
            continue
        ends = i + 1 == n or words[i + 1] != words[i]
        if not stands_alone(text, e) or (i + 1 < n and offsets[i + 1][0] < e):
            continue  # composition, or a code point that several tokens share
        if ends:
            out.append((f"{start + e}", i + 1))
        elif (i == 0 or offsets[i - 1][1] <= s) and stands_alone(text, s) and _width(offsets, words, i) > 3:
            out.append((f"{start + s}:{start + e}:{ids[i]}", i + 1))
    return out


def _width(offsets, words, i: int) -> int:
    """Code points of token i's word, as far as to know whether they are more than 3."""
    low = high = i
    while low and words[low - 1] == words[i] and offsets[i][1] - offsets[low][0] <= 3:
        low -= 1
    while high + 1 < len(words) and words[high + 1] == words[i] and offsets[high][1] - offsets[low][0] <= 3:
        high += 1
    return offsets[high][1] - offsets[low][0]


def _short(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of texts that one chunk holds."""
    ddl = "doc_id long, n_bytes long, n_tokens long"
    out = arrow_schema(rows.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library(path)  # says so where the file is of another build
        packed = word_tokenizer(path).packed
        for b in batches:
            counts = pa.array([len(packed(t)) // 4 for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), counts], schema=out)

    return rows.select("doc_id", "n_bytes", "text").mapInArrow(run, ddl)


def _pieces(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    out = arrow_schema(rows.sparkSession, _PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, key, n_bytes, text in zip(*(c.to_pylist() for c in b.columns)):
                ends = cut(text, chunk, overlap)
                for at in range(0, len(ends), 64):
                    some = [(doc_id, key, n_bytes, at + k, len(ends), text[s:e]) for k, (s, e) in enumerate(ends[at : at + 64])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), out)], schema=out)

    return rows.select("doc_id", "key", "n_bytes", "text").mapInArrow(run, _PIECE)


def _coded(pieces: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    out = arrow_schema(pieces.sparkSession, _CODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = library(path)
        for b in batches:
            for doc_id, key, n_bytes, no, chunks, text in zip(*(c.to_pylist() for c in b.columns)):
                coded = t.encode(text, add_special_tokens=False)
                start = max(0, no * chunk - overlap)
                head = places(text, coded, start, MARGIN, overlap - MARGIN) if no else []
                tail = places(text, coded, start, len(text) - overlap + MARGIN, len(text) - MARGIN) if no + 1 < chunks else []
                dicts = [[{"place": p, "after": k} for p, k in x] for x in (head, tail)]
                row = (doc_id, key, n_bytes, no, chunks, len(coded.ids), *dicts)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, out)], schema=out)

    return pieces.mapInArrow(run, _CODED)


def _spliced(coded: DataFrame) -> DataFrame:
    """doc_id, key, n_bytes, n_tokens (null where a border has no common place) and how many rows of the table are such a one."""
    # rows of one id and text count once here; their number comes back at the end
    one = coded.groupBy("doc_id", "key", "n_bytes", "no").agg(F.any_value("n_tokens").alias("n_tokens"), F.any_value("head").alias("head"), F.any_value("tail").alias("tail"), F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("doc_id", "key", "n_bytes").orderBy("no")
    after = F.map_from_entries(F.lead("head").over(order))
    pairs = one.withColumn("next", after)
    both = F.filter(F.transform("tail", lambda x: F.struct(x["after"].alias("a"), F.try_element_at("next", x["place"]).alias("b"))), lambda x: x["b"].isNotNull())
    splice = F.get(both, F.lit(0))
    pairs = pairs.select("doc_id", "key", "n_bytes", "n_tokens", "copies", F.col("next").isNotNull().alias("border"), splice.alias("x"))
    return pairs.groupBy("doc_id", "key", "n_bytes").agg(
        F.when(F.bool_or(F.col("border") & F.col("x").isNull()), F.lit(None)).otherwise(
            F.sum(F.col("n_tokens") - F.when(F.col("border"), F.col("n_tokens") - F.col("x.a") + F.col("x.b")).otherwise(F.lit(0)))
        ).alias("n_tokens"),
        F.max("copies").alias("copies"),
    )


def count_tokens(
    docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of ``docs``."""
    if overlap < 3 * MARGIN or chunk < 2 * overlap:
        raise ValueError("an overlap is three margins at least, a chunk two overlaps")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    # octets bound code points from above, so most rows are told apart without counting
    fits = (F.col("n_bytes") <= chunk) | (F.length("text") <= chunk)
    long = rows.where(~fits).withColumn("key", F.sha2("text", 256))
    with scratch(docs.sparkSession) as keep:
        found, todo, at, over = [], long, chunk, overlap
        while True:
            pieces = _pieces(todo, at, over).repartition("doc_id", "key", "no")
            done = keep(_spliced(materialise(_coded(pieces, path, at, over), "chunks")), "counts")
            found.append(done.where("n_tokens IS NOT NULL"))
            open_ = done.where("n_tokens IS NULL")
            if open_.isEmpty():
                break
            again = open_.select(F.col("doc_id").alias("again_id"), F.col("key").alias("again_key"))
            todo = long.join(again, F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col("key") == F.col("again_key")), "left_semi")
            at, over = at * WIDEN, over * WIDEN
        longs = reduce(DataFrame.unionByName, found).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    every = _short(rows.where(fits), path).unionByName(longs.select("doc_id", "n_bytes", "n_tokens"))
    return every.withColumn("over_limit", F.col("n_tokens") > limit)
