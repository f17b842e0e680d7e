"""Language-model scores from Elias-Fano n-gram tries that are sharded by word.

The model is a bigram model with a Dirichlet prior on the smoothed unigram model:

    p(w | v) = (c(v w) + MU * p1(w)) / (c(v) + MU),   p1(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))

so log10 p(w | v) = log10 p1(w) + gain(v, w) + backoff(v), with gain = log10(1 + c(v w) / (MU * p1(w))) and
backoff = log10(MU / (c(v) + MU)). The gain depends on the word's shard alone and the backoff on the
context's count alone, so shards answer independently, and no model is ever broadcast.

Pass 1 counts words (pre-aggregated per batch) for N, V and the frequent words. Pass 2 sums the bigrams of a batch
before anything moves: a shard gets each distinct bigram of a batch once, with its count in the batch's training
rows, never its occurrences. It builds its trie from the sums, answers every batch's bigrams with codes, and the
batch puts the codes back on its tokens, which rode along with the shards as numbers of bigrams. So a pair
that makes up a third of all tokens costs its shard one entry a batch.

A shard is meant for ``tokens_per_shard`` tokens. Words with more than a HOT-th of that are dealt by word and context
together. Their counts are collected and sent to all tasks: at most MOST_HOT words (16 MB), which holds because
the limit is also at least an MOST_HOT-th of all tokens. Beyond MOST_HOT * tokens_per_shard / HOT tokens (1.6e11, half a
TB of text) an undivided word may thus weigh more than a HOT-th of a shard, as the share of one word in MOST_HOT.

Gains are quantised to 1/256 of log10, probabilities to 1/2048; contexts are 40-bit hashes and words 64-bit hashes, so
counts are exact but for hash collisions. ``mean_score`` is the score by token, and ``n_again`` counts the tokens whose pair
with the word before stands in training more often than once, for texts not of training at all: high in texts that
occur twice.

Null texts count as empty: one end token. Whole texts are scored, very long ones as well. A null id is held out (the remainder of an empty text is 0).
Repeated rows are trained on and scored each on their own. Without any training token every count is 0. An
empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, arrow_schema, materialise, scratch, shuffle_partitions
from .eliasfano import BigramTrie

MEMO_LIMIT = 250_000
HOT, MOST_HOT = 8, 1_000_000
#: Fixed stand-ins for the end of a text and for the place before its first word; words never hold a blank.
END = xxhash.xxh3_64_intdigest(b" end")
START = xxhash.xxh3_64_intdigest(b" start")
_LOW40 = np.uint64((1 << 40) - 1)


@dataclass(frozen=True)
class Params:
    mu: float = 200.0
    add: float = 0.1
    tokens_per_shard: int = 1_300_000
    tokens_per_batch: int = 1_000_000  # a map task holds one such batch at a time


class _WordIds(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_LIMIT:
            self.clear()
        got = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = got
        return got


_IDS = _WordIds()


def token_ids(text: str | None) -> np.ndarray:
    """64-bit ids of the words and the end token."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()
    ids = np.empty(len(words) + 1, np.uint64)
    ids[:-1] = np.fromiter(map(_IDS.__getitem__, words), np.uint64, len(words))
    ids[-1] = END
    return ids


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (64-bit id) and its count in the training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = [token_ids(t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if not held_out(i)]
            if train:
                words, counts = np.unique(np.concatenate(train), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "c"])

    return _texts(docs).mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(word: np.ndarray, context: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    at = np.minimum(np.searchsorted(hot, word), max(0, len(hot) - 1))
    is_hot = hot[at] == word if len(hot) else np.zeros(len(word), bool)
    key = _mixed(np.where(is_hot, word ^ (context * np.uint64(0x9E3779B97F4A7C15)), word))
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


ROWS = "doc_ids array<long>, doc_at array<int>, doc_tokens array<int>, codes binary"
BLOB = f"shard long, batch long, {ROWS}, words binary, fan binary, contexts binary, counts binary"
PART = f"batch long, shard long, {ROWS}, fan binary, seen binary, alone binary, gains binary"


def _bytes(x: np.ndarray) -> bytes:
    """Unsigned integers in the least of 1, 2, 4 or 8 bytes that holds them all, after a byte that says which."""
    top = int(x.max()) if len(x) else 0
    kind = "<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8"
    return kind[-1].encode() + x.astype(kind).tobytes()


def _numbers(scalar: pa.Scalar) -> np.ndarray:
    data = scalar.as_buffer()
    return np.frombuffer(data[1:], f"<u{bytes(data[:1]).decode()}").astype(np.int64)


def _blobs(docs: DataFrame, hot: np.ndarray, shards: int, p: Params) -> DataFrame:
    """Per batch and shard: the distinct words, their contexts, and counts in training rows.

    The pairs of a batch are numbered by shard, word and context. Ids, lengths and the pair numbers of a row's tokens
    ride with one of the shards.
    """
    fields = arrow_schema(docs.sparkSession, BLOB)

    def flush(first: int, ids: list, tokens: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(t) for t in tokens])
        ends = np.cumsum(lengths)
        word = np.concatenate(tokens)
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[ends - lengths] = np.uint64(START)
        context &= _LOW40
        shard = shard_of(word, context, hot, shards)
        order = np.lexsort((context, word, shard))
        w, v = word[order], context[order]
        new_word = np.ones(len(w), bool)
        new_word[1:] = (w[1:] != w[:-1]) | (shard[order][1:] != shard[order][:-1])
        new = new_word.copy()
        new[1:] |= v[1:] != v[:-1]
        heads = np.flatnonzero(new)
        code = np.empty(len(order), np.uint32)
        code[order] = np.cumsum(new) - 1
        training = np.repeat(np.array([not held_out(i) for i in ids]), lengths)
        count = np.add.reduceat(training[order].astype(np.int64), heads)
        of_pair = shard[order][heads]
        word_heads = np.flatnonzero(new_word[heads])
        fan = np.diff(word_heads, append=len(heads))
        of_word = of_pair[word_heads]
        five = v[heads].view(np.uint8).reshape(-1, 8)[:, :5]
        wide = 3 if len(heads) < 1 << 24 else 4  # bytes of a pair's number
        carrier = (first + np.arange(len(ids))) % shards
        out = []
        for s in np.union1d(of_word, carrier).tolist():
            a, b = np.searchsorted(of_pair, [s, s + 1])
            c, d = np.searchsorted(of_word, [s, s + 1])
            own = np.flatnonzero(carrier == s)
            codes = np.concatenate([code[ends[k] - lengths[k] : ends[k]] for k in own]) if len(own) else np.empty(0, np.uint32)
            out.append((
                s, first, [ids[k] for k in own], own, lengths[own], codes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide].tobytes(), w[heads[word_heads[c:d]]].tobytes(), _bytes(fan[c:d]),
                five[a:b].tobytes(), _bytes(count[a:b]),
            ))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        ids, tokens, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                tokens.append(token_ids(text.as_py()))
                held += len(tokens[-1])
                if held >= p.tokens_per_batch:
                    yield flush(first, ids, tokens)
                    first += len(ids)
                    ids, tokens, held = [], [], 0
        if ids:
            yield flush(first, ids, tokens)

    return _texts(docs).mapInArrow(run, BLOB)


class _Shard:
    """The questions of one shard, unpacked: words by batch, and the distinct bigrams with their counts in training."""

    def __init__(self, t: pa.Table):
        words, contexts, counts, fans = [], [], [], []
        for k in range(len(t)):
            five = np.frombuffer(t["contexts"][k].as_buffer(), np.uint8).reshape(-1, 5)
            wide = np.zeros((len(five), 8), np.uint8)
            wide[:, :5] = five
            words.append(np.frombuffer(t["words"][k].as_buffer(), np.uint64))
            fans.append(_numbers(t["fan"][k]))
            contexts.append(wide.view(np.uint64).ravel())
            counts.append(_numbers(t["counts"][k]))
        self.word_edges = np.cumsum([0, *map(len, words)])
        self.pair_edges = np.cumsum([0, *map(len, contexts)])
        self.asked = np.concatenate(words)
        word = np.repeat(self.asked, np.concatenate(fans))
        context, count = np.concatenate(contexts), np.concatenate(counts)
        del words, contexts, counts
        order = np.lexsort((context, word))
        w, v = word[order], context[order]
        new = np.ones(len(order), bool)
        new[1:] = (w[1:] != w[:-1]) | (v[1:] != v[:-1])
        heads = np.flatnonzero(new)
        self.word, self.context = w[heads], v[heads]
        self.count = np.add.reduceat(count[order], heads) if len(heads) else np.empty(0, np.int64)
        self.entry = np.empty(len(order), np.int64)  # the distinct bigram of every question
        self.entry[order] = np.cumsum(new) - 1


def _counted(words: np.ndarray, counts: np.ndarray, hot: np.ndarray, hot_counts: np.ndarray) -> np.ndarray:
    """Counts of words, those of hot words as given: a shard sees only some of their contexts."""
    if not len(hot):
        return counts
    at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
    return np.where(hot[at] == words, hot_counts[at], counts)


def _trie(q: _Shard, hot: np.ndarray, hot_counts: np.ndarray, total: float, p: Params) -> bytes:
    """The levels of a shard: words and contexts of the training rows."""
    seen = q.count > 0
    word, context, count = q.word[seen], q.context[seen], q.count[seen]
    words, of_word = np.unique(word, return_inverse=True)
    counts = _counted(words, np.bincount(of_word, weights=count, minlength=len(words)).astype(np.int64), hot, hot_counts)
    alone = (counts + p.add) / total
    gains = np.log10(1 + count / (p.mu * alone[of_word])) if len(count) else np.empty(0)
    return BigramTrie.build(words, counts, of_word, context, gains, np.log10(alone)).to_bytes()


def _gathered(t: pa.Table, total: float, texts: int, p: Params) -> pa.Table:
    """The rows of one batch: its shards' answers put back on its tokens. The batch's size bounds what this holds."""
    t = t.sort_by("shard")
    many = lambda c, of: np.concatenate([of(x) for x in t[c]])
    lists = lambda x: np.asarray(x.as_py(), np.int64)
    u2 = lambda x: np.frombuffer(x.as_buffer(), "<u2").astype(np.int64)
    at, length = many("doc_at", lists), many("doc_tokens", lists)
    ids = [i for x in t["doc_ids"] for i in x.as_py()]
    order = np.argsort(at)
    starts = np.cumsum(length) - length
    thin = many("codes", lambda x: np.frombuffer(x.as_buffer(), np.uint8)).reshape(int(length.sum()), -1)
    wide = np.zeros((len(thin), 4), np.uint8)
    wide[:, : thin.shape[1]] = thin
    code = wide.view("<u4").ravel()
    fan, seen, gains = many("fan", _numbers), many("seen", _numbers), many("gains", u2)
    of_word = np.repeat(np.arange(len(fan)), fan)
    seen, is_end = seen >> 1, seen & 1  # the lowest bit marks the end token, which stands in for the place before a text
    alone = np.log10((seen + p.add) / total)
    backoff = np.log10(p.mu / (np.where(is_end, texts, seen) + p.mu))
    value = (backoff - many("alone", u2) / BigramTrie.FINE)[of_word] + gains / BigramTrie.STEPS
    pair_count = (10.0 ** (gains / BigramTrie.STEPS) - 1) * p.mu * 10.0 ** alone[of_word]
    training = np.repeat([not held_out(i) for i in ids], length)
    sums = lambda x: np.add.reduceat(x, starts)[order]
    score, n = sums(value[code]), length[order]
    return pa.table(
        {
            "doc_id": pa.array([ids[k] for k in order], pa.int64()), "n_tokens": pa.array(n), "n_known": pa.array(sums((seen > 0)[of_word[code]].astype(np.int64))),
            "base_score": pa.array(sums(alone[of_word[code]])), "score": pa.array(score), "mean_score": pa.array(score / n),
            "n_again": pa.array(sums((pair_count[code] > 0.5 + training).astype(np.int64))),
        }
    )


def score(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), mean_score and n_again of every row."""
    p = params or Params()
    spark = docs.sparkSession
    with scratch(spark):
        counts = materialise(word_counts(docs), "words")
        n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        limit = max(p.tokens_per_shard // HOT, -(-n // MOST_HOT), 1)
        # words to the left of a whole text's end are as frequent as texts are: the end token is given its count as well
        wanted = (F.col("c") > F.lit(limit)) | (F.col("word") == F.lit(int(np.uint64(END).view(np.int64))))
        frequent = counts.where(wanted).collect()  # at most MOST_HOT rows, as limit * MOST_HOT >= n
    given = {END: 0} | {int(np.int64(r.word).view(np.uint64)): r.c for r in frequent}
    hot = np.array(sorted(given), np.uint64)
    hot_counts = np.array([given[int(w)] for w in hot], np.int64)
    texts = given[END]  # training texts: as many as end tokens
    total = n + p.add * (v + 1)
    shards = max(shuffle_partitions(spark), -(-int(n) // p.tokens_per_shard))

    def answer(t: pa.Table) -> pa.Table:
        q = _Shard(t)
        trie = BigramTrie.mapped(_trie(q, hot, hot_counts, total, p))
        words, of_asked = np.unique(q.asked, return_inverse=True)
        number, seen = trie.word(words)
        seen = _counted(words, seen, hot, hot_counts)
        alone = np.where(number >= 0, trie.alone[np.maximum(number, 0)] if len(trie.alone) else 0, BigramTrie.quantised(np.log10((seen + p.add) / total))).astype("<u2")
        marked = (seen << 1) | (words == np.uint64(END))
        gains = trie.gain(number[np.searchsorted(words, q.word)], q.context)[q.entry].astype("<u2")
        cut = lambda x, edges, to=np.ndarray.tobytes: pa.array([to(x[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.binary())
        columns = [t[c] for c in ("batch", "shard", "doc_ids", "doc_at", "doc_tokens", "codes", "fan")]
        columns += [cut(marked[of_asked], q.word_edges, _bytes), cut(alone[of_asked], q.word_edges), cut(gains, q.pair_edges)]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=part_fields)

    part_fields = arrow_schema(spark, PART)
    parts = _blobs(docs, hot, shards, p).repartition(shards, "shard").groupBy("shard").applyInArrow(answer, PART)
    batches = max(shuffle_partitions(spark), -(-int(n) // p.tokens_per_batch))
    out = "doc_id long, n_tokens long, n_known long, base_score double, score double, mean_score double, n_again long"
    whole = parts.repartition(batches, "batch").groupBy("batch").applyInArrow(lambda t: _gathered(t, total, texts, p), out)
    out_of_training = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    return whole.select(
        "doc_id", out_of_training.alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score", "mean_score", "n_again"
    )
