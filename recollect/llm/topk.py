"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers floor(256 * x). They are dealt into range partitions by length, cut into lanes (rows of
packed bytes), and each lane into buckets of similar length, the longest first. The stated queries are packed
into blocks. Within a meeting of a block and a lane each query keeps the k-th best score so
far; divided by the query's and the bucket's greatest length it is the bucket's local cosine threshold. Above 1
the bucket is skipped whole (length pruning); from COORDINATE_FROM on, the bucket is pruned by coordinates; below that all of
the bucket is looked at. What is left is verified by exact products.

Coordinate pruning takes the query's largest components, as many as leave it so short a rest that rest times a usual rest of
a vector stays under half the threshold. Their part of the product, and the lengths of both rests, bound the product; vectors
whose bound misses the threshold are left out.

The head lane, with the longest vectors, goes to all blocks first and gives every query its first threshold. Lanes whose longest vector
cannot reach the lowest of a block's thresholds do not meet the block: both sides carry the lengths, and the join looks
at those before any vector moves. Blocks go to the lanes in chunks of at most CHUNK_BYTES, which are broadcast, and
what a chunk finds is written before the next goes out, so one chunk at a time is held; lanes stay where they are.

No cap: every query meets every lane or is excluded by a bound, so the result is exact. Memory is bounded by a
lane, a block and a chunk. The work grows with queries times vectors, as the stated query set makes it.

Vectors that are null or hold a null or non-finite component take no part, nor do rows without an id. Vectors of
different widths are compared as if zeros followed. An empty vector scores 0 with everything. Repeated query
rows give one result, rows with equal ids and different vectors one result for each id (its best rows); a
candidate with the query's id is the query's own. Ties go to the smaller id. An empty table gives an empty
result. Only the id and the vector are read. Components up to 2**20 or so are multiplied in floating point
without rounding; larger ones go through Python integers, and scores beyond 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, materialise, scratch


#: Under every score; its negation still fits.
NONE = -(1 << 62)


@dataclass(frozen=True)
class Params:
    k: int = 5
    every: int = 50  # queries: ids divisible by this
    scale: int = 256
    lane: int = 16384  # vectors to a lane
    bucket: int = 1024  # vectors to a bucket
    block: int = 1024  # queries to a block
    coordinate_from: float = 0.25
    lane_bytes: int = 32_000_000  # of a lane's components, at most
    chunk_bytes: int = 64_000_000  # of query blocks broadcast at once


LANES = "part int, ids binary, width int, values binary, longest double"


def quantise(table: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id, integer components and length of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    whole = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = table.where(whole).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))
    return rows.withColumn("len", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))


def _pack(rows: list[tuple[int, list[int]]]) -> tuple[bytes, int, bytes, float]:
    width = max((len(v) for _, v in rows), default=0)
    m = np.zeros((len(rows), width), np.int64)
    for i, (_, v) in enumerate(rows):
        m[i, : len(v)] = v
    longest = float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max())) if width else 0.0
    if not m.size or np.abs(m).max() < 2**31:
        m = m.astype(np.int32)
    return np.array([i for i, _ in rows], np.int64).tobytes(), width, m.tobytes(), longest


def _packed(rows: DataFrame, size: int, most_bytes: int) -> DataFrame:
    """Rows of a partition, in their order, as packed rows of at most ``size`` vectors and about ``most_bytes``."""
    out = arrow_schema(rows.sparkSession, LANES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list[int]]] = []
        width = 0

        def flush() -> pa.RecordBatch:
            row = (TaskContext.get().partitionId(), *_pack(held))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, out)], schema=out)

        for batch in batches:
            for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(pair)
                width = max(width, len(pair[1]))
                if len(held) >= size or 8 * width * len(held) >= most_bytes:
                    yield flush()
                    held, width = [], 0
        if held:
            yield flush()

    return rows.select("id", "v").mapInArrow(run, LANES)


def _unpack(ids: bytes, width: int, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    small = len(values) == 4 * len(i) * width
    return i, np.frombuffer(values, np.int32 if small else np.int64).reshape(len(i), width).astype(np.int64)


def _products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows; in floating point where no partial sum can be rounded."""
    width = min(q.shape[1], m.shape[1])
    q, m = q[:, :width], m[:, :width]
    if not width or not len(q) or not len(m):
        return np.zeros((len(q), len(m)), np.int64)
    bound = float(np.abs(q).max()) * float(np.abs(m).max()) * width
    if bound < 2**23:
        return (q.astype(np.float32) @ m.astype(np.float32).T).astype(np.int64)
    if bound < 2**52:
        return (q.astype(np.float64) @ m.astype(np.float64).T).astype(np.int64)
    return (q.astype(object) @ m.astype(object).T).astype(np.int64)


class _Best:
    """The k best (score, id) of every query so far, better first."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.skipped = 0  # products that bounds ruled out
        self.score = np.full((n, k), NONE, np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max, np.int64)

    def floor(self) -> np.ndarray:
        return self.score[:, -1]

    def offer(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.score[query, -1]
        if not keep.any():
            return
        s = np.concatenate([self.score[query], scores[keep]])
        i = np.concatenate([self.id[query], ids[keep]])
        order = np.lexsort((i, -s))[: self.k]
        self.score[query], self.id[query] = s[order], i[order]


def retrieve(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, floors: np.ndarray, p: Params) -> _Best:
    """The best of one lane for one block of queries; vectors under a query's floor may be left out."""
    best = _Best(len(q), p.k)
    lengths = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    q_length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    slack = 1e-9
    for at in range(0, len(order), p.bucket):
        rows = order[at : at + p.bucket]
        top = float(lengths[rows[0]]) * (1 + slack)
        floor = np.maximum(best.floor(), floors)
        reach = q_length * top
        known = floor > NONE
        live = ~known | (floor <= reach * (1 + slack) + slack)
        if not live.any():
            best.skipped += len(q) * (len(order) - at)
            break  # shorter buckets cannot reach either
        best.skipped += int(np.count_nonzero(~live)) * len(rows)
        local = np.where(known & (reach > 0), floor / np.where(reach > 0, reach, 1), -1.0)
        by_coordinate = live & (local >= p.coordinate_from)
        part, part_ids = m[rows], ids[rows]
        full = np.flatnonzero(live & ~by_coordinate)
        if len(full):
            scores = _products(q[full], part)
            scores[query_ids[full][:, None] == part_ids[None, :]] = NONE
            worth = (scores >= floor[full][:, None]) & (scores > NONE)
            for row in np.flatnonzero(worth.any(axis=1)).tolist():
                take = worth[row]
                best.offer(full[row], scores[row, take], part_ids[take])
        pruned = np.flatnonzero(by_coordinate)
        if len(pruned):
            columns = np.ascontiguousarray(part[:, : q.shape[1]].T, np.float64)
            squares, own = columns * columns, lengths[rows] ** 2
        for one in pruned.tolist():
            focus = _focus(q[one], q_length[one], float(local[one]), len(columns))
            rest_q = np.sqrt(max(0.0, q_length[one] ** 2 - float((q[one, focus].astype(np.float64) ** 2).sum())))
            rest_v = np.sqrt(np.maximum(own - squares[focus].sum(axis=0), 0))
            bound = q[one, focus].astype(np.float64) @ columns[focus] + rest_q * rest_v
            left = np.flatnonzero((bound >= floor[one] - 1e-6 * (abs(float(floor[one])) + reach[one])) & (part_ids != query_ids[one]))
            best.skipped += len(rows) - len(left)
            if len(left):
                best.offer(one, _products(q[one : one + 1], part[left])[0], part_ids[left])
    return best


def _focus(q: np.ndarray, length: float, threshold: float, width: int) -> np.ndarray:
    """The largest components, until the rest of the query is under half the threshold in length."""
    order = np.argsort(-np.abs(q[:width]), kind="stable")
    got = np.cumsum(q[order].astype(np.float64) ** 2)
    return order[: int(np.searchsorted(got, (1 - (threshold / 2) ** 2) * length**2)) + 1]


BEST = "block long, place int, query_id long, vec_id long, score long, skipped long"


def _meet(pairs: DataFrame, p: Params) -> DataFrame:
    """One row per (query block, lane) to the lane's best for every query of the block; the first row of a meeting has the products skipped."""
    out = arrow_schema(pairs.sparkSession, BEST)
    least = NONE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in (dict(zip(batch.schema.names, (c[r].as_py() for c in batch.columns))) for r in range(batch.num_rows)):
                query_ids, q = _unpack(x["q_ids"], x["q_width"], x["q_values"])
                ids, m = _unpack(x["ids"], x["width"], x["values"])
                floors = np.full(len(q), least, np.int64)
                for f in x["floors"] or []:
                    floors[f["place"]] = f["floor"]
                best = retrieve(query_ids, q, ids, m, floors, p)
                row, col = np.nonzero(best.id != np.iinfo(np.int64).max)
                block = np.full(len(row), x["block"], np.int64)
                skipped = np.zeros(len(row), np.int64)
                skipped[:1] = best.skipped
                columns = [block, row, query_ids[row], best.id[row, col], best.score[row, col], skipped]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    columns = ["block", "q_ids", "q_width", "q_values", "floors", "ids", "width", "values"]
    return pairs.select(*columns).mapInArrow(run, BEST)


def _chunks(blocks: DataFrame, size: int) -> list[DataFrame]:
    """The blocks in chunks that are each known to be of at most ``size`` bytes, thresholds included, or one block."""
    sizes = blocks.select("block", (F.octet_length("q_values") + 3 * F.octet_length("q_ids")).alias("n")).orderBy("block").collect()  # two numbers a block
    out, held = [], 0
    for r in sizes:
        if not out or held + r.n > size:
            out.append([])
            held = 0
        out[-1].append(r.block)
        held += r.n
    return [blocks.where(F.col("block").isin(c)) for c in out]


def meetings(vectors: DataFrame, params: Params | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """What every meeting of a block of queries and a lane found: BEST."""
    p = params or Params()
    rows = quantise(vectors, p.scale, id_col, vector_col)
    n = rows.count()
    parts = max(1, -(-n // p.lane))
    by_length = rows.repartitionByRange(parts, F.col("len").desc(), "id").sortWithinPartitions(F.col("len").desc(), "id")
    lanes = _packed(by_length, p.lane, p.lane_bytes).withColumn("lane", F.monotonically_increasing_id()).drop("part")
    lanes = materialise(lanes, "lanes")

    asked = rows.where(F.pmod("id", F.lit(p.every)) == 0).select("id", "v", "len").distinct()
    asked = asked.repartitionByRange(max(1, -(-n // (p.every * p.block))), F.col("len").desc(), "id")  # queries of like length share their blocks
    names = {"ids": "q_ids", "width": "q_width", "values": "q_values"}
    blocks = _packed(asked, p.block, p.lane_bytes).select(F.monotonically_increasing_id().alias("block"), *[F.col(a).alias(b) for a, b in names.items()])
    blocks = materialise(blocks, "blocks")
    chunks = _chunks(blocks, p.chunk_bytes)

    # the head lane first: one lane, bounded by its bytes, goes to the blocks where they lie
    longest = lanes.agg(F.max(F.struct("longest", "lane"))["lane"]).first()[0]
    head, others = lanes.where(F.col("lane") == F.lit(longest)), lanes.where(F.col("lane") != F.lit(longest))
    unknown = F.lit(None).cast("array<struct<place:int,floor:bigint>>")
    first = materialise(_meet(blocks.withColumn("floors", unknown).join(F.broadcast(head), F.lit(True)), p), "head")

    floors = first.groupBy("block", "place", "query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
    # a block's reach: the least length of a vector that some query of it still needs; queries without k results need any
    lengths = asked.select(F.col("id").alias("query_id"), "len")
    needs = floors.join(lengths.groupBy("query_id").agg(F.max("len").alias("len")), "query_id")
    need = F.when((F.col("n") >= p.k) & (F.col("floor") > 0) & (F.col("len") > 0), F.col("floor") / F.col("len") * (1 - 1e-9)).otherwise(F.lit(-1.0))
    about = needs.groupBy("block").agg(
        F.collect_list(F.when(F.col("n") >= p.k, F.struct("place", "floor"))).alias("floors"),  # a block's queries at most
        F.min(need).alias("reach"), F.count(F.lit(1)).alias("queries"),
    )
    about = materialise(about, "floors")

    met = [first]
    for c in chunks:
        known = c.join(about, "block", "left")
        complete = F.col("queries") == F.octet_length("q_ids") / 8
        known = known.withColumn("reach", F.when(complete, F.col("reach")).otherwise(F.lit(-1.0))).drop("queries")
        met.append(materialise(_meet(others.join(F.broadcast(known), F.col("longest") >= F.col("reach")), p), "met"))
    return reduce(DataFrame.unionByName, met)


def top_k(vectors: DataFrame, params: Params | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score for the rows whose id is divisible by ``every``."""
    p = params or Params()
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    with scratch(vectors.sparkSession) as keep:
        best = keep(meetings(vectors, p, id_col, vector_col).select("query_id", "vec_id", "score"), "met")
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
