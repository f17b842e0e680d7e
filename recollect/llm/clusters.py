"""Centroid clustering with Elkan's bounds, in integers.

Vectors become integers floor(scale * x) and lie packed in blocks. A block keeps for each vector its cluster, an upper bound
of the distance to that cluster's centroid and a lower bound of the distance to every centroid. A round moves the bounds
by how far the centroids went and then looks only at what they cannot settle:

* a vector whose upper bound is under half the distance from its centroid to the nearest other one stays;
* a centroid is looked at only where the upper bound reaches its lower bound and half its distance to the vector's own;
* before that the upper bound is made exact, and both are asked again.

Bounds are doubles, every one rounded outwards, and all three tests prune only what is strictly further, so ties
reach the exact comparison of squared integer distances and go to the smaller number.

Each round writes the blocks with their bounds and partial sums to the shared folder, and the table before goes.
Sums per cluster and component are added by Spark; only they (clusters times (components + 1) numbers) reach the driver,
and only the centroids go back.

Vectors of another width, null ones and those with a null or non-finite component take no part, nor do rows without an id.
Repeated rows take part on their own; of equal ids the vector that is less comes first among the first centroids. With
fewer vectors than clusters there are as many centroids as vectors. An empty table gives an empty result. Only the id and the vector are read. Components
beyond 2**26 are computed in Python integers, and those, sums or distances beyond 64 bits raise an error.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import remove, shared_dir
from .common import arrow_schema, materialise, named

BLOCKS = "ids binary, vectors binary, cluster binary, upper binary, lower binary, sums array<bigint>, computed bigint"


@dataclass(frozen=True)
class Params:
    clusters: int = 8
    rounds: int = 10
    width: int = 64
    scale: int = 1024
    seed: int = 3
    block: int = 4096


def quantise(table: DataFrame, p: Params, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and integer components of the vectors that take part."""
    v = named(vector_col).cast("array<double>")
    whole = (F.size(v) == p.width) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = table.where(named(id_col).isNotNull() & whole)
    whole_number = lambda x: F.when(F.abs(x) * p.scale < 2.0**62, F.floor(x * p.scale)).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))
    return rows.select(named(id_col).cast("long").alias("id"), F.transform(v, whole_number).alias("v"))


def first_centroids(rows: DataFrame, p: Params) -> np.ndarray:
    """The vectors whose ids hash least, in order of the hash."""
    hashed = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.col("id").cast("string")), 256)
    got = rows.orderBy(hashed, "v").limit(p.clusters).collect()
    return np.array([r.v for r in got], np.int64).reshape(len(got), p.width)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(x, -np.inf), -np.inf), 0.0)


def squared(a: np.ndarray, b: np.ndarray, wide: bool = False) -> np.ndarray:
    """Exact squared distances of rows, in Python integers where they are ``wide``."""
    if wide:
        a, b = a.astype(object), b.astype(object)
        return ((a - b) ** 2).sum(axis=-1)
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def is_wide(v: np.ndarray, c: np.ndarray) -> bool:
    """Whether a squared distance of these rows might not fit 64 bits."""
    top = max((max(-int(x.min()), int(x.max())) for x in (v, c) if x.size), default=0)
    return 4 * top * top * max(1, c.shape[-1]) >= 2**63


def _root(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64))


@dataclass
class State:
    """A block between rounds."""

    cluster: np.ndarray  # int32, -1 before the first round
    upper: np.ndarray
    lower: np.ndarray  # vectors x centroids

    @staticmethod
    def new(n: int, k: int) -> State:
        return State(np.full(n, -1, np.int32), np.full(n, np.inf), np.zeros((n, k)))


def assign(v: np.ndarray, c: np.ndarray, s: State, moved: np.ndarray) -> int:
    """Bring ``s`` up to centroids ``c``, which ``moved`` that far (rounded up); returns how many distances were computed."""
    n, k = len(v), len(c)
    rows = np.arange(n)
    computed, wide = 0, is_wide(v, c)
    if n and s.cluster[0] < 0:
        s.cluster[:] = 0
    else:
        s.upper = _up(s.upper + moved[s.cluster])
        s.lower = _down(s.lower - moved[None, :])
    half = _down(_root(squared(c[:, None], c[None, :], wide)) / 2)
    nearest = np.where(np.eye(k, dtype=bool), np.inf, half).min(axis=1)
    best = np.zeros(n, object if wide else np.int64)  # squared distance to the own centroid, of rows that are not stale
    stale = np.ones(n, bool)
    open_ = s.upper >= nearest[s.cluster]
    for j in range(k):
        own = s.cluster
        look = open_ & (own != j) & (s.upper >= s.lower[:, j]) & (s.upper >= half[own, j])
        tighten = np.flatnonzero(look & stale)
        if len(tighten):
            best[tighten] = squared(v[tighten], c[own[tighten]], wide)
            exact = _root(best[tighten])
            s.upper[tighten], s.lower[tighten, own[tighten]] = _up(exact), _down(exact)
            stale[tighten] = False
            computed += len(tighten)
            look &= (s.upper >= s.lower[:, j]) & (s.upper >= half[own, j])
        at = rows[look]
        if not len(at):
            continue
        d2 = squared(v[at], c[j], wide)
        computed += len(at)
        exact = _root(d2)
        s.lower[at, j] = _down(exact)
        closer = (d2 < best[at]) | ((d2 == best[at]) & (j < own[at]))
        win = at[closer]
        s.cluster[win], s.upper[win], best[win] = j, _up(exact[closer]), d2[closer]
    return computed


def _sums(v: np.ndarray, cluster: np.ndarray, k: int) -> list[int]:
    """Per cluster the sums of the components, then the count; one flat list."""
    exact = v if not v.size or int(np.abs(v).max()) * len(v) < 2**62 else v.astype(object)
    out: list[int] = []
    for j in range(k):
        mine = exact[cluster == j]
        out += [int(x) for x in mine.sum(axis=0)] if len(mine) else [0] * v.shape[1]
        out.append(len(mine))
    return out


def _unpacked(row: dict, width: int, k: int) -> tuple[np.ndarray, np.ndarray, State]:
    ids = np.frombuffer(row["ids"], np.int64)
    small = len(row["vectors"]) == 4 * len(ids) * width
    v = np.frombuffer(row["vectors"], np.int32 if small else np.int64).reshape(len(ids), width).astype(np.int64)
    s = State(np.frombuffer(row["cluster"], np.int32).copy(), np.frombuffer(row["upper"]).copy(), np.frombuffer(row["lower"]).reshape(len(ids), k).copy())
    return ids, v, s


def _block(ids: np.ndarray, v: np.ndarray, s: State, k: int, computed: int) -> tuple:
    small = not v.size or np.abs(v).max() < 2**31
    return (ids.tobytes(), v.astype(np.int32 if small else np.int64).tobytes(), s.cluster.tobytes(), s.upper.tobytes(), s.lower.tobytes(), _sums(v, s.cluster, k), computed)


def _batch(row: tuple, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)


def _first_round(rows: DataFrame, c: np.ndarray, p: Params) -> DataFrame:
    out, k = arrow_schema(rows.sparkSession, BLOCKS), len(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, p.block):
                part = b.slice(at, p.block)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), p.width)
                s = State.new(len(ids), k)
                yield _batch(_block(ids, v, s, k, assign(v, c, s, np.zeros(k))), out)

    return rows.select("id", "v").mapInArrow(run, BLOCKS)


def _next_round(blocks: DataFrame, c: np.ndarray, moved: np.ndarray, p: Params) -> DataFrame:
    out, k = arrow_schema(blocks.sparkSession, BLOCKS), len(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, v, s = _unpacked({n: b.column(i)[r].as_py() for i, n in enumerate(b.schema.names)}, p.width, k)
                yield _batch(_block(ids, v, s, k, assign(v, c, s, moved)), out)

    return blocks.select("ids", "vectors", "cluster", "upper", "lower").mapInArrow(run, BLOCKS)


def moved_to(blocks: DataFrame, c: np.ndarray) -> np.ndarray:
    """The floors of the clusters' means; an empty cluster keeps its centroid."""
    totals = blocks.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    k, width = c.shape
    flat = np.zeros(k * (width + 1), np.int64)
    for r in totals.collect():  # clusters times (components + 1)
        flat[r.at] = r.x
    new = c.copy()
    for j, (*sums, n) in enumerate(flat.reshape(k, width + 1).tolist()):
        if n:
            new[j] = [s // n for s in sums]
    return new


ROWS = "vec_id long, cluster int, distance long"


def _distances(blocks: DataFrame, c: np.ndarray, p: Params) -> DataFrame:
    out, k = arrow_schema(blocks.sparkSession, ROWS), len(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, v, s = _unpacked({n: b.column(i)[r].as_py() for i, n in enumerate(b.schema.names)}, p.width, k)
                columns = [ids, s.cluster, squared(v, c[s.cluster], is_wide(v, c)).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, out)], schema=out)

    return blocks.select("ids", "vectors", "cluster", "upper", "lower").mapInArrow(run, ROWS)


def fit(rows: DataFrame, p: Params) -> tuple[DataFrame, np.ndarray, list[int]]:
    """ROWS after the last assignment, the final centroids, and the distances computed in each assignment."""
    spark = rows.sparkSession
    c = first_centroids(rows, p)
    if not len(c):
        return spark.createDataFrame([], ROWS), c, []
    base, held, computed = f"{shared_dir(spark)}/clusters-{uuid.uuid4().hex}", [], []

    def stored(df: DataFrame) -> DataFrame:
        """Write one round and drop the one before."""
        path = f"{base}-{len(computed)}"
        held.append(path)
        df.write.parquet(path)
        while len(held) > 1:
            remove(spark, held.pop(0))
        made = spark.read.schema(df.schema).parquet(path)
        computed.append(made.agg(F.sum("computed")).first()[0])
        return made

    try:
        blocks = stored(_first_round(rows, c, p))
        for _ in range(p.rounds):
            new = moved_to(blocks, c)
            moved = _up(_root(squared(new, c, is_wide(new, c))))
            c = new
            blocks = stored(_next_round(blocks, c, moved, p))
        return materialise(_distances(blocks, c, p), "clustered"), c, computed
    finally:
        for path in held:
            remove(spark, path)


def cluster(table: DataFrame, params: Params | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256: one row per vector that takes part."""
    p = params or Params()
    rows, c, _ = fit(quantise(table, p, id_col, vector_col), p)
    sums = {r.cluster: r.x for r in rows.groupBy("cluster").agg(F.sum("distance").alias("x")).collect()}  # one per cluster
    about = [(j, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j in sorted(sums)]
    table_of = rows.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table_of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
