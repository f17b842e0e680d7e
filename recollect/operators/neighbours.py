"""Exact nearest neighbours of many rows at once by metric partitioning, and the edges of the similarity graph.

A cosine of t between two unit vectors is a distance of sqrt(2 - 2 t). So the triangle inequality tells, from distances to
a few pivots, which vectors cannot reach the threshold, and the join leaves those out:

* The asked rows are dealt to their nearest pivots (a bounded sample of them) and packed into blocks of one pivot. A
  block knows its radius. A corpus vector further from the block's pivot than radius and threshold allow is not compared.
* Few asked rows (their packed bytes are counted first) go to every task; the corpus is read where it lies, once.
* Many asked rows: the corpus is dealt to pivots as well and packed into parts by range of (pivot, distance), so that
  a popular pivot is cut into shells, not held by one task. Every block lists the window of distances around each pivot
  that it can reach (border vectors are so listed under several), and an equi-join on the pivot with these windows names
  the pairs of block and part that meet. Only those move.

Every bound is loosened by SLACK, so the result is exact. Vectors without structure (all about equally far apart) are
compared in full, as no bound holds there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..plans.storage import materialise

BLOCK, PART = 512, 8192
#: Packed bytes of asked rows that are given to every task.
SMALL_BYTES = 32_000_000
#: Rows and components that pivots are chosen from, and pivots.
PIVOT_SAMPLE, PIVOT_VALUES, PIVOTS = 4096, 4_000_000, 256
SLACK = 1e-6

_DEALT = "id string, scope string, cell int, away double, vector binary"
_PACKED = "names array<string>, scope array<string>, cell int, low double, high double, vectors binary, near array<double>, far array<double>, gap array<double>"


@dataclass(frozen=True)
class Pivots:
    """Unit vectors that rows are dealt to, of the width of all."""

    rows: np.ndarray
    single: bool  # whether components are floats, kept as such

    @property
    def width(self) -> int:
        return self.rows.shape[1]

    @property
    def kind(self):
        return np.float32 if self.single else np.float64

    def away(self, x: np.ndarray) -> np.ndarray:
        """Distances of unit rows (which may have components beyond the pivots' width) to the pivots."""
        d = 1 + (self.rows * self.rows).sum(1)[None, :] - 2 * x @ self.rows.T
        return np.sqrt(np.maximum(d, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths; a zero row, or one with a component that is no number, becomes nan throughout."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(1))[:, None]


def _chosen(asked: DataFrame, single: bool, width: int) -> Pivots:
    """Pivots among the asked rows whose ids hash least: each next one is the row furthest from those before."""
    n = min(PIVOT_SAMPLE, max(64, PIVOT_VALUES // max(width, 1)))
    taken = asked.orderBy(F.xxhash64("id"), "id").limit(n).collect()  # bounded by rows and components
    x = np.zeros((len(taken), width))
    for i, r in enumerate(taken):
        x[i, : len(r.embedding)] = [v if v is not None else np.nan for v in r.embedding]
    x = _unit(x)
    x = x[np.isfinite(x).all(1)]
    if not len(x):
        return Pivots(np.zeros((1, width)), single)
    found, d = [0], ((x - x[0]) ** 2).sum(1)
    while len(found) < min(PIVOTS, len(x) // 8) and d.max() > 1e-12:
        found.append(int(np.argmax(d)))
        d = np.minimum(d, ((x - x[found[-1]]) ** 2).sum(1))
    return Pivots(x[found], single)


def _matrix(raw: list[bytes], pivots: Pivots) -> np.ndarray:
    return np.frombuffer(b"".join(raw), pivots.kind).reshape(len(raw), pivots.width).astype(np.float64)


def _dealt(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """Rows (id, scope, embedding) with their pivot, the distance to it, and the packed vector; zero and broken vectors go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.zeros((b.num_rows, pivots.width), pivots.kind)
            for i, v in enumerate(b.column(2).to_pylist()):
                x[i, : len(v)] = [c if c is not None else np.nan for c in v]
            unit = _unit(x.astype(np.float64))
            good = np.flatnonzero(np.isfinite(unit).all(1))
            if not len(good):
                continue
            d = pivots.away(unit[good])
            cell = d.argmin(1)
            ids, scope = b.column(0).take(pa.array(good)), b.column(1).take(pa.array(good))
            away = d[np.arange(len(good)), cell]
            vectors = pa.array([x[i].tobytes() for i in good], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.cast(pa.string()), scope.cast(pa.string()), pa.array(cell, pa.int32()), pa.array(away), vectors], names=["id", "scope", "cell", "away", "vector"])

    return rows.mapInArrow(run, _DEALT)


def _packed(dealt: DataFrame, size: int, pivots: Pivots, windows: bool) -> DataFrame:
    """Consecutive rows of one pivot in rows of at most ``size``. ``windows`` adds what a block can be away from each pivot, and
    by how much less any of its rows is away from its own than from each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            near = far = gap = None
            if windows:
                d = pivots.away(_unit(_matrix([r[4] for r in held], pivots)))
                own = d[:, held[0][2]]
                near, far, gap = d.min(0).tolist(), d.max(0).tolist(), (d - own[:, None]).min(0).tolist()
            away = [r[3] for r in held]
            row = ([r[0] for r in held], [r[1] for r in held], held[0][2], min(away), max(away), b"".join([r[4] for r in held]), near, far, gap)
            doubles = pa.list_(pa.float64())
            kinds = [pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.float64(), pa.float64(), pa.binary(), doubles, doubles, doubles]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[c.split()[0] for c in _PACKED.split(", ")])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (row[2] != held[0][2] or len(held) >= size):
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    return dealt.select("id", "scope", "cell", "away", "vector").mapInArrow(run, _PACKED)


FOUND = "a string, b string, similarity double, compared long"


def _meet(block: dict, names: np.ndarray, scope: np.ndarray, unit: np.ndarray, pivots: Pivots, k: int, threshold: float) -> tuple[list, list, list, int]:
    """The best ``k`` of each of the block's rows among these, and how many products that took."""
    reach = np.sqrt(max(0.0, 2 - 2 * threshold))
    live = np.arange(len(unit))
    if reach < 2:
        pivot = pivots.rows[block["cell"]]
        d = np.sqrt(np.maximum(1 + (pivot * pivot).sum() - 2 * unit @ pivot, 0))
        live = np.flatnonzero((d <= block["high"] + reach + SLACK) & (d >= block["low"] - reach - SLACK))
    a, b, v = [], [], []
    if len(live):
        s = block["unit"] @ unit[live].T
        for i, (name, own) in enumerate(zip(block["names"], block["scope"])):
            ok = s[i] >= threshold
            if own is not None:
                ok &= scope[live] == own
            hit = np.flatnonzero(ok)
            if len(hit):
                order = np.lexsort((names[live[hit]], -np.round(s[i, hit], 12)))[:k]
                hit = hit[order]
                a += [name] * len(hit)
                b += names[live[hit]].tolist()
                v += s[i, hit].tolist()
    return a, b, v, len(block["names"]) * len(live)


def _batch(a: list, b: list, v: list, compared: int) -> pa.RecordBatch:
    counts = [0] * len(a)
    if counts:
        counts[0] = compared
    else:  # the number of products goes along in a row of its own
        a, b, v, counts = [None], [None], [None], [compared]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(v, pa.float64()), pa.array(counts, pa.int64())], names=["a", "b", "similarity", "compared"])


def _block(row: dict, pivots: Pivots) -> dict:
    x = _unit(np.frombuffer(row["vectors"], pivots.kind).reshape(len(row["names"]), -1).astype(np.float64))
    return row | {"unit": np.pad(x, ((0, 0), (0, pivots.width - x.shape[1])))}


def _everywhere(rows: DataFrame, blocks: list[dict], pivots: Pivots, k: int, threshold: float) -> DataFrame:
    """Blocks that every task is given meet the rows (id, scope, embedding) where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [_block(b, pivots) for b in blocks]
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                vectors = part.column(2).to_pylist()
                x = np.zeros((part.num_rows, max([pivots.width, *map(len, vectors)])))
                for i, v in enumerate(vectors):
                    x[i, : len(v)] = [c if c is not None else np.nan for c in v]
                unit = _unit(x)[:, : pivots.width]  # asked rows have nothing beyond
                good = np.isfinite(unit).all(1)
                names, scope = np.array(part.column(0).to_pylist(), object)[good], np.array(part.column(1).to_pylist(), object)[good]
                for block in ready:
                    yield _batch(*_meet(block, names, scope, unit[good], pivots, k, threshold))

    return rows.mapInArrow(run, FOUND)


def _paired(blocks: DataFrame, parts: DataFrame, pivots: Pivots, k: int, threshold: float) -> DataFrame:
    """Blocks meet the parts that their windows name."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    window = F.explode(F.transform(F.arrays_zip("near", "far", "gap"), lambda x, i: F.struct(i.alias("cell"), x["near"].alias("near"), x["far"].alias("far"), x["gap"].alias("gap"))))
    asked = blocks.select("block", window.alias("w")).select("block", "w.*")
    # a row of another pivot's cell is nearer to that pivot than to the block's: half the difference bounds the distance
    asked = asked.where(F.col("gap") / 2 <= reach + SLACK)
    held = parts.select("part", "cell", "low", "high")
    met = asked.join(held, "cell").where((F.col("low") <= F.col("far") + reach + SLACK) & (F.col("high") >= F.col("near") - reach - SLACK)).select("block", "part")
    left = blocks.select("block", *[F.col(c).alias(f"q_{c}") for c in ("names", "scope", "cell", "low", "high", "vectors")])
    pairs = met.join(left, "block").join(parts.select("part", "names", "scope", "vectors"), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x = {n: c[r].as_py() for n, c in zip(batch.schema.names, batch.columns)}
                block = _block({c[2:]: x[c] for c in x if c.startswith("q_")}, pivots)
                unit = _unit(np.frombuffer(x["vectors"], pivots.kind).reshape(len(x["names"]), pivots.width).astype(np.float64))
                yield _batch(*_meet(block, np.array(x["names"], object), np.array(x["scope"], object), unit, pivots, k, threshold))

    return pairs.drop("block", "part").mapInArrow(run, FOUND)


def met(asked: DataFrame, corpus: DataFrame, k: int, threshold: float, per_project: bool = False, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """FOUND: what every meeting found, at most ``k`` for each asked row, and the products it computed (in its first row)."""
    spark = asked.sparkSession
    ready = lambda df, s: df.where(F.col("embedding").isNotNull()).select(F.col("id").cast("string").alias("id"), s.cast("string").alias("scope"), "embedding")
    few = materialise(ready(asked, F.col("project") if per_project else F.lit(None)), "asked")
    rows = ready(corpus, F.col("project"))
    extent = lambda df: df.agg(F.max(F.size("embedding")).alias("width"), F.count(F.lit(1)).alias("n")).first()
    single = not any(isinstance(df.schema["embedding"].dataType.elementType, DoubleType) for df in (few, rows))
    size = extent(few)
    pivots = _chosen(few, single, size.width or 1)
    dealt = _dealt(few, pivots).repartitionByRange(max(1, -(-size.n // (16 * BLOCK))), "cell", "away", "id").sortWithinPartitions("cell", "away", "id")
    blocks = materialise(_packed(dealt, BLOCK, pivots, True), "blocks")
    if (blocks.agg(F.sum(F.octet_length("vectors"))).first()[0] or 0) <= small_bytes:
        given = [r.asDict() for r in blocks.select("names", "scope", "cell", "low", "high", "vectors").collect()]  # of checked size
        return _everywhere(rows, given, pivots, k, threshold)
    blocks = blocks.withColumn("block", F.monotonically_increasing_id())
    size = extent(rows)
    wide = Pivots(np.pad(pivots.rows, ((0, 0), (0, max(0, (size.width or 1) - pivots.width)))), single)
    shells = _dealt(rows, wide).repartitionByRange(max(1, -(-size.n // (16 * PART))), "cell", "away", "id").sortWithinPartitions("cell", "away", "id")
    parts = materialise(_packed(shells, PART, wide, False).withColumn("part", F.monotonically_increasing_id()), "shells")
    return _paired(blocks, parts, wide, k, threshold)


def nearest(asked: DataFrame, corpus: DataFrame, k: int, threshold: float, per_project: bool = False, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """a, b, similarity: for every asked row its ``k`` most similar corpus rows at or over ``threshold``.

    Both sides: id, project, embedding. Ties go to the smaller id, and a row finds itself. With ``per_project`` an asked
    row with a project only sees rows of that project; one without sees all. Null and zero vectors find nothing, nor are they found.
    """
    best = met(asked, corpus, k, threshold, per_project, small_bytes).where(F.col("a").isNotNull()).drop("compared")
    ranked = Window.partitionBy("a").orderBy(F.round("similarity", 12).desc(), "b")
    return best.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k).drop("n")


def edges(candidates: DataFrame, corpus: DataFrame, threshold: float = 0.8, k: int = 6) -> DataFrame:
    """Directed neighbour edges of the candidates: ``k`` counts the row itself, which is dropped afterwards."""
    live = corpus.where(F.col("archived") == F.lit(False))
    return nearest(candidates, live, k, threshold, per_project=True).where("a <> b")


def duplicates(batch: DataFrame, corpus: DataFrame, threshold: float = 0.9) -> DataFrame:
    """a, b, similarity: the one most similar stored row of each batch row, if it reaches the threshold.

    Each item meets stored rows only, never its own batch.
    """
    return nearest(batch, corpus.where(F.col("archived") == F.lit(False)), 1, threshold)
