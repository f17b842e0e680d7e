"""Approximate vector search: cells of a coarse quantiser, product-quantised residuals, exact re-ranking.

The index is a Parquet table partitioned by cell. A search reads the cells nearest to the query (a partition filter), sums
looked-up parts of the product from the codes (built-in expressions, no Python), and ranks the best of those again by
their exact cosine. So what it returns is exact in its similarities and may only miss rows.

Cells and codes are fitted on a sample: the rows whose ids hash least, ``sample`` of them or as many as ``sample_values``
components allow. Every row with a vector is indexed. How many cells a search reads is set when the index is built: exact
neighbours of some sampled rows are found, and the least number of cells that holds ``recall`` of them is kept.

Null vectors, zero ones, and those with a null or non-finite component are not indexed, as nothing is similar to them.
Vectors of another width than the sample's first raise an error. An empty table gives an index that finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import cosine, literal, norm, present
from . import neighbours
from .search import Scope


@dataclass(frozen=True)
class Params:
    cells: int = 256
    parts: int = 16
    codes: int = 256
    sample: int = 65_536
    sample_values: int = 16_000_000
    tuned_on: int = 64
    tuned_k: int = 10
    recall: float = 0.97
    refine: int = 20  # rows ranked exactly for each one returned
    file_rows: int = 1_000_000
    file_bytes: int = 64_000_000  # of texts and vectors, which one task sorts into files


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Lloyd's rounds on a bounded sample; an empty cluster takes the row that is furthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        far = np.argsort(-((x - c[own]) ** 2).sum(1), kind="stable")
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        c[empty] = x[far[: len(empty)]]
    return c


def _padded(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows cut into ``parts`` of one width, zeros behind."""
    step = -(-x.shape[1] // parts)
    out = np.zeros((len(x), parts * step))
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), parts, step)


MODEL = "width int, probe int, centroids array<array<double>>, codebooks array<array<array<double>>>"


class AnnIndex:
    """An index in a folder: ``rows`` (partitioned by cell) and ``model`` (one row)."""

    def __init__(self, spark: SparkSession, path: str, params: Params | None = None):
        self.spark, self.path, self.p = spark, path, params or Params()
        m = spark.read.schema(MODEL).parquet(f"{path}/model").first()
        self.width, self.probe = m.width, m.probe  # a width of 0: nothing is indexed
        self.centroids = np.array(m.centroids)
        self.codebooks = np.array(m.codebooks)  # parts x codes x step

    # building --------------------------------------------------------------------------

    @staticmethod
    def build(rows: DataFrame, path: str, params: Params | None = None) -> AnnIndex:
        """``rows``: id, embedding and whatever else a search filters by or returns."""
        p, spark = params or Params(), rows.sparkSession
        usable = rows.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
        usable = usable.where(norm(F.col("embedding")) > 0)
        total = usable.agg(F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(usable)).alias("bytes"), F.min_by(F.size("embedding"), F.struct(F.xxhash64("id"), "id")).alias("width")).first()
        width = total.width or 1
        n = min(p.sample, max(256, p.sample_values // width))
        taken = _least(usable.select("id", "embedding"), n, total.n)  # bounded by rows and components
        unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
        sample = unit(np.array([r.embedding for r in taken], np.float64)) if taken else np.zeros((1, width))
        centroids = k_means(sample, max(1, min(p.cells, len(sample) // 4)))
        residuals = _padded(sample - centroids[_nearest(sample, centroids)], p.parts)
        codebooks = np.stack([k_means(residuals[:, j], min(p.codes, len(sample)), 8, j) for j in range(p.parts)])

        coded = _coded(usable, width, centroids, codebooks)
        files = max(1, -(-total.n // p.file_rows), -(-(total.bytes or 0) // p.file_bytes))
        # by range of cell and id: a large cell is cut over tasks, and files are sorted by id
        coded.repartitionByRange(files, "cell", "id").sortWithinPartitions("cell", "id").write.partitionBy(*(["cell"] if taken else [])).parquet(f"{path}/rows")
        probe = _tuned(spark.createDataFrame([(r.id, r.embedding) for r in taken[: p.tuned_on]], "id string, embedding array<double>"), usable, spark.read.parquet(f"{path}/rows") if taken else None, centroids, p)
        spark.createDataFrame([(width if taken else 0, probe, centroids.tolist(), codebooks.tolist())], MODEL).coalesce(1).write.parquet(f"{path}/model")
        return AnnIndex(spark, path, p)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    # searching -------------------------------------------------------------------------

    def cells_of(self, query: np.ndarray, probe: int | None = None) -> list[int]:
        """The cells a search reads, the nearest first."""
        d = ((self.centroids - query) ** 2).sum(1)
        return np.argsort(d, kind="stable")[: probe or self.probe].tolist()

    def shortlist(self, query: Sequence[float], k: int, scope: Scope | None = None, probe: int | None = None) -> DataFrame:
        """id and approximate similarity of the best ``k * refine`` rows of the cells read."""
        q = np.array(query, np.float64)
        q = q / (np.linalg.norm(q) or 1.0)
        numbers = lambda x: "array(" + ",".join(f"{v!r}D" for v in x) + ")"
        tables = np.einsum("pd,pcd->pc", _padded(q[None], self.p.parts)[0], self.codebooks)
        parts = [F.expr(f"{numbers((self.centroids @ q).tolist())}[cell]")] + [F.expr(f"{numbers(t.tolist())}[code[{j}]]") for j, t in enumerate(tables)]
        about = parts[0]
        for x in parts[1:]:
            about = about + x
        read = self.rows().where(F.col("cell").isin(self.cells_of(q, probe))).where((scope or Scope()).condition())
        return read.select("id", "cell", about.alias("about")).orderBy(F.col("about").desc(), "id").limit(k * self.p.refine)

    def search(self, query: Sequence[float], k: int = 10, threshold: float = 0.5, scope: Scope | None = None, probe: int | None = None) -> DataFrame:
        """The rows of ``shortlist`` ranked by exact similarity, by id at ties: the index's columns and ``similarity``."""
        if not self.width:
            return self.rows().withColumn("similarity", F.lit(None).cast("double")).drop("cell", "code")
        if len(query) != self.width:
            raise ValueError(f"the index holds vectors of width {self.width}")
        listed = self.shortlist(query, k, scope, probe).select(F.col("id").alias("listed"), F.col("cell").alias("in_cell"))
        q = np.array(query, np.float64)
        read = self.rows().where(F.col("cell").isin(self.cells_of(q / (np.linalg.norm(q) or 1.0), probe)))
        # k * refine rows: a bounded broadcast
        found = read.join(F.broadcast(listed), (F.col("id") == F.col("listed")) & (F.col("cell") == F.col("in_cell")))
        found = found.withColumn("similarity", cosine(F.col("embedding"), literal(query))).where(present(F.col("similarity"), threshold))
        return found.orderBy(F.col("similarity").desc(), "id").limit(k).drop("cell", "code", "listed", "in_cell")

    def neighbours(self, asked: DataFrame, k: int = 10, threshold: float = -1.0, scope: Scope | None = None, probe: int | None = None) -> DataFrame:
        """a, b, similarity: the k best of every asked row (id, embedding). Cells that no asked row reads are not scanned; a row finds itself."""
        usable = asked.where(F.col("embedding").isNotNull() & (norm(F.col("embedding")) > 0)).select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
        found = None
        for rows in _asked_blocks(usable, self.width) if self.width else ():
            q = np.array([r.embedding for r in rows], np.float64).reshape(len(rows), self.width)
            q /= np.linalg.norm(q, axis=1, keepdims=True)
            probed = np.zeros((len(q), len(self.centroids)), bool)
            for i, x in enumerate(q):
                probed[i, self.cells_of(x, probe)] = True
            read = self.rows().where(F.col("cell").isin(np.flatnonzero(probed.any(axis=0)).tolist())).where((scope or Scope(include_archived=True)).condition())
            some = _scanned(read, [r.id for r in rows], q, probed, self.centroids, self.codebooks, k, self.p.refine)
            ranked = Window.partitionBy("a").orderBy(F.round("similarity", 12).desc(), "b")
            some = some.where(F.col("similarity") >= threshold).withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k).drop("n")
            found = some if found is None else found.unionByName(some)
        return found if found is not None else self.spark.createDataFrame([], "a string, b string, similarity double")


def _row_bytes(rows: DataFrame) -> Column:
    """About what a row takes: its texts and arrays."""
    out = F.lit(64)
    for f in rows.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            out = out + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            out = out + 8 * F.coalesce(F.size(F.col(f"`{f.name}`")), F.lit(0))
    return out.cast("long")


def _least(rows: DataFrame, n: int, total: int) -> list:
    """The ``n`` rows (id, embedding) of ``total`` whose ids hash least. Only rows under a hash that about twice as many have go to the one task that
    orders them, however many tasks there are."""
    by_hash = lambda df: df.orderBy(F.xxhash64("id"), "id").limit(n).collect()
    if total > 2 * n:
        taken = by_hash(rows.where(F.xxhash64("id") < F.lit(-(2**63) + 2**64 * 2 * n // total)))
        if len(taken) == n:
            return taken
    return by_hash(rows)


#: Of asked vectors that a job gives to every task, about.
ASKED_BYTES = 32_000_000


def _asked_blocks(asked: DataFrame, width: int) -> Iterator[list]:
    """Asked rows (id, embedding) in groups of at most ASKED_BYTES, by a hash of the id; groups' sizes are counted first."""
    groups = max(1, -(-asked.count() * width * 8 // ASKED_BYTES))
    dealt = asked.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)))
    for g in range(groups):
        rows = dealt.where(F.col("group") == g).select("id", "embedding").collect()
        if rows:
            yield rows


def _scanned(rows: DataFrame, ids: list, q: np.ndarray, probed: np.ndarray, centroids: np.ndarray, codebooks: np.ndarray, k: int, refine: int) -> DataFrame:
    """a, b, similarity: of every batch of index rows the best for each asked row that reads their cell."""
    tables = np.einsum("apd,pcd->apc", _padded(q, len(codebooks)), codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.arange(len(codebooks))
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            cells = batch.column(1).to_numpy(zero_copy_only=False).astype(int)
            codes = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(int).reshape(len(names), len(codebooks))
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(names), -1)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            a, b, v = [], [], []
            for i in np.flatnonzero(probed[:, np.unique(cells)].any(axis=1)).tolist():
                mine = np.flatnonzero(probed[i, cells])
                about = (centroids @ q[i])[cells[mine]] + tables[i][part, codes[mine]].sum(axis=1)
                mine = mine[_top(about, k * refine)]
                exact = x[mine] @ q[i]
                best = np.lexsort((names[mine], -np.round(exact, 12)))[:k]
                a += [ids[i]] * len(best)
                b += names[mine[best]].tolist()
                v += exact[best].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(v, pa.float64())], names=["a", "b", "similarity"])

    return rows.select("id", "cell", "code", "embedding").mapInArrow(run, "a string, b string, similarity double")


def _top(scores: np.ndarray, n: int) -> np.ndarray:
    return np.argpartition(-scores, n - 1)[:n] if n < len(scores) else np.arange(len(scores))


def _coded(rows: DataFrame, width: int, centroids: np.ndarray, codebooks: np.ndarray) -> DataFrame:
    """The rows with ``cell`` and ``code`` (one number a part). Only vectors go to Python."""
    parts = len(codebooks)
    kind = pa.struct([("cell", pa.int32()), ("code", pa.list_(pa.int16()))])

    @F.arrow_udf("cell int, code array<smallint>")
    def place(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(flat) != len(column) * width:
                raise ValueError(f"the index holds vectors of width {width} only")
            x = flat.reshape(len(column), width)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            cell = _nearest(x, centroids)
            rest = _padded(x - centroids[cell], parts)
            code = np.stack([_nearest(rest[:, j], codebooks[j]) for j in range(parts)], axis=1).astype(np.int16)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * parts + 1, parts), pa.int32()), pa.array(code.ravel()))
            yield pa.StructArray.from_arrays([pa.array(cell, pa.int32()), codes], fields=list(kind))

    placed = rows.withColumn("_at", place("embedding"))
    return placed.withColumns({"cell": F.col("_at.cell"), "code": F.col("_at.code")}).drop("_at")


def _tuned(asked: DataFrame, rows: DataFrame, indexed: DataFrame | None, centroids: np.ndarray, p: Params) -> int:
    """The least number of cells that holds the share ``recall`` of the exact neighbours of ``asked``."""
    if indexed is None:
        return 1
    asked_rows = asked.collect()  # tuned_on at most
    none = F.lit(None).cast("string").alias("project")
    true = neighbours.nearest(asked.select("id", none, "embedding"), rows.select("id", none, "embedding"), p.tuned_k, -1.0)
    cells = true.join(indexed.select(F.col("id").alias("b"), "cell"), "b").select("a", "cell").collect()  # tuned_on * tuned_k
    place = {}
    for r in asked_rows:
        q = np.array(r.embedding) / np.linalg.norm(r.embedding)
        place[r.id] = np.argsort(np.argsort(((centroids - q) ** 2).sum(1), kind="stable"))
    ranks = np.sort([place[r.a][r.cell] for r in cells])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(p.recall * len(ranks))) - 1)]) + 1 if len(ranks) else 1
