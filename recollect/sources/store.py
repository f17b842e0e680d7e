"""A versioned table of memories: a version is a list of parts, and a write adds a part.

Parquet has no row updates. An insert writes the new rows as a part; an update, an archive, a patch or a delete writes the rows it
changes, as they are from then on, as a part that hides older rows of the same key. Readers take the newest version whose list
is written, lay the latest changes over the rows (a join with the changed keys, which are few) and never see half a
write. So a write costs what it changes; ``compact`` writes the table anew, which also happens once a version
has ``most_parts`` parts. One writer at a time is assumed. Paths go through Hadoop's file systems, so any store Spark reaches will do.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metadata import merged as merged_metadata
from ..model import THOUGHTS

_LIST = "_parts"


class VersionedTable:
    """Versions v1, v2, ... of one table under a root folder; the newest ``keep`` stay. ``key`` names a row."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, keep: int = 3, key: str = "id", most_parts: int = 32):
        self.spark, self.root, self.keep, self.key, self.most_parts = spark, root.rstrip("/"), keep, key, most_parts
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _folders(self) -> list[int]:
        fs, p = self._path(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def versions(self) -> list[int]:
        found = [n for n in self._folders() if self._path(f"{self.root}/v{n}")[0].exists(self._path(f"{self.root}/v{n}/{_LIST}")[1])]
        return found[-self.keep :]

    def parts(self, version: int) -> list[tuple[int, str]]:
        """Folder and kind (rows or changes) of every part, in the order of writing."""
        fs, p = self._path(f"{self.root}/v{version}/{_LIST}")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [(int(n), kind) for n, kind in (line.split() for line in text.splitlines())]

    def read(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], self.schema)
        parts = self.parts(known[-1] if version is None else version)
        load = lambda n, schema: self.spark.read.schema(schema).parquet(f"{self.root}/v{n}").withColumn("_at", F.lit(n))
        rows = reduce(DataFrame.unionByName, [load(n, self.schema) for n, kind in parts if kind == "rows"])
        changed = [load(n, T.StructType([*self.schema, T.StructField("_gone", T.BooleanType())])) for n, kind in parts if kind == "changes"]
        names = self.schema.fieldNames()
        if not changed:
            return rows.select(*names)
        every = F.struct(*names, "_gone", "_at")
        latest = reduce(DataFrame.unionByName, changed).groupBy(F.col(self.key).alias("_key")).agg(F.max_by(every, "_at").alias("x"))
        hidden = latest.select("_key", F.col("x._at").alias("_since"))
        old = rows.join(hidden, (rows[self.key] == hidden["_key"]) & (rows["_at"] < hidden["_since"]), "left_anti")
        return old.select(*names).unionByName(latest.where(~F.col("x._gone")).select(*[F.col("x").getField(c).alias(c) for c in names]))

    def _add(self, rows: DataFrame, kind: str, before: list[tuple[int, str]]) -> int:
        version = max(self._folders(), default=0) + 1
        fields = [*self.schema, *([T.StructField("_gone", T.BooleanType())] if kind == "changes" else [])]
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]).write.mode("overwrite").parquet(f"{self.root}/v{version}")
        fs, p = self._path(f"{self.root}/v{version}/{_LIST}.new")
        stream = fs.create(p, True)
        stream.write(bytearray("".join(f"{n} {k}\n" for n, k in [*before, (version, kind)]).encode()))
        stream.close()
        fs.rename(p, self._path(f"{self.root}/v{version}/{_LIST}")[1])
        used = {n for v in self.versions() for n, _ in self.parts(v)} | set(self.versions())
        for old in self._folders():
            if old not in used:
                fs.delete(self._path(f"{self.root}/v{old}")[1], True)
        return self.compact() if len(before) + 1 >= self.most_parts else version

    def _current(self) -> list[tuple[int, str]]:
        known = self.versions()
        return self.parts(known[-1]) if known else []

    def write(self, rows: DataFrame) -> int:
        """The whole table anew."""
        return self._add(rows, "rows", [])

    def compact(self) -> int:
        return self.write(self.read())

    def append(self, rows: DataFrame) -> int:
        """New rows; columns they lack are null."""
        for f in self.schema:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        return self._add(rows, "rows", self._current())

    def change(self, rows: DataFrame) -> int:
        """Rows as they are from now on, by key, whether there before or not; those with ``_gone`` set are deleted."""
        if not self._current():
            self.write(self.read())
        rows = rows if "_gone" in rows.columns else rows.withColumn("_gone", F.lit(False))
        return self._add(rows, "changes", self._current())


class Store(VersionedTable):
    """The memory table."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 3):
        super().__init__(spark, root, THOUGHTS, keep)

    def insert(self, rows: DataFrame, as_of: datetime) -> int:
        """Append; missing columns are null, and both times are ``as_of`` unless given."""
        for f in THOUGHTS:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        return self.append(rows.withColumns({"archived": F.coalesce("archived", F.lit(False)), "created_at": F.coalesce("created_at", F.lit(as_of)), "updated_at": F.coalesce("updated_at", F.lit(as_of))}))

    def _changed(self, where: Column, values: dict[str, Column], as_of: datetime) -> DataFrame:
        """The rows of ``where`` with new values."""
        return self.read().where(where).withColumns(values | {"updated_at": F.lit(as_of)})

    def replace(self, id: str, content: str, embedding: list[float] | None, metadata: dict, as_of: datetime) -> int:
        """Update by id: content, vector and all metadata columns; those not given become null."""
        columns = ("type", "topics", "people", "source", "origin", "source_file_hash", "code_hash")
        kinds = {f.name: f.dataType for f in self.schema}
        value = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)
        values = {c: value(metadata.get(c)).cast(kinds[c]) for c in columns}
        values |= {"content": F.lit(content), "embedding": value(embedding).cast(kinds["embedding"])}
        return self.update(id, values, as_of)

    def update(self, id: str, values: dict[str, Column], as_of: datetime) -> int:
        """Replace columns of one row; an unknown id raises."""
        row = self._changed(F.col("id") == id, values, as_of)
        if row.isEmpty():
            raise KeyError(id)
        return self.change(row)

    def archive(self, ids: list[str], as_of: datetime) -> int:
        return self.change(self._changed(F.col("id").isin(ids), {"archived": F.lit(True)}, as_of))

    def set_supersedes(self, id: str, loser: str, as_of: datetime) -> int:
        return self.change(self._changed(F.col("id") == id, {"supersedes": F.lit(loser)}, as_of))

    def delete(self, id: str, as_of: datetime) -> int:
        """Clear references to the row, and drop it."""
        freed = self._changed((F.col("supersedes") == id) & (F.col("id") != id), {"supersedes": F.lit(None)}, as_of).withColumn("_gone", F.lit(False))
        return self.change(freed.unionByName(self.read().where(F.col("id") == id).withColumn("_gone", F.lit(True))))

    def patch(self, changes: DataFrame, as_of: datetime) -> int:
        return self.change(patched(self.read().join(changes.select("id"), "id", "left_semi"), changes, as_of))

    def merge(self, canonical: DataFrame, as_of: datetime) -> int:
        """One version: the canonical rows in, their sources archived."""
        sources = canonical.select(F.explode("merged_from").alias("id"))
        return self.change(merged(self.read().join(sources, "id", "left_semi"), canonical, as_of))


def patched(rows: DataFrame, changes: DataFrame, as_of: datetime) -> DataFrame:
    """Rows with a patch table (id and any columns) laid over them, key by key; null patch values leave a column alone.

    Metadata is merged by its top-level keys, where a key given as null becomes null.
    """
    columns = [c for c in changes.columns if c not in ("id", "archive")]
    renamed = changes.withColumnsRenamed({c: f"new_{c}" for c in changes.columns if c != "id"}).withColumn("hit", F.lit(True))
    out = rows.join(renamed, "id", "left")
    values = {c: merged_metadata(F.col(c), F.col(f"new_{c}")) if c == "metadata" else F.coalesce(f"new_{c}", c) for c in columns}
    if "archive" in changes.columns:
        values["archived"] = F.coalesce("new_archive", "archived")
    values["updated_at"] = F.when(F.col("hit"), F.lit(as_of)).otherwise(F.col("updated_at"))
    return out.withColumns(values).select(*rows.columns)


def merged(rows: DataFrame, canonical: DataFrame, as_of: datetime) -> DataFrame:
    """Sources of ``canonical`` (with merged_from) archived, and the canonical rows added under the id merge-<cluster>."""
    gone = canonical.select(F.explode("merged_from").alias("id")).distinct().withColumn("archive", F.lit(True))
    new = canonical.withColumns({"id": F.concat(F.lit("merge-"), "cluster"), "archived": F.lit(False), "created_at": F.lit(as_of), "updated_at": F.lit(as_of)})
    for f in rows.schema:
        if f.name not in new.columns:
            new = new.withColumn(f.name, F.lit(None).cast(f.dataType))
    return patched(rows, gone, as_of).unionByName(new.select(*rows.columns))


def upserted(rows: DataFrame, new: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """``new`` replaces rows with its keys and adds the others: insert, on conflict update.

    With ``columns``, only those of a row that is there already are set, to what ``new`` has (null included); new keys come in whole.
    """
    if columns is not None:
        given = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{n}") for n, c in enumerate(columns)], F.lit(True).alias("_hit"))
        held = rows.join(given, rows[key] == given["_key"], "left")
        held = held.withColumns({c: F.when(F.col("_hit"), F.col(f"_{n}")).otherwise(F.col(c)) for n, c in enumerate(columns)}).select(*rows.columns)
        return held.unionByName(new.join(rows.select(key), key, "left_anti"), allowMissingColumns=True)
    return rows.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def consumed(codes: DataFrame, code: str, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """Single use: the row if it is unused and unexpired, and the table with it marked."""
    hit = (F.col("code") == code) & F.col("consumed_at").isNull() & (F.col("expires_at") > F.lit(as_of))
    return codes.where(hit), codes.withColumn("consumed_at", F.when(hit, F.lit(as_of)).otherwise(F.col("consumed_at")))


def purged(rows: DataFrame, as_of: datetime) -> DataFrame:
    """Rows that have not expired."""
    return rows.where(F.col("expires_at") > F.lit(as_of))
