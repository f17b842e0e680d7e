"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The tables of the innermost ``scratch`` block, or None outside of any.
_HELD: ContextVar[list[str] | None] = ContextVar("held", default=None)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session has it; a folder of our own only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or "/tmp/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    The table goes when the ``scratch`` block around ends, else with the interpreter.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = _HELD.get()
    if held is None:
        atexit.register(remove, spark, path)
    else:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose tables are removed at its end. It yields ``materialise`` for what outlives it, which is then read from no table inside."""
    outer = _HELD.get()
    held: list[str] = []

    def result(df: DataFrame, name: str) -> DataFrame:
        token = _HELD.set(outer)
        try:
            return materialise(df, name)
        finally:
            _HELD.reset(token)

    token = _HELD.set(held)
    try:
        yield result
    finally:
        _HELD.reset(token)
        for path in held:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # at exit the session may be gone; the folder then goes with the cluster's
        pass
