"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import materialise, scratch  # noqa: F401

#: Maps ASCII capitals to small letters and leaves all other bytes alone.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: White space as the contracts define it: a blank and code points 9 to 13.
SPACE_RUN = "[ \\t-\\r]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def named(column: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def kept_struct(docs: DataFrame, keep: list[str]) -> Column:
    """The columns ``keep`` as one struct with fields c0, c1, ..., so that names of the input cannot clash or be misread."""
    return F.struct(*[named(c).alias(f"c{n}") for n, c in enumerate(keep)])


def unkept(docs: DataFrame, instead: dict[str, Column] | None = None, struct: str = "kept_columns") -> list[Column]:
    """The input's columns from ``kept_struct(docs, docs.columns)``, some of them replaced."""
    return [(instead or {}).get(c, F.col(f"{struct}.c{n}")).alias(c) for n, c in enumerate(docs.columns)]


def before_each(values: Column, join: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each element what ``join`` makes of all elements before it, from ``zero``.

    An appended array is copied at each step, so the elements are folded in blocks of about the cube root of their
    number: n elements cost n ** (4 / 3) copies, not n * n.
    """
    kind = "array<bigint>"

    def fold(part: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct(join(acc["all"], x).alias("all"), F.array_append(acc["at"], acc["all"]).alias("at"))

        return F.aggregate(part, F.struct(zero.alias("all"), F.array().cast(kind).alias("at")), step, lambda acc: acc["at"])

    def blocked(all_values: Column, width: Column) -> Column:
        def together(blocks: Column) -> Column:
            wholes = F.transform(blocks, lambda b: F.aggregate(b, zero, join))
            return let(fold(wholes), lambda heads: F.flatten(F.transform(blocks, lambda b, i: F.transform(fold(b), lambda x: join(F.get(heads, i), x)))))

        last = F.floor((F.size(all_values) - 1) / width).cast("int")
        return let(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(all_values, i * width + 1, width)), together)

    def bound(v: Column) -> Column:
        return F.when(F.size(v) == 0, F.array().cast(kind)).otherwise(let(F.ceil(F.cbrt(F.size(v))).cast("int") + 3, lambda width: blocked(v, width)))

    return let(values, bound)


def map_texts(
    df: DataFrame,
    make_rows: Callable[[], Callable[[list, list], list[list]]],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One output row per input row, made in Arrow batches; null texts become empty.

    ``make_rows`` runs once per task and returns a function from ids and texts to output columns.
    Only the two named columns are read, so further columns cannot clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = make_rows()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            columns = rows(ids, texts)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    out = arrow_schema(df.sparkSession, schema)
    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
