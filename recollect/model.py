"""The memory table: schema, and the bridge view that derives it from the corpus tables.

One row is one retrievable idea. ``archived`` is nullable on purpose, and ``topics``/``people`` keep a missing
list (null) apart from an empty one, because operators treat the cases differently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The kinds a memory may have.
TYPES = (
    "observation", "task", "idea", "reference", "person_note", "decision", "meeting", "architecture", "pattern", "postmortem",
    "requirement", "bug", "convention",
)

THOUGHTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("content", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("type", T.StringType()),
        T.StructField("topics", T.ArrayType(T.StringType())),
        T.StructField("people", T.ArrayType(T.StringType())),
        T.StructField("source", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("source_file_hash", T.StringType()),
        T.StructField("code_hash", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("created_by", T.StringType()),
        T.StructField("archived", T.BooleanType()),
        T.StructField("supersedes", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("metadata", T.VariantType()),  # whatever keys have no column of their own
    ]
)

FALLBACK_TYPE = "observation"

_TOPICS = (None, [], ["market", "markets"], ["market-analysis"], ["market_analysis", "gold"], ["Market Analysis"], ["golds", "news"])
_PEOPLE = (None, [], ["Varkas"], ["Bert Varkas"], ["Ann Lee", "Varkas"], ["ann lee"])


#: Free metadata of a row: language, size, a flag, a list and an object. Filled in by both engines' printf.
_METADATA = '{"lang": "%s", "size": %d, "even": %s, "tags": ["all", "t%s"], "nested": {"rest": %s, "none": null}}'


def _pick(choices, key: Column, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for n, c in enumerate(choices):
        if c is not None:
            value = F.array(*[F.lit(x) for x in c]).cast(kind) if isinstance(c, list) else F.lit(c)
            out = F.when(key == n, value).otherwise(out)
    return out


def thoughts(spark: SparkSession, sf_dir: str, embedding: bool = False) -> DataFrame:
    """The bridge view. The embeddings table is joined only when asked for, so other plans never read vectors."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    d = d.join(labels, "doc_id", "left")
    if embedding:
        e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
        d = d.join(e, "doc_id", "left")
    else:
        d = d.withColumn("embedding", F.lit(None).cast("array<float>"))
    i = F.col("doc_id")
    created = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + i * 60)
    return d.select(
        i.cast("string").alias("id"),
        F.col("text").alias("content"),
        "embedding",
        F.when(i % 17 != 0, F.get(F.array(*[F.lit(t) for t in TYPES]), (i % 13).cast("int"))).alias("type"),
        _pick(_TOPICS, i % 7, "array<string>").alias("topics"),
        _pick(_PEOPLE, i % 6, "array<string>").alias("people"),
        "source",
        F.when(i % 4 == 0, F.lit("import")).alias("origin"),
        F.when(i % 9 < 2, F.concat(F.lit("h"), (i % 50).cast("string"))).alias("source_file_hash"),
        F.when(i % 8 == 3, F.concat(F.lit("c"), (i % 20).cast("string"))).alias("code_hash"),
        F.when(i % 5 != 0, F.concat(F.lit("proj"), (i % 3).cast("string"))).alias("project"),
        F.when(i % 7 != 0, F.concat(F.lit("user"), (i % 4).cast("string"))).alias("created_by"),
        F.when(i % 11 != 0, F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("archived"),
        F.when((i % 19 == 0) & (i > 0), (i - 1).cast("string")).alias("supersedes"),
        created.alias("created_at"),
        F.timestamp_seconds(F.unix_timestamp(created) + (i % 10) * 3600).alias("updated_at"),
        F.when(i % 13 != 0, F.parse_json(F.format_string(_METADATA, F.col("lang"), F.col("n_chars"), F.when(i % 2 == 0, "true").otherwise("false"), (i % 3).cast("string"), (i % 4).cast("string")))).alias("metadata"),
    )


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``content`` of every row of the bridge view, for plans that ask for nothing else. A row stands once for each of its labels there, and the join that
    tells how often would send every text through an exchange; here only the texts from the least to the greatest id with several labels go through one."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("content"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    least, greatest = (labels.agg(end("doc_id")).scalar() for end in (F.min, F.max))
    again = d.where(F.col("doc_id").between(least, greatest)).join(labels, "doc_id")
    return d.select("content").unionAll(again.select("content", F.explode(F.sequence(F.lit(2), "times"))).select("content"))


def _sql_list(c) -> str:
    return "[" + ", ".join(f"'{x}'" for x in c) + "]::VARCHAR[]"


def thoughts_sql() -> str:
    """The same view for DuckDB, as the body of a common table expression."""
    kinds = ", ".join(f"'{t}'" for t in TYPES)
    topics = " ".join(f"WHEN {n} THEN {_sql_list(c)}" for n, c in enumerate(_TOPICS) if c is not None)
    people = " ".join(f"WHEN {n} THEN {_sql_list(c)}" for n, c in enumerate(_PEOPLE) if c is not None)
    return f"""
    SELECT d.doc_id::VARCHAR AS id, d.text AS content, e.embedding,
           CASE WHEN d.doc_id % 17 <> 0 THEN [{kinds}][d.doc_id % 13 + 1] END AS type,
           CASE d.doc_id % 7 {topics} END AS topics, CASE d.doc_id % 6 {people} END AS people, d.source,
           CASE WHEN d.doc_id % 4 = 0 THEN 'import' END AS origin,
           CASE WHEN d.doc_id % 9 < 2 THEN 'h' || (d.doc_id % 50) END AS source_file_hash,
           CASE WHEN d.doc_id % 8 = 3 THEN 'c' || (d.doc_id % 20) END AS code_hash,
           CASE WHEN d.doc_id % 5 <> 0 THEN 'proj' || (d.doc_id % 3) END AS project,
           CASE WHEN d.doc_id % 7 <> 0 THEN 'user' || (d.doc_id % 4) END AS created_by,
           CASE WHEN d.doc_id % 11 <> 0 THEN coalesce(l.toxic = 1, false) END AS archived,
           CASE WHEN d.doc_id % 19 = 0 AND d.doc_id > 0 THEN (d.doc_id - 1)::VARCHAR END AS supersedes,
           TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id) AS created_at,
           TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id) + to_hours(d.doc_id % 10) AS updated_at,
           CASE WHEN d.doc_id % 13 <> 0 THEN printf('{_METADATA}', d.lang, d.n_chars, CASE WHEN d.doc_id % 2 = 0 THEN 'true' ELSE 'false' END, (d.doc_id % 3)::VARCHAR, (d.doc_id % 4)::VARCHAR)::JSON END AS metadata
    FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id
    """
