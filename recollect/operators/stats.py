"""Corpus statistics. Totals and histograms count archived rows; the vocabulary counts live rows only."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scoped(thoughts: DataFrame, project: str | None = None, created_by: str | None = None) -> DataFrame:
    for column, value in (("project", project), ("created_by", created_by)):
        if value is not None:
            thoughts = thoughts.where(F.col(column) == value)
    return thoughts


def totals(thoughts: DataFrame) -> DataFrame:
    """Count and date range in one aggregate."""
    return thoughts.agg(F.count(F.lit(1)).alias("total"), F.min("created_at").alias("earliest"), F.max("created_at").alias("latest"))


def types(thoughts: DataFrame) -> DataFrame:
    return thoughts.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def top_values(thoughts: DataFrame, field: str, limit: int = 10) -> DataFrame:
    """The most frequent entries of a list column, ties by value."""
    counted = thoughts.select(F.explode(field).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), "value").limit(limit)


def distinct_topics(thoughts: DataFrame, project: str | None = None, limit: int = 500) -> DataFrame:
    return top_values(scoped(thoughts, project), "topics", limit)


def vocabulary(thoughts: DataFrame, project: str) -> DataFrame:
    """field, value, n over live rows: topics of one project ('' for none), people of all projects."""
    live = thoughts.where(F.col("archived") == F.lit(False))
    topics = live.where(F.coalesce("project", F.lit("")) == project).select(F.lit("topics").alias("field"), F.explode("topics").alias("value"))
    people = live.select(F.lit("people").alias("field"), F.explode("people").alias("value"))
    return topics.unionByName(people).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def projects(thoughts: DataFrame) -> DataFrame:
    return thoughts.where(F.col("archived") == F.lit(False)).select(F.coalesce("project", F.lit("")).alias("project")).distinct()


def combined(thoughts: DataFrame, project: str | None = None, created_by: str | None = None) -> DataFrame:
    """One row: total, date range, type histogram, ten most used topics and people."""
    rows = scoped(thoughts, project, created_by)

    def folded(df: DataFrame, name: str) -> DataFrame:
        entries = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(df.columns[0]).alias("v"))))
        return df.agg(F.transform(entries, lambda x: F.concat_ws(":", x["v"], (-x["m"]).cast("string"))).alias(name))

    out = totals(rows)
    for part in (folded(types(rows), "types"), folded(top_values(rows, "topics"), "topics"), folded(top_values(rows, "people"), "people")):
        out = out.join(F.broadcast(part))  # one row each
    return out


def with_pending(combined: DataFrame, proposals: DataFrame, project: str, as_of: datetime) -> DataFrame:
    """The row of ``combined`` with the project's open, unexpired proposal: ``pending`` (id, expires_at, n_items), null for none; the newest, if several."""
    open_ = proposals.where((F.col("project") == project) & (F.col("status") == "open") & (F.col("expires_at") > F.lit(as_of)))
    newest = open_.agg(F.max_by(F.struct("id", "expires_at", F.size("items").cast("long").alias("n_items")), F.struct("created_at", "id")).alias("pending"))
    return combined.join(F.broadcast(newest))  # one row each
