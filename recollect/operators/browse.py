"""Listing by metadata and time. A missing archive flag shows a row here, unlike in search."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import scratch


def visible(include_archived: bool = False) -> Column:
    return F.lit(True) if include_archived else ~F.coalesce(F.col("archived"), F.lit(False))


def listed(
    thoughts: DataFrame,
    type: str | None = None,
    topic: str | None = None,
    person: str | None = None,
    days: int | None = None,
    as_of: datetime | None = None,
    project: str | None = None,
    created_by: str | None = None,
    include_archived: bool = False,
    limit: int = 50,
) -> DataFrame:
    """The newest rows that fit every given filter; ``days`` of 0 or None sets no time bound, and needs ``as_of``."""
    rows = thoughts.where(visible(include_archived))
    for column, value in (("type", type), ("project", project), ("created_by", created_by)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    for column, value in (("topics", topic), ("people", person)):
        if value is not None:
            rows = rows.where(F.array_contains(column, value))
    if days:
        rows = rows.where(F.col("created_at") >= F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))
    return rows.select("id", "content", "type", "topics", "people", "source", "created_by", "created_at").orderBy(F.col("created_at").desc(), "id").limit(limit)


def by_source(thoughts: DataFrame, name: str, include_archived: bool = False, limit: int = 50) -> DataFrame:
    """Rows whose provenance origin or source is ``name``, newest first."""
    rows = thoughts.where((F.col("origin") == name) | (F.col("source") == name)).where(visible(include_archived))
    return rows.select("id", "content", "source", "origin", "project", "created_at").orderBy(F.col("created_at").desc(), "id").limit(limit)


def by_ids(thoughts: DataFrame, ids: list[str]) -> DataFrame:
    """The rows of a stated list of ids, archived ones included."""
    return thoughts.where(F.col("id").isin(ids)).select("id", "content", "archived", "project", "created_at")


def tagged(thoughts: DataFrame, field: str, values: list[str], project: str | None = None) -> DataFrame:
    """Live rows that carry any of the values in ``topics`` or ``people``; a project, if given, with '' for none."""
    if field not in ("topics", "people"):
        raise ValueError(f"not a tag field: {field}")
    rows = thoughts.where(F.col("archived") == F.lit(False)).where(F.arrays_overlap(field, F.array(*[F.lit(v) for v in values])))
    if project is not None:
        rows = rows.where(F.coalesce("project", F.lit("")) == project)
    return rows.select("id", "topics", "people", "project")


def lineage(thoughts: DataFrame, start: str, steps: int = 64) -> DataFrame:
    """id, supersedes and depth of a row and of what it supersedes, step by step, to the end of the chain; only ids are walked.

    A recursive statement walks ``steps`` rows (Spark bounds its depth); a longer chain is gone on with from where that ends, and
    each stretch is written. A chain that closes into a ring raises.
    """
    spark, links, found, seen, at = thoughts.sparkSession, thoughts.select("id", "supersedes"), None, set(), start
    with scratch(spark) as keep:
        while True:
            walked = spark.sql(
                """WITH RECURSIVE walk(id, supersedes, depth) AS (
                     SELECT id, supersedes, 0 FROM {links} WHERE id = :start
                     UNION ALL SELECT t.id, t.supersedes, w.depth + 1 FROM walk w JOIN {links} t ON t.id = w.supersedes WHERE w.depth + 1 < :steps)
                   SELECT id, supersedes, depth FROM walk""",
                args={"start": at, "steps": steps}, links=links,
            )
            walked = keep(walked, "lineage")
            offset = len(seen) * steps
            seen.add(at)
            part = walked.withColumn("depth", F.col("depth") + offset)
            found = part if found is None else found.unionByName(part)
            last = walked.where(F.col("depth") == steps - 1).select("supersedes").first()
            if last is None or last.supersedes is None:
                return found
            at = last.supersedes
            if at in seen:
                raise ValueError(f"the chain of {start} closes into a ring")
