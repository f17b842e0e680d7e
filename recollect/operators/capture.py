"""The write path: validation, discipline, duplicate check and the outcome of a batch, as columns.

A batch is a DataFrame of raw items: content, type, topics, people, source, project, created_by, supersedes, and the
extracted_type / extracted_topics / extracted_people an extractor proposed. Invalid rows carry an ``error`` and
take no part in what follows; nothing is dropped silently.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.embed import truncated
from ..functions.labels import is_uuid, normalise_topic
from ..model import FALLBACK_TYPE, TYPES
from .neighbours import duplicates
from .vocabulary import resolved


@dataclass(frozen=True)
class Discipline:
    person_aliases: Mapping[str, str] = field(default_factory=dict)
    self_names: tuple[str, ...] = ()
    topic_aliases: Mapping[str, str] = field(default_factory=dict)
    require_specific_type: bool = True
    require_known_topics: bool = False
    require_project: bool = False
    default_project: str = "personal"
    dedupe_enabled: bool = True
    dedupe_threshold: float = 0.9
    default_source: str = "api"

    def __post_init__(self):
        if not 0 <= self.dedupe_threshold <= 1:
            raise ValueError("dedupe_threshold must lie between 0 and 1")


def validated(batch: DataFrame, default_source: str = "api", byte_limit: int = 6000) -> DataFrame:
    """``error`` (null if fine), ``warnings``, and defaults filled in. Bodies as JSON are taken apart by ``intake``."""
    error = F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "content is required").when(
        F.col("supersedes").isNotNull() & ~is_uuid(F.col("supersedes")) & ~F.col("supersedes").rlike("^[0-9]+$"), "supersedes must be an id"
    )
    warnings = F.array_compact(F.array(F.when(truncated(F.col("content"), byte_limit), F.lit("embedding_truncated"))))
    return batch.withColumns({"source": F.coalesce("source", F.lit(default_source)), "error": error, "warnings": warnings})


def resolved_type(given: Column, extracted: Column, strict: bool) -> tuple[Column, Column]:
    """(type, error): a given type must be one of the kinds; else the extracted one, whatever it is, or the fallback if that is allowed."""
    kinds = [F.lit(t) for t in TYPES]
    chosen = F.coalesce(given, extracted, F.lit(FALLBACK_TYPE))
    error = F.when(given.isNotNull() & ~given.isin(*kinds), F.lit("unknown type"))
    if strict:
        error = F.coalesce(error, F.when(given.isNull() & (chosen == FALLBACK_TYPE), F.lit("a specific type is required")))
    return chosen, error


def resolved_project(project: Column, rules: Discipline) -> tuple[Column, Column]:
    blank = F.trim(F.coalesce(project, F.lit(""))) == ""
    default = F.lit(rules.default_project or None).cast("string")
    if rules.require_project:
        return F.when(~blank, project), F.when(blank, F.lit("a project is required"))
    return F.when(blank, default).otherwise(project), F.lit(None).cast("string")


def disciplined(batch: DataFrame, known_topics: list[str], rules: Discipline) -> DataFrame:
    """Type, topics, people and project by the rules. Caller lists override extracted ones; the first violation is the error."""
    kind, kind_error = resolved_type(F.col("type"), F.col("extracted_type"), rules.require_specific_type)
    project, project_error = resolved_project(F.col("project"), rules)
    topics = resolved(F.coalesce("topics", "extracted_topics"), rules.topic_aliases, known_topics, True)
    people = resolved(F.coalesce("people", "extracted_people"), rules.person_aliases, None, False, rules.self_names)
    known = F.array_distinct(F.transform(F.array(*[F.lit(t) for t in known_topics]).cast("array<string>"), normalise_topic))
    unknown = F.array_except(topics, known)
    gate = F.when(F.size(unknown) > 0, F.concat(F.lit("unknown topics: "), F.array_join(unknown, ", "))) if rules.require_known_topics else F.lit(None).cast("string")
    return batch.withColumns(
        {"type": kind, "topics": topics, "people": people, "project": project, "unknown_topics": unknown, "error": F.coalesce("error", kind_error, gate, project_error)}
    )


def outcomes(batch: DataFrame, corpus: DataFrame, known_topics: list[str], rules: Discipline, embedder=None) -> DataFrame:
    """Every item with ``status``: written, duplicate (with ``duplicate_of`` and ``similarity``) or rejected (with ``error``).

    ``batch`` has an ``id``; its ``embedding`` is made by ``embedder`` where missing. Items that force or supersede skip the duplicate check.
    """
    checked = disciplined(validated(batch, rules.default_source), known_topics, rules)
    if embedder is not None:
        checked = checked.withColumn("embedding", embedder(F.col("content")))
    skip = F.coalesce(F.col("force"), F.lit(False)) if "force" in batch.columns else F.lit(False)
    if rules.dedupe_enabled:
        asked = checked.where(F.col("error").isNull() & ~skip & F.col("supersedes").isNull()).select("id", "project", "embedding")
        found = duplicates(asked, corpus, rules.dedupe_threshold).select(F.col("a").alias("id"), F.col("b").alias("duplicate_of"), "similarity")
        checked = checked.join(found, "id", "left")
    else:
        checked = checked.withColumns({"duplicate_of": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double")})
    status = F.when(F.col("error").isNotNull(), "rejected").when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("written")
    return checked.withColumn("status", status)
