"""Retrieval: exact vector top-k, full text, and their fusion by reciprocal rank.

Every ranking ends in the id, so equal scores have one order. Top-k is an ordered limit (each task keeps k rows),
never a window over the whole table; ranks are numbered over the k rows that are left.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fts
from ..functions.labels import shown
from ..functions.metadata import contains
from ..functions.vector import cosine, literal, present


@dataclass(frozen=True)
class Scope:
    """Which rows a search may see. Archived rows, and rows whose flag is missing, are hidden unless asked for; ``metadata`` is what a row's must contain."""

    type: str | None = None
    topic: str | None = None
    project: str | None = None
    created_by: str | None = None
    include_archived: bool = False
    metadata: dict | None = None

    def condition(self) -> Column:
        """One conjunction; parts that were not given are left out, so simple parts reach the scan."""
        parts = [] if self.include_archived else [F.col("archived") == F.lit(False)]
        parts += [F.col(c) == F.lit(v) for c, v in (("type", self.type), ("project", self.project), ("created_by", self.created_by)) if v is not None]
        if self.topic is not None:
            parts.append(F.array_contains("topics", self.topic))
        if self.metadata is not None:
            parts.append(contains(F.col("metadata"), self.metadata))
        out = F.lit(True)
        for p in parts:
            out = out & p
        return out


def semantic(thoughts: DataFrame, query: Sequence[float], k: int = 10, threshold: float = 0.5, scope: Scope | None = None) -> DataFrame:
    """id, content, similarity, created_at of the k nearest at or over the threshold, by similarity and id."""
    similarity = cosine(F.col("embedding"), literal(query))
    seen = thoughts.where((scope or Scope()).condition()).where(F.col("embedding").isNotNull())
    return (
        seen.select("id", "content", similarity.alias("similarity"), "created_at")
        .where(present(F.col("similarity"), threshold))
        .orderBy(F.col("similarity").desc(), "id")
        .limit(k)
    )


def textual(thoughts: DataFrame, query: str, k: int = 50, scope: Scope | None = None, english: bool = True) -> DataFrame:
    """id, text_rank and created_at of the k best text matches, by rank and id. An empty query matches nothing."""
    parsed = fts.parse(query)
    stored = [c for c in ("lexemes", "english_lexemes") if c in thoughts.columns]
    matched = thoughts.where((scope or Scope()).condition()).select("id", "created_at", "content", *stored)
    return (
        fts.ranked(matched, parsed, english)
        .select("id", "text_rank", "created_at")
        .orderBy(F.col("text_rank").desc(), "id")
        .limit(k)
    )


def _numbered(hits: DataFrame, order: list, name: str) -> DataFrame:
    # at most the candidate pool's rows come here, so one partition is the right size
    return hits.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def hybrid(
    thoughts: DataFrame,
    query: Sequence[float],
    text: str,
    k: int = 10,
    threshold: float = 0.5,
    scope: Scope | None = None,
    rrf_k: int = 60,
    pool: int = 50,
    english: bool = True,
) -> DataFrame:
    """Both legs' best ``pool`` rows, scored by the sum of 1 / (rrf_k + rank). The threshold binds the vector leg only."""
    near = semantic(thoughts, query, pool, threshold, scope).select("id", "similarity")
    near = _numbered(near, [F.col("similarity").desc(), "id"], "near_rank")
    said = textual(thoughts, text, pool, scope, english).select("id", "text_rank")
    said = _numbered(said, [F.col("text_rank").desc(), "id"], "text_place")
    legs = near.join(said, "id", "full_outer")
    part = lambda rank: F.coalesce(1.0 / (F.lit(float(rrf_k)) + F.col(rank)), F.lit(0.0))
    fused = legs.select(
        "id", "similarity", "text_rank", (part("near_rank") + part("text_place")).alias("score"),
        F.when(F.col("near_rank").isNotNull() & F.col("text_place").isNotNull(), "both").when(F.col("near_rank").isNotNull(), "semantic").otherwise("text").alias("matched_by"),
    )
    # 2 * pool rows at most: a bounded broadcast
    rows = thoughts.select("id", "content", "created_at").join(F.broadcast(fused), "id")
    return rows.orderBy(F.col("score").desc(), F.col("created_at").desc(), "id").limit(k)


def semantic_as_hybrid(thoughts: DataFrame, query: Sequence[float], k: int = 10, threshold: float = 0.5, scope: Scope | None = None) -> DataFrame:
    """The fallback without a text index: the hybrid columns from the vector leg alone."""
    rows = semantic(thoughts, query, k, threshold, scope)
    return rows.select("id", "similarity", F.lit(0.0).alias("text_rank"), F.col("similarity").alias("score"), F.lit("semantic").alias("matched_by"), "content", "created_at")


def presented(results: DataFrame) -> DataFrame:
    """Similarity to 3 places, rank and score to 5."""
    return results.withColumns({"similarity": shown(F.col("similarity"), 3), "text_rank": shown(F.col("text_rank"), 5), "score": shown(F.col("score"), 5)})


def by_source_hash(thoughts: DataFrame, file_hash: str, limit: int = 25, include_archived: bool = False) -> DataFrame:
    """Rows of one source file, newest first; a missing archive flag hides a row here."""
    rows = thoughts.where(F.col("source_file_hash") == file_hash).where(Scope(include_archived=include_archived).condition())
    return rows.select("id", "content", "source_file_hash", "code_hash", "created_at").orderBy(F.col("created_at").desc(), "id").limit(limit)
