"""Spelling rules of topics and people, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_topic(topic: Column) -> Column:
    """Trimmed, small letters, separators to one hyphen, other signs dropped, one hyphen off either end."""
    t = F.regexp_replace(F.lower(F.trim(topic)), r"[\s_]+", "-")
    t = F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9-]", ""), r"-{2,}", "-")
    return F.regexp_replace(t, r"^-|-$", "")


def topic_key(topic: Column) -> Column:
    """What spellings of one topic share: hyphens for separators, and the plural ending off (ies to y, es, s)."""
    t = F.regexp_replace(F.lower(F.trim(topic)), r"[\s_-]+", "-")
    return (
        F.when(t.rlike("ies$"), F.regexp_replace(t, "ies$", "y"))
        .when(t.rlike("es$"), F.regexp_replace(t, "es$", ""))
        .otherwise(F.regexp_replace(t, "s$", ""))
    )


def person_words(name: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(name)), r"[\s_-]+"), lambda w: w != "")


def project_key(project: Column) -> Column:
    return F.coalesce(project, F.lit(""))


def origin_of(origin: Column, source: Column) -> Column:
    return F.coalesce(origin, source, F.lit(""))


def is_uuid(value: Column) -> Column:
    return value.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def shown(value: Column, digits: int) -> Column:
    """Rounded half up for display."""
    scale = 10**digits
    return F.floor(value * scale + 0.5) / scale


def preview(content: Column, size: int = 240) -> Column:
    return F.when(F.length(content) > size, F.concat(F.substring(content, 1, size), F.lit("…"))).otherwise(content)


def contents_joined(parts: Column) -> Column:
    """Longest first (ties by the order given), what a kept part already holds left out, joined by a blank line.

    ``parts``: array of struct(position, content).
    """
    ranked = F.array_sort(F.transform(parts, lambda p: F.struct((-F.length(p["content"])).alias("l"), p["position"].alias("p"), p["content"].alias("c"))))
    kept = F.aggregate(
        ranked,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda k: F.contains(k, x["c"])), acc).otherwise(F.array_append(acc, x["c"])),
    )
    return F.array_join(kept, "\n\n")
