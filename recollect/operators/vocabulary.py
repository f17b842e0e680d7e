"""Alias inference over stored spellings, alias tables, and the sweep that rewrites rows.

Vocabularies are tables (value, n). Alias tables have ``variant`` and ``canonical``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import normalise_topic, person_words, topic_key
from .components import components


def _elected(grouped: DataFrame, shorter: bool) -> DataFrame:
    """Per group the most used spelling (ties by length, then by name) against the others."""
    size = F.length("value")
    order = Window.partitionBy("g").orderBy(F.col("n").desc(), size if shorter else size.desc(), "value")
    return (
        grouped.withColumn("canonical", F.first("value").over(order))
        .where(F.col("value") != F.col("canonical"))
        .select(F.col("value").alias("variant"), "canonical")
    )


def topic_aliases(counts: DataFrame) -> DataFrame:
    """Spellings with one key (case, separators, plural) point to the most used; ties to the shorter."""
    return _elected(counts.withColumn("g", topic_key(F.col("value"))), shorter=True)


def person_aliases(counts: DataFrame) -> DataFrame:
    """Names whose word sets contain one another, directly or through others, point to the most used; ties to the longer.

    A contained name shares every word with the containing one, so pairs are found by joining on the contained name's
    rarest word; two single names with the same words meet there as well. A name without a word is contained in
    every name; such names are left alone.
    """
    words = counts.select("value", F.array_distinct(person_words(F.col("value"))).alias("w")).where(F.size("w") > 0)
    each = words.select("value", "w", F.explode("w").alias("word"))
    rarity = each.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    rarest = each.join(rarity, "word").groupBy("value", "w").agg(F.min(F.struct("uses", "word"))["word"].alias("word"))
    pairs = rarest.withColumnsRenamed({"value": "a", "w": "wa"}).join(each.withColumnsRenamed({"value": "b", "w": "wb"}), "word")
    linked = pairs.where((F.col("a") != F.col("b")) & (F.size(F.array_except("wa", "wb")) == 0)).select("a", "b")
    roots = components(linked).withColumnsRenamed({"node": "value", "root": "g"})
    grouped = counts.join(roots, "value", "left").withColumn("g", F.coalesce("g", "value"))
    return _elected(grouped, shorter=False)


def keyed_topics(aliases: DataFrame) -> DataFrame:
    """Alias entries as the write path looks them up: both sides normalised, empty ones dropped."""
    keyed = aliases.select(normalise_topic(F.col("variant")).alias("variant"), normalise_topic(F.col("canonical")).alias("canonical"))
    return keyed.where((F.col("variant") != "") & (F.col("canonical") != "")).distinct()


def keyed_people(aliases: DataFrame) -> DataFrame:
    return aliases.select(F.lower(F.trim("variant")).alias("variant"), "canonical")


def merge_aliases(inferred: DataFrame, configured: DataFrame) -> DataFrame:
    """Configured entries win; inferred ones stay unless they would undo, revisit or loop through another entry."""
    names = lambda df, c: df.select(F.lower(c).alias("k")).distinct()
    spoken = configured.select(F.col("variant").alias("k")).distinct()
    out = inferred.join(spoken, inferred["variant"] == F.col("k"), "left_anti")
    out = out.join(names(configured, "canonical"), F.lower(out["variant"]) == F.col("k"), "left_anti")
    out = out.join(spoken, F.lower(out["canonical"]) == F.col("k"), "left_anti")
    loops = inferred.select(F.col("variant").alias("k")).distinct()
    out = out.join(loops, F.lower(out["canonical"]) == F.col("k"), "left_anti")
    return configured.select("variant", "canonical").unionByName(out.select("variant", "canonical"))


def stale_spellings(counts: DataFrame, aliases: DataFrame, key: Column) -> DataFrame:
    """Stored spellings (value) whose key an alias maps to another spelling. ``key`` is an expression over value."""
    found = counts.withColumn("variant", key).join(aliases, "variant")
    return found.where(F.col("canonical") != F.col("value")).select("value", "canonical")


def resolved(values: Column, aliases: Mapping[str, str], known: list[str] | None, topics: bool, self_names: tuple[str, ...] = ()) -> Column:
    """A list column with every entry resolved, in order, without repeats; a missing list counts as empty.

    Topics: normalised, alias applied, then a plural s matched to the known ones. People: trimmed, alias by lower case,
    the owner's own names dropped.
    """
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.create_map().cast("map<string,string>")
    values = F.coalesce(values, F.array().cast("array<string>"))
    if topics:
        stored = F.array(*[F.lit(k) for k in known or []]).cast("array<string>")

        def topic(x):
            aliased = F.coalesce(F.try_element_at(table, normalise_topic(x)), normalise_topic(x))
            short = F.substring(aliased, F.lit(1), F.length(aliased) - 1)
            more = F.concat(aliased, F.lit("s"))
            return (
                F.when(F.array_contains(stored, aliased), aliased)
                .when(aliased.endswith("s") & F.array_contains(stored, short), short)
                .when(F.array_contains(stored, more), more)
                .otherwise(aliased)
            )

        return F.array_distinct(F.transform(F.filter(values, lambda x: normalise_topic(x) != ""), topic))
    own = F.array(*[F.lit(n.strip().lower()) for n in self_names]).cast("array<string>")
    named = F.transform(F.filter(values, lambda x: F.trim(x) != ""), lambda x: F.coalesce(F.try_element_at(table, F.lower(F.trim(x))), F.trim(x)))
    return F.array_distinct(F.filter(named, lambda x: ~F.array_contains(own, F.lower(F.trim(x)))))


def vocabulary_changes(rows: DataFrame, topic_table: Mapping[str, str], person_table: Mapping[str, str], known: list[str] | None = None) -> DataFrame:
    """id, old and new lists of the rows whose resolved topics or people differ from what is stored."""
    empty = F.array().cast("array<string>")
    new = rows.select(
        "id", F.coalesce("topics", empty).alias("topics"), F.coalesce("people", empty).alias("people"),
        resolved(F.col("topics"), topic_table, known, True).alias("new_topics"),
        resolved(F.col("people"), person_table, None, False).alias("new_people"),
    )
    return new.where(~(F.col("topics").eqNullSafe(F.col("new_topics"))) | ~(F.col("people").eqNullSafe(F.col("new_people"))))


def resolve_entries(rows: DataFrame, field: str, aliases: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """id, pos, original, spelt, resolved and action of every entry of a list column, by joins: tables of any size will do.

    Topics are spelt normalised and matched to ``known`` (value) with or without a final s; people are trimmed.
    ``action`` is canonicalised, normalised, new_topic or null, as a note for whoever wrote the entry.
    """
    topics = field == "topics"
    entry = normalise_topic(F.col("original")) if topics else F.trim("original")
    e = rows.select("id", F.posexplode(field).alias("pos", "original")).withColumn("spelt", entry).where("spelt <> ''")
    table = aliases.select(F.col("variant").alias("key"), "canonical").dropDuplicates(["key"])
    e = e.withColumn("key", F.col("spelt") if topics else F.lower("spelt")).join(table, "key", "left").withColumn("resolved", F.coalesce("canonical", "spelt"))
    if topics and known is not None:
        stored = known.select(normalise_topic(F.col("value")).alias("k")).distinct()
        short = F.when(F.col("resolved").endswith("s"), F.substring(F.col("resolved"), F.lit(1), F.length("resolved") - 1))
        for name, form in (("same", F.col("resolved")), ("short", short), ("long", F.concat("resolved", F.lit("s")))):
            e = e.withColumn("_f", form).join(stored.select(F.col("k").alias("_f"), F.col("k").alias(name)), "_f", "left").drop("_f")
        e = e.withColumn("resolved", F.coalesce("same", "short", "long", "resolved"))
        e = e.withColumn("unknown", F.coalesce("same", "short", "long").isNull())
    else:
        e = e.withColumn("unknown", F.lit(False))
    action = F.when(F.col("resolved") != F.col("spelt"), "canonicalised").when(F.col("unknown"), "new_topic").when(F.col("spelt") != F.col("original"), "normalised")
    return e.select("id", "pos", "original", "spelt", "resolved", action.alias("action"))


def resolve_lists(rows: DataFrame, field: str, aliases: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """id and the resolved list, in order and without repeats; rows without entries are left out."""
    e = resolve_entries(rows, field, aliases, known)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "resolved")))
    return e.groupBy("id").agg(F.array_distinct(F.transform(ordered, lambda x: x["resolved"])).alias(f"new_{field}"))


def planned_changes(rows: DataFrame, topic_table: DataFrame, person_table: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """As ``vocabulary_changes``, with the tables joined."""
    empty = F.array().cast("array<string>")
    out = rows.select("id", F.coalesce("topics", empty).alias("topics"), F.coalesce("people", empty).alias("people"))
    out = out.join(resolve_lists(rows, "topics", topic_table, known), "id", "left").join(resolve_lists(rows, "people", person_table), "id", "left")
    out = out.withColumns({c: F.coalesce(c, empty) for c in ("new_topics", "new_people")})
    return out.where((F.col("topics") != F.col("new_topics")) | (F.col("people") != F.col("new_people")))
