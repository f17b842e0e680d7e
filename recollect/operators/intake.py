"""JSON bodies to capture items: shape checks, warnings, legacy keys and batches, over VARIANT with built-in expressions.

A body is an object with content, source, project, created_by, supersedes and metadata. Nothing a client sends goes without a word:
an unknown key is ignored with a warning, a key that used to stand at the top moves into metadata with a warning, and in strict mode the
first such warning is the item's error instead. A long content only ever warns. A batch holds items under ``thoughts``, with defaults
beside them, and is taken whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import is_uuid
from ..functions.metadata import at, merged

#: Keys of a body, keys that used to stand beside them, keys of a batch, and reasons of warnings.
BODY_KEYS = ("content", "source", "project", "created_by", "supersedes", "metadata")
LEGACY_KEYS = ("type", "topics", "people", "tags", "action_items", "captured_at", "expiresAt", "provenance", "hallmark")
BATCH_KEYS = ("thoughts", "project", "source", "created_by", "metadata")
UNKNOWN, LEGACY, WRONG_TYPE, TRUNCATED = "unknown_field", "deprecated_top_level", "wrong_type", "embedding_truncated"

WARNING = "struct<field:string,reason:string,message:string>"


def _text(body: Column, key: str) -> Column:
    """A key's string, null for anything else."""
    v = at(body, key)
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _keys(body: Column) -> Column:
    return F.array_sort(F.map_keys(F.try_variant_get(body, "$", "map<string,variant>")))


def _has(body: Column, key: str) -> Column:
    return F.array_contains(_keys(body), key)


def _filled(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _some(keys: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(k) for k in keys])


def _warning(field: Column, reason: Column, message: Column) -> Column:
    return F.struct(field.alias("field"), reason.alias("reason"), message.alias("message"))


def checked(items: DataFrame, body: str = "body", default_source: str = "api", strict: bool = False, byte_limit: int = 6000) -> DataFrame:
    """The rows with content, source, project, created_by, supersedes, metadata, warnings and error (null if fine) from a VARIANT column."""
    b = F.col(body)
    content, stated = _text(b, "content"), at(b, "metadata")
    none = F.array().cast(f"array<{WARNING}>")
    error = F.when(~_is_object(b), "the body must be an object").when(~_filled(content), "content must be a text that is not blank")
    error = error.when(_has(b, "source") & ~_filled(_text(b, "source")), "source must be a text that is not blank")
    for key in ("project", "created_by"):
        error = error.when(_has(b, key) & ~_filled(_text(b, key)), f"{key} must be a text that is not blank")
    error = error.when(_has(b, "supersedes") & ~F.coalesce(is_uuid(_text(b, "supersedes")), F.lit(False)), "supersedes must be an id")

    shape = F.when(_has(b, "metadata") & ~_is_object(stated), F.array(_warning(F.lit("metadata"), F.lit(WRONG_TYPE), F.lit("metadata is no object and was ignored")))).otherwise(none)
    strange = F.filter(_keys(b), lambda k: ~F.array_contains(_some(BODY_KEYS), k))
    old = lambda k: F.array_contains(_some(LEGACY_KEYS), k)
    note = lambda k: F.when(old(k), F.concat(k, F.lit(" belongs under metadata and was moved there"))).otherwise(F.concat(k, F.lit(" is not known and was ignored")))
    shape = F.concat(shape, F.transform(strange, lambda k: _warning(k, F.when(old(k), LEGACY).otherwise(UNKNOWN), note(k))))
    n = F.octet_length(content)
    long = F.when(n > byte_limit, F.array(_warning(F.lit("content"), F.lit(TRUNCATED), F.concat(F.lit("of "), n.cast("string"), F.lit(f" bytes a vector reflects the first {byte_limit}"))))).otherwise(none)

    # legacy keys under what metadata says itself; what the length says over both
    moved = F.to_variant_object(F.map_filter(F.try_variant_get(b, "$", "map<string,variant>"), lambda k, v: old(k)))
    metadata = merged(moved, F.when(_is_object(stated), stated))
    bytes_ = F.to_variant_object(F.struct(F.lit(True).alias("embedding_truncated"), F.lit(byte_limit).alias("embedding_indexed_bytes"), n.alias("content_bytes")))
    metadata = merged(metadata, F.when(n > byte_limit, bytes_))
    if strict:
        error = F.coalesce(error, F.get(shape, F.lit(0))["message"])
    return items.withColumns(
        {
            "content": content, "source": F.coalesce(_text(b, "source"), F.lit(default_source)), "project": _text(b, "project"), "created_by": _text(b, "created_by"),
            "supersedes": _text(b, "supersedes"), "metadata": metadata, "warnings": F.coalesce(F.concat(shape, long), none), "error": error,
        }
    )


def batches(bodies: DataFrame, id_col: str = "batch", body: str = "body", default_source: str = "api", strict: bool = False, byte_limit: int = 6000) -> DataFrame:
    """batch, item (from 0) and what ``checked`` gives, one row an item; ``batch_error`` is set in all rows of a batch that fails.

    A batch whose envelope fails has one row, without item. ``envelope_warnings`` names keys of the envelope that were ignored.
    """
    b = F.col(body)
    thoughts = F.try_variant_get(at(b, "thoughts"), "$", "array<variant>")
    strange = F.filter(_keys(b), lambda k: ~F.array_contains(_some(BATCH_KEYS), k))
    envelope = F.transform(strange, lambda k: _warning(k, F.lit(UNKNOWN), F.concat(k, F.lit(" on the batch was ignored"))))
    failed = F.when(~_is_object(b), "the body must be an object").when(F.coalesce(F.size(thoughts), F.lit(0)) < 1, "thoughts must be a list that is not empty")
    for key in ("project", "created_by"):
        failed = failed.when(_has(b, key) & ~_filled(_text(b, key)), f"{key} must be a text that is not blank")
    if strict:
        failed = F.coalesce(failed, F.get(envelope, F.lit(0))["message"])
    # what stands beside the items is under what an item says itself
    source = F.coalesce(F.when(_text(b, "source") != "", _text(b, "source")), F.lit(default_source))
    given = F.map_filter(F.try_variant_get(b, "$", "map<string,variant>"), lambda k, v: k.isin("project", "created_by") | ((k == "metadata") & _is_object(v)))
    rows = bodies.select(F.col(id_col).alias("batch"), failed.alias("failed"), F.coalesce(envelope, F.array().cast(f"array<{WARNING}>")).alias("envelope_warnings"), source.alias("inherited"), given.alias("given"), thoughts.alias("thoughts"))
    each = rows.select("batch", "failed", "envelope_warnings", "inherited", "given", F.posexplode_outer(F.when(F.col("failed").isNull(), F.col("thoughts"))).alias("item", "own"))
    merged_body = F.when(_is_object(F.col("own")), merged(F.to_variant_object("given"), F.col("own"))).otherwise(F.col("own"))
    out = checked(each.withColumn("body", merged_body), "body", default_source, strict, byte_limit)
    out = out.withColumn("source", F.when(_has(F.col("body"), "source"), F.col("source")).otherwise(F.col("inherited")))
    out = out.withColumn("error", F.when(F.col("item").isNotNull(), F.col("error")))
    # a batch is one body, so its items fit one task
    whole = Window.partitionBy("batch")
    first = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("item"))).over(whole)
    place = F.min(F.when(F.col("error").isNotNull(), F.col("item"))).over(whole)
    batch_error = F.coalesce("failed", F.when(first.isNotNull(), F.concat(F.lit("item "), place.cast("string"), F.lit(": "), first)))
    return out.withColumn("batch_error", batch_error).drop("failed", "inherited", "given", "own", "body")
