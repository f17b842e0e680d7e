"""Schemaless metadata as VARIANT: containment filters, shallow merges and overlays, all as built-in expressions.

A filter is a Python dict and is compiled to paths: one typed comparison for each of its leaves. Types are compared as JSON has
them: 1 and 1.0 are equal, "1" and 1 are not, true is no number. An object is contained in one that has its keys; a
list in one that has, for each of its entries, an entry that contains it; anything else in its equal.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def parsed(text: Column) -> Column:
    """JSON text as a VARIANT; broken text is null."""
    return F.try_parse_json(text)


def _object(v: Column) -> Column:
    """The top-level keys of an object, null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def at(v: Column, key: str) -> Column:
    """What an object holds under a key, null if nothing."""
    if _PLAIN_KEY.match(key):
        return F.try_variant_get(v, f"$.{key}", "variant")
    return F.try_element_at(_object(v), F.lit(key))  # a path cannot spell every key


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _equals(v: Column, wanted) -> Column:
    if wanted is None:
        return F.is_variant_null(v)
    if isinstance(wanted, bool):
        return (_kind(v) == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == wanted)
    if isinstance(wanted, str):
        return (_kind(v) == "STRING") & (F.try_variant_get(v, "$", "string") == wanted)
    number = _kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    exact = F.lit(Decimal(wanted)) if isinstance(wanted, int) and abs(wanted) < 10**27 else None
    if exact is not None:
        whole = F.try_variant_get(v, "$", "decimal(38,10)")
        return number & F.coalesce(whole == exact, F.try_variant_get(v, "$", "double") == float(wanted))
    return number & (F.try_variant_get(v, "$", "double") == float(wanted))


def _entry(wanted):
    return lambda e: F.coalesce(_holds(e, wanted), F.lit(False))


def _holds(v: Column, wanted) -> Column:
    if isinstance(wanted, dict):
        out = _kind(v).startswith("OBJECT")
        for key, value in wanted.items():
            out = out & F.coalesce(_holds(at(v, key), value), F.lit(False))
        return out
    if isinstance(wanted, (list, tuple)):
        entries = F.try_variant_get(v, "$", "array<variant>")
        out = entries.isNotNull()
        for value in wanted:
            out = out & F.exists(entries, _entry(value))
        return out
    return _equals(v, wanted)


def contains(metadata: Column, wanted: dict) -> Column:
    """Whether metadata contains ``wanted``; null metadata does not. An empty filter holds for any object."""
    return F.coalesce(_holds(metadata, wanted), F.lit(False))


def has_entry(metadata: Column, field: str, value: str) -> Column:
    """Whether the list (or the string) under a key has an entry that is (or is itself) ``value``."""
    held = at(metadata, field)
    return F.coalesce(_holds(held, [value]), F.lit(False)) | F.coalesce(_equals(held, value), F.lit(False))


def merged(metadata: Column, patch: Column) -> Column:
    """Top-level keys of ``patch`` over those of ``metadata``: a key given as null is null from then on. A null patch changes nothing."""
    base, over = F.coalesce(_object(metadata), _object(F.parse_json(F.lit("{}")))), _object(patch)
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(over), k))
    return F.when(over.isNull(), metadata).otherwise(F.to_variant_object(F.map_concat(kept, over)))


def overlay(*layers: Column) -> Column:
    """Objects laid over each other, the first at the bottom (extracted, the caller's, what the rules resolved); null layers are skipped."""
    out = layers[0]
    for layer in layers[1:]:
        out = merged(out, layer)
    return out
