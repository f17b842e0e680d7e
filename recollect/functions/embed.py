"""The offline embedder: hashed character trigrams, unit length. Runs in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


_SIGNS = " 0123456789abcdefghijklmnopqrstuvwxyz"
_NUMBER = np.zeros(128, np.int64)
_NUMBER[np.frombuffer(_SIGNS.encode(), np.uint8)] = np.arange(len(_SIGNS))


@lru_cache(maxsize=1)
def _slots() -> np.ndarray:
    """A number for every trigram there can be (37 signs, so 50,653), from its hash."""
    return np.array([int.from_bytes(hashlib.sha256((a + b + c).encode()).digest()[:4], "big") for a in _SIGNS for b in _SIGNS for c in _SIGNS], np.int64)


def trigram_vector(text: str | None, size: int) -> list[float]:
    """Counts of the trigrams of the padded text (small letters and digits only), scaled to length 1; zero stays zero."""
    flat = " " + re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).strip() + " "
    v = np.zeros(size)
    if len(flat) > 2:
        x = _NUMBER[np.frombuffer(flat.encode("ascii"), np.uint8)]
        v += np.bincount(_slots()[(x[:-2] * len(_SIGNS) + x[1:-1]) * len(_SIGNS) + x[2:]] % size, minlength=size)
    length = float(np.sqrt((v * v).sum())) or 1.0
    return (v / length).tolist()


def trigram_embedder(size: int = 64):
    """A Column function from text to vector, usable wherever an embedder is asked for."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            yield column.map(lambda t: trigram_vector(t, size))

    # else a filter on the vector is pushed below the projection that made it, and every vector is made twice
    return embed.asNondeterministic()


def truncated(content: Column, limit: int = 6000) -> Column:
    """Whether a text is longer in bytes than the embedder reads."""
    return F.octet_length(content) > limit


def truncation_notes(content: Column, limit: int = 6000) -> Column:
    return F.when(
        truncated(content, limit),
        F.struct(F.lit(True).alias("embedding_truncated"), F.lit(limit).alias("embedding_indexed_bytes"), F.octet_length(content).alias("content_bytes")),
    )
