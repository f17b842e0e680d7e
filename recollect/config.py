"""Settings: defaults, then a JSON file, then the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import fields
from datetime import datetime, timezone

from .operators.capture import Discipline
from .operators.consolidate import Thresholds

_TRUE = {"1", "true", "yes", "on"}


def _number(text: str | None, default: float) -> float:
    """A finite number, else the default."""
    try:
        x = float(text)
    except (TypeError, ValueError):
        return default
    return x if x == x and abs(x) != float("inf") else default


def timestamp(text: str | None) -> datetime | None:
    """A time in ISO form as UTC without a zone; anything else raises, it never becomes the epoch. Nothing given is None."""
    if text is None:
        return None
    when = datetime.fromisoformat(text.strip())
    return when.astimezone(timezone.utc).replace(tzinfo=None) if when.tzinfo else when


def discipline(path: str | None = None, env: Mapping[str, str] | None = None) -> Discipline:
    env = os.environ if env is None else env
    stored = {}
    if path:
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
    spelt = {"".join(p if i == 0 else p.title() for i, p in enumerate(f.name.split("_"))): f.name for f in fields(Discipline)}
    values = {spelt[k]: tuple(v) if isinstance(v, list) else v for k, v in stored.items() if k in spelt}
    for f in fields(Discipline):
        given = env.get(f"RECOLLECT_{f.name.upper()}")
        if given is None:
            continue
        default = getattr(Discipline(), f.name)
        if isinstance(default, bool):
            values[f.name] = given.strip().lower() in _TRUE
        elif isinstance(default, float):
            values[f.name] = _number(given, default)
        elif isinstance(default, tuple):
            values[f.name] = tuple(x.strip() for x in given.split(",") if x.strip())
        elif isinstance(default, str):
            values[f.name] = given
    if "person_aliases" in values:
        values["person_aliases"] = {k.strip().lower(): v for k, v in values["person_aliases"].items()}
    return Discipline(**values)


def thresholds(env: Mapping[str, str] | None = None) -> Thresholds:
    env = os.environ if env is None else env
    base = Thresholds()
    number = lambda name, default: _number(env.get(f"RECOLLECT_{name}"), default)
    return Thresholds(
        neighbour=number("NEIGHBOUR", base.neighbour), merge=number("MERGE", base.merge), contradiction_floor=number("CONTRADICTION_FLOOR", base.contradiction_floor),
        min_synthesis=int(number("MIN_SYNTHESIS", base.min_synthesis)), dedupe=number("DEDUPE_THRESHOLD", base.dedupe),
    )


def search_threshold(env: Mapping[str, str] | None = None, default: float = 0.5) -> float:
    x = _number((os.environ if env is None else env).get("RECOLLECT_SEARCH_THRESHOLD"), default)
    return x if 0 <= x <= 1 else default
