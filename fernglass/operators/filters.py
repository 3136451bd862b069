"""The filter that every operation shares, as one predicate over (tags, dirs, updated_at)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from fernglass.errors import InvalidRequest


def strict(raw: Mapping[str, Any], known: Sequence[str], what: str) -> None:
    """Keys that aren't known are errors, not the absence of a wish."""
    if not isinstance(raw, Mapping):
        raise InvalidRequest(f"{what} must be a mapping")
    if odd := [k for k in raw if k not in known]:
        raise InvalidRequest(f"{what}: unknown {', '.join(map(str, odd))}")


def whole(name: str, value: Any, least: int, most: int | None = None) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least or (most is not None and value > most):
        raise InvalidRequest(f"{name} must be a whole number from {least}" + (f" to {most}" if most is not None else "") + f", not {value!r}")
    return value


def number(name: str, value: Any) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise InvalidRequest(f"{name} must be a finite number, not {value!r}")
    return value


def clean_dir(name: str) -> str | None:
    """./a, /a and a//. name a; the root constrains nothing."""
    if not isinstance(name, str) or "\\" in name:
        raise InvalidRequest("dir must be text with / between its parts")
    parts = [p for p in name.split("/") if p not in ("", ".")]
    if ".." in parts:
        raise InvalidRequest('dir must not hold ".."')
    return "/".join(parts) or None


@dataclass(frozen=True)
class Filter:
    """tags: all of them; tags_any: one at least; dir: anywhere below; updated_after: strictly, in epoch ms."""

    tags: tuple[str, ...] = ()
    tags_any: tuple[str, ...] = ()
    dir: str | None = None
    updated_after: float | None = None

    @classmethod
    def parse(cls, raw: Mapping[str, Any] | None) -> Filter:
        raw = raw or {}
        strict(raw, ("tags", "tags_any", "dir", "updated_after"), "filter")
        lists = {}
        for name in ("tags", "tags_any"):
            value = raw.get(name) or ()
            if isinstance(value, str) or not all(isinstance(t, str) and t for t in value):
                raise InvalidRequest(f"{name} must be a list of texts that aren't empty")
            lists[name] = tuple(value)
        after = raw.get("updated_after")
        return cls(**lists, dir=None if raw.get("dir") is None else clean_dir(raw["dir"]), updated_after=None if after is None else number("updated_after", after))

    @classmethod
    def since(cls, ms: int, **more: Any) -> Filter:
        """At or after a moment."""
        return cls(updated_after=ms - 1, **more)

    def column(self) -> Column:
        out = F.lit(True)
        for tag in self.tags:
            out = out & F.array_contains("tags", tag)
        if self.tags_any:
            out = out & F.arrays_overlap(F.col("tags"), F.array(*map(F.lit, self.tags_any)))
        if self.dir is not None:
            out = out & F.array_contains("dirs", self.dir)
        if self.updated_after is not None:
            out = out & (F.col("updated_at") > F.lit(self.updated_after))
        return out
