"""Configuration: where documents are and where the engine keeps what it makes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from fernglass.errors import UsageError

#: The folder of the engine below the documents, unless another is named.
OWN_FOLDER = ".fernglass"


@dataclass(frozen=True)
class Config:
    source: str
    target: str

    @classmethod
    def load(cls, raw: Mapping[str, Any]) -> Config:
        if odd := set(raw) - {"source", "target"}:
            raise UsageError(f"unknown settings: {', '.join(sorted(odd))}")
        if not isinstance(raw.get("source"), str) or not raw["source"]:
            raise UsageError("source must name a folder")
        source = Path(raw["source"]).resolve()
        if not source.is_dir():
            raise UsageError(f"{source} is no folder")
        target = Path(raw.get("target") or source / OWN_FOLDER).resolve()
        if target == source or target in source.parents:
            raise UsageError("target must not be the source or hold it")
        return cls(str(source), str(target))
