"""The shapes of what the engine answers, as JSON Schema, and a check of answers against them."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

TEXT, WHOLE, NUMBER, FLAG = {"type": "string"}, {"type": "integer"}, {"type": "number"}, {"type": "boolean"}


def record(required: Mapping[str, Any], optional: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """An object with these keys and no others."""
    return {"type": "object", "properties": {**required, **(optional or {})}, "required": sorted(required), "additionalProperties": False}


def rows(of: Mapping[str, Any]) -> dict[str, Any]:
    return {"type": "array", "items": dict(of)}


def maybe(of: Mapping[str, Any]) -> dict[str, Any]:
    return {"anyOf": [dict(of), {"type": "null"}]}


SUMMARY = {"ref": TEXT, "path": TEXT, "title": TEXT, "tags": rows(TEXT), "updated_at": WHOLE, "meta": TEXT}
OVERVIEW = record({"documents": WHOLE, "chunks": WHOLE, "tags": rows(record({"name": TEXT, "documents": WHOLE})), "index_version": TEXT, "embedding_model": maybe(TEXT)})
LISTING = record({"total": WHOLE, "documents": rows(record(SUMMARY)), "index_version": TEXT})
DOCUMENT = record({**SUMMARY, "outline": rows(record({"depth": WHOLE, "text": TEXT, "anchor": TEXT})), "text": TEXT, "index_version": TEXT})
SCORES = record({"retrieval": NUMBER, "rerank": maybe(NUMBER), "relevance": NUMBER, "signals": {"type": "object", "additionalProperties": NUMBER}, "final": NUMBER})
HIT = record({**SUMMARY, "breadcrumb": TEXT, "text": TEXT, "chunks": record({"from": WHOLE, "to": WHOLE}), "scores": SCORES})
SEARCH = record({"results": rows(HIT), "timings": record(dict.fromkeys(("embed_ms", "search_ms", "rerank_ms", "total_ms"), NUMBER)), "index_version": TEXT})
FAILURE = record({"error": record({"kind": TEXT, "message": TEXT})})

_KINDS = {"string": str, "object": Mapping, "array": list, "boolean": bool, "null": type(None)}


def _is(value: Any, kind: str) -> bool:
    if kind in ("integer", "number"):
        return not isinstance(value, bool) and isinstance(value, int if kind == "integer" else (int, float))
    return isinstance(value, _KINDS[kind])


def misfits(value: Any, shape: Mapping[str, Any], at: str = "$") -> list[str]:
    """Where and how a value departs from a shape; empty if it fits."""
    if "anyOf" in shape:
        return [] if any(not misfits(value, s, at) for s in shape["anyOf"]) else [f"{at}: fits none of the shapes"]
    if not _is(value, shape["type"]):
        return [f"{at}: no {shape['type']}"]
    out: list[str] = []
    if shape["type"] == "array":
        for k, x in enumerate(value):
            out += misfits(x, shape["items"], f"{at}[{k}]")
    elif shape["type"] == "object":
        known, more = shape.get("properties", {}), shape.get("additionalProperties", True)
        out += [f"{at}.{k}: missing" for k in shape.get("required", ()) if k not in value]
        for k, x in value.items():
            if k in known:
                out += misfits(x, known[k], f"{at}.{k}")
            elif more is False:
                out.append(f"{at}.{k}: unknown")
            elif isinstance(more, Mapping):
                out += misfits(x, more, f"{at}.{k}")
    return out
