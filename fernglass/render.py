"""Answers as Markdown."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from typing import Any


def day(ms: int) -> str:
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=ms)).strftime("%Y-%m-%d")


def quoted(text: str) -> str:
    lines = text.split("\n")
    while lines and not lines[0].strip():
        lines.pop(0)
    return "\n".join(f"> {x}" if x else ">" for x in lines)


def overview(r: dict[str, Any]) -> str:
    head = [f"{r['documents']} documents, {r['chunks']} chunks", f"index {r['index_version']}", f"model {r['embedding_model'] or 'none'}", ""]
    return "\n".join(head + [f"- {t['name']}: {t['documents']}" for t in r["tags"]])


def _line(d: dict[str, Any]) -> str:
    return f"- {d['ref']}: {d['title']} ({day(d['updated_at'])})" + (f" [{', '.join(d['tags'])}]" if d["tags"] else "")


def listing(r: dict[str, Any]) -> str:
    return "\n".join([f"{len(r['documents'])} of {r['total']} documents", "", *map(_line, r["documents"])])


def search(r: dict[str, Any]) -> str:
    parts = []
    for k, x in enumerate(r["results"], 1):
        s = x["scores"]
        rerank = "none" if s["rerank"] is None else f"{s['rerank']:.3f}"
        signals = "".join(f", {n} {v:.3f}" for n, v in sorted(s["signals"].items()))
        parts.append(f"## {k}. {x['ref']}\n\n{x['breadcrumb']} ({day(x['updated_at'])})\nfinal {s['final']:.3f}, relevance {s['relevance']:.3f}, rerank {rerank}, retrieval {s['retrieval']:.3f}{signals}\n\n{quoted(x['text'].rstrip())}")
    return "\n\n".join(parts) or "no results"


def document(r: dict[str, Any]) -> str:
    least = min((h["depth"] for h in r["outline"]), default=1)
    outline = [f"{'  ' * (h['depth'] - least)}- {h['text']} (#{h['anchor']})" for h in r["outline"]]
    return "\n".join([_line(r), "", *outline, *([""] if outline else []), r["text"]])
