"""The YAML of a document's frontmatter: mappings, lists, plain and quoted scalars, block scalars.

Scalars follow the core schema of YAML 1.2: dates stay text, only true and false are booleans. Keys may not repeat.
"""

from __future__ import annotations

import json
import re
from datetime import date
from typing import Any

NUMBER = re.compile(r"[-+]?(?:0|[1-9]\d*|\d+)(?:\.\d*)?(?:[eE][-+]?\d+)?$|[-+]?\.\d+(?:[eE][-+]?\d+)?$")
KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#\[\]{}&*!|>'"%@`,?:-][^#]*?|[?:-][^\s#][^#]*?)[ \t]*:(?:[ \t]+(.*)|$)""")
DATE_TIME = re.compile(r"(\d{4})-(\d{2})-(\d{2})(?:[T ](?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?(?:Z|([+-])([01]\d|2[0-3]):([0-5]\d)))?$")


class YamlError(ValueError):
    pass


def _uncommented(s: str) -> str:
    quote = ""
    for i, c in enumerate(s):
        if quote:
            quote = "" if c == quote and not (quote == '"' and s[i - 1] == "\\") else quote
        elif c in "\"'" and (i == 0 or s[i - 1] in " ,[{:"):
            quote = c
        elif c == "#" and (i == 0 or s[i - 1] in " \t"):
            return s[:i].rstrip()
    return s.rstrip()


def _scalar(s: str) -> Any:
    if s[:1] == '"':
        try:
            return json.loads(re.sub(r"\\x([0-9a-fA-F]{2})", r"\\u00\1", s))
        except ValueError:
            raise YamlError(f"bad quoted text: {s}") from None
    if s[:1] == "'":
        if len(s) < 2 or s[-1] != "'" or "'" in s[1:-1].replace("''", ""):
            raise YamlError(f"bad quoted text: {s}")
        return s[1:-1].replace("''", "'")
    if s in ("", "~", "null", "Null", "NULL"):
        return None
    if s in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return s.lower() == "true"
    if re.match(r"[-+]?\d+$", s):
        return int(s)
    if NUMBER.match(s):
        return float(s)
    if s[0] in "@`%&*!" or ": " in s or s.endswith(":"):
        raise YamlError(f"unexpected text: {s}")
    return s


def _flow(s: str) -> Any:
    """A [list] or {mapping} on one line, or a scalar."""
    at = 0

    def skip() -> None:
        nonlocal at
        while at < len(s) and s[at] in " \t\n":
            at += 1

    def item(stops: str) -> Any:
        nonlocal at
        skip()
        if s[at : at + 1] in ("[", "{"):
            return group()
        m = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'").match(s, at)
        start, at = at, m.end() if m else at
        while not m and at < len(s) and s[at] not in stops and not (s[at] == ":" and ":" in stops and s[at + 1 : at + 2] in (" ", "")):
            at += 1
        return _scalar(s[start:at].strip())

    def group() -> Any:
        nonlocal at
        opener = s[at]
        close, out, pairs = "]" if opener == "[" else "}", [], {}
        at += 1
        while True:
            skip()
            if at >= len(s):
                raise YamlError(f"unclosed {opener}")
            if s[at] == close:
                at += 1
                return out if opener == "[" else pairs
            if opener == "[":
                out.append(item(",]"))
            else:
                key = item(",}:")
                skip()
                value = None
                if s[at : at + 1] == ":":
                    at += 1
                    value = item(",}")
                if str(key) in pairs:
                    raise YamlError(f"the key {key} is repeated")
                pairs[str(key)] = value
            skip()
            if s[at : at + 1] == ",":
                at += 1
            elif s[at : at + 1] != close:
                raise YamlError(f"unclosed {opener}")

    if s[:1] not in ("[", "{"):
        return _scalar(s)
    out = group()
    if s[at:].strip():
        raise YamlError(f"unexpected text: {s[at:]}")
    return out


class _Reader:
    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.i = 0

    def peek(self) -> tuple[int, str] | None:
        while self.i < len(self.lines):
            line = self.lines[self.i]
            if line.strip() and not line.lstrip().startswith("#"):
                lead = len(line) - len(line.lstrip(" "))
                if line[lead] == "\t":
                    raise YamlError("tabs can't indent")
                return lead, _uncommented(line[lead:])
            self.i += 1
        return None

    def block_scalar(self, style: str, parent: int) -> str:
        rows, width = [], None
        while self.i < len(self.lines):
            line = self.lines[self.i]
            lead = len(line) - len(line.lstrip(" "))
            if line.strip():
                if lead <= parent:
                    break
                width = lead if width is None else width
            rows.append(line[width or 0 :] if line.strip() else "")
            self.i += 1
        body = "\n".join(rows)
        kept = body.rstrip("\n")
        if style[0] == ">":
            kept = re.sub(r"(?<!\n)\n(?!\n)", " ", kept)
        return kept if "-" in style else kept + ("\n" if kept else "")

    def value(self, rest: str | None, parent: int) -> Any:
        """What follows a key or a dash."""
        self.i += 1
        rest = _uncommented(rest or "")
        if re.match(r"[|>][-+]?\d?$", rest):
            return self.block_scalar(rest, parent)
        if rest:
            while rest[0] in "[{" and (rest.count("[") > rest.count("]") or rest.count("{") > rest.count("}")) and self.i < len(self.lines):
                rest += " " + _uncommented(self.lines[self.i].strip())
                self.i += 1
            if rest[0] not in "[{\"'":  # a plain scalar goes on over deeper lines
                while (n := self.peek()) and n[0] > parent and not KEY.match(n[1]) and not n[1].startswith("- "):
                    rest += " " + n[1]
                    self.i += 1
            return _flow(rest)
        n = self.peek()
        if n and (n[0] > parent or (n[0] == parent and n[1].startswith("-") and n[1][1:2] in ("", " "))):
            return self.node(n[0])
        return None

    def node(self, lead: int) -> Any:
        n = self.peek()
        if n[1][0] == "-" and n[1][1:2] in ("", " "):
            out = []
            while (n := self.peek()) and n[0] == lead and n[1][0] == "-" and n[1][1:2] in ("", " "):
                rest = n[1][1:].lstrip()
                if KEY.match(rest) and rest[:1] not in "\"'[{":  # a mapping that starts behind the dash
                    deeper = lead + len(n[1]) - len(rest)
                    self.lines[self.i] = " " * deeper + rest
                    out.append(self.node(deeper))
                else:
                    out.append(self.value(rest, lead))
            if n and n[0] > lead:
                raise YamlError(f"bad indentation: {n[1]}")
            return out
        if not KEY.match(n[1]):
            self.i += 1
            return _flow(n[1])
        pairs: dict[str, Any] = {}
        while (n := self.peek()) and n[0] == lead:
            m = KEY.match(n[1])
            if not m or (n[1][0] == "-" and n[1][1:2] == " "):
                raise YamlError(f"not a key: {n[1]}")
            key = str(_scalar(m[1])) if m[1][0] in "\"'" else m[1]
            if key in pairs:
                raise YamlError(f"the key {key} is repeated")
            pairs[key] = self.value(m[2], lead)
        if n and n[0] > lead:
            raise YamlError(f"bad indentation: {n[1]}")
        return pairs


def parse_yaml(text: str) -> Any:
    reader = _Reader(text)
    n = reader.peek()
    if n is None:
        return None
    out = reader.node(n[0])
    if reader.peek():
        raise YamlError(f"unexpected text: {reader.peek()[1]}")
    return out


def epoch_ms(value: Any) -> int:
    """Milliseconds of an ISO date (at midnight UTC) or of a date-time with a zone."""
    if not isinstance(value, str):
        raise ValueError("updated_at must be an ISO 8601 date or date-time as text")
    m = DATE_TIME.match(value)
    if not m or value.endswith("\n"):
        raise ValueError(f'updated_at: "{value}" is no ISO 8601 date and no date-time with a zone')
    year, month, day = int(m[1]), int(m[2]), int(m[3])
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    if not 1 <= month <= 12 or not 1 <= day <= (31, 28 + leap, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]:
        raise ValueError(f'updated_at: "{value}" is no real date')
    # the calendar repeats every 400 years; year 0 isn't a date of this library
    days = (date(year + 400, month, day) - date(1970, 1, 1)).days - 146_097
    seconds = 0.0
    if len(value) > 10:
        clock = re.match(r"(\d{2}):(\d{2})(?::(\d{2})(\.\d+)?)?", value[11:])
        seconds = int(clock[1]) * 3600 + int(clock[2]) * 60 + int(clock[3] or 0) + int(float(clock[4] or 0) * 1000) / 1000
        if m[4]:
            seconds -= (1 if m[4] == "+" else -1) * (int(m[5]) * 3600 + int(m[6]) * 60)
    return days * 86_400_000 + round(seconds * 1000)


FIXED = ("title", "updated_at", "tags")


def validated(raw: Any) -> dict[str, Any]:
    """title, updated_at (ms), tags and, of all other keys, meta. All that is wrong is reported at once."""
    if not isinstance(raw, dict):
        raise ValueError("frontmatter must be a mapping")
    problems, out = [], {"meta": {k: v for k, v in raw.items() if k not in FIXED}}
    title, tags = raw.get("title"), raw.get("tags")
    if not isinstance(title, str):
        problems.append("title must be text")
    elif not title:
        problems.append("title must not be empty")
    if not isinstance(tags, list) or not all(isinstance(t, str) for t in tags):
        problems.append("tags must be a list of texts")
    try:
        out["updated_at"] = epoch_ms(raw.get("updated_at"))
    except ValueError as e:
        problems.append(str(e))
    if problems:
        raise ValueError("; ".join(problems))
    return out | {"title": title, "tags": tags}
