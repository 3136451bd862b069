"""Top-level Markdown blocks of a document body (CommonMark, with pipe tables), found line by line.

Offsets are code points here; chunks store UTF-16 units (see utf16_offsets).
"""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
from dataclasses import dataclass, field

ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*$")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
BREAK = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?=[ \t]|$)([ \t]*)(.*)$")
DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
DEFINITION = re.compile(r" {0,3}\[(?:[^\[\]\\]|\\.)+\]:[ \t]*\S+(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
RAW_TAGS = "pre|script|style|textarea"
#: Fixed by CommonMark: tags that open an HTML block of the sixth kind.
BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p "
    "param search section summary table tbody td tfoot th thead title tr track ul"
).replace(" ", "|")
HTML_STARTS = [
    (re.compile(rf" {{0,3}}<(?:{RAW_TAGS})(?:[\s>]|$)", re.I), re.compile(rf"</(?:{RAW_TAGS})>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{BLOCK_TAGS})(?:\s|/?>|$)", re.I), None),
]
ATTRIBUTE = r"\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?"
TAG = rf"(?:<[A-Za-z][\w-]*(?:{ATTRIBUTE})*\s*/?>|</[A-Za-z][\w-]*\s*>)"
LONE_TAG = re.compile(rf" {{0,3}}{TAG}[ \t]*$")
INLINE_HTML = re.compile(rf"{TAG}|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>", re.S)
PUNCTUATION = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"


@dataclass
class Heading:
    depth: int
    text: str
    anchor: str


@dataclass
class Block:
    type: str
    start: int
    end: int
    headings: list[Heading] = field(default_factory=list)
    items: list[tuple[int, int]] = field(default_factory=list)
    depth: int = 0
    raw: str = ""


def utf16_offsets(text: str):
    """A function from code point offsets to UTF-16 offsets of text."""
    wide = [i for i, c in enumerate(text) if ord(c) > 0xFFFF]
    if not wide:
        return lambda i: i
    import bisect

    return lambda i: i + bisect.bisect_left(wide, i)


def _indent(line: str) -> int:
    n = 0
    for c in line:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def _blank(line: str) -> bool:
    return not line.strip(" \t")


def _fence(line: str):
    m = FENCE.match(line)
    return m if m and not (m[1][0] == "`" and "`" in m[2]) else None


def _html_end(line: str, lone: bool):
    """Of a line that starts an HTML block, what ends it: a pattern, or None for a blank line; else False."""
    for start, end in HTML_STARTS:
        if start.match(line):
            return end
    return None if lone and LONE_TAG.match(line) else False


def _interrupts(line: str) -> bool:
    """Whether a line ends a paragraph before it."""
    if _indent(line) >= 4:
        return False
    item = ITEM.match(line)
    return bool(
        ATX.match(line) or _fence(line) or BREAK.match(line) or re.match(r" {0,3}>", line) or _html_end(line, False) is not False or (item and item[4] and (item[2] in "-+*" or item[2][:-1] == "1"))
    )


def _cells(row: str) -> int:
    row = re.sub(r"\\\|", "", row.strip())
    return len(row.removeprefix("|").removesuffix("|").split("|"))


class _Scanner:
    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.at, n = [], 0
        for line in self.lines:
            self.at.append(n)
            n += len(line) + 1
        self.blocks: list[Block] = []

    def add(self, kind: str, first: int, last: int, *, indented: bool = False, **more) -> Block:
        lead = 0 if indented else len(self.lines[first]) - len(self.lines[first].lstrip(" \t"))
        self.blocks.append(Block(kind, self.at[first] + lead, self.at[last] + len(self.lines[last]), **more))
        return self.blocks[-1]

    def run(self) -> list[Block]:
        i, lines = 0, self.lines
        while i < len(lines):
            line = lines[i]
            if _blank(line):
                i += 1
            elif _indent(line) >= 4:
                i = self.indented_code(i)
            elif m := ATX.match(line):
                text = re.sub(r"(?:^|[ \t]+)#+$", "", m[2] or "")
                self.add("heading", i, i, depth=len(m[1]), raw=text)
                i += 1
            elif m := _fence(line):
                i = self.fenced_code(i, m[1])
            elif BREAK.match(line):
                self.add("thematicBreak", i, i)
                i += 1
            elif re.match(r" {0,3}>", line):
                i = self.quote(i)
            elif ITEM.match(line):
                i = self.list(i)
            elif (end := _html_end(line, True)) is not False:
                i = self.html(i, end)
            elif i + 1 < len(lines) and "|" in line + lines[i + 1] and DELIMITER.match(lines[i + 1]) and _cells(line) == _cells(lines[i + 1]):
                i = self.table(i)
            else:
                i = self.paragraph(i)
        return self.blocks

    def indented_code(self, i: int) -> int:
        last = j = i
        while j < len(self.lines) and (_blank(self.lines[j]) or _indent(self.lines[j]) >= 4):
            if not _blank(self.lines[j]):
                last = j
            j += 1
        self.add("code", i, last, indented=True)
        return last + 1

    def fenced_code(self, i: int, fence: str) -> int:
        j = i + 1
        while j < len(self.lines):
            m = FENCE.match(self.lines[j])
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                break
            j += 1
        last = min(j, len(self.lines) - 1)
        self.add("code", i, last)
        return last + 1

    def quote(self, i: int) -> int:
        j, open_text = i, False
        while j < len(self.lines):
            line = self.lines[j]
            if m := re.match(r" {0,3}> ?(.*)", line):
                open_text = bool(m[1].strip()) and not (ATX.match(m[1]) or _fence(m[1]) or BREAK.match(m[1]) or _indent(m[1]) >= 4)
            elif _blank(line) or not open_text or _interrupts(line):
                break
            j += 1
        self.add("blockquote", i, j - 1)
        return j

    def list(self, i: int) -> int:
        first = ITEM.match(self.lines[i])
        kind, items, j = first[2][-1], [], i
        while j < len(self.lines):
            m = ITEM.match(self.lines[j])
            if not m or m[2][-1] != kind or BREAK.match(self.lines[j]):
                break
            pad = len(m[3].expandtabs(4))
            width = len(m[1]) + len(m[2]) + (pad if m[4] and 1 <= pad <= 4 else 1)
            start, last, j = j, j, j + 1
            open_text, fence = bool(m[4]) and not _fence(m[4]), (_fence(m[4]) or [None, None])[1]
            while j < len(self.lines):
                line = self.lines[j]
                if _blank(line):
                    if not m[4] and j == start + 1:
                        break
                    open_text = False
                elif _indent(line) >= width:
                    inner = line[min(width, len(line) - len(line.lstrip())) :]
                    if fence:
                        f = FENCE.match(inner)
                        fence = None if f and f[1][0] == fence[0] and len(f[1]) >= len(fence) and not f[2].strip() else fence
                        open_text = False
                    else:
                        fence = (_fence(inner) or [None, None])[1]
                        open_text = not fence and not (ATX.match(inner) or BREAK.match(inner))
                    last = j
                elif open_text and not _interrupts(line) and not ITEM.match(line):
                    last = j
                else:
                    break
                j += 1
            items.append((self.at[start] + len(m[1]), self.at[last] + len(self.lines[last])))
            j = last + 1
            k = j
            while k < len(self.lines) and _blank(self.lines[k]):
                k += 1
            if k < len(self.lines) and (n := ITEM.match(self.lines[k])) and n[2][-1] == kind and not BREAK.match(self.lines[k]):
                j = k
            else:
                break
        self.blocks.append(Block("list", items[0][0], items[-1][1], items=items))
        return j

    def html(self, i: int, end) -> int:
        j = i
        if end is None:
            while j + 1 < len(self.lines) and not _blank(self.lines[j + 1]):
                j += 1
        else:
            while j < len(self.lines) and not end.search(self.lines[j]):
                j += 1
            j = min(j, len(self.lines) - 1)
        self.add("html", i, j)
        return j + 1

    def table(self, i: int) -> int:
        j = i + 2
        while j < len(self.lines) and not _blank(self.lines[j]) and not _interrupts(self.lines[j]):
            j += 1
        self.add("table", i, j - 1)
        return j

    def paragraph(self, i: int) -> int:
        while i < len(self.lines) and DEFINITION.match(self.lines[i]):
            self.add("definition", i, i)
            i += 1
        if i >= len(self.lines) or _blank(self.lines[i]) or (self.blocks and self.blocks[-1].type == "definition" and _interrupts(self.lines[i])):
            return i
        j = i + 1
        while j < len(self.lines) and not _blank(self.lines[j]):
            if m := UNDERLINE.match(self.lines[j]):
                raw = "\n".join(x.strip() for x in self.lines[i:j])
                self.add("heading", i, j, depth=1 if m[1][0] == "=" else 2, raw=raw)
                return j + 1
            if _interrupts(self.lines[j]):
                break
            j += 1
        self.add("paragraph", i, j - 1)
        return j


def plain_text(raw: str) -> str:
    """The text of an inline run: marks, link targets and HTML left out, entities and escapes resolved."""
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\ue000{len(kept) - 1}\ue001"

    def code(m: re.Match) -> str:
        s = m[2].replace("\n", " ")
        return keep(s[1:-1] if len(s) > 1 and s[0] == s[-1] == " " and s.strip() else s)

    out = re.sub(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", code, raw, flags=re.S)
    out = re.sub(rf"\\([{PUNCTUATION}])", lambda m: keep(m[1]), out)
    out = re.sub(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>", lambda m: keep(m[1]), out)
    out = INLINE_HTML.sub("", out)
    target = r"\((?:[^()\s]|\([^()]*\))*(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)"
    for _ in range(3):
        out = re.sub(rf"!?\[((?:[^\[\]])*)\](?:{target}|\[[^\]]*\])", r"\1", out)
    out = re.sub(r"(\*{1,3})(?=\S)(.+?)(?<=\S)\1", r"\2", out, flags=re.S)
    out = re.sub(r"(?<!\w)(_{1,3})(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2", out, flags=re.S)
    out = html.unescape(out)
    return re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m[1])], out)


def collapse(text: str) -> str:
    return re.sub(r"[\s﻿]+", " ", text).strip(" ")


class Slugs:
    """Anchors, unique within a document."""

    def __init__(self) -> None:
        self.taken: set[str] = set()

    def __call__(self, text: str) -> str:
        """The words of a heading joined by hyphens, with the least number that makes them a new name."""
        kept = [c for c in text.lower() if c in "- " or unicodedata.category(c) == "Pc" or unicodedata.category(c)[0] in "LMN"]
        name = "".join(kept).replace(" ", "-") or "section"
        names = itertools.chain((name,), (f"{name}-{k}" for k in itertools.count(1)))
        anchor = next(x for x in names if x not in self.taken)
        self.taken.add(anchor)
        return anchor


def blocks_of(body: str) -> list[Block]:
    """Blocks with the headings in force; a heading's own is the last of its path. Headings without any content
    are left out; one that is only HTML ends the sections above it but has no name."""
    slugs, path, out = Slugs(), [], []
    for block in _Scanner(body).run():
        if block.type == "heading":
            if not block.raw.strip():
                continue
            text = collapse(plain_text(block.raw))
            while path and path[-1].depth >= block.depth:
                path.pop()
            if text:
                path.append(Heading(block.depth, text, slugs(text)))
        block.headings = list(path)
        out.append(block)
    return out


def outline_of(blocks: list[Block], length: int) -> list[tuple[Heading, int, int]]:
    """Each heading with its section: up to the next heading that is no deeper."""
    found = [(b.headings[-1], b.start) for k, b in enumerate(blocks) if b.type == "heading" and b.headings and not (k and any(b.headings[-1] is h for h in blocks[k - 1].headings))]
    out, next_start = [], {}  # by depth, where the next heading of it starts
    for h, start in reversed(found):
        out.append((h, start, min((s for d, s in next_start.items() if d <= h.depth), default=length)))
        next_start[h.depth] = start
    return out[::-1]
