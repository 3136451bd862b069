"""Media columns: ordered text and media references parsed from HTML, with payloads found by digest.

Payloads are kept in a store of (digest, media): 8-bit greyscale PNG, 576 samples a row, one copy per digest and
batch. A reference whose source is sha256:... carries that digest; a join on the digest brings what was read back from
the stored bytes, and every reference keeps its position in the sequence and its caption. A digest, or none, that many
references have is dealt over several parts of the join.

Every img, video, audio, source, embed and object with a source is a reference, whatever its source; one that names
no digest has a null digest. A figure's caption, before or after its media, goes to all of them; that of a figure
without media is text. Elsewhere the caption is the alternative text or title.

Defined results: null text or html is empty; a payload is padded with bytes 255 to a positive multiple of 576;
equal payloads are equal in every column, repeated rows included; a reference without stored media keeps null
columns; tags left open end with the page; very long texts are handled one at a time; an empty table gives an empty
result; null ids keep their rows.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm.common import salted_join, stored, texts

ROW = 576
FILL = 255
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
SKIP = {"script", "style", "template"}
BLOCK = {"p", "div", "figure", "article", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "blockquote", "body", "br"}
#: Media elements, and the attributes that may hold their source.
MEDIA = {"img": ("src", "data-src", "srcset"), "video": ("src", "poster"), "audio": ("src",), "source": ("src", "srcset"), "embed": ("src",), "object": ("data",)}
DIGEST = "sha256:"
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string,src:string>>"
SHAPE = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string()), ("src", pa.string())]))


def padded(raw: bytes) -> bytes:
    return raw + bytes([FILL]) * (-len(raw) % ROW if raw else ROW)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """payload, a multiple of 576 bytes, as rows of greyscale samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = rows
    return PNG_MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples of to_png, with every checksum proved."""
    if data[:8] != PNG_MAGIC:
        raise ValueError("not a PNG")
    at, packed, shape = 8, [], (0, 0)
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)[::-1]
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[0], shape[1] + 1)
    if lines[:, 0].any():
        raise ValueError("only filter 0 is written here")
    return lines[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Mean, spread, mean step between neighbours, and the share of each of 8 bands of intensity."""
    flat = samples.reshape(-1)
    counts = np.bincount(flat, minlength=256)
    values = np.arange(256)
    mean = float((counts * values).sum() / len(flat))
    spread = float(np.sqrt(max(0.0, (counts * values.astype(float) ** 2).sum() / len(flat) - mean * mean)))
    step = float(np.abs(np.diff(flat.astype(np.int16))).mean())
    return f"{mean:.4f},{spread:.4f},{step:.4f}," + "/".join(f"{x / len(flat):.4f}" for x in counts.reshape(8, 32).sum(1))


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.skip = 0
        self.figures: list[dict] = []  # open figures: their media, and the words of their caption
        self.in_caption = False

    def add(self, kind: str, **more) -> dict:
        self.items.append({"kind": kind, "text": None, "digest": None, "caption": None, "src": None} | more)
        return self.items[-1]

    def flush(self) -> None:
        text = "".join(self.words).strip()
        self.words = []
        if text and self.in_caption:
            self.figures[-1]["caption"].append(text)
        elif text:
            self.add("text", text=text)

    def end_figure(self) -> None:
        self.flush()
        self.in_caption = False
        figure = self.figures.pop()
        if caption := " ".join(figure["caption"]):
            for x in figure["media"]:
                x["caption"] = caption
            if not figure["media"]:
                self.add("text", text=caption)

    def handle_starttag(self, tag, attrs):
        if tag in SKIP:
            self.skip += 1
        elif tag == "figcaption":
            self.flush()
            self.in_caption = bool(self.figures)
        elif tag in MEDIA:
            a = dict(attrs)
            if src := next((a[x] for x in MEDIA[tag] if a.get(x)), None):
                self.flush()
                item = self.add("media", digest=src[len(DIGEST) :] if src.startswith(DIGEST) else None, caption=a.get("alt") or a.get("title"), src=src)
                for figure in self.figures[-1:]:
                    figure["media"].append(item)
        elif tag in BLOCK:
            self.flush()
            if tag == "figure":
                self.in_caption = False
                self.figures.append({"media": [], "caption": []})

    def handle_endtag(self, tag):
        if tag in SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption":
            self.flush()
            self.in_caption = False
        elif tag == "figure" and self.figures:
            self.end_figure()
        elif tag in BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)

    def finish(self) -> list[dict]:
        self.close()
        while self.figures:
            self.end_figure()
        self.flush()
        return [{"position": i} | x for i, x in enumerate(self.items)]


def sequence_of(page: str | None) -> list[dict]:
    """The texts and media references of a page in order; a figure's caption goes to its media."""
    p = _Sequence()
    p.feed(page or "")
    return p.finish()


def parse_sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """One row per page: id and its sequence."""
    kind = dict(pages.dtypes)[id_col]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sequence_of(x) for x in batch.column(1).to_pylist()], SHAPE)], [id_col, "sequence"])

    return pages.select(id_col, html_col).mapInArrow(parse, f"`{id_col}` {kind}, sequence {SEQUENCE}")


def store_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The store of the texts' payloads: (digest, media). A task writes equal payloads once."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[str] = set()
            for lo, hi, data, off in texts(batch, text_col):
                out: dict[str, list] = {"digest": [], "media": []}
                for k in range(hi - lo):
                    payload = padded(data[off[k] : off[k + 1]].tobytes())
                    if (digest := hashlib.sha256(payload).hexdigest()) not in seen:
                        seen.add(digest)
                        out["digest"].append(digest)
                        out["media"].append(to_png(payload))
                if out["digest"]:
                    yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("digest", pa.string()), ("media", pa.binary())]))

    return stored(docs.select(text_col).mapInArrow(write, "digest string, media binary"), "media")


def read_media(store: DataFrame) -> DataFrame:
    """What the stored bytes hold, one row per digest."""
    fields = [("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, media in zip(batch.column("digest").to_pylist(), batch.column("media"), strict=True):
                media = media.as_py()
                samples = from_png(media)
                payload = samples.tobytes()
                out.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], schema=pa.schema(fields))

    rows = store.mapInArrow(read, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    rest = [n for n, _ in fields[1:]]
    return rows.groupBy("digest").agg(F.min(F.struct(*rest)).alias("m")).select("digest", "m.*")


def references(sequences: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per media reference: the columns to keep, position, caption, digest and src."""
    return sequences.select(*keep, F.explode("sequence").alias("x")).filter("x.kind = 'media'").select(*keep, "x.position", "x.caption", "x.digest", "x.src")


def resolve(refs: DataFrame, media: DataFrame, id_col: str) -> DataFrame:
    """The references with the columns of media, a row per digest; null where there is none."""
    return salted_join(stored(refs, "media-references"), media, "digest", [id_col, "position"])


def page_of(text: str, digest: str) -> str:
    """A page with a paragraph for each line of a text, and a figure with the media made of it."""
    body = "".join(f"<p>{html.escape(x, quote=False)}</p>" for x in text.split("\n"))
    return f'<article>{body}<figure><img src="{DIGEST}{digest}"><figcaption>The text as samples</figcaption></figure></article>'


def document_references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The references of the pages made of the documents: id, n_bytes of the text, position, caption, digest and src.
    Pages are made and parsed where the texts are; only the references leave the task."""
    kind = dict(docs.dtypes)[id_col]
    fields = [("position", pa.int32()), ("caption", pa.string()), ("digest", pa.string()), ("src", pa.string())]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in texts(batch, text_col):
                row, size, refs = [], [], []
                for k in range(hi - lo):
                    raw = data[off[k] : off[k + 1]].tobytes()
                    own = [x for x in sequence_of(page_of(raw.decode(), hashlib.sha256(padded(raw)).hexdigest())) if x["kind"] == "media"]
                    row += [lo + k] * len(own)
                    size += [len(raw)] * len(own)
                    refs += own
                ids = batch.column(id_col).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), *(pa.array([x[c] for x in refs], t) for c, t in fields)], [id_col, "n_bytes", *(c for c, _ in fields)])

    return docs.select(id_col, text_col).mapInArrow(parse, f"`{id_col}` {kind}, n_bytes long, position int, caption string, digest string, src string")


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes, what was read back of its stored payload, and the reference's position and caption."""
    media = read_media(store_media(docs, text_col))
    out = resolve(document_references(docs, id_col, text_col), media, id_col)
    return out.select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
