"""WARC archives with a shared Zstandard dictionary, written as rows of binary archives or as files.

An archive starts with a skippable frame (magic 0x184D2A5D) whose content is the dictionary; then follows one
Zstandard frame per record, each compressed on its own with that dictionary; the first is a warcinfo record with the
archive's name. A record with the payload of
another one becomes a revisit of the record with the largest id among equals, if the payload has at least
`min_bytes` bytes.

Defined results: null html is an empty payload; a null id forms its own record and is a revisit of the largest
non-null id with its payload (a response if there is none); repeated rows give a record each, with the same
values, record id included, as they are one resource; an empty table gives no archive. Archives are cut by bytes, so memory doesn't grow with the table; a
record longer than the cut is an archive of its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm.common import salted_join, stored

#: Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0xEC30A437
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 16 << 10
SAMPLE_BYTES = 1 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response record, or a revisit (without the payload) if refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [WARC_VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:record:{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:record:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def info_bytes(name: str, date: str) -> bytes:
    """The warcinfo record of an archive."""
    body = b"software: fernglass\r\nformat: WARC File Format 1.1\r\n"
    head = [WARC_VERSION, "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{name}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstd.ZstdCompressionDict:
    """Trained on an even sample of the records; with too few to train on, their raw content."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = [r[: 1 << 16] for r in records[::step]]
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES].ljust(8, b"\n"), dict_type=zstd.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = 3) -> bytes:
    d = dictionary(records)
    packer = zstd.ZstdCompressor(level=level, dict_data=d, write_content_size=True)
    raw = d.as_bytes()
    return b"".join([struct.pack("<II", SKIPPABLE_MAGIC, len(raw)), raw, *map(packer.compress, records)])


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that starts here ends, from its headers."""
    if struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise ValueError("not a Zstandard frame")
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return at + 4 * checksum


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive, decompressed one by one."""
    magic, n = struct.unpack_from("<II", data, 0)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive has no leading dictionary frame")
    raw = data[8 : 8 + n]
    kind = zstd.DICT_TYPE_FULLDICT if raw[:4] == struct.pack("<I", DICTIONARY_MAGIC) else zstd.DICT_TYPE_RAWCONTENT
    reader, at = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw, dict_type=kind)), 8 + n
    while at < len(data):
        end = frame_end(data, at)
        yield reader.decompress(data[at:end])
        at = end


def parsed(record: bytes) -> dict:
    """Headers in lower case, and the payload after the HTTP header."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    out = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    if out["warc-type"] == "warcinfo":
        return out
    http, _, payload = rest[: int(out["content-length"])].partition(b"\r\n\r\n")
    out["http-length"] = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return out | {"payload": payload}


def write_archives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Rows (archive, n_records, data), kept as Parquet in the shared folder."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b"")).alias("payload")).withColumn("sha", F.sha1("payload"))
    narrow = stored(rows.select("id", "sha", F.octet_length("payload").alias("n")), "warc-payloads")
    # the largest id of each payload: counted before the shuffle; the rows that meet it hold two numbers and a digest
    largest = narrow.filter(F.col("n") >= min_bytes).groupBy("sha").agg(F.max("id").alias("largest"), F.count("*").alias("copies")).filter("copies > 1")
    revisits = salted_join(narrow, largest, "sha", ["id"]).filter("largest is not null and not (id <=> largest)").select(F.col("id").alias("r_id"), F.col("sha").alias("r_sha"), "largest").distinct()
    dealt = rows.join(revisits, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("sha") == F.col("r_sha")), "left").select("id", "url", "payload", "largest")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"records-{hashlib.sha1(b''.join(hashlib.sha1(x).digest() for x in held)).hexdigest()}.warc.zst"
            return pa.RecordBatch.from_pydict({"archive": [name], "n_records": [len(held)], "data": [archive([info_bytes(name, date), *held])]}, schema=schema)

        schema = pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            for i, url, payload, to in zip(*(batch.column(c) for c in ("id", "url", "payload", "largest")), strict=True):
                i, payload, to = i.as_py(), payload.as_py(), to.as_py()
                held.append(record_bytes(str(i), url.as_py(), payload, base32_sha1(payload), None if to is None else str(to), date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return stored(dealt.mapInArrow(pack, "archive string, n_records long, data binary"), "warc")


def export_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive as a file that other tools read, below a folder (a URI) that all executors share: its path
    and bytes. A file appears whole, and one that is written twice is the same."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            out: dict[str, list] = {"path": [], "bytes": []}
            for name, data in zip(batch.column("archive").to_pylist(), batch.column("data"), strict=True):
                at.create_dir(root, recursive=True)
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with at.open_output_stream(part, compression=None) as f:
                    f.write(data.as_py())
                at.move(part, f"{root}/{name}")
                out["path"].append(f"{folder}/{name}")
                out["bytes"].append(len(data.as_py()))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64())]))

    return stored(archives.select("archive", "data").mapInArrow(write, "path string, bytes long"), "warc-files")


def read_archives(archives: DataFrame, id_col: str = "page_id") -> DataFrame:
    """A row per record read back: id, payload_bytes and payload_digest of the full payload, record_type, refers_to."""
    number = re.compile(r"<urn:record:(-?\d+)>")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                out: list[tuple] = []
                for record in records_of(data.as_py()):
                    r = parsed(record)
                    if r["warc-type"] == "warcinfo":
                        continue
                    digest = r["warc-payload-digest"].removeprefix("sha1:")
                    if r["warc-type"] == "response" and (len(r["payload"]) != r["http-length"] or base32_sha1(r["payload"]) != digest):
                        raise ValueError(f"damaged record {r['warc-record-id']}")
                    own, to = (number.fullmatch(r.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
                    out.append((int(own[1]) if own else None, r["http-length"], digest, r["warc-type"], int(to[1]) if to else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], [id_col, "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("data").mapInArrow(unpack, f"{id_col} long, payload_bytes long, payload_digest string, record_type string, refers_to long")


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) || '0' AS x, max(page_id) OVER (PARTITION BY h) AS largest FROM p)
SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(x, (5 * i) // 4 + 1, 3))::INT >> (7 - (5 * i) % 4)::INT) & 31))::INT, 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM d
"""
