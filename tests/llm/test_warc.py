import base64
import hashlib
import random

import duckdb
import pytest
import zstandard

from fernglass.llm import warc
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    html = [prose(rng, rng.randint(0, 200)) for _ in range(40)] + [None, "", None, "é" * 50, "x" * 300_000]
    rows = [(i, f"http://a.example/{i}\r\nX: 1", h, "clash", 1) for i, h in enumerate(html)]
    rows += [(100 + i, None, rng.choice(html), "clash", 1) for i in range(40)] + [rows[3], (None, "u", html[5], "clash", 1), (None, "u", "only here", "clash", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, n int")


def brute(rows, min_bytes=0):
    largest = {}
    for r in rows:
        if r.page_id is not None:
            largest[r.html or ""] = max(largest.get(r.html or "", -1), r.page_id)
    out = []
    for r in rows:
        p = (r.html or "").encode()
        to = largest.get(r.html or "") if len(p) >= min_bytes else None
        to = None if to == r.page_id else to
        out.append((r.page_id, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(pages, least):
    archives = warc.write_archives(pages, min_bytes=least)
    got = sorted((tuple(r) for r in warc.read_archives(archives).collect()), key=str)
    assert got == brute(pages.collect(), least)
    for r in archives.collect():
        records = list(warc.records_of(bytes(r.data)))
        info = warc.parsed(records[0])
        assert info["warc-type"] == "warcinfo" and info["warc-filename"] == r.archive
        assert len(records) == r.n_records + 1 and all(x.startswith(b"WARC/1.1\r\n") and x.endswith(b"\r\n\r\n") for x in records)


def test_files_hold_the_archives(pages, tmp_path):
    archives = warc.write_archives(pages)
    folder = f"file://{tmp_path}/out"
    for _ in range(2):  # a task that runs again writes the same
        files = {r.path: r.bytes for r in warc.export_archives(archives, folder).collect()}
    held = {f"{folder}/{r.archive}": bytes(r.data) for r in archives.collect()}
    assert files == {k: len(v) for k, v in held.items()} and {f"{folder}/{p.name}": p.read_bytes() for p in (tmp_path / "out").iterdir()} == held


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(empty)).count() == 0


def test_same_rows_as_sql(pages, tmp_path):
    pages.filter("page_id is not null").coalesce(1).write.parquet(str(tmp_path / "p"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/p/*.parquet'")
    assert sorted(c.execute(warc.WARC_SQL).fetchall(), key=str) == brute(pages.filter("page_id is not null").collect())


def test_format():
    records = [warc.record_bytes(str(i), "http://x", prose(random.Random(i), 100).encode(), "D", None, "2020-01-01T00:00:00Z") for i in range(200)]
    data = warc.archive(records)
    assert data[:4] == bytes.fromhex("5d2a4d18") and list(warc.records_of(data)) == records
    plain = zstandard.ZstdDecompressor()
    assert len(data) < sum(len(zstandard.compress(r)) for r in records)
    with pytest.raises(zstandard.ZstdError):  # the frames need the dictionary
        at = 8 + int.from_bytes(data[4:8], "little")
        plain.decompress(data[at : warc.frame_end(data, at)])
    few = records[:1]
    assert list(warc.records_of(warc.archive(few))) == few  # too few to train on
    with pytest.raises(ValueError):
        list(warc.records_of(b"\x00" * 20))


def test_headers_cannot_be_forged():
    record = warc.record_bytes("1", "http://x\r\nWARC-Type: revisit", b"", "D", None, "d")
    assert warc.parsed(record)["warc-type"] == "response"
