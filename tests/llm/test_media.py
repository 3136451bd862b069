import hashlib
import zlib

import numpy as np
import pytest

from fernglass.llm import media as M
from fernglass.llm.common import salted_join


def test_lossless():
    rng = np.random.default_rng(1)
    for n in (576, 576 * 7):
        raw = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        png = M.to_png(raw)
        assert M.from_png(png).tobytes() == raw
        with pytest.raises((ValueError, zlib.error)):
            M.from_png(png[:60] + bytes([png[60] ^ 1]) + png[61:])
    assert [len(M.padded(b"x" * n)) for n in (0, 1, 575, 576, 577)] == [576, 576, 576, 576, 1152]
    assert M.padded(b"ab")[2:] == b"\xff" * 574


def found(page):
    return [(x["position"], x["kind"], x["text"], x["digest"], x["caption"]) for x in M.sequence_of(page)]


def test_sequences():
    page = '<html><head><style>p{}</style></head><body><p>One &amp; two</p><figure><img src="sha256:aa" alt="alt"><figcaption>Cap <b>tion</b></figcaption></figure>mid<img src="sha256:bb" alt="b"><img src="x.png"><script>var t="</p>";</script><p>end'
    assert found(page) == [(0, "text", "One & two", None, None), (1, "media", None, "aa", "Cap tion"), (2, "text", "mid", None, None), (3, "media", None, "bb", "b"), (4, "media", None, None, None), (5, "text", "end", None, None)]
    assert M.sequence_of(None) == M.sequence_of("") == []


def test_pages_as_they_are_written():
    page = """<!DOCTYPE html><HTML><body><h1>Title</h1><FIGURE CLASS=x><a href="/p"><IMG SRC="https://example.org/a.jpg" ALT="a"></a>
        <figcaption>Above &mdash; <em>the lake</em></figcaption></FIGURE>
        <p>Before <img src="data:image/png;base64,AA==" title="dot"/> after</p>
        <figure><figcaption>First the caption</figcaption><picture><source srcset="b.webp 2x"><img src="b.png"></picture></figure>
        <figure><figcaption>No picture here</figcaption></figure>
        <video poster="p.jpg"><source src="v.mp4"></video><img alt="no source"><audio></audio><object data="sha256:cc"></object>
        <figure><img src="sha256:dd"><figure><img src="e.png"><figcaption>inner</figcaption></figure><figcaption>outer"""
    got = M.sequence_of(page)
    want = [("text", "Title", None, None), ("media", None, "https://example.org/a.jpg", "Above — the lake"), ("text", "Before", None, None), ("media", None, "data:image/png;base64,AA==", "dot"), ("text", "after", None, None)]
    want += [("media", None, "b.webp 2x", "First the caption"), ("media", None, "b.png", "First the caption"), ("text", "No picture here", None, None), ("media", None, "p.jpg", None), ("media", None, "v.mp4", None), ("media", None, "sha256:cc", None)]
    want += [("media", None, "sha256:dd", "outer"), ("media", None, "e.png", "inner")]
    assert [(x["kind"], x["text"], x["src"], x["caption"]) for x in got] == want
    assert [x["digest"] for x in got if x["digest"]] == ["cc", "dd"] and [x["position"] for x in got] == list(range(len(want)))


def test_references_are_resolved_in_place(spark):
    pages = spark.createDataFrame([(1, '<p>a</p><img src="sha256:x" alt="c1"><p>b</p><img src="sha256:y" alt="c2"><img src="sha256:x" alt="c3"><img src="u.png">', 9), (2, None, 9), (None, '<img src="sha256:x">', 9)], "page_id long, html string, digest int")
    store = spark.createDataFrame([("x", 5)], "digest string, n int")
    out = M.resolve(M.references(M.parse_sequences(pages, "page_id", "html"), ["page_id"]), store, "page_id")
    assert sorted(((r.page_id, r.position, r.caption, r.digest, r.n) for r in out.collect()), key=str) == [(1, 1, "c1", "x", 5), (1, 3, "c2", "y", None), (1, 4, "c3", "x", 5), (1, 5, None, None, None), (None, 0, None, "x", 5)]


def test_a_digest_of_most_references_is_dealt_over_the_join(spark):
    """Hot keys and rows without a key keep their columns; keys and salts don't multiply rows."""
    refs = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"d{i}", i) for i in range(3000)], "id long, digest string, position long")
    store = spark.createDataFrame([("hot", 1), ("d0", 2), ("d6", 3), ("unused", 4)], "digest string, n int")
    joined = salted_join(refs, store, "digest", ["id", "position"])
    assert sorted(map(str, ((r.id, r.digest, r.n) for r in joined.collect()))) == sorted(str((i, d, {"hot": 1, "d0": 2, "d6": 3}.get(d))) for i, d, _ in refs.collect())


def test_documents(make, corpus):
    rows = M.document_media(make(corpus)).collect()
    want = []
    for i, t in corpus:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    by = {}
    for r in rows:
        by.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by.values())
    assert M.document_media(make([])).count() == 0


def test_features():
    flat = M.feature_of(np.full((2, 576), 255, np.uint8))
    assert flat.startswith("255.0000,0.0000,0.0000,") and flat.endswith("/1.0000")
