import json
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fernglass.functions.vectors import decode_vector, encode_vector
from fernglass.sources import markdown, store
from fernglass.sources.blocks import Slugs, blocks_of, outline_of
from fernglass.sources.chunker import middle_cut, structural
from fernglass.sources.frontmatter import YamlError, epoch_ms, parse_yaml, validated

LINES = ["# Title", "## Part", "text. more! end?", "- item", "  deeper", "1. one", "```", "code", "> quote", "| a | b |", "|---|---|", "", "", "    indented", "***", "<div>", "word 😀 word", "setext", "---"]


def kinds(body):
    return [b.type for b in blocks_of(body)]


def texts(title, body, size=1000):
    return [s.text for s in structural(size).chunk(title, body)]


def test_blocks():
    assert kinds("para\n\n# h\n\n- a\n- b\n\n```\n# no\n```\n\n> q\nlazy\n\n    code\n\n<div>\nx\n</div>\n\n| a |\n|---|\n| 1 |\n\n***\n") == ["paragraph", "heading", "list", "code", "blockquote", "code", "html", "table", "thematicBreak"]
    assert kinds("1. a\n   more\n\n   para\n2. b") == ["list"]
    assert kinds("para\n- item") == ["paragraph", "list"]
    assert kinds("para\n2. no list") == ["paragraph"]
    assert kinds("~~~\nopen to the end") == ["code"]


def test_setext_heading_over_lines():
    (chunk,) = structural().chunk("Doc", "Foo *bar*\nbaz\n---\n\ntext")
    assert (chunk.breadcrumb, chunk.anchor) == ("Doc › Foo bar baz", "foo-bar-baz")


def test_html_only_heading_is_a_boundary_without_a_name():
    chunks = structural().chunk("Doc", "## A\n\n### B\n\nx\n\n## <br>\n\ny")
    assert [(c.breadcrumb, c.anchor) for c in chunks] == [("Doc › A › B", "b"), ("Doc", "")]


def test_only_an_empty_heading():
    (chunk,) = structural().chunk("Doc", "##\n\n")[:1]
    assert (chunk.start, chunk.end, chunk.anchor) == (0, 4, "")
    assert structural().chunk("Doc", " \n\n") == []


def test_large_blocks():
    table = "| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 10
    assert texts("T", table, 20) == [table]
    assert texts("T", 'One. Two! "Three." Four', 8) == ["One. ", "Two! ", '"Three." ', "Four"]
    assert texts("T", "- aaaa\n- bbbb\n- cccc", 8) == ["- aaaa\n", "- bbbb\n", "- cccc"]


def test_trailing_heading_joins_the_chunk_before():
    assert texts("T", "## A\n\ntext\n\n## B\n") == ["## A\n\ntext\n\n## B\n"]
    assert texts("T", "## A\n\n### B\n") == ["## A\n\n### B\n"]


def test_breadcrumb():
    assert middle_cut("Doc › Very long heading", 20) == "Doc › Very…g heading"
    assert middle_cut("😀" * 5, 3) == "😀…😀"
    (a, b) = structural().chunk("Doc", "# Doc\n\nx\n\n# Other\n\ny")
    assert (a.breadcrumb, b.breadcrumb) == ("Doc", "Doc › Other")


def test_slugs_pass_over_taken_names():
    slug = Slugs()
    assert [slug(t) for t in ("Notes", "Notes", "Notes 1", "Notes-1", "Notes", "!?", "Ünï_x y")] == ["notes", "notes-1", "notes-1-1", "notes-1-2", "notes-2", "section", "ünï_x-y"]


def test_outline_skips_levels():
    body = "### C\n\nx\n\n## B\n\ny\n\n### D\n\nz"
    got = [(h.text, body[a:z]) for h, a, z in outline_of(blocks_of(body), len(body))]
    assert got == [("C", "### C\n\nx\n\n"), ("B", "## B\n\ny\n\n### D\n\nz"), ("D", "### D\n\nz")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(LINES), max_size=25), st.integers(1, 60))
def test_chunks_tile_the_body(lines, size):
    body = "\n".join(lines)
    chunks = structural(size).chunk("T", body)
    assert "".join(c.text for c in chunks) == (body if chunks else "")
    assert bool(chunks) == bool(body.strip())
    wide = body.encode("utf-16-le")
    assert all(wide[2 * c.start : 2 * c.end].decode("utf-16-le") == c.text for c in chunks)


@pytest.mark.parametrize("size", [0, -1, 1.5, True, "9"])
def test_chunk_size_must_be_positive(size):
    with pytest.raises(ValueError):
        structural(size)


def test_yaml():
    raw = parse_yaml('title: "A: b"\nupdated_at: 2026-01-01\ntags: [x, "y, z"]\nnest:\n  a: 1\n  b:\n    - q\n    - k: v\n      w: [1, {p: true}]\nfold: >-\n  a\n  b\nnone:\n')
    assert raw == {"title": "A: b", "updated_at": "2026-01-01", "tags": ["x", "y, z"], "nest": {"a": 1, "b": ["q", {"k": "v", "w": [1, {"p": True}]}]}, "fold": "a b", "none": None}
    for bad in ("a: 1\na: 2", "a: [1", "a: b: c", "\ta: 1", 'a: "x'):
        with pytest.raises(YamlError):
            parse_yaml(bad)


@pytest.mark.parametrize(("text", "ms"), [("1970-01-02", 86_400_000), ("2026-10-05T00:00:00Z", 1_791_158_400_000), ("0000-02-29", -62_162_121_600_000), ("2026-01-01 10:00Z", 1_767_261_600_000), ("2026-01-01T10:00:00.250+02:00", 1_767_254_400_250)])
def test_dates(text, ms):
    assert epoch_ms(text) == ms


@pytest.mark.parametrize("text", ["2026-02-30", "2026-1-1", "2026-01-01T10:00", "2026-01-01T24:00:00Z", "2026-01-01T10Z", "", "today", None, 20260101, "2026-01-01\n"])
def test_no_dates(text):
    with pytest.raises(ValueError):
        epoch_ms(text)


def test_frontmatter_reports_all_problems():
    with pytest.raises(ValueError, match="title.*tags.*updated_at"):
        validated({"title": "", "tags": "x"})
    assert validated({"title": "t", "tags": [], "updated_at": "2026-01-01", "channel": "#a"})["meta"] == {"channel": "#a"}


def test_codec():
    assert encode_vector([1, 0.5, -2, 0.25], 4) == "ADwAOADAADQ="
    assert decode_vector("ADwAOADAADQ=", 4).tolist() == [1, 0.5, -2, 0.25]
    for values, dims in (([1.0], 2), ([70000.0], 1), ([float("nan")], 1)):
        with pytest.raises(ValueError):
            encode_vector(values, dims)
    for text, dims in (("ADwAOADAADQ", 4), ("ADwAOADAADQ=", 3), ("AHw=", 1), ("ADx=", 1)):
        with pytest.raises(ValueError):
            decode_vector(text, dims)


def test_sidecar_round_trip(tmp_path):
    head = {"doc_hash": "a" * 64, "chunker": "c", "model": "m", "dims": 2}
    chunks = [{"start": 0, "end": 4, "breadcrumb": "T", "anchor": "", "hash": "b" * 64, "vector": [1.0, 2.0]}, {"start": 4, "end": 9, "breadcrumb": "T", "anchor": "x", "hash": "c" * 64, "vector": [0.5, 0.0]}]
    text = store.to_json(head, chunks)
    got, back = store.from_json(text)
    assert got == head and [c["vector"].tolist() for c in back] == [[1.0, 2.0], [0.5, 0.0]]
    assert store.to_json(head, chunks) == text and text.endswith("}\n")
    raw = json.loads(text)
    for change in ({"format": 2}, {"doc_hash": "x"}, {"dims": 0}, {"extra": 1}, {"chunks": [raw["chunks"][1], raw["chunks"][0]]}, {"chunks": [raw["chunks"][0] | {"end": 0}]}, {"dims": 3}):
        with pytest.raises(store.StoreError):
            store.from_json(json.dumps(raw | change))
    store.write_sidecar(str(tmp_path), "a/b.md", text)
    assert store.list_sidecars(str(tmp_path)) == (["a/b.md"], [])
    kind, held = store.read_sidecar(str(tmp_path), "a/b.md")
    assert kind == "fine" and held["chunks"][0]["vector"] == raw["chunks"][0]["vector"] and [v.tolist() for v in store.vectors_of(held)] == [[1.0, 2.0], [0.5, 0.0]]
    for content, want in ((b"{", "invalid"), (json.dumps(raw | {"dims": 5}).encode(), "invalid"), (b"\xff\xfe", "unreadable")):
        Path(store.sidecar_path(str(tmp_path), "a/b.md")).write_bytes(content)
        assert store.read_sidecar(str(tmp_path), "a/b.md")[0] == want
    assert store.read_sidecar(str(tmp_path), "a/c.md") == ("missing", None)
    with pytest.raises(store.StoreError):  # as long as three numbers, but isn't: seen when it is decoded
        store.vectors_of(store.checked(raw | {"dims": 3}))
    store.delete_sidecar(str(tmp_path), "a/b.md")
    assert store.list_sidecars(str(tmp_path)) == ([], []) and (tmp_path / "vectors").is_dir() and not (tmp_path / "vectors/a").exists()
    for path in ("../x.md", "a//b.md", "C:/x.md", "a\\b.md", "./a.md"):
        with pytest.raises(store.StoreError):
            store.sidecar_path("t", path)


def test_files(tmp_path):
    for name in ("b.md", "a/_c.md", ".d.md", ".hidden/e.md", "out/f.md", "a/x.txt", "A.MD"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / "link.md").symlink_to(tmp_path / "b.md")
    assert markdown.find_files(str(tmp_path), str(tmp_path / "out")) == [".d.md", "a/_c.md", "b.md"]


def test_parsed_documents():
    row = markdown.parsed("a.md", "﻿---\r\ntitle: T\r\nupdated_at: 2026-01-01\r\ntags: []\r\n---\r\n\r\n# H\r\n".encode())
    assert row["error"] is None and row["body"] == "\n\n# H\n" and row["headings"][0]["anchor"] == "h"
    for raw in (b"no", b"---\ntitle: x", b"---\ntitle: [\n---\n", b"---\ntitle: t\n---\n", b"x" * (markdown.MOST_BYTES + 1)):
        assert markdown.parsed("a.md", raw)["error"]


def test_vectors_of_a_column(spark):
    from fernglass.functions.vectors import decode_vectors, encode_vectors

    df = spark.createDataFrame([(1, [1.0, 0.5]), (2, None)], "id int, v array<float>")
    back = decode_vectors(encode_vectors(df, "v", 2), "v", 2).orderBy("id").collect()
    assert [r.v for r in back] == [[1.0, 0.5], None]
    assert np.allclose(back[0].v, [1.0, 0.5])
