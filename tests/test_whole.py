"""Queries over whole texts."""

import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fernglass.plans import catalogue


@pytest.fixture(scope="module")
def turns(tmp_path_factory):
    """Conversations as (conv_id, turn, role, text), and the folder of their table."""
    rng = random.Random(8)
    sentence = lambda n: " ".join(rng.choice(["some", "words", "of", "prose"]) for _ in range(n)).capitalize() + rng.choice([". ", "! ", '." '])
    long = [1, 2, 40, 120, 400]  # sentences of 400 words are above the size by themselves
    rows = [(c, t, rng.choice(["user", "tool"]), "".join(sentence(rng.choice(long[: 3 + c % 3])) for _ in range(rng.choice([1, 4, 12]))) + "The end") for c in range(12) for t in range(4)]
    folder = tmp_path_factory.mktemp("whole")
    pq.write_table(pa.Table.from_pylist([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows], pa.schema([("conv_id", pa.int64()), ("turn", pa.int32()), ("role", pa.string()), ("text", pa.string())])), folder / "conversations.parquet")
    return rows, str(folder)


def brute_chunks(sections, most=1000):
    """Sections of (heading, paragraph): a paragraph above the size goes by sentence; a chunk ends before a heading, or
    a sentence that is too long or makes the chunk too long. A heading stays with what follows it."""
    chunks = []
    for heading, line in sections:
        parts = re.findall(r".+?[.!?][\"')\]]*\s+|.+$", line) if len(line) > most else [line]
        now, bodies = heading, 0
        for part in parts:
            if bodies and (len(now) + len(part.rstrip()) > most or len(part.rstrip()) > most):
                chunks.append(now)
                now = ""
            now, bodies = now + part, 1
        chunks.append(now + "\n\n")
    return chunks


def test_whole_turns_are_split_by_sentence(spark, turns):
    rows, folder = turns
    got = {}
    for r in sorted(catalogue.QUERIES["structural_chunks"](spark, folder).collect(), key=lambda r: (r.path, r.ordinal)):
        got.setdefault(r.path, []).append(r.text)
    for c in range(12):
        sections = [(f"## {role} {turn}\n\n", " ".join(text.split())) for conv, turn, role, text in rows if conv == c]
        assert "".join(got[f"c{c}.md"]) == "".join(h + line + "\n\n" for h, line in sections)
        assert got[f"c{c}.md"] == brute_chunks(sections)
    assert max(map(len, got.values())) > 4


def test_whole_outline(spark, turns):
    rows, folder = turns
    got = {(r.path, r.anchor): (r.start, r.end) for r in catalogue.QUERIES["document_outline"](spark, folder).collect()}
    for conv, turn, role, text in rows:
        start, end = got[f"c{conv}.md", f"{role}-{turn}"]
        assert end - start == len(f"## {role} {turn}\n\n{' '.join(text.split())}\n\n")


def test_searches_find_words_behind_the_fortieth_character_of_a_title(spark, tmp_path):
    head = "a first line of which forty characters are soon over"
    docs = [(i, f"{head} thand tion\nbody" if i == 3 else f"{head} other\nbody") for i in range(8)]
    pq.write_table(pa.Table.from_pylist([{"doc_id": i, "text": t, "lang": "en", "source": "s"} for i, t in docs]), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([3], pa.int64()), "quality": pa.array([1], pa.int32()), "toxic": pa.array([0], pa.int32())}), tmp_path / "labels.parquet")
    for name in ("keyword_bm25", "keyword_filtered"):  # the second line has the words in its title alone
        assert sorted((r.path, r.ordinal) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()) == [("s/en/3.md", 0), ("s/en/3.md", 1)]
    assert {r.path for r in catalogue.QUERIES["search_pipeline"](spark, str(tmp_path)).collect()} == {"s/en/3.md"}


def test_spans_of_every_document(spark, tmp_path):
    texts = [None, "", "x" * 60, "x" * 120, "x" * 200, "x" * 300, "x" * 400]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    gaps = {(r[0], r[1]) for r in catalogue.QUERIES["coverage_gaps"](spark, str(tmp_path)).select("path", "at").collect()}
    assert gaps == {("d3", 100), ("d4", 100), ("d5", 100), ("d6", 100), ("d6", 300)}
    ends = {r.path: (r.end, r.covered) for r in catalogue.QUERIES["tiling_ends"](spark, str(tmp_path)).collect()}
    assert ends == {f"d{i}": (len(t), len(t)) for i, t in enumerate(texts) if t}
