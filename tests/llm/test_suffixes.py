import hashlib
import random

import numpy as np
import pytest

from fernglass.llm import suffixes as S
from fernglass.llm.stages import cut_text

LAST = 2**63 - 1


def brute(texts):
    """Sorted (id, bytes, removed, spans, digest of the rest) of every row."""
    first: dict[bytes, int] = {}
    raw = [(LAST if i is None else i, (t or "").encode()) for i, t in texts]
    for i, b in raw:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], LAST), i)
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum())
        out.append((None if i == LAST else i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"split": 2, "part_bytes": 5000, "shard_bytes": 3000, "chunk_bytes": 4000}])
def test_same_bytes_as_brute_force(make, corpus, sizes):
    out = S.remove_repeats(make(corpus).repartition(4), **sizes)
    got = sorted((tuple(r) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    assert got == brute(corpus)


def test_small_alphabets(make):
    rng = random.Random(9)
    texts = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) * rng.randint(1, 9)) for i in range(60)] + [(60 + i, "a" * (40 + i)) for i in range(25)]
    got = sorted((tuple(r)[:5] for r in S.remove_repeats(make(texts), split=3, chunk_bytes=500, shard_bytes=500).collect()), key=str)
    assert got == brute(texts)


def test_empty_table(make):
    assert S.remove_repeats(make([])).count() == 0


def test_spans_are_the_removed_bytes(make, corpus):
    by_id = {}
    for i, t in corpus:
        by_id.setdefault(i, []).append(t)
    for r in S.remove_repeats(make(corpus)).filter("n_removed > 0").collect():
        own = [t for t in by_id[r.doc_id] if hashlib.sha256((t or "").encode()).hexdigest() == r.text_sha256][0].encode()
        rest, at = b"", 0
        for s in r.spans:
            rest, at = rest + own[at : s.start], s.end
        assert hashlib.sha256(rest + own[at:]).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed


def test_suffix_array_and_common_prefixes():
    rng = random.Random(2)
    for _ in range(30):
        pieces = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 90))) for _ in range(rng.randint(1, 12))})
        text = b"".join(p + b"\xff" for p in pieces)
        arr = np.frombuffer(text, np.uint8)
        order = S.suffix_array(arr)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        start = np.cumsum([0] + [len(p) + 1 for p in pieces])[:-1]
        shared = S.common_prefixes(arr, order, start, start + np.array([len(p) for p in pieces]))
        for k in range(1, len(order)):
            a, b = text[order[k - 1] :], text[order[k] :]
            if text[order[k]] == 0xFF:
                continue
            same = next((n for n in range(min(len(a), len(b))) if a[n] != b[n]), min(len(a), len(b)))
            assert shared[k] == min(same, 50)


def test_merge_by_binary_search():
    rng = random.Random(3)
    for n in (1, 2, 5, 16):
        runs = [sorted({rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(0, 12))}) for _ in range(n)]
        ids = [[rng.randrange(100) for _ in r] for r in runs]
        least = {}
        for r, i in zip(runs, ids, strict=True):
            for s, k in zip(r, i, strict=True):
                least[s] = min(least.get(s, 999), k)
        got = S.merged([np.array([s.encode() for s in r], "S50") for r in runs], [np.array(i, np.int64) for i in ids])
        assert [g.tolist() for g in got] == [[least[s] for s in r] for r in runs]


def test_a_passage_of_most_documents_is_merged_over_shards(make, monkeypatch):
    """More holders of an anchor than a shard takes, in as many different contexts; some slots are shared."""
    monkeypatch.setattr(S, "SLOTS", 64)
    rng = random.Random(4)
    passage = "this passage is the same in every document and goes on for a while, well over fifty bytes"
    texts = [(i, f"{rng.random()} {passage[rng.randint(0, 20) : rng.randint(72, 89)]} {rng.random()}") for i in range(300)]
    got = sorted((tuple(r)[:5] for r in S.remove_repeats(make(texts).repartition(6), split=4, chunk_bytes=600, shard_bytes=2000).collect()), key=str)
    assert got == brute(texts)


def test_blobs_visit_only_the_parts_that_have_rows():
    from fernglass.llm.common import blob_rows

    parts = np.array([10**15, 3, 10**15, 7])  # a list of all parts would not fit
    own, (a, b) = blob_rows(parts, np.arange(4), np.arange(4, dtype=np.int8))
    assert own.tolist() == [3, 7, 10**15] and [np.frombuffer(x, np.int64).tolist() for x in a] == [[1], [3], [0, 2]] and [list(x) for x in b] == [[1], [3], [0, 2]]
    assert blob_rows(np.zeros(0, np.int64), np.zeros(0))[1] == [[]]


def test_cut_text_keeps_whole_characters():
    assert cut_text("aéb", [(1, 3)]) == "ab" and cut_text("aéb", [(1, 2)]) == "aéb" and cut_text("aéb", [(2, 4)]) == "aé"
    assert cut_text("x", []) == "x" and cut_text("ab", [(0, 2)]) == ""
