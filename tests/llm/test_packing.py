import random
import re

import pytest

from fernglass.llm.packing import opened, pack, pack_documents, pack_texts, pieces_of

LENGTHS = (512, 1024, 2048, 4096)


def brute_pack(words, lengths, overhead, fill):
    """Best fit by looking at every bin for every piece."""
    bins, where = [], {}
    for i in sorted(range(len(words)), key=lambda i: (-words[i], i)):
        if not words[i]:
            continue
        fits = [(c - n, b) for b, (c, n) in enumerate(bins) if c - n >= words[i]]
        if fits:
            b = min(fits)[1]
        else:
            costs = {c: (c + overhead) / c * (words[i] + (1 - fill) * (c - words[i])) for c in lengths if c >= words[i]}
            bins.append((min(costs, key=lambda c: (costs[c], c)), 0))
            b = len(bins) - 1
        where[i] = (b, bins[b][1])
        bins[b] = (bins[b][0], bins[b][1] + words[i])
    return where, [min(c for c in lengths if c >= n) for _, n in bins]


def test_same_bins_as_brute_force():
    rng = random.Random(8)
    for _ in range(20):
        words = [rng.choice([0, 3, 60, 64, 100, rng.randint(1, 64)]) if rng.random() < 0.9 else 128 for _ in range(rng.randint(0, 120))]
        bins, place, capacity = pack(words, (64, 128), 8, 0.9)
        where, want = brute_pack(words, (64, 128), 8, 0.9)
        assert capacity == want and {i: (b, p) for i, (b, p) in enumerate(zip(bins, place, strict=True)) if b >= 0} == where


def test_bins_hold_their_pieces():
    rng = random.Random(1)
    words = [rng.choice([0, 1, 30, 511, 512, 513, 900, 4096, rng.randint(1, 4096)]) for _ in range(800)]
    bins, place, capacity = pack(words, LENGTHS)
    held = [[] for _ in capacity]
    for n, b, p in zip(words, bins, place, strict=True):
        if n:
            held[b].append((p, n))
        else:
            assert b == -1
    for pieces, c in zip(held, capacity, strict=True):
        at = 0
        for p, n in sorted(pieces):
            assert p == at
            at += n
        assert at <= c and (c == 512 or at > c // 2)  # shrunk to the shortest length that holds it
    assert sum(words) / sum(capacity) > 0.97


def test_the_cheapest_length_is_opened():
    assert opened(300, LENGTHS, 64, 0.95) == 512 and opened(4096, LENGTHS, 64, 0.95) == 4096 and opened(513, LENGTHS, 64, 0.95) == 1024
    assert opened(10, LENGTHS, 4000, 0.99) > 512  # a dear bin pays only if it is long


def test_pieces():
    assert pieces_of([0, 5, 4096, 9000], 4096) == [(0, 0, 0, 0), (1, 0, 0, 5), (2, 0, 0, 4096), (3, 0, 0, 4096), (3, 1, 4096, 4096), (3, 2, 8192, 808)]


def checked(rows):
    """Every bin is filled without gaps to no more than its capacity."""
    spans = {}
    for r in rows:
        assert (r.bin is None) == (r.n_words == 0)
        if r.bin:
            spans.setdefault((r.bin, r.capacity), []).append((r.place, r.n_words))
    assert len({b for b, _ in spans}) == len(spans)
    for (_, capacity), s in spans.items():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(s[-1]) <= capacity


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_every_word_is_packed_once(make, corpus):
    rows = pack_documents(make(corpus), lengths=(64, 128, 256), group=30).collect()
    assert sum(r.n_words for r in rows) == sum(size(t) for _, t in corpus)
    checked(rows)
    assert pack_documents(make([])).count() == 0


def test_one_group_is_best_fit_of_all_rows(make, corpus):
    distinct = {}
    for i, t in corpus:
        distinct.setdefault((i is None, i, t), []).append(None)
    texts = [(i, t) for (_, i, t), n in distinct.items() if len(n) == 1 and sum(k[1] == i for k in distinct) == 1]
    order = sorted(texts, key=lambda x: (-size(x[1]), x[0] is None, x[0]))
    words = [p for _, t in order for p in [256] * (size(t) // 256) + ([size(t) % 256] if size(t) % 256 or not size(t) else [])]
    where, capacity = brute_pack(words, (64, 128, 256), 64, 0.95)
    got = pack_documents(make(texts), lengths=(64, 128, 256)).collect()
    checked(got)
    assert sorted(r.n_words for r in got) == sorted(words) and sorted(c for _, c in {(r.bin, r.capacity) for r in got if r.bin}) == sorted(capacity)
    assert {(r.bin, r.place) for r in got if r.bin} == {(f"0-{b}", p) for b, p in where.values()}


@pytest.mark.parametrize("batch", ["10", "100", "10000"])
def test_bins_depend_on_the_rows_alone(spark, make, corpus, batch, tmp_path):
    want = sorted(map(str, pack_documents(make(corpus), group=25).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert sorted(map(str, pack_documents(make(corpus).repartition(7), group=25).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_file_read_twice(spark, make, tmp_path):
    make([(i, "w " * (7 * i % 300)) for i in range(40)]).coalesce(1).write.parquet(str(tmp_path / "d"))
    one = spark.read.parquet(str(tmp_path / "d"))
    rows = pack_documents(one.unionByName(one)).collect()
    checked(rows)
    assert len(rows) == 80 and {r.copy for r in rows} == {0, 1}


def test_texts_are_rebuilt(make, corpus):
    long = "  lead " + " ".join(f"w{i}" for i in range(1500)) + " \n"
    texts = [*corpus, (900, long), (900, long), (901, "\t")]
    rows = pack_texts(make(texts), lengths=(64, 128, 256)).collect()
    checked(rows)
    assert all(size(r.text) == r.n_words for r in rows)
    by = {}
    for r in sorted(rows, key=lambda r: r.piece):
        by.setdefault((r.doc_id, r.text_hash, r.copy), []).append(r.text)
    got = [(k[0], None if v == [None] else "".join(v)) for k, v in by.items()]
    assert sorted(map(str, got)) == sorted(map(str, texts))
    assert pack_texts(make([])).count() == 0
