import re

import pytest
from pyspark.sql import functions as F

from fernglass.llm.mixing import MIX_SQL, expected_copies, mix_sources, repeated, source_targets


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def poured(sizes, weights, total, cap):
    """Water-filling as rounds: what lies above a cap is shared anew."""
    target, open_ = {}, dict(sizes)
    left = total
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if weights[s] * unit > cap * sizes[s]]
        if not full:
            target |= {s: weights[s] * unit for s in open_}
            break
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 7, "e": 0, None: 300}
    order = sorted((s for s in sizes if s), key=lambda s: s.encode()) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    out = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 1.5, 2.0).collect()
    want = poured(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
    assert {r.source: pytest.approx(r.target) for r in out} == want


def test_mix(make, corpus):
    out = mix_sources(make(corpus)).collect()
    assert len(out) == len(corpus) and sorted(r["size"] for r in out) == sorted(size(t) for _, t in corpus)
    assert all(r.taken == r["size"] * r.copies and 0 <= r.copies <= 2 for r in out)
    again = mix_sources(make(corpus).repartition(7), buckets=8).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_each_source_comes_near_its_target(make):
    texts = [(i, "w " * (1 + i * 37 % 50)) for i in range(3000)]
    docs = make(texts)
    mixed = mix_sources(docs)
    by = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= r.most / 2 + 1 for r in by)
    assert repeated(docs, mixed).agg(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0] == mixed.agg(F.sum("taken")).first()[0]


def test_same_rows_as_sql(make, tmp_path, corpus):
    import duckdb

    texts = [(i, t.replace("\x00", "") if t else t) for i, t in corpus if i is not None]
    make(texts).coalesce(1).write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    found = c.execute(MIX_SQL)
    names = [d[0] for d in found.description]
    want = sorted(str([row[names.index(x)] for x in ("doc_id", "size", "target", "copies", "taken", "part")]) for row in found.fetchall())
    assert sorted(str([r.doc_id, r["size"], r.target, r.copies, r.taken, r.part]) for r in mix_sources(make(texts)).collect()) == want


def expected(classes, target, cap=2.0):
    """Copies by class of w: the common factor is found by halving."""
    low, high = 0.0, 1e9
    for _ in range(200):
        c = (low + high) / 2
        if sum(min(cap, c * w) * n for w, n in classes.items()) < target:
            low = c
        else:
            high = c
    return {w: min(cap, high * w) for w in classes}


def test_expected_copies(spark):
    classes = {1: 40, 3: 900, 5: 2000, 9: 70_000, 12: 3000}
    total = sum(classes.values())
    for target in (0.0, 0.3 * total, 1.2 * total, 1.9 * total, 2.0 * total):
        rows = spark.createDataFrame([("s", w, n, total, target) for w, n in classes.items()], "source string, w long, class_size long, source_size long, target double")
        got = {r.w: r.whole + r.part for r in expected_copies(rows, 2.0).collect()}
        assert got == {w: pytest.approx(e, abs=1e-9) for w, e in expected(classes, target).items()}


def test_inclusion_follows_the_probabilities(make):
    """Long texts are taken more often than short ones, each class about as often as its probability says."""
    texts = [(4 * i, "w " * (1 << (i % 8))) for i in range(16_000)]
    by = mix_sources(make(texts)).groupBy("size").agg(F.count("*").alias("n"), F.avg("copies").alias("copies"), F.max("part").alias("part"), F.sum("taken").alias("taken"), F.max("target").alias("target")).orderBy("size").collect()
    mean = [r.copies for r in by]
    assert len({round(r.part, 6) for r in by}) >= 7 and mean == sorted(mean) and mean[-1] > 2 * mean[0]
    for r in by:
        part, whole = r.part, round(r.copies - r.part)
        assert abs(r.copies - whole - part) <= 4 * (part * (1 - part) / r.n) ** 0.5 + 2 / r.n


def test_repeated_rows_share_the_copies_of_the_mix(make):
    """Rows that share an id, with equal and with other texts: the words that come out are those that the mix took."""
    texts = [(i // 9, ["w " * (3 + i % 4), "v " * 5, "w w w"][i % 3]) for i in range(400)]
    docs = make(texts)
    mixed = mix_sources(docs)
    want = {tuple(r) for r in mixed.groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").alias("c")).filter("c > 0").collect()}
    out = repeated(docs, mixed)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.groupBy("doc_id", "source", F.xxhash64("text")).count().collect()} == want
    assert out.agg(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0] == mixed.agg(F.sum("taken")).first()[0]


def test_empty_table(make):
    assert mix_sources(make([])).count() == 0
    assert all(r.taken == 0 for r in mix_sources(make([(1, None), (2, "")])).collect())
