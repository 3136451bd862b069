import hashlib
import random
import re
import zlib

import corpus_pipeline
import numpy as np

from fernglass.llm.stages import without_near_copies, without_repeats, without_toxic
from fernglass.llm.toxicity import ToxicityModel
from tests.llm.conftest import prose
from tests.llm.test_shingles import shingles


def brute_stay(texts, n=5, percent=80):
    """Rows (id, text) that stay, by comparing every two: one of each component, and all without a word."""
    sets = [shingles(t, n) for _, t in texts]
    left, groups = {k for k, s in enumerate(sets) if s}, []
    while left:
        group, edge = set(), {min(left)}
        while edge:
            group |= edge
            left -= edge
            edge = {b for b in left if any(100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) for a in edge)}
        groups.append(group)
    least = [min({texts[k][0] for k in g}, key=lambda i: (i is None, i or 0)) for g in groups]
    return groups, least, [t for s, t in zip(sets, texts, strict=True) if not s]


def test_near_copies_leave_one_of_each_group(make, corpus):
    texts = [*corpus, (7, "one text of an id that another has as well"), (7, "and words that nobody copied, under the same number"), (8, "a third text which has nothing to do with either")]
    docs = make(texts)
    out = without_near_copies(docs.repartition(5))
    assert out.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in out.collect()]
    groups, least, blank = brute_stay(texts)
    assert sorted(map(str, [r for r in rows if not shingles(r[1], 5)])) == sorted(map(str, blank))
    of = {texts[k]: g for g, members in enumerate(groups) for k in members}
    worded = [r for r in rows if shingles(r[1], 5)]
    assert sorted(of[r] for r in worded) == list(range(len(groups)))  # one row of each group, and every group
    assert all(least[of[r]] == r[0] for r in worded)
    assert without_near_copies(make([])).count() == 0


def test_unrelated_texts_of_one_id_stay(make):
    texts = [(7, "alpha beta gamma delta epsilon zeta eta"), (7, "red orange yellow green blue indigo violet"), (8, "do re mi fa sol la ti do do do")]
    assert sorted((r.doc_id, r.text) for r in without_near_copies(make(texts)).collect()) == sorted(texts)
    doubled = [*texts, texts[0], (9, texts[0][1])]
    assert sorted((r.doc_id, r.text) for r in without_near_copies(make(doubled)).collect()) == sorted(texts)


def brute_repeats(texts):
    """Rows (id, text) without the characters whose bytes a document with a smaller id holds in a string of 50."""
    last = 2**63 - 1
    first = {}
    for i, t in texts:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], last), last if i is None else i)
    out = []
    for i, t in texts:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < (last if i is None else i):
                gone[p : p + 50] = [True] * 50
        if not any(gone):
            out.append((i, t))
            continue
        rest, at = "", 0
        for c in t:
            n = len(c.encode())
            rest += "" if all(gone[at : at + n]) else c
            at += n
        if rest.strip():
            out.append((i, rest))
    return out


def test_repeats_leave_the_rest_of_the_text(make, corpus):
    accents = "é" * 60 + " unlike the other "
    texts = [*corpus, (70_000, accents + "first"), (70_001, "x" + accents + "second")]
    docs = make(texts)
    out = without_repeats(docs.repartition(3))
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(str((r.doc_id, r.text)) for r in rows) == sorted(map(str, brute_repeats(texts)))
    assert all(r.text is None or r.n_chars == len(r.text) for r in rows)
    assert without_repeats(make([])).count() == 0


def test_toxic_documents_go(make):
    texts = [(i, f"good words here w{chr(97 + i % 26)}{chr(97 + i // 26)} " + ("foulword " if i % 3 == 0 else "") + "and more") for i in range(90)] + [(200, None), (201, "")]
    model = ToxicityModel.fit([(t, int("foulword" in t)) for _, t in texts[:60]])
    docs = make(texts)
    out = without_toxic(docs, model)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {i for i, t in texts if "foulword" not in (t or "")}


def probability(model, text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return model.tagged(raw, np.array([0, len(raw)]))[0][0]


def test_all_stages(spark, tmp_path, make, corpus):
    """Every stage against its operator's brute-force version, on the rows that the one before kept."""
    rng = random.Random(12)
    foul = [(1000 + i, f"{prose(rng, 10)} {'foulword' if i % 2 else 'nothing'} {prose(rng, 10)}") for i in range(80)]
    texts = [(i, t) for i, t in corpus if i is not None] + foul
    docs = make(texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 0, int("foulword" in t)) for i, t in foul]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in now.collect()]
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        kept[name] = [(r.doc_id, r.text) for r in now.collect()]
        if name == "toxicity":
            model = ToxicityModel.fit([(t, y) for t, _, y in sorted(((t, hashlib.md5((t or "").encode()).hexdigest(), y) for i, _, y in labels for j, t in texts if i == j and zlib.crc32(str(i).encode()) % 5), key=lambda x: x[1:])])
            fine = [x for x in texts if probability(model, x[1]) < 0.5]
            assert sorted(map(str, kept[name])) == sorted(map(str, fine))
            assert not any("foulword" in (t or "") for _, t in fine) and len(fine) > 0.9 * (len(texts) - 40)
        elif name == "near_copies":
            groups, _, blank = brute_stay(before)
            assert len(kept[name]) == len(groups) + len(blank)
        elif name == "repeats":
            assert sorted(map(str, kept[name])) == sorted(map(str, brute_repeats(before)))
        else:
            assert set(kept[name]) <= set(before) and len(kept[name]) > len(before)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by = {}
    for r in sorted(out, key=lambda r: r.piece):
        by.setdefault((r.doc_id, r.text_hash, r.copy), []).append(r.text)
    got = [(k[0], None if v == [None] else "".join(v)) for k, v in by.items()]
    assert sorted(map(str, got)) == sorted(map(str, kept["mixing"])) and len(corpus_pipeline.STAGES) == 5
    assert sum(r.n_words for r in out) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in kept["mixing"])


def test_empty_tables(spark, tmp_path, make):
    make([]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
