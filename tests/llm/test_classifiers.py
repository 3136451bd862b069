import random
import zlib

import numpy as np

from fernglass.llm import langid as L
from fernglass.llm import toxicity as T
from tests.llm.conftest import prose, rows_of, SCHEMA

ALPHABETS = {"en": "the and ing tion wh sh".split(), "de": "der ung sch ich keit ß ä".split(), "fr": "eau que é è oi ment".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def held(i):
    return zlib.crc32(str(i).encode())


def test_languages(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang, rng.randint(3, 80)), lang) for i, lang in enumerate(list(ALPHABETS) * 120)]
    odd = [(900, None, "en"), (901, "", "en"), (902, "123 !?", "en"), (903, "é", None), (904, "漢字" * 40, None), (0, rows[0][1], "en"), (905, sentence(rng, "de", 9000), "de")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "doc_id long, text string, lang string, id string, score int")
    train = docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 != 2 and doc_id < 900").select("doc_id", "lang")
    model = L.fit_languages(docs, train)
    out = {r.doc_id: r for r in L.identify_languages(docs, model).collect()}
    test = [(i, lang) for i, _, lang in rows if held(i) % 4 == 2]
    assert np.mean([out[i].lang_pred == lang for i, lang in test]) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values())
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[900].score == 0
    assert out[903].lang_pred in model.langs and out[904].rejected and not out[905].rejected and out[905].lang_pred == "de"
    none = L.fit_languages(docs, train.limit(0))
    assert {r.lang_pred for r in L.identify_languages(docs, none).collect()} == {"und"}
    assert L.identify_languages(docs.limit(0), model).count() == 0


def brute_counts(text):
    """Hashed n-grams of 2 and 3 bytes one by one: what is no ASCII letter, nor part of another, is a space."""
    raw, out = bytes(L.FOLD[b] for b in text.encode()), np.zeros(L.DIMS)
    word = lambda x: int(x) & 0xFFFFFFFF
    for p in range(len(raw) - 1):
        two = int(L.ONE[raw[p]]) ^ int(L.TWO[raw[p + 1]])
        if raw[p : p + 2] != b"  ":
            out[word(two * 0x9E3779B1) >> 20] += 1
            if p + 2 < len(raw):
                three = two ^ int(L.THREE[raw[p + 2]]) ^ 0x5BD1E995
                out[word(three * 0x85EBCA6B) >> 20] += 1
    return out


def test_nearest_centroid_by_the_definition(spark):
    """Each prediction against cosines that are taken one by one, of counts that are counted one by one."""
    rng = random.Random(21)
    rows = [(i, sentence(rng, lang, rng.randint(1, 30)), lang) for i, lang in enumerate(list(ALPHABETS) * 30)]
    rows += [(500, "Mixed der the eau 12", "en"), (501, "x", None), (502, "long " + sentence(rng, "fr", 4000), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit_languages(docs, docs.filter("doc_id % 4 != 1").select("doc_id", "lang"))
    tf = {i: brute_counts(t) for i, t, _ in rows}
    train = [i for i, _, lang in rows if lang and i % 4 != 1]
    idf = np.array([np.log((1 + len(train)) / (1 + sum(tf[i][d] > 0 for i in train))) + 1 for d in range(L.DIMS)])
    assert np.allclose(model.idf, idf, rtol=1e-5) and (model.owner == np.repeat(range(3), L.CENTROIDS)).all()
    out = {r.doc_id: r for r in L.identify_languages(docs.repartition(3), model).collect()}
    for i, _, _ in rows:
        x = np.log1p(tf[i]) * idf
        cos = [float(np.dot(x, c) / max(np.sqrt(np.dot(x, x)), 1e-12)) for c in model.centroids]
        best = int(np.argmax(cos))
        assert abs(out[i].score - min(max(cos[best], 0), 1)) < 1e-5
        assert out[i].lang_pred == model.langs[model.owner[best]] or max(c for c, o in zip(cos, model.owner, strict=True) if model.langs[o] == out[i].lang_pred) > cos[best] - 1e-6
        assert out[i].rejected == (1 - cos[best] > model.reach[model.owner[best]]) or abs(1 - cos[best] - model.reach[model.owner[best]]) < 1e-6


def test_long_training_texts_are_learned_from(spark):
    """A language whose texts are all very long, and one of many classes, are learned; samples keep to their bound."""
    from fernglass.llm.training import sampled

    rng = random.Random(22)
    rows = [(i, sentence(rng, "de", 12_000), "de") for i in range(3)] + [(10 + i, sentence(rng, "en", 40), "en") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert min(len(t) for i, t, _ in rows if i < 3) > 50_000
    assert L.fit_languages(docs, docs.select("doc_id", "lang")).langs == ["de", "en"]
    many = spark.range(6000).selectExpr("id", "case when id < 3000 then 0 else id end as y")
    kept = sampled(many, "id", "y", 700).groupBy("y").count().collect()
    assert len(kept) == 3001 and {r["y"]: r["count"] for r in kept}[0] in range(600, 701)


def test_counts_do_not_cross_texts():
    data = np.frombuffer("abcabd".encode(), np.uint8)
    both = L.counts(data, np.array([0, 3, 6]))
    assert np.array_equal(both[0], L.counts(data[:3], np.array([0, 3]))[0]) and np.array_equal(both[1], L.counts(data[3:], np.array([0, 3]))[0])
    assert L.counts(data[:0], np.array([0, 0, 0])).shape == (2, L.DIMS)


def brute_marginals(emission, trans):
    n = len(emission)
    p, z, pairs = np.zeros(n), 0.0, np.zeros((2, 2))
    for code in range(2**n):
        s = [code >> t & 1 for t in range(n)]
        w = trans[0, s[0]] + emission[0] * s[0]
        for t in range(1, n):
            w += trans[s[t - 1], s[t]] + emission[t] * s[t]
        w = np.exp(w)
        z += w
        p += w * np.array(s)
        pairs[0, s[0]] += w
        for t in range(1, n):
            pairs[s[t - 1], s[t]] += w
    return p / z, pairs / z


def test_forward_backward_is_exact(monkeypatch):
    monkeypatch.setattr(T, "RUN", 3)
    rng = np.random.default_rng(2)
    trans = rng.normal(size=(2, 2))
    sizes = [1, 0, 3, 7, 10, 2, 6]
    row = np.repeat(np.arange(len(sizes)), sizes)
    e = rng.normal(size=len(row)) * 2
    p, pairs = T.Field(trans).marginals(e, row, len(sizes), pairs=True)
    want, total = [], np.zeros((2, 2))
    for k, n in enumerate(sizes):
        if n:
            a, b = brute_marginals(e[row == k], trans)
            want.append(a)
            total += b
    assert np.allclose(p, np.concatenate(want)) and np.allclose(pairs, total)


def toxic_rows(rng, n):
    bad = ["grumfel", "snarkos", "vexquil"]
    out = []
    for i in range(n):
        words = prose(rng, rng.randint(5, 120)).split(" ")
        y = int(i % 4 == 0)
        for _ in range(rng.randint(1, 4) if y else 0):
            words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "ing", "!"])
        out.append((i, " ".join(words), y))
    return out


def test_toxicity(spark):
    rng = random.Random(3)
    rows = toxic_rows(rng, 600)
    odd = [(900, None), (901, ""), (902, "..."), (903, "Grumfel"), (904, prose(rng, 5000)), (905, prose(rng, 5000) + " é snarkosity vexquil"), (1, rows[1][1])]
    docs = spark.createDataFrame(rows_of([(i, t) for i, t, _ in rows] + odd), SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if held(i) % 5] + [(7777, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    model = T.fit_toxicity(docs, labels)
    out = {r.doc_id: r for r in model.score(docs).collect()}
    test = [(i, y) for i, _, y in rows if held(i) % 5 == 0]
    assert np.mean([(out[i].score >= 0.5) == bool(y) for i, y in test]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())
    assert [out[i].score < 0.5 for i in (900, 901, 902, 904)] == [True] * 4 and out[900].score == out[901].score == out[902].score
    assert out[903].score > 0.5 and [(s.start, s.end) for s in out[903].spans] == [(0, 7)]
    long = odd[5][1]
    assert [long[s.start : s.end] for s in out[905].spans] == ["snarkosity vexquil"]
    assert model.score(docs.limit(0)).count() == 0
    blind = T.fit_toxicity(docs, labels.filter("toxic = 1"))
    assert {r.score for r in blind.score(docs).collect()} == {1.0}
    assert {r.score for r in T.fit_toxicity(docs, labels.limit(0)).score(docs).collect()} == {0.0}
