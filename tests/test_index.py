"""The inverted index, against the search that reads every chunk, and what the engine does with it."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fernglass.engine import create_engine, embed
from fernglass.errors import InvalidRequest, StartupError
from fernglass.models import HashEmbedder, TextEmbedder, pair_reranker
from fernglass.operators import freshness, ranking, writing
from fernglass.operators.filters import Filter
from fernglass.operators.postings import KeywordIndex, write_index
from fernglass.shared import Files, shared_dir
from fernglass.sources import store

WORDS = "web webhook webhooks hook time timeout timeouts the retry".split()


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(2)
    rows = []
    for d in range(30):
        title = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 4)))
        for k in range(rng.randint(1, 6)):
            rows.append((f"d{d}.md", k, title, f"{title} > {rng.choice(WORDS)}", " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12))), ["x"] if d % 3 else []))
    return spark.createDataFrame(rows, "path string, ordinal int, title string, breadcrumb string, text string, tags array<string>").withColumns({"dirs": F.array().cast("array<string>"), "updated_at": F.lit(0)})


def brute(rows, terms, prefix):
    """BM25 by the definition, field by field."""
    fields = ("title", "breadcrumb", "text")
    toks = {(r.path, r.ordinal): {f: [t for t in ranking.re.findall(r"\w+", r[f].lower()) if t not in ranking.STOPWORDS] for f in fields} for r in rows}
    fits = (lambda t, q: t.startswith(q)) if prefix else (lambda t, q: t == q)
    score = dict.fromkeys(toks, 0.0)
    for f in fields:
        mean = sum(len(t[f]) for t in toks.values()) / len(toks)
        for q in terms:
            tf = {k: sum(fits(t, q) for t in v[f]) for k, v in toks.items()}
            df = sum(n > 0 for n in tf.values())
            idf = math.log(1 + (len(toks) - df + 0.5) / (df + 0.5))
            for k, n in tf.items():
                if n:
                    score[k] += ranking.BOOSTS[f] * idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(toks[k][f]) / mean))
    return {k: pytest.approx(s) for k, s in score.items() if s > 0}


@pytest.mark.parametrize("prefix", [False, True])
@pytest.mark.parametrize("query", ["web", "the timeout hook", "webhook time web", "nothing", "the"])
def test_scores_of_index_and_scan(spark, chunks, tmp_path_factory, query, prefix):
    path = str(tmp_path_factory.mktemp("index"))
    write_index(chunks, path)
    index = KeywordIndex.read(spark, path)
    want = brute(chunks.collect(), ranking.query_terms(query), prefix)
    assert {(r.path, r.ordinal): r.score for r in index.keyword(query, prefix=prefix).collect()} == want
    assert {(r.path, r.ordinal): r.score for r in ranking.keyword(chunks, query, prefix=prefix).collect()} == want
    own = Filter(tags=("x",))
    got = {(r.path, r.ordinal): r.score for r in index.keyword(query, allowed=chunks.filter(own.column()).select("path").distinct(), prefix=prefix).collect()}
    assert got == {k: v for k, v in want.items() if int(k[0][1:-3]) % 3}


def test_a_search_reads_its_terms_only(spark, chunks, tmp_path):
    write_index(chunks, str(tmp_path))
    index = KeywordIndex.read(spark, str(tmp_path))
    plan = index.matches(["webhook"], True)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,webhook)" in plan and "text" not in plan


def put(folder, name, body, tags="[t]"):
    to = folder / name
    to.parent.mkdir(parents=True, exist_ok=True)
    to.write_text(f"---\ntitle: {name}\nupdated_at: 2026-01-01\ntags: {tags}\n---\n{body}\n")


def test_the_engine_finds_words_by_their_beginning(spark, tmp_path):
    put(tmp_path / "in", "a.md", "All about webhooks and their retries.")
    put(tmp_path / "in", "b.md", "Nothing of the kind.")
    embed(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    engine = create_engine(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    found = lambda q, **more: [r["path"] for r in engine.search({"query": q, "mode": "keyword"} | more)["results"]]
    assert found("webhook") == ["a.md"] and found("kin") == ["b.md"] and found("ebhook") == []
    assert found("webhook", filter={"tags": ["t"]}) == ["a.md"] and found("webhook", filter={"dir": "x"}) == []

    class Zeros(HashEmbedder):
        def query(self, text):
            return [0.0] * self.dims

    for broken in (Zeros(), TextEmbedder("fake/words", 64, lambda t: [[math.nan] * 64]), TextEmbedder("fake/words", 64, lambda t: [[1.0] * 3])):
        engine.embedder = broken
        with pytest.raises(InvalidRequest, match="query vector"):
            engine.search({"query": "webhook", "mode": "semantic"})


def test_text_that_no_chunk_holds_keeps_the_engine_from_serving(spark, tmp_path):
    put(tmp_path / "in", "a.md", "# One\n\nfirst 😀 part\n\n# Two\n\nsecond part")
    embed(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    create_engine(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    chunks = store.read_chunks(spark, str(tmp_path / "out"))
    titles = store.read_titles(spark, str(tmp_path / "out"))
    store.write_chunks(chunks.filter("ordinal > 0"), titles, str(tmp_path / "out"))
    with pytest.raises(StartupError, match="is in no chunk"):
        create_engine(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    docs = spark.createDataFrame([("p", "ab 😀 cd"), ("q", "ab"), ("r", "a  ")], "path string, body string")
    rows = [("p", 0, 0, 3), ("p", 1, 5, 8), ("q", 0, 0, 9), ("r", 0, 0, 1)]
    got = {r.path: r.reason for r in freshness.uncovered(spark.createDataFrame(rows, "path string, ordinal int, start long, end long"), docs).collect()}
    assert set(got) == {"p", "q"} and "between 3 and 5" in got["p"] and "behind" in got["q"]


def test_versions_of_the_store(spark, tmp_path):
    put(tmp_path / "in", "a.md", "one")
    target = str(tmp_path / "out")
    for body in ("one", "two", "three", "four"):
        put(tmp_path / "in", "a.md", body)
        embed(spark, str(tmp_path / "in"), target)
    files = Files(spark)
    assert store.versions(files, target) == [3, 4] and [n for n in files.names(target) if n.startswith("chunks")] == ["chunks-000000003", "chunks-000000004"]
    files.delete(f"{target}/index-000000004/fields")  # as if the writer had been stopped
    assert "three" in store.read_chunks(spark, target).first().text
    embed(spark, str(tmp_path / "in"), target)
    assert store.versions(files, target)[-1] == 5 and "four" in store.read_chunks(spark, target).first().text


def test_failing_texts_fail_their_documents_only(spark, tmp_path):
    def vectors(texts):
        if any("poison" in t for t in texts):
            raise RuntimeError("no")
        return [[float(len(t)), 1.0] for t in texts]

    model = TextEmbedder("m", 2, vectors, count_tokens=lambda t: len(t.split()))
    for name, body in (("a.md", "fine"), ("b.md", "poison"), ("c.md", "word " * 600 + "."), ("d.md", "fine, too")):
        put(tmp_path / "in", name, body)
    report = embed(spark, str(tmp_path / "in"), str(tmp_path / "out"), model)
    failed = dict(report["failures"])
    assert set(failed) == {"b.md"} | ({"c.md"} if "c.md" in failed else set()) and "no" in failed["b.md"]
    assert {r.path for r in store.read_chunks(spark, str(tmp_path / "out")).collect()} == {"a.md", "b.md", "c.md", "d.md"} - set(failed)
    new = spark.createDataFrame([("p", "h1", "word " * 600), ("q", "h2", "ok")], "path string, hash string, text string").coalesce(1)
    rows = {r.path: r for r in writing.embedded(new, vectors, 2, count=lambda t: len(t.split())).collect()}
    assert "600 tokens" in rows["p"].problem and list(rows["q"].fresh) == [2.0, 1.0]
    with pytest.raises(ValueError, match="600 tokens"):
        model.query("word " * 600)


def test_pairs_are_cut_to_the_window(spark):
    seen = pair_reranker(lambda t: [len(w) for w in t.split()], lambda pairs: [1000.0 * len(q) + len(p) for q, p in pairs])
    df = spark.createDataFrame([("w " * 900,), ("a b",)], "t string")
    assert [r[0] for r in df.select(seen("q " * 400)(F.col("t"))).collect()] == [128_381.0, 128_002.0]


def test_shared_folder(spark, monkeypatch):
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs://x/y"
    assert shared_dir(Session()) == "hdfs://x/y"
