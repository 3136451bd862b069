import math

import pytest
from pyspark.sql import functions as F

from fernglass.errors import InvalidRequest
from fernglass.functions import scores, text
from fernglass.operators import freshness, listing, ranking, retrieval, writing
from fernglass.operators.filters import Filter

DAY = 86_400_000
NOW = 1_791_158_400_000


def value(spark, column, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("a.md", ["x"], [], 1), ("ops/b.md", ["x", "y"], ["ops"], 2), ("ops/db/c.md", ["y", "y"], ["ops", "ops/db"], 3), ("opsy/d.md", [], ["opsy"], 4)]
    return spark.createDataFrame([(p, p, t, d, u * DAY, "{}", 2) for p, t, d, u in rows], "path string, title string, tags array<string>, dirs array<string>, updated_at long, meta string, n_chunks int").cache()


@pytest.mark.parametrize(
    ("raw", "names"),
    [({}, "abcd"), ({"tags": ["x"]}, "ab"), ({"tags": ["x", "y"]}, "b"), ({"tags": []}, "abcd"), ({"tags_any": ["x", "y"]}, "abc"), ({"dir": "ops"}, "bc"), ({"dir": "./ops//db/"}, "c"), ({"dir": "/"}, "abcd"), ({"updated_after": 2 * DAY}, "cd"), ({"dir": "ops", "tags_any": ["x"], "updated_after": DAY}, "b")],
)
def test_filter(docs, raw, names):
    got = docs.filter(Filter.parse(raw).column()).select("path").collect()
    assert "".join(sorted(r.path.split("/")[-1][0] for r in got)) == names


@pytest.mark.parametrize("raw", [{"tag": ["x"]}, {"tags": [""]}, {"tags": "x"}, {"dir": "a/../b"}, {"dir": "a\\b"}, {"updated_after": float("nan")}, {"updated_after": True}])
def test_filter_is_strict(raw):
    with pytest.raises(InvalidRequest):
        Filter.parse(raw)


def test_since_is_inclusive(docs):
    assert docs.filter(Filter.since(3 * DAY).column()).count() == 2


def test_overview_and_listing(docs):
    assert listing.counts(docs, Filter(tags=("x",))).first() == (2, 4)
    assert [tuple(r) for r in listing.tag_counts(docs).collect()] == [("x", 2), ("y", 2)]
    assert [r.path for r in listing.listed(docs, sort="updated_at", limit=2).collect()] == ["opsy/d.md", "ops/db/c.md"]
    assert [r.path for r in listing.listed(docs, offset=1, limit=2).collect()] == ["ops/b.md", "ops/db/c.md"]


def test_text_functions(spark):
    assert value(spark, text.collapsed(F.col("t")), t=" a\u00a0\n b ") == "a b"
    assert value(spark, text.normalized(F.col("t")), t="\ufeffa\r\nb\rc") == "a\nb\rc"
    assert value(spark, text.is_blank(F.col("t")), t=" \u200b\u3000\t") is True
    assert value(spark, text.ancestor_dirs(F.col("t")), t="a/b/c.md") == ["a", "a/b"]
    assert value(spark, text.ancestor_dirs(F.col("t")), t="c.md") == []
    assert value(spark, text.slug(F.col("t")), t="Ünï (x)_y z!") == "ünï-x_y-z"
    assert value(spark, text.middle_cut(F.col("t"), 20), t="Doc › Very long heading") == "Doc › Very…g heading"
    assert value(spark, text.quoted(F.col("t")), t=" \n\na\n\nb") == "> a\n>\n> b"
    assert value(spark, text.decoded_ref(F.col("t")), t="a%20b+c%23d") == "a b+c#d"
    assert value(spark, text.posix_path(F.col("t")), t="a\\b") == "a/b"
    assert [value(spark, text.plain_number(F.col("t")), t=t) for t in ("1.5", "-2e3", "0x10", "", "1.")] == [1.5, -2000.0, None, None, 1.0]
    assert value(spark, text.tokens(F.col("t")), t="The ERR_X_504 and Über-test") == ["err_x_504", "über", "test"]


@pytest.mark.parametrize(("t", "ms"), [("0000-02-29", -62_162_121_600_000), ("2026-10-05T00:00:00Z", NOW), ("2026-02-30", None), ("2026-01-01T10:00", None), ("2026-01-01T24:00:00Z", None)])
def test_updated_at(spark, t, ms):
    assert value(spark, text.updated_at_ms(F.col("t")), t=t) == ms


def test_scores(spark):
    assert value(spark, scores.recency(F.col("t"), NOW, 90), t=NOW + DAY) == 1
    blend = scores.blend(F.lit(0.5), scores.recency(F.lit(NOW - 15 * DAY), NOW, 90), F.lit(0.0), 0.15, 0.0)
    assert value(spark, blend) == pytest.approx(0.5586348077)
    assert value(spark, scores.applied_tag_weight(F.array(F.lit("a"), F.lit("b")), {"a": 0.2, "b": -0.2, "c": 0.5})) == -0.2
    assert value(spark, scores.tag_signal(F.array(F.lit("a")), {})) == 0
    assert value(spark, scores.cosine(F.array(F.lit(1.0), F.lit(0.0)), scores.vector([1, 1]))) == pytest.approx(math.sqrt(0.5))


@pytest.fixture(scope="module")
def index(spark):
    rows = [("many.md", 0, "webhook webhook retry"), ("many.md", 1, "webhook late"), ("many.md", 2, "webhook"), ("once.md", 0, "a webhook among many other words that say little"), ("none.md", 0, "nothing here: ERR_WEBHOOK_TIMEOUT_504"), ("none.md", 1, "  ")]
    vectors = {"many.md": [1.0, 0.0], "once.md": [0.6, 0.8], "none.md": [-1.0, 0.0]}
    data = [(p, o, "Title", "Title", "" if o == 0 else f"s{o}", t, ["slack"] if p == "once.md" else [], [], NOW - 15 * DAY, vectors[p]) for p, o, t in rows]
    return spark.createDataFrame(data, "path string, ordinal int, title string, breadcrumb string, anchor string, text string, tags array<string>, dirs array<string>, updated_at long, embedding array<double>").cache()


def test_keyword(index):
    got = ranking.top(ranking.keyword(index, "the Webhook?"), 30).collect()
    assert {(r.path, r.ordinal) for r in got} == {("many.md", 0), ("many.md", 1), ("many.md", 2), ("once.md", 0)}
    assert got[-1].path == "once.md" and all(a.score >= b.score for a, b in zip(got, got[1:], strict=False))
    assert [(r.path) for r in ranking.keyword(index, "err_webhook_timeout_504").collect()] == ["none.md"]
    assert ranking.keyword(index, "webhook", Filter(tags=("slack",))).count() == 1
    assert ranking.keyword(index, "webh").count() == 0 and ranking.keyword(index, "webh", prefix=True).count() == 4
    for blank in (" ", "the and of", "???"):
        assert ranking.keyword(index, blank).count() == 0


def test_semantic_and_hybrid(index):
    near = ranking.semantic(index, [1.0, 0.0])
    assert near.count() == 6
    mixed = {(r.path, r.ordinal): r.score for r in ranking.hybrid(ranking.keyword(index, "webhook"), near).collect()}
    assert ("none.md", 0) not in mixed and max(mixed.values()) <= 1 + 1e-9
    heavy = ranking.top(ranking.hybrid(ranking.keyword(index, "webhook"), near, 1000, 1), 1).first()
    assert heavy.path == "many.md"


def test_cap(index):
    got = ranking.capped(ranking.semantic(index, [1.0, 0.0])).collect()
    assert sorted((r.path, r.ordinal) for r in got) == [("many.md", 0), ("many.md", 1), ("none.md", 0), ("none.md", 1), ("once.md", 0)]


def results(index, rerank=None, **changes):
    options = retrieval.Options(mode="semantic").merged(changes.pop("weights", None), **changes)
    found = ranking.capped(ranking.top(ranking.semantic(index, [1.0, 0.0]), 30))
    return retrieval.retrieve(found, index, options, NOW, rerank).collect()


def test_without_a_reranker_the_best_hit_sets_the_scale(index):
    got = results(index, limit=10)
    assert got[0].scores.rerank is None and got[0].scores.relevance == 1 and got[0].ref == "many.md"
    assert (got[0]["first"], got[0]["last"]) == (0, 1) and got[0].text == "webhook webhook retrywebhook late"


def test_reranked(index):
    got = results(index, rerank=lambda p: F.lit(0.0), limit=10)
    assert got[0].scores.final == pytest.approx(0.5586348077)
    blank = [r for r in got if r.path == "none.md"]
    assert blank[0]["last"] == 1  # neighbours merge, the blank one is never ranked itself
    low = results(index, rerank=lambda p: F.lit(-20.0), limit=10, min_score=0.1)
    assert low == []


def test_expand_and_limit(index):
    got = results(index, rerank=lambda p: F.when(p.contains("late"), 3.0).otherwise(-3.0), limit=1, expand=1, min_score=0.5)
    assert [(r.ref, r["first"], r["last"]) for r in got] == [("many.md#s1", 0, 2)]


def test_no_candidates(index):
    found = ranking.keyword(index, "zebra")
    assert retrieval.retrieve(found, index, retrieval.Options(), NOW, lambda p: F.lit(0.0)).count() == 0


@pytest.mark.parametrize("weights", [{"speed": 0.1}, {"tag:": 0.1}, {"recency": -0.1}, {"recency": 0.6}, {"tag:slack": 0.4}, {"tag:x": 0.1}, {"tag:slack": float("nan")}, {"tag:slack": 1.5}])
def test_weights_are_checked(weights):
    with pytest.raises(InvalidRequest):
        retrieval.Options().merged(weights).checked({"slack"})


def test_weight_hint():
    with pytest.raises(InvalidRequest, match="default"):
        retrieval.Options().merged({"tag:slack": -0.4}).checked({"slack"})
    assert retrieval.Options().merged({"tag:slack": -0.4, "recency": 0.1}).checked({"slack"}).weights["recency"] == 0.1


@pytest.mark.parametrize("changes", [{"mode": "x"}, {"limit": 0}, {"limit": 11}, {"expand": 3}, {"candidates": 0}, {"min_score": float("inf")}, {"half_life": 0}, {"hybrid_weights": (0.0, 1.0)}])
def test_options_are_checked(changes):
    with pytest.raises(InvalidRequest):
        retrieval.Options().merged(**changes).checked()


def test_freshness(spark):
    docs = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, doc_hash string")
    heads = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4"), ("e", "5")], "path string, stored_hash string")
    failed = spark.createDataFrame([("e",)], "path string")
    assert dict(freshness.statuses(docs, heads, failed).collect()) == {"a": "current", "b": "stale", "c": "missing", "d": "orphan", "e": "unread"}


def test_gaps(spark):
    bodies = spark.createDataFrame([("a", "one  two"), ("b", "x"), ("c", "xy  ")], "path string, body string")
    spans = spark.createDataFrame([("a", 0, 3), ("a", 5, 8), ("c", 1, 2)], "path string, start int, end int")
    assert sorted(tuple(r) for r in freshness.gaps(spans, bodies).collect()) == [("b", 0), ("c", 0)]


def test_reuse(spark):
    planned = spark.createDataFrame([("a", 0, "h1", "t1"), ("a", 1, "h2", "t2"), ("a", 2, "h2", "t2"), ("b", 0, "h1", "t1")], "path string, ordinal int, hash string, text string")
    old = spark.createDataFrame([("a", "h1", "m", [9.0]), ("b", "h1", "other", [8.0])], "path string, hash string, model string, embedding array<double>")
    rows = writing.with_reuse(planned, old, "m")
    assert sorted(tuple(r)[:2] for r in writing.pending(rows).collect()) == [("a", "h2"), ("b", "h1")]
    done = writing.completed(rows, lambda t: F.array(F.length(t).cast("double")))
    assert {(r.path, r.ordinal): (r.embedding, r.reused) for r in done.collect()} == {("a", 0): ([9.0], True), ("a", 1): ([2.0], False), ("a", 2): ([2.0], False), ("b", 0): ([2.0], False)}
    assert writing.report(done, 3) == {"written": 2, "up_to_date": 1, "chunks_embedded": 3, "chunks_reused": 1}
