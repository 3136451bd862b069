"""Registered queries and, beside each, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fernglass.functions import scores, text
from fernglass.operators import freshness, listing, ranking, retrieval, writing
from fernglass.operators.filters import Filter
from fernglass.plans.kb import CHUNKS_SQL, DAY_MS, KB_SQL, NOW_MS, documents, index, paths, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# -- filters, overview, listing --------------------------------------------------------------------------------

HALF_YEAR = NOW_MS - 180 * DAY_MS
FILTERS = {
    "filter_tags_all": (Filter.parse({"tags": ["en", "good"]}), "list_has_all(tags, ['en', 'good'])"),
    "filter_tags_any": (Filter.parse({"tags_any": ["fr", "toxic"]}), "list_has_any(tags, ['fr', 'toxic'])"),
    "filter_dir": (Filter.parse({"dir": "./src1/"}), "starts_with(path, 'src1/')"),
    "filter_updated_after": (Filter.parse({"updated_after": HALF_YEAR}), f"updated_at > {HALF_YEAR}"),
    "filter_combined": (Filter.parse({"tags": ["good"], "tags_any": ["en", "de"], "dir": "src2//", "updated_after": HALF_YEAR}), f"list_contains(tags, 'good') AND list_has_any(tags, ['en', 'de']) AND starts_with(path, 'src2/') AND updated_at > {HALF_YEAR}"),
    "filter_since": (Filter.since(NOW_MS - 30 * DAY_MS), f"updated_at >= {NOW_MS - 30 * DAY_MS}"),
}


def _filtered(filter: Filter):
    return lambda spark, sf: documents(spark, sf).filter(filter.column()).select("doc_id", "path", "updated_at")


for _name, (_filter, _where) in FILTERS.items():
    QUERIES[_name] = _filtered(_filter)
    SQL[_name] = f"WITH {KB_SQL} SELECT doc_id, path, updated_at FROM kb WHERE {_where}"


@query(f"WITH {KB_SQL} SELECT count(*) AS documents, coalesce(sum(len(string_split(body, chr(10)))), 0)::BIGINT AS chunks FROM kb WHERE list_contains(tags, 'en')")
def overview_counts(spark, sf):
    docs = documents(spark, sf).withColumn("n_chunks", F.size(F.split("body", "\n")))
    return listing.counts(docs, Filter(tags=("en",)))


@query(f"WITH {KB_SQL} SELECT tag, count(DISTINCT path) AS documents FROM (SELECT path, unnest(tags) AS tag FROM kb) GROUP BY tag")
def tag_counts(spark, sf):
    return listing.tag_counts(documents(spark, sf))


@query(f"WITH {KB_SQL} SELECT DISTINCT unnest(tags) AS tag FROM kb")
def tag_vocabulary(spark, sf):
    return listing.tag_vocabulary(documents(spark, sf))


@query(f"WITH {KB_SQL} SELECT path AS ref, path, title, array_to_string(tags, ',') AS tags, updated_at FROM kb WHERE list_contains(tags, 'good') ORDER BY path LIMIT 50 OFFSET 20")
def list_by_path_page(spark, sf):
    return listing.listed(documents(spark, sf), Filter(tags=("good",)), "path", 20, 50).withColumn("tags", F.array_join("tags", ","))


@query(f"WITH {KB_SQL} SELECT path AS ref, path, title, array_to_string(tags, ',') AS tags, updated_at FROM kb ORDER BY updated_at DESC, path LIMIT 50")
def list_by_updated(spark, sf):
    return listing.listed(documents(spark, sf), sort="updated_at").withColumn("tags", F.array_join("tags", ","))


@query(f"WITH {KB_SQL} SELECT count(*) AS total FROM kb WHERE list_has_any(tags, ['fr', 'toxic'])")
def list_total(spark, sf):
    return documents(spark, sf).filter(Filter(tags_any=("fr", "toxic")).column()).agg(F.count("*").alias("total"))


# -- scalar functions ------------------------------------------------------------------------------------------


@query(f"WITH {KB_SQL} SELECT path, array_to_string(dirs, '|') AS dirs FROM kb")
def ancestor_dirs(spark, sf):
    return documents(spark, sf).select("path", F.array_join("dirs", "|").alias("dirs"))


@query("SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS doc_hash FROM documents")
def doc_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.digest(text.normalized(F.col("text"))).alias("doc_hash"))


@query("SELECT conv_id, turn, sha256(role || chr(10) || text) AS hash FROM conversations")
def chunk_hash(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("breadcrumb"), "text").select("conv_id", "turn", freshness.chunk_hash().alias("hash"))


@query(r"SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM benchmark")
def collapsed_text(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.collapsed(F.col("text")).alias("text"))


@query(r"SELECT p_partkey, CASE WHEN s = '' THEN 'section' ELSE s END AS slug FROM (SELECT p_partkey, replace(regexp_replace(lower(p_name || ' (' || p_type || ') #' || p_size), '[^\p{L}\p{M}\p{N}\p{Pc}\- ]', '', 'g'), ' ', '-') AS s FROM part)")
def slug_base(spark, sf):
    name = F.concat("p_name", F.lit(" ("), "p_type", F.lit(") #"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", text.slug(name).alias("slug"))


@query("SELECT p_partkey, CASE WHEN length(b) <= 20 THEN b ELSE substr(b, 1, 10) || '…' || right(b, 9) END AS breadcrumb FROM (SELECT p_partkey, concat_ws(' › ', p_name, p_type, p_brand) AS b FROM part)")
def breadcrumb_cut(spark, sf):
    crumb = F.concat_ws(" › ", "p_name", "p_type", "p_brand")
    return table(spark, sf, "part").select("p_partkey", text.middle_cut(crumb, 20).alias("breadcrumb"))


@query(r"""SELECT item_id, k::INT AS position, s AS sentence FROM (SELECT item_id, unnest(parts) AS s, unnest(generate_series(0, len(parts) - 1)) AS k FROM
    (SELECT item_id, list_filter(string_split(regexp_replace(text, '([.!?]["'')\]]*)\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS parts FROM benchmark))""")
def sentence_split(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.posexplode(text.sentences(F.col("text"))).alias("position", "sentence"))


@query(f"""WITH RECURSIVE s AS (SELECT item_id, list_filter(string_split(regexp_replace(text, '([.!?]["'')\\]]*)\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS parts FROM benchmark),
p AS (SELECT item_id, 1 AS k, 1 AS grp, length(parts[1])::BIGINT AS size, parts FROM s WHERE len(parts) > 0
    UNION ALL SELECT item_id, k + 1, CASE WHEN size + length(parts[k + 1]) > 200 THEN grp + 1 ELSE grp END, CASE WHEN size + length(parts[k + 1]) > 200 THEN length(parts[k + 1]) ELSE size + length(parts[k + 1]) END, parts FROM p WHERE k < len(parts))
SELECT item_id, grp::INT AS grp, count(*) AS sentences, max(size) AS size FROM p GROUP BY item_id, grp""")
def pack_sentences(spark, sf):
    """Sentences in the chunker's groups: one ends before the sentence that would make it too long."""
    from fernglass.sources.blocks import Block
    from fernglass.sources.chunker import packed

    def groups(batches):
        for batch in batches:
            rows = []
            for item, parts in zip(batch.column("item_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                ends = [0]
                for p in parts:
                    ends.append(ends[-1] + len(p))
                blocks = [Block("paragraph", a, z, []) for a, z in zip(ends, ends[1:], strict=False)]
                rows += [{"item_id": item, "grp": k, "sentences": len(g), "size": g[-1].end - g[0].start} for k, g in enumerate(packed(blocks, lambda a, z: z - a > 200) if blocks else [], 1)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("item_id", pa.int64()), ("grp", pa.int32()), ("sentences", pa.int64()), ("size", pa.int64())]))

    rows = table(spark, sf, "benchmark").select("item_id", text.sentences(F.col("text")).alias("parts"))
    return rows.mapInArrow(groups, "item_id long, grp int, sentences long, size long")


@query("SELECT o_orderkey, (epoch_ms(o_orderdate) // 1000 * 1000)::BIGINT AS ms, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def updated_at_parsed(spark, sf):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf, "orders").select("o_orderkey", text.updated_at_ms(stamp).alias("ms")).withColumn("day", text.day(F.col("ms")))


@query("SELECT event_id, event_type AS title, epoch_ms(date_trunc('second', ts)) AS updated_at, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events")
def meta_fields(spark, sf):
    """Fields of the frontmatter beside the fixed ones pass through as JSON."""
    from fernglass.sources import markdown

    head = F.concat(F.lit("---\ntitle: "), "event_type", F.lit("\nupdated_at: "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("\ntags: [x]\n"))
    more = F.array_join(F.transform(F.json_object_keys("props"), lambda k: F.concat(k, F.lit(": "), F.element_at(F.from_json("props", "map<string,string>"), k), F.lit("\n"))), "")
    files = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("path"), F.encode(F.concat(head, more, F.lit("---\n")), "UTF-8").alias("content"))
    docs = markdown.documents(markdown.parse_rows(files))
    keys = F.json_object_keys("meta")
    return docs.select(F.col("path").cast("long").alias("event_id"), "title", "updated_at", F.element_at(F.from_json("meta", "map<string,string>"), F.get(keys, F.lit(0))).alias("first_value"), F.array_join(F.array_sort(keys), ",").alias("keys"))


@query("""SELECT o_orderkey, printf('%.3f', o_totalprice / 7.0::DOUBLE) AS score, CASE WHEN regexp_matches(t, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN t::DOUBLE END AS plain
FROM (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN '-' || o_orderkey || '.25' WHEN 1 THEN '.' || o_orderkey || 'e-3' WHEN 2 THEN o_orderkey || '.' WHEN 3 THEN '1e' || o_orderkey || 'x' ELSE o_orderpriority END AS t FROM orders)""")
def formatted_numbers(spark, sf):
    key = F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 5
    written = F.when(kind == 0, F.concat(F.lit("-"), key, F.lit(".25"))).when(kind == 1, F.concat(F.lit("."), key, F.lit("e-3"))).when(kind == 2, F.concat(key, F.lit("."))).when(kind == 3, F.concat(F.lit("1e"), key, F.lit("x"))).otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", text.three_decimals(F.col("o_totalprice") / 7.0).alias("score"), text.plain_number(written).alias("plain"))


# -- candidates ------------------------------------------------------------------------------------------------

WORDS = ("the", "tion", "thand")  # the first is a stop word
TERMS = ranking.query_terms("the tion thand")
STOPS = ", ".join(f"'{w}'" for w in text.STOPWORDS)


def _field_sql(field: str, boost: float) -> str:
    one = lambda t: f"""CASE WHEN tf_{field}_{t} > 0 THEN {boost}::DOUBLE * ln(1 + (n - df_{field}_{t} + 0.5::DOUBLE) / (df_{field}_{t} + 0.5::DOUBLE)) * tf_{field}_{t} * 2.2::DOUBLE / (tf_{field}_{t} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len_{field} / mean_{field})) ELSE 0 END"""
    return " + ".join(one(t) for t in TERMS)


def keyword_sql() -> str:
    """CTEs up to hits(path, ordinal, score), over every chunk."""
    fields = ("title", "breadcrumb", "text")
    toks = ", ".join(f"list_filter(regexp_extract_all(lower({f}), '[\\p{{L}}\\p{{N}}_]+'), lambda t: t NOT IN ({STOPS})) AS {f}_tokens" for f in fields)
    tfs = ", ".join([f"len({f}_tokens)::DOUBLE AS len_{f}" for f in fields] + [f"len(list_filter({f}_tokens, lambda t: t = '{t}'))::DOUBLE AS tf_{f}_{t}" for f in fields for t in TERMS])
    stats = ", ".join(["count(*)::DOUBLE AS n"] + [f"avg(len_{f}) AS mean_{f}" for f in fields] + [f"count(*) FILTER (tf_{f}_{t} > 0)::DOUBLE AS df_{f}_{t}" for f in fields for t in TERMS])
    score = " + ".join(_field_sql(f, ranking.BOOSTS[f]) for f in fields)
    return f"""{CHUNKS_SQL},
tok AS (SELECT path, ordinal, tags, dirs, updated_at, {toks} FROM chunks),
tfs AS (SELECT path, ordinal, tags, dirs, updated_at, {tfs} FROM tok),
stats AS (SELECT {stats} FROM tfs),
hits AS (SELECT path, ordinal, tags, {score} AS score FROM tfs, stats)"""


def _top30(hits):
    return ranking.top(hits.withColumn("score", r6("score")), 30)


SEARCH = " ".join(WORDS)


@query(f"WITH {keyword_sql()} SELECT path, ordinal, round(score, 6) AS score FROM hits WHERE score > 0 ORDER BY round(score, 6) DESC, path, ordinal LIMIT 30")
def keyword_bm25(spark, sf):
    return _top30(index(spark, sf).words.keyword(SEARCH))


@query(f"WITH {keyword_sql()} SELECT path, ordinal, round(score, 6) AS score FROM hits WHERE score > 0 AND list_contains(tags, 'good') ORDER BY round(score, 6) DESC, path, ordinal LIMIT 30")
def keyword_filtered(spark, sf):
    return _top30(index(spark, sf).words.keyword(SEARCH, allowed=documents(spark, sf).filter(Filter(tags=("good",)).column())))


@query(f"WITH {CHUNKS_SQL} SELECT path, ordinal, 0.0::DOUBLE AS score FROM chunks WHERE false")
def keyword_without_terms(spark, sf):
    return index(spark, sf).words.keyword("the and of")


@query(f"WITH {keyword_sql()} SELECT path, ordinal, round(score, 6) AS score FROM hits WHERE score > 0 ORDER BY round(score, 6) DESC, path, ordinal LIMIT 30")
def keyword_scan(spark, sf):
    """The same search without an index."""
    return _top30(ranking.keyword(index(spark, sf).chunks, SEARCH))


def _vectors(spark, sf) -> DataFrame:
    """Vectors as chunks: the label is the document."""
    rows = table(spark, sf, "embeddings").filter("embedding is not null")
    return rows.select(F.concat(F.lit("l"), F.col("label").cast("string")).alias("path"), F.col("vec_id").cast("int").alias("ordinal"), "embedding")


def _query_vector(spark, sf) -> list[float]:
    return list(table(spark, sf, "embeddings").filter("vec_id = 3").first().embedding)


COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
SEMANTIC_SQL = f"near AS (SELECT 'l' || e.label AS path, e.vec_id::INT AS ordinal, round({COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 3 AND e.embedding IS NOT NULL)"


@query(f"WITH {SEMANTIC_SQL} SELECT * FROM near ORDER BY score DESC, path, ordinal LIMIT 30")
def semantic_topk(spark, sf):
    return _top30(ranking.semantic(_vectors(spark, sf), _query_vector(spark, sf)))


@query(f"WITH {SEMANTIC_SQL}, top AS (SELECT * FROM near ORDER BY score DESC, path, ordinal LIMIT 30) SELECT path, ordinal, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, ordinal) AS k FROM top) WHERE k <= 2")
def semantic_cap_per_label(spark, sf):
    return ranking.capped(_top30(ranking.semantic(_vectors(spark, sf), _query_vector(spark, sf))))


HYBRID_SQL = f"""{keyword_sql()},
doc AS (SELECT path, max(score) AS score FROM hits WHERE score > 0 GROUP BY path),
near AS (SELECT kb.path, {COS} AS score FROM embeddings e JOIN kb ON kb.doc_id = e.vec_id, embeddings q WHERE q.vec_id = 3 AND e.embedding IS NOT NULL),
sides AS (SELECT path, 0.5::DOUBLE * (score / (SELECT max(score) FROM doc)) AS score FROM doc
    UNION ALL SELECT path, 0.5::DOUBLE * (score / (SELECT max(score) FROM near)) FROM near WHERE score >= 2.220446049250313e-16),
mixed AS (SELECT path, 0 AS ordinal, round(sum(score), 6) AS score FROM sides GROUP BY path)"""


def _hybrid(spark, sf) -> DataFrame:
    by_line = index(spark, sf).words.keyword(SEARCH)
    by_doc = by_line.groupBy("path").agg(F.max("score").alias("score")).withColumn("ordinal", F.lit(0)).select("path", "ordinal", "score")
    near = paths(spark, sf).withColumnRenamed("doc_id", "vec_id").join(table(spark, sf, "embeddings").filter("embedding is not null"), "vec_id").withColumns({"ordinal": F.lit(0), "tags": F.array().cast("array<string>")})
    return ranking.hybrid(by_doc, ranking.semantic(near, _query_vector(spark, sf)))


@query(f"WITH {HYBRID_SQL} SELECT path, ordinal, score FROM mixed ORDER BY score DESC, path LIMIT 30")
def hybrid_topk(spark, sf):
    return _top30(_hybrid(spark, sf))


# -- scores ----------------------------------------------------------------------------------------------------

TAG_WEIGHTS = {"good": 0.2, "toxic": -0.3, "fr": 0.3}


@query(f"WITH {KB_SQL} SELECT path, round(pow(0.5::DOUBLE, greatest(0, ({NOW_MS} - updated_at) / {DAY_MS}.0::DOUBLE) / 90.0::DOUBLE), 6) AS recency FROM kb")
def recency_signal(spark, sf):
    return documents(spark, sf).select("path", r6(scores.recency(F.col("updated_at"), NOW_MS, 90.0)).alias("recency"))


TAG_SQL = "CASE WHEN list_contains(tags, 'toxic') THEN -0.3::DOUBLE WHEN list_contains(tags, 'fr') THEN 0.3::DOUBLE WHEN list_contains(tags, 'good') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END"


@query(f"WITH {KB_SQL} SELECT path, round({TAG_SQL}, 6) AS applied, round({TAG_SQL} / 0.3::DOUBLE, 6) AS signal FROM kb")
def tag_signal(spark, sf):
    return documents(spark, sf).select("path", r6(scores.applied_tag_weight(F.col("tags"), TAG_WEIGHTS)).alias("applied"), r6(scores.tag_signal(F.col("tags"), TAG_WEIGHTS)).alias("signal"))


@query(f"WITH {KB_SQL} SELECT path, round(0.55::DOUBLE * ((doc_id % 100) / 100.0::DOUBLE) + 0.15::DOUBLE * pow(0.5::DOUBLE, ({NOW_MS} - updated_at) / {DAY_MS}.0::DOUBLE / 90.0::DOUBLE) + 0.3::DOUBLE * ({TAG_SQL} / 0.3::DOUBLE), 6) AS final FROM kb")
def blend_final(spark, sf):
    out = scores.blend((F.col("doc_id") % 100) / F.lit(100.0), scores.recency(F.col("updated_at"), NOW_MS, 90.0), scores.tag_signal(F.col("tags"), TAG_WEIGHTS), 0.15, 0.3)
    return documents(spark, sf).select("path", r6(out).alias("final"))


@query(f"WITH {SEMANTIC_SQL}, top AS (SELECT * FROM near ORDER BY score DESC, path, ordinal LIMIT 30) SELECT path, ordinal, round(greatest(score, 0) / max(score) OVER (), 6) AS relevance FROM top")
def normalised_relevance(spark, sf):
    top = _top30(ranking.semantic(_vectors(spark, sf), _query_vector(spark, sf)))
    return retrieval.relevance_of(top, rerank=False).select("path", "ordinal", r6("relevance").alias("relevance"))


@query(f"WITH {SEMANTIC_SQL}, top AS (SELECT * FROM near ORDER BY score DESC, path, ordinal LIMIT 30) SELECT path, ordinal FROM (SELECT path, ordinal, greatest(score, 0) / max(score) OVER () AS r FROM top) WHERE r >= 0.5")
def cutoff_relevance(spark, sf):
    top = _top30(ranking.semantic(_vectors(spark, sf), _query_vector(spark, sf)))
    return retrieval.relevance_of(top, rerank=False).filter("relevance >= 0.5").select("path", "ordinal")


# -- merging neighbours: a conversation is a document, a turn a chunk --------------------------------------------

HITS_SQL = "conv AS (SELECT 'c' || conv_id AS path, turn::INT AS ordinal, text FROM conversations), last AS (SELECT path, max(ordinal) AS last FROM conv GROUP BY path), hit AS (SELECT path, ordinal, ((ordinal * 7) % 11)::DOUBLE AS final FROM conv WHERE (ordinal * 7) % 3 = 0)"


def islands_sql(expand: int) -> str:
    return f"""{HITS_SQL},
r AS (SELECT path, ordinal, final, greatest(0, ordinal - {expand}) AS f, least(last, ordinal + {expand}) AS t FROM hit JOIN last USING (path)),
s AS (SELECT *, CASE WHEN f > max(t) OVER (PARTITION BY path ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ordinal) AS island FROM s),
m AS (SELECT path, min(f)::INT AS first, max(t)::INT AS last, arg_max(ordinal, [final, -ordinal]) AS best FROM i GROUP BY path, island)"""


def _turns(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").cast("int").alias("ordinal"), "text")


def _islands(spark, sf, expand: int) -> DataFrame:
    rows = _turns(spark, sf)
    hits = rows.filter("ordinal * 7 % 3 = 0").select("path", "ordinal", (F.col("ordinal") * 7 % 11).cast("double").alias("final"), F.lit(True).alias("reranked"))
    return retrieval.merged(hits, rows.groupBy("path").agg(F.max("ordinal").alias("last")), expand)


@query(f"WITH {islands_sql(0)} SELECT path, first, last, best FROM m")
def merge_islands(spark, sf):
    return _islands(spark, sf, 0).select("path", "first", "last", F.col("best.ordinal").alias("best"))


@query(f"WITH {islands_sql(1)} SELECT path, first, last, best FROM m")
def expand_neighbours(spark, sf):
    return _islands(spark, sf, 1).select("path", "first", "last", F.col("best.ordinal").alias("best"))


@query(f"WITH {islands_sql(1)} SELECT m.path, first, last, string_agg(text, '' ORDER BY ordinal) AS text FROM m JOIN conv ON conv.path = m.path AND ordinal BETWEEN first AND last GROUP BY m.path, first, last")
def join_chunks(spark, sf):
    return retrieval.joined_text(_islands(spark, sf, 1).select("path", "first", "last"), _turns(spark, sf))


RERANK_WORDS = "tion and thand"


@query(f"SELECT item_id, ({' + '.join(f'CASE WHEN contains(lower(text), {w!r}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END' for w in RERANK_WORDS.split())}) - 1.0::DOUBLE AS logit, round(1 / (1 + exp(-(({' + '.join(f'CASE WHEN contains(lower(text), {w!r}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END' for w in RERANK_WORDS.split())}) - 1.0::DOUBLE))), 6) AS relevance FROM benchmark")
def rerank_overlap(spark, sf):
    logit = retrieval.word_overlap(RERANK_WORDS)(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", logit.alias("logit"), r6(scores.logistic(logit)).alias("relevance"))


@query(f"""WITH {keyword_sql()},
cand AS (SELECT path, ordinal, score FROM hits WHERE score > 0 ORDER BY score DESC, path, ordinal LIMIT 30),
cap AS (SELECT path, ordinal, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, ordinal) AS k FROM cand) WHERE k <= 2),
found AS (SELECT cap.*, c.breadcrumb, c.text, c.tags, c.updated_at, ({' + '.join(f"CASE WHEN contains(lower(concat_ws(chr(10), c.breadcrumb, c.text)), '{w}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for w in WORDS)}) - 1.0::DOUBLE AS logit FROM cap JOIN chunks c USING (path, ordinal)),
fin AS (SELECT *, 1 / (1 + exp(-logit)) AS relevance, 0.85::DOUBLE * (1 / (1 + exp(-logit))) + 0.15::DOUBLE * pow(0.5::DOUBLE, greatest(0, ({NOW_MS} - updated_at) / {DAY_MS}.0::DOUBLE) / 90.0::DOUBLE) AS final FROM found),
lst AS (SELECT path, max(ordinal) AS last FROM chunks GROUP BY path),
r AS (SELECT fin.*, greatest(0, ordinal - 1) AS f, least(last, ordinal + 1) AS t FROM fin JOIN lst USING (path)),
s AS (SELECT *, CASE WHEN f > max(t) OVER (PARTITION BY path ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ordinal) AS island FROM s),
m AS (SELECT path, min(f) AS first, max(t) AS last, arg_max(ordinal, [final, -ordinal]) AS best, max(final) AS final FROM i GROUP BY path, island),
ranked AS (SELECT *, row_number() OVER (ORDER BY final DESC, path, first) AS rank FROM m ORDER BY final DESC, path, first LIMIT 10)
SELECT rank::INT AS rank, ranked.path, path || CASE WHEN best = 0 THEN '' ELSE '#l' || best END AS ref, first::INT AS first, last::INT AS last, round(final, 6) AS final,
    (SELECT string_agg(text, '' ORDER BY c.ordinal) FROM chunks c WHERE c.path = ranked.path AND c.ordinal BETWEEN first AND last) AS text FROM ranked""")
def search_pipeline(spark, sf):
    """A whole search: candidates, cap, rerank, signals, cutoff, merge, order, limit."""
    own = index(spark, sf)
    found = ranking.capped(ranking.top(own.words.keyword(SEARCH), 30))
    options = retrieval.Options(mode="keyword", limit=10, expand=1)
    out = retrieval.retrieve(found, own.chunks, options, NOW_MS, retrieval.word_overlap(SEARCH))
    return out.select("rank", "path", "ref", "first", "last", r6("scores.final").alias("final"), "text")


# -- freshness and the write path: stored headers made from the documents, some altered -------------------------

STORE_SQL = f"""{KB_SQL}, d AS (SELECT doc_id, path, sha256(body) AS doc_hash FROM kb),
h AS (SELECT CASE WHEN doc_id % 7 = 5 THEN 'gone/' || path ELSE path END AS path, CASE WHEN doc_id % 7 = 3 THEN sha256('old') ELSE doc_hash END AS stored_hash, CASE WHEN doc_id % 11 = 0 THEN 'b' ELSE 'a' END AS stored_model FROM d WHERE doc_id % 7 <> 1)"""


def _stored(spark, sf) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark, sf).select("doc_id", "path", "body", text.digest(F.col("body")).alias("doc_hash"))
    k = F.col("doc_id") % 7
    path = F.when(k == 5, F.concat(F.lit("gone/"), "path")).otherwise(F.col("path"))
    headers = docs.filter(k != 1).select(
        path.alias("path"), F.when(k == 3, F.sha2(F.lit("old"), 256)).otherwise(F.col("doc_hash")).alias("stored_hash"), F.lit("c").alias("stored_chunker"), F.when(F.col("doc_id") % 11 == 0, "b").otherwise("a").alias("stored_model"), F.lit(64).alias("stored_dims")
    )
    return docs, headers


@query(f"WITH {STORE_SQL} SELECT coalesce(d.path, h.path) AS path, CASE WHEN doc_hash IS NULL THEN 'orphan' WHEN stored_hash IS NULL THEN 'missing' WHEN doc_hash = stored_hash THEN 'current' ELSE 'stale' END AS status FROM d FULL JOIN h ON d.path = h.path")
def fresh_stale_missing_orphan(spark, sf):
    return freshness.statuses(*_stored(spark, sf))


@query(f"WITH {STORE_SQL} SELECT path, stored_model FROM h WHERE (SELECT count(DISTINCT stored_model) FROM h JOIN d USING (path) WHERE stored_hash = doc_hash) > 1 AND EXISTS (SELECT 1 FROM d WHERE d.path = h.path AND doc_hash = stored_hash)")
def mixed_models(spark, sf):
    docs, headers = _stored(spark, sf)
    current = headers.join(docs.select("path", "doc_hash"), "path").filter("doc_hash = stored_hash")
    return freshness.mixed(current, "stored_model").join(current.select("path", "stored_model"), "path").select("path", "stored_model")


@query(f"WITH {STORE_SQL} SELECT d.path, coalesce(stored_hash = doc_hash, false) AS keep, coalesce(stored_model = 'a', false) AS same_model FROM d LEFT JOIN h ON d.path = h.path WHERE NOT coalesce(stored_hash = doc_hash AND stored_model = 'a', false)")
def documents_to_plan(spark, sf):
    return writing.to_plan(*_stored(spark, sf), "c", "a", 64).select("path", "keep", "same_model")


TURNS_SQL = "t AS (SELECT 'c' || conv_id AS path, turn::INT AS ordinal, text, sha256(role || chr(10) || text) AS hash FROM conversations), old AS (SELECT path, hash, min(ordinal % 5)::DOUBLE AS v FROM t WHERE ordinal % 2 = 0 GROUP BY path, hash)"


def _planned(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").cast("int").alias("ordinal"), "text", F.col("role").alias("breadcrumb")).withColumn("hash", freshness.chunk_hash())
    old = rows.filter("ordinal % 2 = 0").groupBy("path", "hash").agg(F.min(F.col("ordinal") % 5).cast("double").alias("v")).select("path", "hash", F.lit("a").alias("model"), F.array("v").alias("embedding"))
    return rows, old


@query(f"WITH {TURNS_SQL} SELECT DISTINCT path, hash FROM t WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.path = t.path AND old.hash = t.hash)")
def pending_chunks(spark, sf):
    rows, old = _planned(spark, sf)
    return writing.pending(writing.with_reuse(rows, old, "a")).select("path", "hash")


@query(f"WITH {TURNS_SQL} SELECT t.path, t.ordinal, old.v IS NOT NULL AS reused, coalesce(old.v, length(t.text)::DOUBLE) AS v FROM t LEFT JOIN old ON old.path = t.path AND old.hash = t.hash")
def vector_reuse(spark, sf):
    rows, old = _planned(spark, sf)
    done = writing.completed(writing.with_reuse(rows, old, "a"), lambda t: F.array(F.length(t).cast("double")))
    return done.select("path", "ordinal", "reused", F.get("embedding", F.lit(0)).alias("v"))


@query(f"WITH {TURNS_SQL} SELECT count(DISTINCT t.path) AS written, count(*) FILTER (old.v IS NOT NULL) AS reused, count(*) FILTER (old.v IS NULL) AS embedded FROM t LEFT JOIN old ON old.path = t.path AND old.hash = t.hash")
def embed_report(spark, sf):
    rows, old = _planned(spark, sf)
    done = writing.completed(writing.with_reuse(rows, old, "a"), lambda t: F.array(F.length(t).cast("double")))
    return done.agg(F.count_distinct("path").alias("written"), F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("embedded"))


SPANS_SQL = """b AS (SELECT 'd' || doc_id AS path, coalesce(text, '') AS body FROM documents),
c AS (SELECT path, 0 AS ordinal, 0 AS start, least(100, length(body)) AS "end" FROM b UNION ALL SELECT path, 1, least(150, length(body)), least(300, length(body)) FROM b)"""


def _spans(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two spans of every document, as far as its body reaches."""
    bodies = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("body"))
    till = lambda n: F.least(F.lit(n), F.length("body"))
    spans = F.array(*(F.struct(F.lit(k).alias("ordinal"), till(a).alias("start"), till(z).alias("end")) for k, (a, z) in enumerate(((0, 100), (150, 300)))))
    return bodies.select("path", F.explode(spans).alias("s")).select("path", "s.*"), bodies


@query(rf"""WITH {SPANS_SQL}, g AS (SELECT path, coalesce(lag("end") OVER (PARTITION BY path ORDER BY start), 0) AS "at", start AS till FROM c UNION ALL SELECT b.path, least(300, length(body)), length(body) FROM b)
SELECT g.path, "at"::BIGINT AS "at" FROM g JOIN b USING (path) WHERE till > g."at" AND NOT regexp_full_match(substr(body, (g."at" + 1)::INT, (till - g."at")::INT), '[\s\p{{Z}}\p{{C}}]*')""")
def coverage_gaps(spark, sf):
    return freshness.gaps(*_spans(spark, sf))


@query("""WITH s AS (SELECT 'd' || doc_id AS path, text AS body, string_split(text, chr(10) || chr(10)) AS parts FROM documents WHERE trim(text) <> ''),
t AS (SELECT path, length(body) AS n, unnest(generate_series(0, len(parts) - 1))::INT AS ordinal, unnest(parts) AS part FROM s)
SELECT path, max(n)::BIGINT AS "end", sum(length(part) + 2)::BIGINT - 2 AS covered FROM t GROUP BY path""")
def tiling_ends(spark, sf):
    """Chunks of the structural chunker tile every body: as long together as the text, without a gap or overlap."""
    from fernglass.engine import chunked
    from fernglass.sources.chunker import structural

    docs = table(spark, sf, "documents").filter(F.trim("text") != "").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.lit("").alias("doc_hash"), F.lit("title").alias("title"), F.col("text").alias("body"))
    rows = chunked(docs, structural()).withColumn("gap", F.coalesce(F.lag("end").over(W.partitionBy("path").orderBy("ordinal")), F.lit(0)) != F.col("start"))
    # offsets are UTF-16 units, the texts' characters are counted
    return rows.groupBy("path").agg(F.sum(F.length("text")).alias("end"), F.sum(F.when(F.col("gap"), F.lit(-1)).otherwise(F.length("text"))).alias("covered"))


@query("""WITH t AS (SELECT 'c' || conv_id AS path, turn::INT AS ordinal, (turn * 10)::INT AS start, (turn * 10 + 8 + 4 * (turn % 2))::INT AS "end" FROM conversations)
SELECT path, ordinal FROM (SELECT *, lag("end") OVER (PARTITION BY path ORDER BY ordinal) AS last FROM t) WHERE start < last""")
def disordered_chunks(spark, sf):
    turn = F.col("ordinal")
    spans = _turns(spark, sf).select("path", "ordinal", (turn * 10).alias("start"), (turn * 10 + 8 + 4 * (turn % 2)).alias("end"))
    return freshness.disordered(spans).select("path", "ordinal")


@query("""WITH t AS (SELECT 'c' || conv_id AS path, turn::INT AS ordinal, (1 + turn % 3)::INT AS depth, (turn * 10)::INT AS start FROM conversations)
SELECT path, ordinal, depth, start, coalesce((SELECT min(u.start) FROM t u WHERE u.path = t.path AND u.ordinal > t.ordinal AND u.depth <= t.depth), 1000)::INT AS section_end FROM t""")
def section_ends(spark, sf):
    heads = _turns(spark, sf).select("path", "ordinal", (1 + F.col("ordinal") % 3).alias("depth"), (F.col("ordinal") * 10).alias("start"), F.lit(1000).alias("length"))
    return listing.section_ends(heads)


@query("SELECT conv_id, count(*) AS blank FROM conversations WHERE regexp_full_match(CASE WHEN turn % 2 = 0 THEN ' ' || chr(9) || chr(10) ELSE text END, '[\\s\\p{Z}\\p{C}]*') GROUP BY conv_id")
def blank_chunks(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("text", F.when(F.col("turn") % 2 == 0, " \t\n").otherwise(F.col("text")))
    return rows.filter(text.is_blank(F.col("text"))).groupBy("conv_id").agg(F.count("*").alias("blank"))


# -- Markdown: a conversation as a document with a heading per turn ---------------------------------------------


def _pages(spark, sf) -> DataFrame:
    """(path, title, body) with one-line paragraphs below second-level headings."""
    part = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), text.collapsed(F.col("text")), F.lit("\n\n"))
    rows = table(spark, sf, "conversations").filter(F.trim("text") != "").select("conv_id", F.col("turn").cast("int").alias("turn"), part.alias("part"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "")
    return rows.groupBy("conv_id").agg(body.alias("body")).select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"), "body")


PAGES_SQL = r"""turns AS (SELECT 'c' || conv_id || '.md' AS path, 'Conversation ' || conv_id AS title, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, role || ' ' || turn AS heading,
    '## ' || role || ' ' || turn || chr(10) || chr(10) || trim(regexp_replace(text, '\s+', ' ', 'g')) || chr(10) || chr(10) AS part FROM conversations WHERE trim(text) <> '')"""


@query()
def structural_chunks(spark, sf):
    """Chunks of whole turns: long ones are split by sentence, which SQL doesn't say; tests compare with brute force."""
    from fernglass.engine import chunked
    from fernglass.sources.chunker import structural

    rows = chunked(_pages(spark, sf).withColumn("doc_hash", F.lit("")), structural())
    return rows.select("path", "ordinal", "breadcrumb", "anchor", "text", freshness.chunk_hash().alias("hash"))


@query(f"""WITH {PAGES_SQL} SELECT path, string_agg(part, '' ORDER BY ordinal) AS body, max(length(title || ' › ' || heading)) <= 250 AS short FROM turns GROUP BY path""")
def chunked_bodies(spark, sf):
    """The structural chunks of each document put together again: its body."""
    rows = structural_chunks(spark, sf)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "")
    return rows.groupBy("path").agg(body.alias("body"), (F.max(F.length("breadcrumb")) <= 250).alias("short"))


@query(f"""WITH {PAGES_SQL}, s AS (SELECT *, (1 + coalesce(sum(length(part)) OVER (PARTITION BY path ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM turns)
SELECT path, replace(heading, ' ', '-') AS anchor, 2 AS depth, start, (start + length(part))::BIGINT AS "end" FROM s""")
def document_outline(spark, sf):
    from fernglass.sources import markdown

    head = F.concat(F.lit("---\ntitle: "), "title", F.lit("\nupdated_at: 2026-01-01\ntags: [x]\n---\n"))
    files = _pages(spark, sf).select("path", F.encode(F.concat(head, "body"), "UTF-8").alias("content"))
    docs = markdown.documents(markdown.parse_rows(files))
    return docs.select("path", F.explode("headings").alias("h")).select("path", "h.anchor", "h.depth", "h.start", "h.end")


@query("""WITH t AS (SELECT 'c' || conv_id AS path, string_agg('"' || sha256(role || chr(10) || text) || '"', ',' ORDER BY turn) AS hashes FROM conversations GROUP BY conv_id)
SELECT sha256('[' || string_agg('["' || path || '","' || sha256(path) || '","c","m",64,[' || hashes || ']]', ',' ORDER BY path) || ']') AS version FROM t""")
def index_version(spark, sf):
    rows = _planned(spark, sf)[0].withColumns({"doc_hash": text.digest(F.col("path")), "chunker": F.lit("c"), "model": F.lit("m"), "dims": F.lit(64)})
    return spark.createDataFrame([(writing.index_version(rows),)], "version string")


@query(f"WITH {CHUNKS_SQL} SELECT DISTINCT path FROM chunks WHERE {' OR '.join(f"len(list_filter(regexp_extract_all(lower({f}), '[{chr(92)}p{{L}}{chr(92)}p{{N}}_]+'), lambda t: starts_with(t, 'tio'))) > 0" for f in ranking.BOOSTS)}")
def keyword_prefix(spark, sf):
    return index(spark, sf).words.keyword("tio", prefix=True).select("path").distinct()


@query(f"WITH {TURNS_SQL} SELECT path, ordinal FROM t WHERE ordinal % 4 = 1")
def altered_chunks(spark, sf):
    """Chunks whose text was changed behind their hash."""
    rows = _planned(spark, sf)[0]
    return freshness.altered(rows.withColumn("text", F.when(F.col("ordinal") % 4 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))).select("path", "ordinal")


@query(f"WITH {STORE_SQL} SELECT DISTINCT h.path FROM h WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.path = h.path)")
def pruned_paths(spark, sf):
    docs, headers = _stored(spark, sf)
    return freshness.statuses(docs, headers).filter("status = 'orphan'").select("path")


HALF = "CASE WHEN x = 0 THEN 0.0::DOUBLE ELSE round_even(x / power(2.0::DOUBLE, greatest(floor(log2(abs(x))), -14) - 10), 0) * power(2.0::DOUBLE, greatest(floor(log2(abs(x))), -14) - 10) END"


@query(f"""WITH v AS (SELECT vec_id, unnest(generate_series(0, len(embedding) - 1))::INT AS place, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE len(embedding) = 64)
SELECT vec_id, place, {HALF} AS x FROM v""")
def vector_codec(spark, sf):
    """Vectors through half precision and base64 and back: each number becomes the nearest of half precision."""
    from fernglass.functions.vectors import decode_vectors, encode_vectors

    rows = table(spark, sf, "embeddings").filter(F.size("embedding") == 64).select("vec_id", "embedding")
    back = decode_vectors(encode_vectors(rows, "embedding", 64), "embedding", 64)
    return back.select("vec_id", F.posexplode("embedding").alias("place", "x")).withColumn("x", F.col("x").cast("double"))
