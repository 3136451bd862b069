"""A knowledge base over the test tables, with a fixed clock.

Documents: path = source/lang/id.md, title = first line, tags = language, source and what labels say. Chunks of the
search queries are the lines of a document; conversations stand in for documents whose chunks are turns.

Searches use an index: chunks and postings of a folder of tables are written once for an application, by the first
search or by build(), and read by all that follow.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.functions.text import ancestor_dirs, collapsed, middle_cut
from fernglass.operators.postings import KeywordIndex, write_index
from fernglass.shared import own_dir
from fernglass.sources.chunker import BREADCRUMB_PART, MAX_CHARS

#: 2026-10-05T00:00:00Z.
NOW_MS = 1_791_158_400_000
DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path) alone."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id", "left")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    tags = F.array_compact(F.array("lang", "source", F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))
    return rows.select("doc_id", path.alias("path"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("body"), tags.alias("tags"), (F.lit(NOW_MS) - (F.col("doc_id") % 720) * DAY_MS).alias("updated_at")).withColumn("dirs", ancestor_dirs(F.col("path")))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk per line, with what searches need of its document; the breadcrumb is the title, cut in the middle as the
    chunker does."""
    rows = documents(spark, sf_dir).withColumn("breadcrumb", middle_cut(collapsed(F.col("title")), MAX_CHARS // BREADCRUMB_PART))
    rows = rows.select("path", "title", "breadcrumb", "tags", "dirs", "updated_at", F.posexplode(F.split("body", "\n")).alias("ordinal", "text"))
    return rows.withColumn("anchor", F.when(F.col("ordinal") == 0, "").otherwise(F.concat(F.lit("l"), F.col("ordinal").cast("string"))))


@dataclass(frozen=True)
class Index:
    chunks: DataFrame
    words: KeywordIndex


_BUILT: dict[str, Index] = {}


def build(spark: SparkSession, sf_dir: str, path: str) -> Index:
    """Write the index of a folder's tables. Chunks are sorted by path, so what a search reads of them is a few row
    groups."""
    rows = chunks(spark, sf_dir)
    rows.repartitionByRange("path", "ordinal").sortWithinPartitions("path", "ordinal").write.parquet(f"{path}/chunks")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/chunks")
    write_index(stored, path)
    return Index(stored, KeywordIndex.read(spark, path))


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of a folder's tables, built if this application hasn't yet."""
    path = f"{own_dir(spark)}/kb-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    if path not in _BUILT:
        _BUILT[path] = build(spark, sf_dir, path)
    return _BUILT[path]


KB_SQL = f"""kb AS (
    SELECT d.doc_id, concat_ws('/', source, lang, doc_id || '.md') AS path, split_part(text, chr(10), 1) AS title, text AS body,
        list_filter([lang, source, CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda t: t IS NOT NULL) AS tags,
        {NOW_MS} - (doc_id % 720) * {DAY_MS} AS updated_at, [source, source || '/' || lang] AS dirs
    FROM documents d LEFT JOIN labels USING (doc_id))"""

_COLLAPSED = r"trim(regexp_replace(title, '\s+', ' ', 'g'))"
CRUMB = f"CASE WHEN length({_COLLAPSED}) <= 250 THEN {_COLLAPSED} ELSE substr({_COLLAPSED}, 1, 125) || '…' || right({_COLLAPSED}, 124) END"

CHUNKS_SQL = f"""{KB_SQL},
lines AS (SELECT path, title, {CRUMB} AS breadcrumb, tags, dirs, updated_at, string_split(body, chr(10)) AS parts FROM kb),
chunks AS (SELECT path, title, breadcrumb, tags, dirs, updated_at, unnest(generate_series(0, len(parts) - 1))::INT AS ordinal, unnest(parts) AS text FROM lines)"""
