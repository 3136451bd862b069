"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Each source gets a target in words: a weighted share of `share` times all words, at most `cap` times
its own words; what lies above a cap is shared anew by weight (water-filling, in closed form).
Within a source documents have unequal chances: one expects min(cap, c * w) copies, w being the number of binary
digits of its size, so that a long text comes in sooner than a fragment; c is such that the expected words are the
target (water-filling again, over a source's few classes of w). Whole copies are certain; the fraction p left is
sampled: documents are ranked by (u / (1 - u)) / (p / (1 - p)) with u drawn from a hash of the id (Rosen's Pareto order
sampling), and taken in that order until the words still missing are met, to within half of the last document. The
rank is near 1 there, so a document is taken with a probability near its p.

Defined results: null text has size 0; a null source is a source of its own and comes last; repeated rows are
rows of their own; an empty table gives an empty result; sources without words have target 0; ties in rank go
to the smaller id, then size, then hash of the text; very long texts count with all their words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fernglass.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Rank buckets per source: the cut is found among their sums, then inside one bucket.
BUCKETS = 1 << 12
#: A source's rows meet its plan in so many groups, so that one source with most rows isn't one task.
SALTS = 64


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_col: str, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of a hash of the id."""
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """sources: (source, source_size), one row per source. Adds target."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    total = W.partitionBy()
    ranked = (
        sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
        .withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(total))
    )
    tight = W.orderBy((F.col("limit") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    ranked = (
        ranked.withColumn("limits_before", F.coalesce(F.sum("limit").over(tight.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_from", F.sum("w").over(tight.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("full", F.col("limit") / F.col("w") <= (F.col("budget") - F.col("limits_before")) / F.col("w_from"))
    )
    level = (F.col("budget") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(total)) / F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(total)
    return ranked.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.col("w") * level)).select("source", "source_size", "target")


def digits(size: str = "size") -> Column:
    """The number of binary digits of a size: what a document's chance is in proportion to."""
    return F.length(F.bin(size)).cast("long")


def expected_copies(classes: DataFrame, cap: float) -> DataFrame:
    """classes: (source, w, class_size, source_size, target), a row per source and w, so a few dozen a source. Adds
    whole, the copies that each document of the class gets for certain, part, its chance of one more, and missing, the
    words that the source's parts are to add."""
    down = W.partitionBy("source").orderBy(F.col("w").desc())
    own = W.partitionBy("source")
    limit, weight, c = F.col("limit"), F.col("weight"), F.lit(float(cap))
    filled = (
        classes.withColumn("limit", c * F.col("class_size"))
        .withColumn("weight", (F.col("w") * F.col("class_size")).cast("double"))
        .withColumn("limits_before", F.coalesce(F.sum(limit).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_from", F.sum(weight).over(down.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("full", F.coalesce(c / F.col("w") <= F.try_divide(F.col("target") - F.col("limits_before"), F.col("weight_from")), F.lit(False)))
    )
    level = F.try_divide(F.col("target") - F.sum(F.when(F.col("full"), limit).otherwise(0.0)).over(own), F.sum(F.when(F.col("full"), 0.0).otherwise(weight)).over(own))
    filled = filled.withColumn("e", F.when(F.col("full"), c).otherwise(F.least(c, F.coalesce(F.col("w") * level, F.lit(0.0)))))
    filled = filled.withColumn("whole", F.floor("e")).withColumn("part", F.col("e") - F.floor("e"))
    return filled.withColumn("missing", F.col("target") - F.sum(F.col("whole") * F.col("class_size")).over(own)).select("source", "w", "source_size", "target", "whole", "part", "missing")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: id, size, source_size, target (of its source), taken (words), copies (0 to cap), part (its
    chance of a copy beyond the certain ones), source and text_hash (xxhash64 of the text)."""
    sizes = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("t"), word_count(text_col).alias("size")), "mix-sizes")
    sizes = sizes.withColumn("w", digits())
    classes = sizes.groupBy("source", "w").agg(F.sum("size").alias("class_size"))
    targets = source_targets(classes.groupBy("source").agg(F.sum("class_size").alias("source_size")), weights, share, cap).withColumnRenamed("source", "s")
    plan = expected_copies(classes.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s"), cap)
    part = F.col("part")
    u = uniform("id", seed)
    odds = F.when(part > 0, (u / (1 - u)) / (part / (1 - part))).otherwise(F.lit(float("inf")))

    def ranked(plan: DataFrame) -> DataFrame:
        spread = plan.withColumnRenamed("source", "s").withColumnRenamed("w", "p_w").withColumn("p_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = sizes.withColumn("salt", F.pmod(F.xxhash64("id", "t"), F.lit(SALTS)).cast("int"))
        out = salted.join(spread, F.col("source").eqNullSafe(F.col("s")) & (F.col("w") == F.col("p_w")) & (F.col("salt") == F.col("p_salt"))).drop("s", "p_w", "salt", "p_salt")
        out = out.withColumn("rank", odds)
        return out.withColumn("bucket", F.when(F.col("rank") == float("inf"), buckets).otherwise(F.floor(F.col("rank") / (1 + F.col("rank")) * buckets)).cast("int"))

    in_order = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = ranked(plan).groupBy("source", "bucket", "missing").agg(F.sum("size").alias("in_bucket"))
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(in_order), F.lit(0)))
    # the first bucket that the missing words don't fill: all before it are taken, none after it
    edge = sums.filter(F.col("before") + F.col("in_bucket") > F.col("missing")).groupBy("source").agg(F.min(F.struct("bucket", "before")).alias("edge"))
    edges = edge.select(F.col("source").alias("e"), F.col("edge.bucket").alias("cut"), F.col("edge.before").alias("before"))
    plan = plan.join(edges, F.col("source").eqNullSafe(F.col("e")), "left").drop("e")

    rows = ranked(plan)
    clear = rows.filter(F.col("cut").isNull() | (F.col("bucket") != F.col("cut"))).withColumn("more", (F.col("part") > 0) & (F.col("cut").isNull() | (F.col("bucket") < F.col("cut"))))
    inside = W.partitionBy("source").orderBy("rank", "id", "size", "t").rowsBetween(W.unboundedPreceding, -1)
    close = rows.filter(F.col("bucket") == F.col("cut")).withColumn("more", (F.col("part") > 0) & (F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2 <= F.col("missing")))
    out = clear.unionByName(close).withColumn("copies", (F.col("whole") + F.col("more").cast("int")).cast("int"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "part", "source", F.col("t").alias("text_hash"))


def repeated(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents of a mix, each as often as it was taken, with all their columns. Rows alike in id, source and text
    share the copies that the mix took of them, so its words come out exactly."""
    taken = mixed.groupBy(F.col(id_col).alias("__fg_id"), F.col("source").alias("__fg_s"), F.col("text_hash").alias("__fg_t")).agg(F.sum("copies").alias("__fg_c"), F.count("*").alias("__fg_m"))
    taken = stored(taken.filter("__fg_c > 0"), "mix-copies")
    alike = F.col(id_col).eqNullSafe(F.col("__fg_id")) & F.col(source_col).eqNullSafe(F.col("__fg_s")) & (F.xxhash64(text_col) == F.col("__fg_t"))
    rows = docs.join(taken.filter("__fg_c % __fg_m = 0"), alike).withColumn("__fg_n", F.expr("__fg_c div __fg_m"))
    # rows that are alike in rank, of which the mix took some: at most one such group a source
    uneven = taken.filter("__fg_c % __fg_m > 0")
    if not uneven.isEmpty():
        number = F.row_number().over(W.partitionBy("__fg_id", "__fg_s", "__fg_t").orderBy("__fg_c"))
        rows = rows.unionByName(docs.join(uneven, alike).withColumn("__fg_n", F.expr("__fg_c div __fg_m") + (number <= F.expr("__fg_c % __fg_m")).cast("int")))
    return rows.filter("__fg_n > 0").withColumn("__fg_k", F.explode(F.sequence(F.lit(1), F.col("__fg_n").cast("int")))).select(*docs.columns)


MIX_SQL = r"""
WITH o AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':7'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
d AS (SELECT *, length(bin(size))::BIGINT AS w FROM o),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (SELECT sum(size) FROM d)::DOUBLE AS budget FROM s),
f AS (SELECT *, cap / w <= (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full FROM w),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE w * ((budget - (SELECT coalesce(sum(cap), 0) FROM f WHERE is_full)) / (SELECT sum(w) FROM f WHERE NOT is_full)) END AS target FROM f),
k AS (SELECT source, w, sum(size)::BIGINT AS class_size FROM d GROUP BY source, w),
g AS (SELECT k.*, t.target, t.source_size, 2.0::DOUBLE * k.class_size AS lim, (k.w * k.class_size)::DOUBLE AS wt FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
h AS (SELECT *, coalesce(2.0::DOUBLE / w <= (target - coalesce(sum(lim) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(wt) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), false) AS is_full FROM g),
i AS (SELECT *, CASE WHEN is_full THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE, coalesce(w * ((target - sum(CASE WHEN is_full THEN lim ELSE 0.0::DOUBLE END) OVER (PARTITION BY source)) / nullif(sum(CASE WHEN is_full THEN 0.0::DOUBLE ELSE wt END) OVER (PARTITION BY source), 0)), 0)) END AS e FROM h),
j AS (SELECT *, floor(e) AS whole, e - floor(e) AS part, target - sum(floor(e) * class_size) OVER (PARTITION BY source) AS missing FROM i),
r AS (SELECT d.doc_id, d.size, j.source_size, j.target, j.whole, j.part, j.missing, d.source,
    CASE WHEN j.part > 0 THEN (u / (1 - u)) / (j.part / (1 - j.part)) ELSE 'inf'::DOUBLE END AS odds FROM d JOIN j ON d.source IS NOT DISTINCT FROM j.source AND d.w = j.w),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies, part FROM (SELECT *, (whole + CASE WHEN part > 0 AND before + size / 2.0::DOUBLE <= missing THEN 1 ELSE 0 END)::INT AS copies FROM c)
"""
