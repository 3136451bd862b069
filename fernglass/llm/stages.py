"""Pipeline stages: each applies an operator to a documents table and returns the documents that result.

Defined results: null and empty texts stay in each stage (the random field finds nothing in them, they link with
nothing, they lose nothing); null ids come after all others; ties between rows of one id go by a hash of the text;
repeated rows are scored alike, and one of them stays among near copies; very long texts are handled whole, one at a
time; extra columns are kept, whatever their names, unless they begin with __fg_; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm.common import stored, texts
from fernglass.llm.mixing import WORD
from fernglass.llm.shingles import link_documents
from fernglass.llm.suffixes import remove_repeats
from fernglass.llm.toxicity import ToxicityModel


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows that the model doesn't reject, with all their columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in texts(batch, text_col):
                yield batch.slice(lo, hi - lo).filter(pa.array(model.tagged(data, off)[0] < threshold))

    return docs.mapInArrow(run, docs.schema)


def without_near_copies(docs: DataFrame, *, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of similar documents one row: that with the smallest id (null last), then the smallest hash of
    its text; of rows that share both any one. A row leaves only if another one of its component stays, so rows that
    share an id but aren't similar all stay, and so does every text without a word."""
    found = link_documents(docs, id_col=id_col, text_col=text_col, n=n, percent=percent).filter("component is not null")
    key = F.struct(F.col(id_col).isNull().alias("null"), F.col(id_col).alias("id"), F.col("text_hash").alias("t"))
    rows = found.groupBy("component", key.alias("row")).agg(F.count("*").alias("n"))
    stay = rows.groupBy("component").agg(F.min(F.struct("row", "n")).alias("x")).select(F.col("x.row.id").alias("__fg_id"), F.col("x.row.t").alias("__fg_t"), F.col("x.n").alias("__fg_n"))
    stay = stored(stay, "near-copies")
    same = F.col(id_col).eqNullSafe(F.col("__fg_id")) & (F.xxhash64(text_col) == F.col("__fg_t"))
    worded = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    once = docs.filter(~worded).unionByName(docs.filter(worded).join(stay.filter("__fg_n = 1"), same, "left_semi"))
    again = stay.filter("__fg_n > 1")
    return once if again.isEmpty() else once.unionByName(docs.filter(worded).join(again, same, "left_semi").dropDuplicates([id_col, text_col]))


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the characters whose bytes all lie in one of the spans."""
    raw = np.frombuffer(text.encode(), np.uint8)
    inner = (raw & 0xC0) == 0x80
    keep = np.ones(len(raw), bool)
    for a, z in spans:
        while a < z and inner[a]:
            a += 1
        while z > a and z < len(raw) and inner[z]:
            z -= 1
        keep[a:z] = False
    return raw[keep].tobytes().decode()


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """Documents without the passages that earlier ones hold; those of which no word is left go. size_col follows."""
    found = remove_repeats(docs, id_col=id_col, text_col=text_col).filter("n_removed > 0")
    spans = found.select(F.col(id_col).alias("__fg_id"), F.col("text_sha256").alias("__fg_t"), F.col("spans").alias("__fg_spans")).dropDuplicates(["__fg_id", "__fg_t"])
    rows = docs.withColumn("__fg_own", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    rows = rows.join(spans, F.col(id_col).eqNullSafe(F.col("__fg_id")) & (F.col("__fg_own") == F.col("__fg_t")), "left")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(text_col).to_pylist()
            spans = batch.column("__fg_spans").to_pylist()
            new = [t if not s else cut_text(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(text, spans, strict=True)]
            stay = pa.array([not s or bool(t.strip()) for t, s in zip(new, spans, strict=True)], pa.bool_())
            cols = {c: batch.column(c) for c in names}
            cols[text_col] = pa.array(new, cols[text_col].type)
            if size_col in cols:
                size = cols[size_col].to_pylist()
                cols[size_col] = pa.array([v if not s else len(t) for v, t, s in zip(size, new, spans, strict=True)], cols[size_col].type)
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names).filter(stay)

    return rows.select(*names, "__fg_spans").mapInArrow(run, docs.schema)
