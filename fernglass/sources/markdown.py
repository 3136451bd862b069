"""A folder of Markdown files as DataFrames of documents and of what couldn't be read."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.functions.text import ancestor_dirs
from fernglass.sources.blocks import blocks_of, outline_of, utf16_offsets
from fernglass.sources.frontmatter import YamlError, parse_yaml, validated

MOST_BYTES = 1 << 20
HEADINGS = "array<struct<depth:int,text:string,anchor:string,start:long,end:long>>"
SCHEMA = f"path string, doc_hash string, title string, updated_at long, tags array<string>, meta string, body string, headings {HEADINGS}, error string"


def find_files(source: str, target: str | None = None) -> list[str]:
    """Paths (with /, relative to source) of regular files that end in .md, in order. Folders that start with a dot
    and the target folder are passed over; links aren't followed."""
    root, out = Path(source).resolve(), []
    skip = Path(target).resolve() if target else None
    for folder, dirs, files in os.walk(root):
        dirs[:] = [d for d in dirs if not d.startswith(".") and Path(folder, d) != skip]
        out += [Path(folder, f).relative_to(root).as_posix() for f in files if f.endswith(".md") and not Path(folder, f).is_symlink() and Path(folder, f).is_file()]
    return sorted(out)


def normalized(raw: bytes) -> str:
    text = raw.decode("utf-8", "replace")
    return (text[1:] if text.startswith("﻿") else text).replace("\r\n", "\n")


def split_frontmatter(text: str) -> tuple[str, str]:
    """The YAML between the first two --- lines, and the body right behind the second."""
    lines = text.split("\n")
    if lines[0].rstrip(" \t") != "---":
        raise ValueError("missing frontmatter")
    for k in range(1, len(lines)):
        if lines[k].rstrip(" \t") == "---":
            head = "\n".join(lines[:k])
            return "\n".join(lines[1:k]), text[len(head) + 1 + len(lines[k]) :]
    raise ValueError("missing frontmatter")


def parsed(path: str, raw: bytes) -> dict:
    """A document's row; what is wrong with it goes to error."""
    row: dict = dict.fromkeys(("doc_hash", "title", "updated_at", "tags", "meta", "body", "headings", "error")) | {"path": path}
    try:
        if len(raw) > MOST_BYTES:
            raise ValueError(f"larger than {MOST_BYTES} bytes")
        text = normalized(raw)
        head, body = split_frontmatter(text)
        try:
            found = parse_yaml(head)
        except YamlError as e:
            raise ValueError(f"invalid YAML frontmatter: {e}") from None
        fields = validated(found)
        to16 = utf16_offsets(body)
        outline = outline_of(blocks_of(body), len(body))
        headings = [{"depth": h.depth, "text": h.text, "anchor": h.anchor, "start": to16(a), "end": to16(z)} for h, a, z in outline]
        return row | {"doc_hash": hashlib.sha256(text.encode()).hexdigest(), "title": fields["title"], "updated_at": fields["updated_at"], "tags": fields["tags"], "meta": json.dumps(fields["meta"], ensure_ascii=False, default=str), "body": body, "headings": headings}
    except ValueError as e:
        return row | {"error": str(e)}


def _arrow_schema() -> pa.Schema:
    heading = pa.struct([("depth", pa.int32()), ("text", pa.string()), ("anchor", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    text = pa.string()
    return pa.schema([("path", text), ("doc_hash", text), ("title", text), ("updated_at", pa.int64()), ("tags", pa.list_(text)), ("meta", text), ("body", text), ("headings", pa.list_(heading)), ("error", text)])


def parse_rows(files: DataFrame) -> DataFrame:
    """files: (path, content) with the bytes of each."""
    schema = _arrow_schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([parsed(p.as_py(), c.as_py()) for p, c in zip(batch.column("path"), batch.column("content"), strict=True)], schema)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def scan(spark: SparkSession, source: str, target: str | None = None, partitions: int | None = None) -> DataFrame:
    """All files of a folder that driver and executors share, parsed. The driver lists names; tasks read the files."""
    paths = find_files(source, target)
    root, schema = str(Path(source).resolve()), _arrow_schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p in batch.column("path").to_pylist():
                try:
                    if os.path.getsize(f"{root}/{p}") > MOST_BYTES:
                        raise ValueError(f"larger than {MOST_BYTES} bytes")
                    rows.append(parsed(p, Path(root, p).read_bytes()))
                except (OSError, ValueError) as e:
                    rows.append(dict.fromkeys(schema.names) | {"path": p, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    names = spark.createDataFrame([(p,) for p in paths], "path string").repartition(partitions or max(1, len(paths) // 64))
    return names.mapInArrow(run, SCHEMA)


def documents(parsed_rows: DataFrame) -> DataFrame:
    return parsed_rows.filter("error is null").drop("error").withColumn("dirs", ancestor_dirs(F.col("path")))


def load_errors(parsed_rows: DataFrame) -> DataFrame:
    return parsed_rows.filter("error is not null").select("path", F.col("error").alias("reason")).orderBy("path")


def report(problems: list[tuple[str, str]]) -> str:
    """path: reason lines in the order of the paths."""
    return "\n".join(f"{p}: {r}" for p, r in sorted(problems))
