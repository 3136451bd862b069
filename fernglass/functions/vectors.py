"""Vectors as base64 of little-endian half-precision numbers."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def encoded_length(dims: int) -> int:
    return -(-dims * 2 // 3) * 4


def encode_vector(values: Sequence[float], dims: int) -> str:
    """Refuses another length, and values that half precision can't hold."""
    if len(values) != dims:
        raise ValueError(f"a vector of {len(values)} values, not {dims}")
    with np.errstate(over="ignore"):
        half = np.asarray(values, np.float32).astype("<f2")
    bad = np.flatnonzero(~np.isfinite(half))
    if len(bad):
        raise ValueError(f"{values[int(bad[0])]} doesn't fit in float16")
    return base64.b64encode(half.tobytes()).decode()


def decode_vector(text: str, dims: int) -> np.ndarray:
    """Refuses what isn't canonical base64, another length, and non-finite values."""
    try:
        raw = base64.b64decode(text, validate=True)
    except ValueError:
        raise ValueError("the vector isn't canonical base64") from None
    if base64.b64encode(raw).decode() != text:
        raise ValueError("the vector isn't canonical base64")
    if len(raw) != dims * 2:
        raise ValueError(f"the vector has {len(raw)} bytes; {dims} values need {dims * 2}")
    out = np.frombuffer(raw, "<f2").astype(np.float32)
    if not np.isfinite(out).all():
        raise ValueError("the vector holds a non-finite value")
    return out


def encode_vectors(df: DataFrame, column: str, dims: int) -> DataFrame:
    """df with the vectors of a column encoded, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            out = pa.array([None if v is None else encode_vector(v, dims) for v in batch.column(at).to_pylist()], pa.string())
            yield batch.set_column(at, column, out)

    return df.mapInArrow(run, ", ".join(f"`{n}` {'string' if n == column else t}" for n, t in df.dtypes))


def decode_vectors(df: DataFrame, column: str, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            out = pa.array([None if v is None else decode_vector(v, dims) for v in batch.column(at).to_pylist()], pa.list_(pa.float32()))
            yield batch.set_column(at, column, out)

    return df.mapInArrow(run, ", ".join(f"`{n}` {'array<float>' if n == column else t}" for n, t in df.dtypes))
