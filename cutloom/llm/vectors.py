"""Vectors as short binary columns: the newest usable vector of each key, exact copies set aside."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.common import latest

#: Steps from zero to a vector's greatest component; a cosine is off by some 1e-6.
STEPS = 32_767


def pack(column: pa.ChunkedArray | pa.Array, dim: int) -> pa.Array:
    """Usable vectors as int16 bytes of their direction; null for null, of another length, not finite or all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    right = np.nonzero(sizes == dim)[0]
    out: list[bytes | None] = [None] * n
    if len(right):
        flat = column.take(pa.array(right)).flatten()
        x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64).reshape(-1, dim)
        top = np.abs(x).max(axis=1)
        ok = np.isfinite(x).all(axis=1) & (top > 0)
        codes = np.rint(x[ok] / top[ok, None] * STEPS).astype("<i2")
        for i, row in zip(right[ok].tolist(), codes):
            out[i] = row.tobytes()
    return pa.array(out, pa.binary())


def unpack(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Packed vectors as rows of unit length."""
    x = np.frombuffer(b"".join(column.to_pylist()), "<i2").reshape(-1, dim).astype(np.float32)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def packed(df: DataFrame, key: str, vector: str, dim: int, version: str) -> DataFrame:
    """key, version, vec of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pack(batch.column(2), dim)], names=[key, version, "vec"])

    types = dict(df.dtypes)
    return df.select(key, version, vector).mapInArrow(run, f"`{key}` {types[key]}, `{version}` {types[version]}, vec binary")


def newest_vectors(df: DataFrame, key: str, vector: str, dim: int, version: str) -> DataFrame:
    """key, vec: the newest version's vector of each key, where it is usable (an unusable newest version has none)."""
    return latest(packed(df, key, vector, dim, version), key, version, ["vec"]).where("vec IS NOT NULL")


def pack_coarse(x: np.ndarray, used: np.ndarray) -> pa.Array:
    """The used ones of rows of unit length as int8 bytes, null for others; a cosine is off by some 1e-3."""
    codes = np.rint(x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-12) * 127).astype(np.int8)
    return pa.array([row.tobytes() if use else None for row, use in zip(codes, used.tolist())], pa.binary())


def unpack_coarse(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, dim).astype(np.float32)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def sample(rows: DataFrame, key: str, version: str, size: int, dim: int, keys: int) -> np.ndarray:
    """At most `size` newest vectors of a share of the keys, chosen by the keys' hash so that about that many come.

    rows: packed, every version; keys: how many keys there are, roughly. All versions of a chosen key are looked at.
    """
    share = min(1.0, size / max(1, keys))
    chosen = rows.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)) + 1))
    best: dict = {}
    got = chosen.select(key, version, "vec").toArrow()
    for k, v, x in zip(*(got.column(i).to_pylist() for i in range(3))):
        if k not in best or (best[k][0] is None and v is not None) or (v is not None and (v, x or b"") > (best[k][0], best[k][1] or b"")):
            best[k] = (v, x)
    del got
    pa.default_memory_pool().release_unused()
    kept = [best[k][1] for k in sorted(best, key=str) if best[k][1] is not None][:size]
    return unpack(pa.array(kept, pa.binary()), dim) if kept else np.empty((0, dim), np.float32)
