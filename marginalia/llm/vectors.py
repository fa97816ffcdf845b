"""Vectors as rows: decoding, validity, and one row for each id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite_rows(column: pa.Array) -> tuple[list[np.ndarray | None], bool]:
    """Each row's vector as doubles, None for a null one or one with a null or non-finite component; whether all have one length."""
    if pa.types.is_null(column.type):
        return [None] * len(column), False
    ends = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null rows have no values here, null values are NaN
    stops = np.cumsum(ends)
    present = column.is_valid().to_numpy(zero_copy_only=False)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    good = present & (bad[stops] == bad[stops - ends])
    return [flat[b - n : b] if ok else None for b, n, ok in zip(stops.tolist(), ends.tolist(), good.tolist(), strict=True)], len(set(ends[good].tolist())) <= 1


def stacked(values: list[bytes], width: int = 0) -> np.ndarray:
    """Vectors stored as bytes of doubles as one matrix; shorter ones are filled up with zeros."""
    sizes = {len(v) for v in values}
    if len(sizes) == 1 and next(iter(sizes)) >= 8 * width:
        return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)
    out = np.zeros((len(values), max([width, *(s // 8 for s in sizes)])))
    for i, v in enumerate(values):
        out[i, : len(v) // 8] = np.frombuffer(v, np.float64)
    return out


def widened(matrix: np.ndarray, width: int) -> np.ndarray:
    return matrix if matrix.shape[1] >= width else np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def one_row_per_id(rows: DataFrame) -> DataFrame:
    """rows of (vec_id, ...) without a repeated vec_id: of several the least row in column order stays. Ids are counted by
    themselves first, so vectors travel for repeated ids only."""
    repeated = rows.groupBy("vec_id").count().where("count > 1").select("vec_id")
    if not repeated.take(1):
        return rows
    others = [c for c in rows.columns if c != "vec_id"]
    least = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct(*others)).alias("least"))
    return rows.join(repeated, "vec_id", "left_anti").unionByName(least.select("vec_id", "least.*"))
