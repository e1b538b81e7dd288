"""Vectors on an integer grid, and summaries of partitions that are merged in a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integers from this magnitude on are not kept: sums of their products would leave 64 bits. Such entries count as not finite.
LIMIT = 1 << 31
#: Summaries that one merge takes.
FAN = 8
_KINDS = (np.int8, np.int16, np.int32)


def on_grid(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(scale * entry) as int64) of a list column's vectors, for each length; those that are null or have a null or non-finite entry are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64) if len(column.values) else np.zeros(0)
    size = np.diff(offsets)
    for dim in np.unique(size[valid]).tolist():
        rows = np.flatnonzero(valid & (size == dim))
        with np.errstate(all="ignore"):
            x = np.floor(values[offsets[rows][:, None] + np.arange(dim)] * scale)
        good = (np.abs(x) < LIMIT).all(axis=1)
        if good.any():
            yield rows[good], x[good].astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row's integers as bytes of the narrowest kind that holds them, after a byte that tells the kind: equal rows, equal bytes."""
    out = np.empty(len(x), dtype=object)
    widest = np.maximum(x, ~x).max(axis=1) if x.shape[1] else np.zeros(len(x), dtype=np.int64)
    kind = np.searchsorted([1 << 7, 1 << 15], widest, side="right")
    for k, dtype in enumerate(_KINDS):
        rows = np.flatnonzero(kind == k)
        raw, step = x[rows].astype(dtype).tobytes(), x.shape[1] * dtype().itemsize
        tag = bytes([k])
        out[rows] = np.array([tag + raw[i * step : (i + 1) * step] for i in range(len(rows))] + [None], dtype=object)[:-1]
    return out.tolist()


def unpacked(codes: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(codes), dim), dtype=np.int64)
    kind = np.array([c[0] for c in codes])
    for k, dtype in enumerate(_KINDS):
        rows = np.flatnonzero(kind == k)
        if len(rows):
            out[rows] = np.frombuffer(b"".join(codes[i][1:] for i in rows.tolist()), dtype=dtype).reshape(len(rows), dim)
    return out


def slot() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def merged(parts: DataFrame, slots: int, combine: Callable[[bytes, bytes], bytes], finish: Callable[[bytes], bytes] | None = None) -> dict[int, bytes]:
    """The one payload that combine makes of all rows of parts(slot, dim, payload) of a dim, by rounds of FAN neighbouring slots a task.

    A payload's size must not grow with the rows. Slots are merged in their order, so the result doesn't depend on which task ends first.
    """

    def rounds(last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def row(key: tuple[int, int], payload: bytes) -> pa.RecordBatch:
            done = finish(payload) if last and finish else payload
            return pa.RecordBatch.from_arrays([pa.array([key[1]], pa.int64()), pa.array([key[0]], pa.int32()), pa.array([done], pa.binary())], ["slot", "dim", "payload"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held = None, b""
            for batch in batches:
                for d, g, payload in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
                    if (d, g) == key:
                        held = combine(held, payload)
                        continue
                    if key is not None:
                        yield row(key, held)
                    key, held = (d, g), payload
            if key is not None:
                yield row(key, held)

        return run

    while True:
        slots = max(1, -(-slots // FAN))
        grouped = parts.select("dim", F.expr(f"slot div {FAN}").alias("g"), "slot", "payload").repartition(slots, "dim", "g").sortWithinPartitions("dim", "g", "slot")
        parts = grouped.mapInArrow(rounds(slots == 1), "slot long, dim int, payload binary")
        if slots == 1:
            break
    return {r["dim"]: bytes(r["payload"]) for r in parts.collect()}
