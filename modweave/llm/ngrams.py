"""Hashed character n-grams of many texts at once, by code point."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from modweave.llm.runtime import chunks, text_bytes

_P = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], dtype=np.uint32)


_CHUNK_BYTES = 1 << 20  # texts whose n-grams are looked up together: some 60 bytes each


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points one after another, and the texts' bounds among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, begins[offsets]


def grams(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A bucket below 2**bits for the n-gram at each position that has n code points."""
    size = len(points) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    h = points[:size] * _P[0]
    for j in range(1, n):
        h = (h ^ (h >> np.uint32(15))) * _P[j] + points[j : j + size] * _P[0]
    h ^= h >> np.uint32(16)
    h *= _P[1]
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def spans(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and number of each text's n-grams."""
    return bounds[:-1], np.maximum(np.diff(bounds) - n + 1, 0)


def sums(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (first axis) over each text's n-grams, 0 for none."""
    out = np.zeros((len(begin), *values.shape[1:]), np.float64)
    full = np.flatnonzero(count)
    if len(full):
        cuts = np.stack([begin[full], begin[full] + count[full]], axis=1).ravel()
        pad = np.concatenate([values, np.zeros((1, *values.shape[1:]), values.dtype)])
        out[full] = np.add.reduceat(pad, cuts, axis=0)[::2]
    return out


def scored(batches: Iterator[pa.RecordBatch], parts) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pairs of a slice of a batch and the sums that ``parts(data, offsets)`` gives for its texts."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for a, b in chunks(offsets, _CHUNK_BYTES):
            yield batch.slice(a, b - a), parts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
