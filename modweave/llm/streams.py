"""Arrow batches that come sorted by key, handed on as whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end where a group ends, with the positions at which their groups begin (and the length at last).

    The rows of a group must be next to each other. Memory is that of a batch and the largest group.
    """
    held: list[pa.RecordBatch] = []

    def last_key(batch):
        return tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        if held and first != last_key(held[-1]):
            yield _grouped(held, keys)
            held = []
        begins = _begins(batch, keys)
        if len(begins) > 1:
            at = int(begins[-1])
            yield _grouped([*held, batch.slice(0, at)], keys)
            held = [batch.slice(at)]
        else:
            held.append(batch)
    if held:
        yield _grouped(held, keys)


def _begins(batch, keys: list[str]) -> np.ndarray:
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        values = batch.column(k).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _grouped(parts: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    whole = pa.Table.from_batches(parts).combine_chunks()
    return whole, np.append(_begins(whole, keys), whole.num_rows)
