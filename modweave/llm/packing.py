"""Best-fit packing by length patterns that a non-negative least-squares fit repeats.

Documents become pieces of at most ``size`` tokens. Which lengths share a sequence is decided on the histogram of
lengths alone (``size`` counts, whatever the input): few-document patterns whose lengths fill a sequence are
enumerated, repeat counts are fitted to the histogram by non-negative least squares and rounded, and what they leave is
packed best-fit, longest first, many equal pieces at a time. Of rounding up, to the nearest and down the one that needs the
fewest sequences is taken, the former where they need as many. The plan says which ranks of each length go to
which sequence and place; the tasks look it up for their own pieces, whose ranks come from counts per task and length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modweave.llm.runtime import chunks, cut, give_back, text_bytes
from modweave.llm.tokens import _CHUNK_BYTES, NAME, Encoder, vocabulary_path

_PARTNERS = 24  # patterns of three lengths that are tried for each first length
_ROUNDED = (0.999, 0.5, 1e-9)  # what is added to a fitted count before its fraction is dropped


def patterns(histogram: np.ndarray, size: int) -> np.ndarray:
    """Triples (a, b, c) of lengths that occur, a >= b >= c, 0 for none, with a + b + c = size."""
    here = np.flatnonzero(histogram)
    found = [(size, 0, 0)] if histogram[size] else []
    found += [(a, size - a, 0) for a in here if 2 * a >= size > a and histogram[size - a]]
    common = here[np.argsort(-histogram[here], kind="stable")]
    for a in here:
        rest = size - a
        fit = common[(common < rest) & (common * 2 >= rest) & (common <= a)]
        fit = fit[(histogram[rest - fit] > 0) & (rest - fit > 0)]
        if len(fit) > _PARTNERS:
            fit = fit[np.unique(np.linspace(0, len(fit) - 1, _PARTNERS).astype(int))]
        found += [(a, b, rest - b) for b in fit]
    return np.array(found, np.int64).reshape(-1, 3)


def nonnegative_fit(triples: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 with least ||A x - histogram||, where column j of A counts the lengths of triple j: accelerated projected gradient."""
    n = len(histogram)
    used = (triples > 0).astype(float)

    def times(x):  # A x, without the slot of length 0
        h = np.bincount(triples.ravel(), (used * x[:, None]).ravel(), n)
        h[0] = 0
        return h

    step = 1.0 / max(1.0, 3.0 * np.bincount(triples.ravel(), used.ravel(), n).max(initial=1))  # row sums times column sums bound the norm
    x = y = np.zeros(len(triples))
    t = 1.0
    target = histogram.astype(float)
    target[0] = 0
    for _ in range(rounds):
        gap = times(y) - target
        new = np.maximum(0, y - step * (gap[triples] * used).sum(axis=1))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x


def plan(histogram: np.ndarray, size: int) -> tuple[list[np.ndarray], int]:
    """For each length the runs (first rank, sequence of that rank, place, sequences to the next rank), and the number of sequences."""
    counts = histogram.astype(np.int64)
    counts[0] = 0
    triples = patterns(counts, size)
    fit = nonnegative_fit(triples, counts) if len(triples) else np.zeros(0)
    return min((_packed(counts, size, triples, np.floor(fit + up).astype(np.int64)) for up in _ROUNDED), key=lambda found: found[1])


def _packed(counts: np.ndarray, size: int, triples: np.ndarray, repeats: np.ndarray) -> tuple[list[np.ndarray], int]:
    """The plan with these repeats of the triples, most repeated first, as far as there are pieces left."""
    left = counts.copy()
    runs: list[list[tuple[int, int, int, int]]] = [[] for _ in range(size + 1)]
    taken = np.zeros(size + 1, np.int64)
    sequences = 0

    def place(length: int, count: int, first: int, at: int) -> None:
        runs[length].append((int(taken[length]), first, at, 1))
        taken[length] += count
        left[length] -= count

    for j in np.argsort(-repeats, kind="stable")[: np.count_nonzero(repeats)]:
        lengths = [int(v) for v in triples[j] if v]
        times = min(int(repeats[j]), *(int(left[v]) // lengths.count(v) for v in lengths))
        if times > 0:
            at = 0
            for v in lengths:
                place(v, times, sequences, at)
                at += v
            sequences += times
    # best fit for the rest: groups of open sequences by room, each a list of (first sequence, count)
    room: dict[int, list[tuple[int, int]]] = {}
    for v in range(size, 0, -1):
        while left[v]:
            best = min((r for r in room if r >= v), default=None)
            if best is None:
                each, times = size // v, int(left[v])
                full, over = divmod(times, each)
                for n, per in ((full, each), (1 if over else 0, over)):
                    if n:
                        for k in range(per):
                            place(v, n, sequences, k * v)
                        if size - per * v:
                            room.setdefault(size - per * v, []).append((sequences, n))
                        sequences += n
                continue
            first, count = room[best].pop()
            n = min(count, int(left[v]))
            if count > n:
                room[best].append((first + n, count - n))
            if not room[best]:
                del room[best]
            place(v, n, first, size - best)
            if best - v:
                room.setdefault(best - v, []).append((first, n))
    return [np.array(r, np.int64).reshape(-1, 4) for r in runs], sequences


def _pieces(size: int, end_id: int, json_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = Encoder(json_path), int(end_id).to_bytes(4, "little")
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            rest = [c for c in batch.schema.names if c != "text"]
            for a, b in chunks(offsets, _CHUNK_BYTES):
                ids, bounds = encoder.ids(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                total = np.diff(bounds) + 1  # with the end id
                first = (total - 1) % size + 1
                n = (total - first) // size + 1
                row = np.repeat(np.arange(len(total)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * size)
                length = np.where(piece == 0, first[row], size)
                raw, at = memoryview(ids.view(np.uint8)), bounds[:-1][row] + start
                last = piece == n[row] - 1
                crc = np.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at.tolist(), (at + length - last).tolist())], np.int64)
                crc[last] = [zlib.crc32(end, int(c)) for c in crc[last]]
                order = np.argsort(length, kind="stable")
                sorted_ = length[order]
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.searchsorted(sorted_, sorted_) + seen[sorted_]
                seen += np.bincount(length, minlength=size + 1)
                columns = [batch.column(c).take(pa.array(a + row)) for c in rest]
                values = [pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(length), task, np.int32)), pa.array(rank)]
                yield pa.RecordBatch.from_arrays([*columns, *values], [*rest, "piece", "start", "length", "ids_crc32", "task", "nth"])
                del ids, raw, crc
                give_back()

    return run


def _placed(runs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for v in np.unique(length):
                of = np.flatnonzero(length == v)
                r = runs.value[v]
                k = np.searchsorted(r[:, 0], rank[of], side="right") - 1
                sequence[of], offset[of] = r[k, 1] + rank[of] - r[k, 0], r[k, 2]
            rest = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(sequence), pa.array(offset)], [*rest, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, size: int = 2048, end_id: int = 0, json_path: str | None = None) -> DataFrame:
    """One row per piece of each text: the id columns of ``docs`` (all but text) with piece, start, length, ids_crc32, sequence_id and offset.

    A document is its text's ids and ``end_id``. Longer ones than ``size`` are cut into pieces of ``size``, the first of
    which may be shorter; a piece's start is the number of the document's ids before it. A null or empty text is the one
    piece [end_id]. Repeated rows are packed each for itself. No rows give no pieces. Columns of docs that are named
    like the results are dropped.
    """
    names = ("piece", "start", "length", "ids_crc32", "task", "nth", "rank", "sequence_id", "offset")
    docs = docs.drop(*names)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    run = _pieces(size, end_id, json_path or vocabulary_path(NAME, ".json"))
    pieces = cut(docs.mapInArrow(run, f"{kinds}piece int, start long, length long, ids_crc32 long, task int, nth long"))
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    # at most one row per task and length, of which a window holds one length
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = cut(per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    histogram = np.zeros(size + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        histogram[r.length] = r.n
    runs, _ = plan(histogram, size)
    ranked = pieces.join(per_task.drop("n"), ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    ranked = ranked.select(*[c for c in pieces.columns if c not in ("task", "nth")], "rank")
    placed = ranked.mapInArrow(_placed(docs.sparkSession.sparkContext.broadcast(runs)), f"{kinds}piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed
