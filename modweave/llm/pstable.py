"""Embedding near-dedup by Euclidean p-stable hashing.

Unit vectors are projected on random Gaussian directions and quantised; ``projections`` values make the bucket of a
vector in each of ``tables`` tables. Vectors that share a bucket are checked by exact cosine in double precision. Equal
vectors are one class throughout, so any number of copies costs one vector.

Buckets with more vectors than a block are dealt over cells, two blocks to a cell. A cell reports sums and a spanning
forest, never pairs: for each vector the number of vectors that it links to here and did not meet in an earlier table,
and links that connect what is connected here. Which table two vectors meet in first is recomputed from the seed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modweave.llm.components import components
from modweave.llm.runtime import as_long, cut, join_frequent
from modweave.llm.streams import whole_groups
from modweave.llm.words import mix

WIDTH = 2.5  # of a quantisation step, on unit vectors
_FAR = 0.566  # chance that two unrelated unit vectors, at distance sqrt(2), share one step of this width
_BLOCK = 1024
_ROWS = 256
_TABLES = 128  # whose keys are computed at a time
_PAIRS = 1 << 19  # linked pairs of cells that are settled at a time


def one_step(cosine: float) -> float:
    """Chance that two unit vectors with this cosine share one step of a random direction."""
    if cosine >= 1:
        return 1.0
    r = WIDTH / math.sqrt(2 - 2 * cosine)
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def shape(n: int, least: float, recall: float, fewest: int) -> tuple[int, int]:
    """(projections, tables) for ``n`` distinct vectors.

    Projections follow n, so that unrelated vectors seldom meet; tables follow the projections, so that a pair at
    cosine ``least`` shares a bucket with the chance ``recall`` or more whatever n is.
    """
    projections = max(8, math.ceil(math.log(max(2, n) / 0.06) / -math.log(_FAR)))
    met = one_step(least) ** projections
    return projections, fewest if met >= 1 else max(fewest, math.ceil(math.log1p(-recall) / math.log1p(-met)))


class Projections:
    """The directions and offsets of all tables, the same in every task."""

    def __init__(self, dim: int, tables: int, projections: int, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.tables, self.projections = tables, projections
        self.directions = rng.normal(size=(dim, tables * projections)) / WIDTH
        self.offsets = rng.random(tables * projections)

    def keys(self, unit: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """(vectors, tables) 64-bit bucket keys of tables ``first`` to ``last``."""
        last = self.tables if last is None else min(last, self.tables)
        p = slice(first * self.projections, last * self.projections)
        steps = np.floor(unit @ self.directions[:, p] + self.offsets[p]).astype(np.int64).view(np.uint64)
        steps = steps.reshape(len(unit), last - first, self.projections)
        dim = np.uint64(unit.shape[1])  # vectors of different lengths have no bucket in common
        out = np.broadcast_to(mix(np.arange(first, last, dtype=np.uint64) ^ (dim << np.uint64(32))), steps.shape[:2]).copy()
        for j in range(self.projections):
            out = mix(out ^ steps[:, :, j], j + 1)
        return out


def unit_vectors(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, in double precision, divided by their norms."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vector: str = "embedding"):
    """Whether a vector takes part: not null, not empty, all components present and finite, not all zero."""
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def _bucketed(tables: int, projections: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, Projections] = {}
        for batch in batches:
            lengths = pc.list_value_length(batch.column("vector")).to_numpy()
            for dim in np.unique(lengths):
                part = batch if (lengths == dim).all() else batch.filter(pa.array(lengths == dim))
                by_dim.setdefault(dim, Projections(dim, tables, projections, seed))
                for a in range(0, part.num_rows, _ROWS):
                    some = part.slice(a, _ROWS)
                    unit = unit_vectors(some.column("vector"))
                    for first in range(0, tables, _TABLES):
                        tbl = np.arange(first, min(first + _TABLES, tables), dtype=np.int32)
                        keys = by_dim[dim].keys(unit, first, first + _TABLES)
                        rep = np.repeat(some.column("rep").to_numpy(), len(tbl))
                        yield pa.RecordBatch.from_arrays([as_long(keys.ravel()), pa.array(np.tile(tbl, some.num_rows)), pa.array(rep)], ["key", "tbl", "rep"])

    return run


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest row that the pairs connect each of n rows with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _first_meeting(p: Projections, x: np.ndarray, i: np.ndarray, j: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether vectors i and j of each pair, which share a bucket in table t, share none in an earlier table."""
    new, live = np.ones(len(i), bool), np.flatnonzero(t > 0)
    for first in range(0, int(t.max(initial=0)), 8):
        a, b, end = i[live], j[live], t[live]
        asked = np.zeros(len(x), bool)
        asked[a] = asked[b] = True
        at = np.cumsum(asked) - 1
        keys = p.keys(x[asked], first, first + 8)
        tables = np.arange(first, first + keys.shape[1])
        for k in range(0, len(live), 1 << 16):
            some = slice(k, k + (1 << 16))
            new[live[some]] = ~((keys[at[a[some]]] == keys[at[b[some]]]) & (tables < end[some, None])).any(axis=1)
        live = live[new[live] & (end > first + 8)]
        if not len(live):
            break
    return new


def _cell_links(tables: int, projections: int, seed: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, Projections] = {}
        for whole, begins in whole_groups(batches, ["key", "tbl", "p", "q"]):
            rep, copies, side = (whole.column(c).to_numpy() for c in ("rep", "copies", "side"))
            table, same = whole.column("tbl").to_numpy(), whole.column("p").to_numpy() == whole.column("q").to_numpy()
            vector = whole.column("vector").combine_chunks()
            lengths = pc.list_value_length(vector).to_numpy()
            unit = unit_vectors(vector) if (lengths == lengths[0]).all() else None
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}  # by dimension, linked rows of cells
            pairs = 0

            def settle(dim: int) -> None:
                i, j = (np.concatenate(c) for c in zip(*waiting.pop(dim)))
                rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                i, j = np.split(at, 2)
                _, one, which = np.unique(rep[rows], return_index=True, return_inverse=True)  # a vector stands in several cells
                x = unit[rows[one]] if unit is not None else unit_vectors(vector.take(pa.array(rows[one])))
                by_dim.setdefault(dim, Projections(dim, tables, projections, seed))
                new = _first_meeting(by_dim[dim], x, which[i], which[j], table[rows[i]])
                n, own, times = len(rows), rep[rows], copies[rows]
                links = np.bincount(i[new], times[j[new]], n) + np.bincount(j[new], times[i[new]], n)
                root = own[_forest(i, j, n)]
                touched = np.flatnonzero((links > 0) | (root != own))
                out.append((own[touched], links[touched].astype(np.int64), root[touched]))

            for s, e in zip(begins[:-1], begins[1:]):
                if e - s < 2:
                    continue
                x = unit[s:e] if unit is not None else unit_vectors(vector.slice(s, e - s))
                close = x @ x.T >= least
                if same[s]:
                    close &= np.tri(e - s, k=-1, dtype=bool)
                else:
                    close &= (side[s:e, None] == 1) & (side[None, s:e] == 0)
                i, j = np.nonzero(close)
                if not len(i):
                    continue
                waiting.setdefault(x.shape[1], []).append((s + i, s + j))
                pairs += len(i)
                if pairs > _PAIRS:
                    pairs = 0
                    for dim in list(waiting):
                        settle(dim)
            for dim in list(waiting):
                settle(dim)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["rep", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, least: float = 0.9, tables: int = 128, seed: int = 17, recall: float = 0.99) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors`` (vec_id, embedding).

    Two rows link when the cosine of their embeddings, in double precision, is ``least`` or more and they share a bucket
    in any table: the chance is ``recall`` or more at ``least``, and more above it. The number of projections follows the
    number of vectors, so that unrelated ones seldom meet, and the number of tables, ``tables`` or more, follows the
    projections, so that the chance is held at every size. Equal embeddings always link. A vector that is null, empty or zero or
    holds a null or non-finite component links with nothing; vectors of different lengths never link. Rows that share a
    vec_id are vectors of their own, all with that id. component_id is the smallest vec_id that links reach, kept says
    that it is the row's own. Extra columns are ignored.
    """
    rows = vectors.select("vec_id", "embedding", usable().alias("usable"))
    valid = rows.where("usable").select("vec_id", F.col("embedding").alias("vector"))
    # copies of one vector meet before they are shuffled; xxhash64 names the class, the vector itself is compared
    classes = cut(valid.groupBy("vector").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()))
    projections, tables = shape(classes.count(), least, recall, tables)
    buckets = classes.select("rep", "vector").mapInArrow(_bucketed(tables, projections, seed), "key long, tbl int, rep long")
    several = buckets.withColumn("size", F.count("*").over(Window.partitionBy("key", "tbl"))).where("size > 1")
    blocks = F.ceil(F.col("size") / _BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks.cast("long")).cast("int")
    cells = several.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = cells.select("key", "tbl", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep")
    cells = cells.join(classes.select("rep", "copies", "vector"), "rep")
    cells = cells.repartition("key", "tbl", "p", "q").sortWithinPartitions("key", "tbl", "p", "q")
    found = cut(cells.mapInArrow(_cell_links(tables, projections, seed, least), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.where("rep != root"), "rep", "root").withColumnRenamed("node", "rep")
    classes = classes.join(links, "rep", "left").join(roots, "rep", "left")
    classes = classes.withColumn("root", F.coalesce("root", "rep")).withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    heads = cut(classes.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("classes")))
    named = join_frequent(classes.select("root", "vector", "copies", "n_links"), heads, "root", "classes")
    named = cut(named.select(F.col("vector").alias("embedding"), "copies", "n_links", "component_id"))
    linked = join_frequent(rows.where("usable").select("vec_id", "embedding"), named, "embedding", "copies").select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
