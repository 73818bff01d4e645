"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``prefix`` nearest pivots in order, which is computed once for each. The index is built block
by block: each block of candidates posts its vectors, with their place of the pivot, in one inverted file per pivot. A
query walks the files of its own nearest pivots and adds up footrule differences (a pivot outside a prefix counts as one
place behind it); the share of the block with the smallest footrule is then reranked by exact inner products on the
original vectors. Pivots are distinct vectors that lie apart, and copies of a vector count as one in a block: a large group
of copies or a tight cluster takes neither the pivots nor the places of what is reranked.

How large a share is needed depends on the vectors: where they lie in clusters, a query's neighbours come first by far; where
they have no structure, no order of pivots tells them from the rest. So the share is fitted, on the sample that the pivots
are drawn from, as the one that holds the wanted recall there.

Vectors may differ in norm: pivots are compared in a space with one more component, sqrt(largest norm**2 - norm**2),
where the largest inner product and the nearest direction are the same. The product of the extra components is taken
less what is equal for all pivots, so that one very long vector does not swallow the rest. Vectors of different lengths have
no inner product: each length has an index of its own, and lengths that are rare are compared without one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modweave.llm.pstable import usable
from modweave.llm.runtime import cut
from modweave.llm.streams import whole_groups

_BLOCK = 8192  # candidates of a block
_QUERIES = 4096  # queries of a cell
_INDEXED = 16  # lengths of vectors, the most frequent ones, that have an index; the others are reranked whole
_FITTED = 256  # vectors of the sample that the share is fitted on
_CELLS = 10_000  # partitions that cells are dealt to, at most


def _apart(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the vectors, farthest first by direction, from the first one on."""
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    chosen, closest = [0], unit @ unit[0]
    while len(chosen) < min(n, len(x)):
        closest[chosen[-1]] = np.inf
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, unit @ unit[chosen[-1]])
    return x[chosen]


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct vector, and the number of each row's vector."""
    whole = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
    _, one, which = np.unique(whole, return_index=True, return_inverse=True)
    return one, which.ravel()


def _members(which: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(vector, id): for each distinct vector the ``most`` smallest different ids of its copies, of which no more can be asked for."""
    order = np.lexsort((ids, which))
    vector, ids = which[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (vector[1:] != vector[:-1]) | (ids[1:] != ids[:-1])
    vector, ids = vector[new], ids[new]
    first = np.arange(len(vector)) - np.searchsorted(vector, vector) < most
    return vector[first], ids[first]


class Permutations:
    """The pivots of one length of vectors."""

    def __init__(self, pivots: np.ndarray, largest: float, prefix: int):
        self.pivots, self.largest, self.prefix, self.share = pivots, largest, min(prefix, len(pivots)), 1.0
        self.less = (pivots * pivots).sum(axis=1) / (largest + self._extra(pivots))  # largest - extra, without cancelling

    def _extra(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.largest * self.largest - (x * x).sum(axis=1), 0))

    def nearest(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """The numbers of each vector's nearest pivots, nearest first, ties to the smaller number."""
        score = x @ self.pivots.T
        if not query:  # x.p + extra(x) * extra(p), less extra(x) * largest
            score -= self._extra(x)[:, None] * self.less
        return np.argsort(-score, axis=1, kind="stable")[:, : self.prefix].astype(np.uint8)

    def fit(self, x: np.ndarray, wanted: int, recall: float) -> None:
        """The share of the distinct vectors ``x`` that has to be reranked to find this part of the ``wanted`` nearest."""
        files, asked = Files(self.nearest(x), len(self.pivots)), x[:_FITTED]
        needed = []
        for i, near in enumerate(self.nearest(asked, query=True)):
            saved, score = files.saved(near), x @ asked[i]
            saved[i], score[i] = -1, -np.inf
            best = np.argpartition(-score, wanted - 1)[:wanted]
            needed.append((saved[None, :] >= saved[best, None]).sum(axis=1) / len(x))
        self.share = float(np.quantile(np.concatenate(needed), recall))


class Files:
    """One block's pivot inverted files: for each pivot how many places before the end of its prefix each vector has it, 0 for not at all."""

    def __init__(self, near: np.ndarray, pivots: int):
        self.before = np.zeros((pivots, len(near)), np.int16)
        self.before[near, np.arange(len(near))[:, None]] = near.shape[1] - np.arange(near.shape[1], dtype=np.int16)

    def saved(self, near: np.ndarray) -> np.ndarray:
        """By how much each vector's footrule to a query is smaller than that of one that shares no pivot, halved."""
        own = len(near) - np.arange(len(near), dtype=np.int16)
        return np.minimum(self.before[near], own[:, None]).sum(axis=0, dtype=np.int16)

    def candidates(self, near: np.ndarray, take: int) -> np.ndarray:
        """The rows with the smallest footrule to a query's nearest pivots."""
        n = self.before.shape[1]
        return np.arange(n) if take >= n else np.argpartition(-self.saved(near), take - 1)[:take]


def _matrix(column: pa.Array | pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    part = column.take(pa.array(rows))
    part = part.combine_chunks() if isinstance(part, pa.ChunkedArray) else part
    return part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def _permuted(shared):
    """Rows with ``near``, the pivots nearest to a vector in order, as bytes; none for a length without an index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, asks = batch.column("dim").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            near = np.full(batch.num_rows, b"", object)
            for dim in np.unique(dims):
                index: Permutations | None = shared.value.get(int(dim))
                for query in (False, True):
                    rows = np.flatnonzero((dims == dim) & (asks == query))
                    if index is not None and len(rows):
                        near[rows] = [r.tobytes() for r in index.nearest(_matrix(batch.column("embedding"), rows), query)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.binary())], [*batch.schema.names, "near"])

    return run


def _near(column: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k largest scores, ties to the smaller id."""
    some = np.arange(len(score)) if len(score) <= k else np.flatnonzero(score >= np.partition(score, -k)[-k])
    return some[np.lexsort((ids[some], -score[some]))[:k]]


def _search(shared, k: int, share: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, begins in whole_groups(batches, ["dim", "block", "part"]):
            asks, ids = whole.column("asks").to_numpy(zero_copy_only=False), whole.column("vec_id").to_numpy()
            dims = whole.column("dim").to_numpy()
            for s, e in zip(begins[:-1], begins[1:]):
                q, c = s + np.flatnonzero(asks[s:e]), s + np.flatnonzero(~asks[s:e])
                if not len(q) or not len(c):
                    continue
                index: Permutations | None = shared.value.get(int(dims[s]))
                x, y = _matrix(whole.column("embedding"), c), _matrix(whole.column("embedding"), q)
                one, which = _distinct(x)
                x = x[one]
                of, member = _members(which, ids[c], k + 1)  # one may be the query's own
                begin = np.searchsorted(of, np.arange(len(x) + 1))
                if index is not None:
                    files, near = Files(_near(whole.column("near"), c[one]), len(index.pivots)), _near(whole.column("near"), q)
                    take = max(4 * k, int(np.ceil((index.share if share is None else share) * len(x))))
                out = []
                for i in range(len(q)):
                    rows = np.sort(files.candidates(near[i], take)) if index is not None else np.arange(len(x))
                    copies = begin[rows + 1] - begin[rows]
                    hits = np.repeat(begin[rows] - (np.cumsum(copies) - copies), copies) + np.arange(copies.sum())
                    score, found = np.repeat(x[rows] @ y[i], copies), member[hits]
                    other = found != ids[q[i]]
                    score, found = score[other], found[other]
                    best = _best(score, found, k)
                    out.append((found[best], score[best]))
                ends = pa.array(np.concatenate([[0], np.cumsum([len(o[0]) for o in out])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[q]), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([o[0] for o in out]))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([o[1] for o in out])))],
                    ["query_id", "ids", "scores"],
                )

    return run


def build(valid: DataFrame, shape, k: int, pivots: int, prefix: int, sample: int, recall: float) -> Permutations:
    """Pivots and share for the vectors of one length, from at most ``sample`` distinct ones, those with the smallest hash."""
    valid = valid.where(F.col("dim") == shape.dim)
    hashed = valid.select(F.xxhash64("embedding").alias("hash"), "embedding")
    few = F.broadcast(hashed.select("hash").distinct().orderBy("hash").limit(sample))
    drawn = hashed.join(few, "hash").groupBy("hash").agg(F.min("embedding").alias("embedding")).orderBy("hash").collect()  # bounded
    x = np.array([r.embedding for r in drawn], np.float64)
    index = Permutations(_apart(x, pivots), float(np.sqrt(shape.square)), prefix)
    if len(x) > 4 * k:
        # of a vector's k nearest among all, the sample holds about this many
        index.fit(x, max(1, min(k, round(k * len(x) / shape.n))), recall)
    return index


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, pivots: int = 128, prefix: int = 48, share: float | None = None, sample: int = 4096, recall: float = 0.96) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the ``k`` nearest vectors found, by largest inner product.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows but the query's own, of the query's
    length. All vectors are indexed; up to 256 ``pivots`` are chosen apart from each other among at most ``sample`` distinct
    vectors of a length, those with the smallest hash. A query reranks as many distinct vectors as the ``share`` of each block,
    those that its footrule puts first, all of a small block; where no share is given it is fitted on the sample such that
    ``recall`` of the neighbours are among them. Ties go to the smaller vec_id. Vectors that are null, empty or zero or hold a
    null or non-finite component take no part; rows with a null vec_id neither. Rows that share a vec_id are no candidates
    of each other. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    valid = vectors.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("dim"))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    asking = F.col("vec_id") % every == 0
    # one row per length; lengths are few, as d different ones take d * d / 2 components
    shapes = cut(valid.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(asking).alias("asked"), F.max(square).alias("square")))
    shapes = shapes.withColumn("blocks", F.ceil(F.col("n") / _BLOCK).cast("int")).withColumn("parts", F.ceil(F.col("asked") / _QUERIES).cast("int")).where("asked > 0")
    chosen = shapes.orderBy(F.desc("n"), "dim").limit(_INDEXED).collect()
    cells = min(_CELLS, max(1, shapes.agg(F.sum(F.col("blocks").cast("long") * F.col("parts"))).first()[0] or 0))
    index = spark.sparkContext.broadcast({r.dim: build(valid, r, k, pivots, prefix, sample, recall) for r in chosen})
    rows = valid.join(F.broadcast(shapes.select("dim", "blocks", "parts")), "dim")
    place = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n).cast("long")).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns, permuted = ["dim", "vec_id", "embedding", "asks", "blocks", "parts"], "dim int, vec_id long, embedding array<{}>, asks boolean, blocks int, parts int, near binary"
    permuted = permuted.format(valid.schema["embedding"].dataType.elementType.simpleString())
    held = rows.withColumn("asks", F.lit(False)).select(*columns).mapInArrow(_permuted(index), permuted)
    held = held.withColumn("block", place("blocks", 0)).withColumn("part", every_of("parts"))
    asked = rows.where(asking).withColumn("asks", F.lit(True)).select(*columns).mapInArrow(_permuted(index), permuted)
    asked = asked.withColumn("part", place("parts", 1)).withColumn("block", every_of("blocks"))
    dealt = held.unionByName(asked).drop("blocks", "parts").repartition(cells, "dim", "block", "part").sortWithinPartitions("dim", "block", "part")
    found = dealt.mapInArrow(_search(index, k, share), "query_id long, ids array<long>, scores array<double>")
    hits = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("hit")).select("query_id", F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score")).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
