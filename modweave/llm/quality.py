"""Quality classifier by supervised subword embeddings.

Each hashed word, word pair and character n-gram has a learned vector; a document is the average of its vectors, and a softmax
over a linear map of that average gives the classes' probabilities. Vectors and map are trained together by stochastic
gradient descent in numpy, one document at a time, with steps that shrink per coordinate as gradients add up.

As the average comes before the linear map, the map can be applied to the vectors once: a text's logit is the average
of one number per feature, which is what the tasks look up for whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modweave.llm.ngrams import code_points, grams, scored, spans, sums
from modweave.llm.words import Words, window_hashes

_N = (1, 2, 3)  # character n-grams beside words and word pairs
_KINDS = 2 + len(_N)


def _features(data: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words, word pairs and each n: buckets, and each text's begin and number among them. Each kind has buckets of its own."""
    words = Words(data, offsets)
    yield (words.hash >> np.uint64(64 - bits)).astype(np.int64), words.bounds[:-1], words.counts
    pairs = window_hashes(words.hash, 2)
    pairs[words.hash[1:] == words.hash[:-1]] = 0  # a word said twice is one and the same pair, whatever the word
    yield (pairs >> np.uint64(64 - bits)).astype(np.int64) + (1 << bits), *spans(words.bounds, 2)
    points, bounds = code_points(data, offsets)
    for kind, n in enumerate(_N, 2):
        yield grams(points, n, bits) + (kind << bits), *spans(bounds, n)


@dataclass
class SubwordModel:
    vectors: np.ndarray  # (kinds << bits, dim)
    weights: np.ndarray  # (dim, 2)
    bias: np.ndarray  # (2,)
    bits: int

    def lookup(self) -> tuple[np.ndarray, float]:
        """What each feature adds to the logit of class 1 over class 0, and the constant part."""
        w = self.weights[:, 1] - self.weights[:, 0]
        return (self.vectors @ w).astype(np.float32), float(self.bias[1] - self.bias[0])


def train(texts: list[str], labels: np.ndarray, bits: int = 16, dim: int = 8, epochs: int = 6, rate: float = 0.3, seed: int = 3) -> SubwordModel:
    """Fit the model to whole texts with labels 0 and 1; each class weighs as it occurs."""
    rng = np.random.default_rng(seed)
    model = SubwordModel(np.zeros((_KINDS << bits, dim)), rng.normal(0, 1 / np.sqrt(dim), (dim, 2)), np.zeros(2), bits)
    rows = []
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        found = [h[b[0] : b[0] + c[0]] for h, b, c in _features(raw, np.array([0, len(raw)]), bits)]
        ids, counts = np.unique(np.concatenate(found), return_counts=True)
        rows.append((ids, counts / max(1, counts.sum())))
    step_v, step_w = np.full(model.vectors.shape, 1e-8), np.full(model.weights.shape, 1e-8)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            hidden = share @ model.vectors[ids]
            logits = hidden @ model.weights + model.bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = np.outer(share, model.weights @ p)
            step_v[ids] += back**2
            model.vectors[ids] -= rate * back / np.sqrt(step_v[ids])
            down = np.outer(hidden, p)
            step_w += down**2
            model.weights -= 0.1 * rate * down / np.sqrt(step_w)
            model.bias -= 0.01 * rate * p
    return model


def _scores(lookup):
    table, bias, bits = lookup.value

    def parts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for h, begin, n in _features(data, offsets, bits):
            total += sums(table[h], begin, n)
            count += n
        return total / np.maximum(count, 1) + bias

    return parts


def _run(lookup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, logit in scored(batches, _scores(lookup)):
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))))], [*rest, "score"])

    return run


def sample(docs: DataFrame, labels: DataFrame, bound: int, buckets: int = 4, held: int = 2) -> DataFrame:
    """At most ``bound`` labelled rows (text, quality), those with the smallest hash of doc_id; held-out ids are left out."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % buckets != held)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").join(known, "doc_id").select("doc_id", "text", "quality")


def quality(docs: DataFrame, labels: DataFrame, bound: int = 6000, threshold: float = 0.7, buckets: int = 4, held: int = 2) -> DataFrame:
    """``docs`` without text and with held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= ``threshold``).

    Learns only from at most ``bound`` rows of ``labels`` whose crc32(doc_id as text) modulo ``buckets`` is not ``held``;
    the score depends on nothing but the whole text. Null and empty texts get the constant part of the model. Without
    labelled rows every score is 0.5. A doc_id labelled twice counts with its higher label; held_out of a null doc_id is
    false. Columns named like the results are replaced.
    """
    docs = docs.drop("held_out", "score", "predicted")
    rows = sample(docs, labels, bound, buckets, held).collect()  # at most ``bound``, or as many as share their ids
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text))
    if rows:
        model = train([r.text for r in rows], np.array([r.quality for r in rows]))
        table, bias = model.lookup()
        bits = model.bits
    else:
        bits, bias = 4, 0.0
        table = np.zeros(_KINDS << bits, np.float32)
    lookup = docs.sparkSession.sparkContext.broadcast((table, bias, bits))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % buckets == held, F.lit(False))
    out = docs.mapInArrow(_run(lookup), f"{kinds}score double")
    return out.withColumn("held_out", held_out).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
