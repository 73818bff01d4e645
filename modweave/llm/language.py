"""Language ID by error-correcting output codes.

Every language has a codeword. One binary classifier per bit, a logistic model over hashed character n-gram shares
trained by stochastic gradient descent, predicts that bit of a text's codeword. Decoding adds up the logistic losses of
the classifiers' margins against each codeword, weighted by how well a bit did in training; the language with the
smallest loss is chosen, and a text whose two best languages are too close is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modweave.llm.ngrams import code_points, grams, scored, spans, sums

_N = (1, 2, 3)
UNKNOWN = "und"
_DRAWS = 1 << 40  # values of the hash that rows are drawn by


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """A (k, bits) matrix of -1 and 1: all splits of up to five languages, else the best of some random codes."""
    if k <= 5:
        splits = [[1 if (s >> i) & 1 else -1 for i in range(k)] for s in range(1, 1 << k) if s & 1 and s != (1 << k) - 1]
        return np.array(splits or [[1] * k]).T
    rng, best, bits = np.random.default_rng(seed), None, int(np.ceil(10 * np.log2(k)))
    for _ in range(200):
        code = rng.choice([-1, 1], (k, bits))
        apart = ((code[:, None] != code[None]).sum(axis=2) + bits * np.eye(k, dtype=int)).min()
        if (np.abs(code.sum(axis=0)) < k).all() and (best is None or apart > best[0]):
            best = (apart, code)
    return best[1]


@dataclass
class CodeModel:
    languages: list[str]
    code: np.ndarray  # (languages, bits)
    table: np.ndarray  # (kinds << buckets, bits)
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit
    bits: int  # of a bucket

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chosen language, its probability by the losses, and by how much it is ahead of the next."""
        z = -margins[:, None, :] * self.code[None]
        loss = (np.logaddexp(0, np.clip(z, -50, 50)) * self.trust).sum(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        two = np.sort(p, axis=1)[:, ::-1]
        return loss.argmin(axis=1), two[:, 0], two[:, 0] - (two[:, 1] if p.shape[1] > 1 else 0)


def _lower(points: np.ndarray) -> np.ndarray:
    points = points.copy()
    points[(points >= 65) & (points <= 90)] += 32
    points[(points >= 0xC0) & (points <= 0xDE) & (points != 0xD7)] += 32
    return points


def _features(data: np.ndarray, offsets: np.ndarray, bits: int):
    points, bounds = code_points(data, offsets)
    points = _lower(points)
    for kind, n in enumerate(_N):
        yield grams(points, n, bits) + (kind << bits), *spans(bounds, n)


def train(texts: list[str], languages: list[str], bits: int = 15, epochs: int = 3, rate: float = 0.5, seed: int = 5) -> CodeModel:
    names = sorted(set(languages))
    code = codewords(len(names)).astype(float)
    rng, width = np.random.default_rng(seed), code.shape[1]
    table, bias = np.zeros((len(_N) << bits, width)), np.zeros(width)
    steps = np.full(table.shape, 1e-8)
    rows = []
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, counts = np.unique(np.concatenate([h[b[0] : b[0] + c[0]] for h, b, c in _features(raw, np.array([0, len(raw)]), bits)]), return_counts=True)
        rows.append((ids, counts / max(1, counts.sum())))
    goal = code[[names.index(x) for x in languages]]
    right = np.zeros(width)
    for epoch in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            margin = share @ table[ids] + bias
            right += (margin * goal[i] > 0) * (epoch == epochs - 1)
            slope = -goal[i] / (1 + np.exp(np.clip(margin * goal[i], -50, 50)))
            back = np.outer(share, slope)
            steps[ids] += back**2
            table[ids] -= rate * back / np.sqrt(steps[ids])
            bias -= 0.01 * rate * slope
    share = right / max(1, len(rows))
    trust = np.clip(2 * share - 1, 0.05, 1)  # a bit that guesses weighs little
    return CodeModel(names, code, table.astype(np.float32), bias, trust, bits)


def _run(shared, margin: float, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: CodeModel = shared.value
        names = np.array(model.languages, object)

        def parts(data, offsets):
            total, count = np.zeros((len(offsets) - 1, model.table.shape[1])), np.zeros(len(offsets) - 1)
            for h, begin, n in _features(data, offsets, model.bits):
                total += sums(model.table[h], begin, n)
                count += n
            return total / np.maximum(count, 1)[:, None] + model.bias

        for batch, margins in scored(batches, parts):
            rest = [c for c in batch.schema.names if keep_text or c != "text"]
            best, p, ahead = model.decode(margins)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(names[best], pa.string()), pa.array(p), pa.array(ahead < margin)], [*rest, "lang_pred", "score", "ambiguous"])

    return run


def sample(docs: DataFrame, per_language: int, buckets: int = 3, held: int = 1) -> DataFrame:
    """At most ``per_language`` rows (lang, text) of each language, those with the smallest hash of doc_id; held-out ids are left out."""
    known = docs.where("doc_id is not null and lang is not null and text is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % buckets != held)
    known = known.select("doc_id", "lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(_DRAWS)).alias("draw"))
    # one row per language, as the model has; the rows drawn are about twice the bound, so no task sorts a whole language
    sizes = known.groupBy(F.col("lang").alias("__lang")).agg((F.lit(2.0 * per_language * _DRAWS) / F.count("*")).alias("below"))
    drawn = known.join(F.broadcast(sizes), F.col("lang") == F.col("__lang")).where("draw < below")
    nth = Window.partitionBy("lang").orderBy("draw", "doc_id", F.xxhash64("text"))
    return drawn.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= per_language).select("doc_id", "lang", "text")


def languages(docs: DataFrame, per_language: int = 700, margin: float = 0.02, buckets: int = 3, held: int = 1, keep_text: bool = False) -> DataFrame:
    """``docs`` without text (unless ``keep_text``) and with held_out, lang_pred, score (0 to 1) and ambiguous.

    Learns only text and lang of at most ``per_language`` rows a language, of documents whose crc32(doc_id as text)
    modulo ``buckets`` is not ``held``; a prediction depends on nothing but the whole text. Texts that are null or
    without any letter are ``und`` with score 0; so is every text if no row has a language. Texts whose two best
    languages' probabilities are less than ``margin`` apart are ambiguous and get the better, ties the first by name.
    held_out of a null doc_id is false. Columns named like the results are replaced.
    """
    docs = docs.drop("held_out", "lang_pred", "score", "ambiguous")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % buckets == held, F.lit(False))
    rows = sorted((r.doc_id, r.lang, r.text) for r in sample(docs, per_language, buckets, held).collect())  # bounded per language
    nothing = [F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous")]
    kept = [c for c in docs.columns if keep_text or c != "text"]
    if not rows:
        return docs.select(*kept, *nothing).withColumn("held_out", held_out)
    model = docs.sparkSession.sparkContext.broadcast(train([r[2] for r in rows], [r[1] for r in rows]))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in kept)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = docs.withColumn("__letters", letters).mapInArrow(_run(model, margin, keep_text), f"{kinds}__letters boolean, lang_pred string, score double, ambiguous boolean")
    out = out.withColumns({
        "lang_pred": F.when(F.col("__letters"), F.col("lang_pred")).otherwise(F.lit(UNKNOWN)),
        "score": F.when(F.col("__letters"), F.col("score")).otherwise(F.lit(0.0)),
        "ambiguous": F.col("__letters") & F.col("ambiguous"),
    })
    return out.drop("__letters").withColumn("held_out", held_out)
