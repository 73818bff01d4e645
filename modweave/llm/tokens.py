"""Token ids and token counts of whole texts with a public tokenizer, inside Arrow functions.

Texts are split at safe boundaries into pieces that encode alone as they do in their text, long texts as well as short
ones. Pieces recur, so each distinct piece of a chunk of texts is encoded once, in batches of about equal bytes, by the
tokenizers library with its defaults: a special string in a text is its special token. A text's count is the sum over
its pieces; ids are put together only where a caller asks for ids.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modweave.llm.runtime import chunks, give_back, text_bytes

NAME = "byte_bpe_50k"
_BATCH_BYTES = 256 << 10
_CHUNK_BYTES = 16 << 20  # texts whose pieces are made distinct together
_STEP = 1 << 17  # pieces whose ids are put together at a time

# Kinds of bytes: 1 letter, 2 digit, 3 other visible ASCII, 4 white space that may begin a piece, 0 no boundary here
_KIND = np.zeros(256, np.uint8)
for _c in range(33, 127):
    _KIND[_c] = 1 if chr(_c).isalpha() else 2 if chr(_c).isdigit() else 3
_KIND[[9, 10, 32]] = 4
_APOSTROPHE, _OTHER = 5, 6  # an apostrophe may begin what follows it; other bytes end before white space at most
_KIND[39] = _APOSTROPHE
_KIND[128:] = _OTHER
_EDGE = np.zeros((8, 8), bool)
_EDGE[1:4, 1:4] = ~np.eye(3, dtype=bool)
_EDGE[[1, 2, 3, 5, 6], 4] = True
# as tables for bytes.translate: an index of numpy's would take eight bytes for each one
_KINDS = _KIND.tobytes()
_EDGES = _EDGE.tobytes().ljust(256, b"\0")


def vocabulary_path(name: str, suffix: str) -> str:
    """A tokenizer's file, as the installed package of public tokenizers names it."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}{suffix}")


@functools.lru_cache(maxsize=2)
def library(json_path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(json_path)
    give_back()
    return found


def pieces(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Where the pieces of the texts begin.

    The vocabulary's pattern takes runs of letters, of digits and of other characters, each with one space before it, and
    runs of white space. So no token reaches over the end of such a run where the next one begins without an apostrophe,
    nor over the place before white space that follows something else. A special string is left whole.
    """
    n = len(data)
    raw = data.tobytes()
    kind = np.frombuffer(bytearray(raw).translate(_KINDS), np.uint8)
    latin = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF: letters but for two signs
    latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
    kind[latin] = kind[latin + 1] = 1
    mark = np.zeros(n + 1, bool)
    mark[1:n] = np.frombuffer(((kind[:-1] << 3) | kind[1:]).tobytes().translate(_EDGES), bool)
    # white space beyond ASCII ends in bytes like those of letters: C2 85, C2 A0, E1 9A 80, E2 80 80 to E2 81 9F, E3 80 80
    at = np.flatnonzero(mark[1:n] & (kind[:-1] == _OTHER)) + 1
    two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    mark[at[(two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3) & np.isin(two, (0x80, 0x81, 0x9A)))]] = False
    for word in special:
        found = raw.find(word)
        while found >= 0:
            mark[found + 1 : found + len(word)] = False
            found = raw.find(word, found + 1)
    mark[offsets] = True
    return np.flatnonzero(mark[:n])


def by_bytes(size: np.ndarray, limit: int = _BATCH_BYTES) -> Iterator[np.ndarray]:
    """Numbers of texts in batches of about equal bytes, texts of like length together, so that no batch waits for one long text."""
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(np.cumsum(size[order]) // limit)) + 1
    yield from np.split(order, cuts)


class Encoder:
    """Counts and ids of texts that stand one after another in UTF-8."""

    def __init__(self, json_path: str):
        self.library = library(json_path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]

    def _distinct(self, data: np.ndarray, offsets: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text where its pieces begin and end among all, for each piece the number of its like, for each like its number of ids; ``keep`` gets likes and encodings batch by batch."""
        begin = pieces(data, offsets, self.special)
        ends = pa.py_buffer(np.append(begin, len(data)).astype("<i8", copy=False))
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, ends, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        bounds, which, texts = np.searchsorted(begin, offsets), found.indices.to_numpy(), found.dictionary.cast(pa.large_string())
        del begin, ends, found
        lengths = np.zeros(len(texts), np.int64)
        for rows in by_bytes(np.diff(text_bytes(texts)[1])):
            encodings = self.library.encode_batch_fast(texts.take(pa.array(rows)).to_pylist(), add_special_tokens=False)
            lengths[rows] = [len(e) for e in encodings]
            keep(rows, encodings)
        return bounds, which, lengths

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of ids of each text."""
        bounds, which, lengths = self._distinct(data, offsets, lambda rows, encodings: None)
        return np.diff(np.append(0, np.cumsum(lengths[which]))[bounds])

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the texts' bounds among them."""
        order, flat = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]

        def keep(rows, encodings):
            order.append(rows)
            flat.append(np.fromiter(chain.from_iterable(e.ids for e in encodings), "<u4"))

        bounds, which, lengths = self._distinct(data, offsets, keep)
        rows, ids = np.concatenate(order), np.concatenate(flat)
        order.clear()
        flat.clear()
        begin = np.empty(len(lengths), np.int64)
        begin[rows] = np.cumsum(lengths[rows]) - lengths[rows]
        ends = np.append(0, np.cumsum(lengths[which]))
        out = np.empty(ends[-1], "<u4")
        for a in range(0, len(which), _STEP):
            to = ends[a : a + _STEP + 1]
            out[to[0] : to[-1]] = ids[np.arange(to[-1] - to[0]) + np.repeat(begin[which[a : a + _STEP]] - (to[:-1] - to[0]), np.diff(to))]
        return out, ends[bounds]


def _counts(json_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(json_path)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            rest = [c for c in batch.schema.names if c != "text"]
            for a, b in chunks(offsets, _CHUNK_BYTES):
                found = encoder.counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in rest), pa.array(np.diff(offsets[a : b + 1])), pa.array(found)], [*rest, "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, limit: int = 512, json_path: str | None = None) -> DataFrame:
    """``docs`` without text and with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``).

    Ids never leave the Arrow function. A null text counts as empty: 0 bytes, 0 tokens. Every row is judged by itself,
    so repeated rows repeat. Columns named like the results are replaced.
    """
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    run = _counts(json_path or vocabulary_path(NAME, ".json"))
    return docs.mapInArrow(run, f"{kinds}n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
