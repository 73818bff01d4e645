"""Substring dedup by level-wise doubling.

A window is ``window`` consecutive words. Windows repeated at one length alone are extended to twice that length:
level by level, from ``base`` words up to ``window``, a window survives if the sub-window that stands for it at that
length occurs at least twice in the corpus, and only survivors are looked at on the next level; where none survive, the
search ends. The stand-in is the sub-window with the smallest hash (a minimiser), which equal windows have in common;
neighbouring windows mostly share it, so a level shuffles about 2 / (window - length + 2) of all positions. What a level
found goes to the next as a bitmap of bounded size: if that fills up, more windows survive, which costs time and changes
no result.

At full length, neighbouring survivors with one stand-in travel together to the partition of that stand-in, sorted by
document and place, with a 64-bit hash each: whatever came before with the same stand-in and hash is an earlier copy,
so one pass over the stream finds the first of each. What a task already knows to be a later copy is marked before the
shuffle and needs no hash, so copies of one text weigh little there. The windows around a stand-in that is very frequent
travel one by one instead, each to the partition of its own hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modweave.llm.runtime import as_long, bitmap_of, chunks, cut, in_bitmap, text_bytes, tidy
from modweave.llm.words import Words, double, mix, sliding, window_hashes

_SPACES, _WORD = "[\\x20\\x09-\\x0D]+", "[^\\x20\\x09-\\x0D]+"


_RUN = 32  # windows that one row stands for, at most
_FREQUENT = 1 << 14  # occurrences of a stand-in beyond which its windows are dealt by their own hashes
_NO_ID = -(1 << 63)  # how a null doc_id counts in the order


class _Levels:
    """Hashes of one chunk's windows at each length, and which full windows survive the levels known so far."""

    def __init__(self, words: Words, base: int, window: int, bitmaps: list[np.ndarray], seed: int = 0):
        self.window, starts = window, np.arange(len(words.hash))
        n = max(0, len(starts) - window + 1)
        own = words.owner()
        self.alive = starts[:n] + window <= words.bounds[1:][own[:n]]
        self.length, self.hash = base, window_hashes(words.hash, base, seed)
        for bitmap in bitmaps:
            self.before = self.least()
            self.alive &= in_bitmap(bitmap, self.before)
            self.hash, self.length = double(self.hash, self.length, seed + 1), 2 * self.length

    def least(self) -> np.ndarray:
        """The smallest hash of this length inside each full window."""
        return sliding(self.hash, self.window - self.length + 1, np.minimum)

    def stand_ins(self) -> np.ndarray:
        """Hashes at the distinct positions that stand for surviving windows."""
        least = np.where(self.alive, self.least(), np.uint64(0))
        width = self.window - self.length + 1
        most = sliding(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum)
        return self.hash[: len(most)][most == self.hash[: len(most)]]


def _stand_ins(base: int, window: int, known: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in chunks(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if len(words.start) >= window:
                    h = _Levels(words, base, window, [x.value for x in known]).stand_ins()
                    h, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([as_long(h), pa.array(n)], ["h", "n"])

    return run


def _runs(base: int, window: int, known: list, frequent):
    """Rows (slot, doc, tag, start, later, hashes): surviving windows that begin at start, start + 1, ... and have one stand-in.

    Bit k of later says that the k-th is known to be a later copy; if all are, there are no hashes and the slot is any.
    A window whose stand-in is ``frequent`` has a row of its own and a slot by its own hash as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            docs, tags = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            for a, b in chunks(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if len(words.start) < window:
                    continue
                levels = _Levels(words, base, window, [x.value for x in known])
                at = np.flatnonzero(levels.alive)
                if not len(at):
                    continue
                # the level before the last is the one whose smallest hash stands for a window
                stand_in = levels.before[at] if known else levels.hash[at]
                row = words.owner()[at]
                doc, start, h = docs[a:b][row], at - words.bounds[row], levels.hash[at]
                later = _later(h, doc, start)
                often = in_bitmap(frequent.value, stand_in)
                stand_in = np.where(often, mix(h ^ mix(stand_in, 47), 48), stand_in)
                new = np.append(True, (at[1:] != at[:-1] + 1) | (stand_in[1:] != stand_in[:-1]) | (row[1:] != row[:-1]) | often[1:])
                begin = np.flatnonzero(new)
                nth = np.arange(len(at)) - begin[np.cumsum(new) - 1]
                new |= nth % _RUN == 0
                begin, nth = np.flatnonzero(new), nth % _RUN
                bits = np.bitwise_or.reduceat(later.astype(np.int64) << nth, begin)
                length = np.diff(np.append(begin, len(at)))
                settled = bits == (np.int64(1) << length) - 1
                slot = np.where(settled, mix(doc[begin].astype(np.uint64) ^ mix(start[begin].astype(np.uint64), 41), 43), stand_in[begin])
                sent = np.repeat(~settled, length)
                ends = np.append(0, np.cumsum(np.where(settled, 0, length))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [as_long(slot), pa.array(doc[begin]), pa.array(tags[a:b][row[begin]]), pa.array(start[begin].astype(np.int32)), pa.array(bits), pa.ListArray.from_arrays(pa.array(ends), as_long(h[sent]))],
                    ["slot", "doc", "tag", "start", "later", "hashes"],
                )

    return run


def _later(h: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows have an equal one with a smaller doc, or the same and a smaller start."""
    if not len(h):
        return np.zeros(0, bool)
    order = np.lexsort((start, doc, h))
    h, doc, start = h[order], doc[order], start[order]
    new = np.append(True, h[1:] != h[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.empty(len(h), bool)
    out[order] = (doc != doc[first]) | (start != start[first])
    return out


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Completes later for rows sorted by slot, doc and start. Between batches only the last slot's distinct windows are held."""
    held = (None, *(np.zeros(0, np.int64) for _ in range(3)))
    for batch in batches:
        if not batch.num_rows:
            continue
        slot, doc, start = (batch.column(c).to_numpy() for c in ("slot", "doc", "start"))
        hashes = batch.column("hashes")
        length = np.diff(hashes.offsets.to_numpy())
        h = hashes.flatten().to_numpy()
        row = np.repeat(np.arange(len(slot)), length)
        nth = np.arange(len(h)) - np.repeat(np.cumsum(length) - length, length)
        kept = held[1:] if held[0] == slot[0] else tuple(np.zeros(0, np.int64) for _ in range(3))
        all_h, all_doc, all_start = (np.concatenate([x, y]) for x, y in zip(kept, (h, doc[row], start[row] + nth)))
        later = _later(all_h, all_doc, all_start)
        end = np.append(np.full(len(kept[0]), slot[0] == slot[-1]), slot[row] == slot[-1]) & ~later
        held = (slot[-1], all_h[end], all_doc[end], all_start[end])
        bits = batch.column("later").to_numpy().copy()
        np.bitwise_or.at(bits, row, later[len(kept[0]) :].astype(np.int64) << nth)
        some = pa.array(bits != 0)
        yield pa.RecordBatch.from_arrays([batch.column("doc").filter(some), batch.column("tag").filter(some), batch.column("start").filter(some), pa.array(bits).filter(some)], ["doc", "tag", "start", "later"])


def _cut_words(window: int):
    """The texts without the words that the windows of ``__runs`` cover, words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            runs = batch.column("__runs")
            for a, b in chunks(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], hashes=False)
                gone = np.zeros(len(words.start) + 1, np.int64)
                for i in range(a, b):
                    if runs[i].is_valid:
                        start, later = (runs[i].values.field(k).to_numpy() for k in (0, 1))
                        which, nth = np.nonzero((later[:, None] >> np.arange(_RUN)) & 1)
                        s = start[which].astype(np.int64) + nth + words.bounds[i - a]
                        np.add.at(gone, s, 1)
                        np.add.at(gone, np.minimum(s + window, words.bounds[i - a + 1]), -1)
                keep = np.cumsum(gone[:-1]) == 0
                texts, removed = _joined(words, keep)
                whole = [batch.column(c).slice(a, b - a) for c in range(batch.num_columns) if batch.schema.names[c] not in ("text", "__runs")]
                names = [c for c in batch.schema.names if c not in ("text", "__runs")]
                yield pa.RecordBatch.from_arrays([*whole, texts, pa.array(words.counts.astype(np.int64)), pa.array(removed)], [*names, "kept_text", "n_words", "n_removed"])

    return run


def _joined(words: Words, keep: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """For each text its kept words with one space between them, and how many words were dropped."""
    begin, end = words.start[keep], words.end[keep]
    mark = np.zeros(len(words.data) + 1, np.int8)
    mark[begin] += 1
    mark[end] -= 1
    inside = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    kept = np.concatenate([[0], np.cumsum(keep)])[words.bounds]
    size = np.concatenate([[0], np.cumsum(end - begin)])
    counts = np.diff(kept)
    gaps = np.maximum(counts - 1, 0)
    out_at = np.concatenate([[0], np.cumsum(size[kept[1:]] - size[kept[:-1]] + gaps)])
    out = np.full(out_at[-1], 32, np.uint8)
    # each kept word begins after the bytes of earlier kept words and one space per earlier word of its text
    row = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(begin)) - kept[:-1][row]
    to = out_at[row] + size[:-1] - size[kept[:-1][row]] + nth
    mark = np.zeros(len(out) + 1, np.int8)
    mark[to] += 1
    np.add.at(mark, to + (end - begin), -1)
    out[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)] = words.data[inside]
    texts = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(out_at.astype("<i8").tobytes()), pa.py_buffer(out.tobytes()))
    return texts.cast(pa.string()), words.counts - counts


def repeated_windows(docs: DataFrame, window: int = 20, base: int = 5) -> DataFrame:
    """``(doc, tag, runs)``: for each text the windows whose word sequence also starts earlier, in a smaller doc_id or the
    same one, as runs (start, later): bit k of later is the window at start + k. ``tag`` tells texts that share a doc_id
    apart; a null doc_id counts as the smallest number."""
    if window < 2 * base or window % base or (window // base) & (window // base - 1):
        raise ValueError("window must be base times two, four, eight and so on")
    spark = docs.sparkSession
    docs = docs.select("text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64("text").alias("tag"))
    known: list = []
    length = base
    while length < window:
        seen = docs.select("text").mapInArrow(_stand_ins(base, window, list(known)), "h long, n long")
        again = cut(seen.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
        candidates = again.count()
        if not candidates:
            return spark.createDataFrame([], "doc long, tag long, runs array<struct<start: int, later: long>>")
        known.append(spark.sparkContext.broadcast(bitmap_of(F.col("h"), again, candidates)))
        length *= 2
        tidy(spark)
    frequent = spark.sparkContext.broadcast(bitmap_of(F.col("h"), again.where(F.col("n") > _FREQUENT)))
    rows = docs.mapInArrow(_runs(base, window, known, frequent), "slot long, doc long, tag long, start int, later long, hashes array<long>")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "slot").sortWithinPartitions("slot", "doc", "start")
    found = rows.mapInArrow(_settled, "doc long, tag long, start int, later long")
    found = cut(found.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "later")).alias("runs")))
    tidy(spark)
    return found


def substring_dedup(docs: DataFrame, window: int = 20, base: int = 5) -> DataFrame:
    """``docs`` with kept_text, n_words and n_removed: texts without the words that repeated windows cover.

    Words are runs of anything but 0x20 and 0x09-0x0D, joined by one space in kept_text. Windows are judged on the
    input, not on what is left, in the order of doc_id, a whole number. Null and blank texts have no words and an empty kept_text. Rows that are alike in id
    and text are alike in the result; a text of its own under a shared doc_id is judged for itself. kept_text
    takes the place of text; columns named like the results are replaced, all others are kept.
    """
    docs = docs.drop("kept_text", "n_words", "n_removed")
    others = [c for c in docs.columns if c != "text"]
    found = repeated_windows(docs, window, base).withColumnsRenamed({"doc": "__id", "tag": "__key", "runs": "__runs"})
    touched, wide = bitmap_of(F.xxhash64("__id", "__key"), found), 4096
    bits = (len(touched) * 8).bit_length() - 1
    slots = [(i, bytearray(touched[i * wide : (i + 1) * wide].tobytes())) for i in range(len(touched) // wide) if touched[i * wide : (i + 1) * wide].any()]
    slots = docs.sparkSession.createDataFrame(slots, "__bucket long, __bitmap binary")
    # texts that lose nothing stay where they are; the bitmap has at most 2**bits bits, so it can be broadcast
    tagged = docs.withColumn("__tag", F.xxhash64("text")).withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)))
    tagged = tagged.withColumn("__slot", F.shiftrightunsigned(F.xxhash64("__doc", "__tag"), 64 - bits))
    tagged = tagged.join(F.broadcast(slots), F.expr("__slot div 32768") == F.col("__bucket"), "left")
    byte = F.conv(F.hex(F.expr("substring(__bitmap, cast(__slot % 32768 div 8 + 1 as int), 1)")), 16, 10).cast("int")
    tagged = tagged.withColumn("__byte", byte)
    tagged = tagged.withColumn("__maybe", F.expr("coalesce(shiftright(__byte, cast(__slot % 8 as int)) & 1 = 1, false)"))
    plain = tagged.where("not __maybe").select(
        *others,
        F.coalesce(F.trim(F.regexp_replace("text", F.lit(_SPACES), F.lit(" "))), F.lit("")).alias("kept_text"),
        F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_removed"),
    )
    hit = tagged.where("__maybe").join(found, (F.col("__doc") == F.col("__id")) & (F.col("__tag") == F.col("__key")), "left")
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    cleaned = hit.select(*others, "text", "__runs").mapInArrow(_cut_words(window), f"{kinds}, kept_text string, n_words long, n_removed long")
    return plain.unionByName(cleaned)
