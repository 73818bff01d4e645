"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles. Each shingle flips one bit of a sketch that is cut into K segments,
so the Hamming distance of two sketches is at most the size of the sets' symmetric difference. Two sets with Jaccard
similarity >= t differ in at most d = (1 - t) / (1 + t) * (|A| + |B|) shingles, so of K > d segments at least K - d
are equal in both sketches (pigeonhole). Sketches are as wide as 64-bit shingle hashes allow and never stored: the key
of a segment is a linear 64-bit hash of its parity bits, the XOR of one random word per set bit.

Sizes fall into bands whose edges grow by at most 1 / t, and a pair meets in the band of its smaller set; K and d are
fixed per band. All K segments of a set, ordered by bits set (most first) and key, are an order common to all sets, so
two sets that share K - d segments share one among the first d + 1 of each: only those are posted, and segments with
no or one bit, which unrelated sets share, hardly ever are among them.

Sets that are equal form one class first. In each posting, every class is verified against the smallest one (a star,
as many pairs as postings). Postings whose classes are still in more than one component are then compared pairwise in
place, by 1024-bit parity sketches in numpy blocks, and only pairs that these cannot exclude are verified. Verification
intersects the whole sets. No cap is set anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modweave.llm.components import components
from modweave.llm.runtime import as_long, bitmap_of, chunks, cut, in_bitmap, join_frequent, text_bytes, tidy
from modweave.llm.streams import whole_groups
from modweave.llm.words import Words, mix, window_hashes

_SKETCH_BITS = 1024
_SEEN = 1 << 20  # class names that a task remembers, so as not to repeat itself
_BLOCK = 1024  # classes of a posting that one cell of the pairwise comparison holds on a side


class Bands:
    """Size bands with their number of segments and greatest symmetric difference. ``num`` / ``den`` is the threshold."""

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den, edges = num, den, [1]
        while edges[-1] <= largest:
            edges.append(max(edges[-1] + 1, edges[-1] * den // num))
        self.edges = np.array([*edges, max(edges[-1] + 1, edges[-1] * den // num)], np.int64)
        top = self.edges[1:] - 1  # the largest size in each band
        self.partner = top * den // num  # the largest size that it can pair with
        self.d = (top + self.partner) * (den - num) // (den + num)
        per_segment = np.where(top < 64, 2.0, 3.0)
        self.k = np.maximum(self.d + 1, np.ceil(top / per_segment).astype(np.int64))

    def of(self, size: int) -> list[int]:
        """The bands in which a set of this size is posted: its own, and the one below if a smaller set there can match."""
        own = int(np.searchsorted(self.edges, size, side="right")) - 1
        found = [own] if own == 0 or size > self.partner[own - 1] else [own, own - 1]
        return [i for i in found if self.d[i] > 0]  # where no difference is allowed, equal sets are one class already


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and the texts' bounds."""
    words = Words(data, offsets, lower=True)
    grams = window_hashes(words.hash, n, seed)
    short = (words.counts > 0) & (words.counts < n)
    sizes = np.where(short, 1, np.maximum(words.counts - n + 1, 0))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(bounds[-1], np.uint64)
    keep = np.ones(len(out), bool)
    for i in np.flatnonzero(sizes):
        a, b, w = bounds[i], bounds[i + 1], words.bounds[i]
        if short[i]:
            h = np.uint64(words.counts[i])
            for x in words.hash[w : words.bounds[i + 1]]:
                h = mix(np.array([h ^ x]), seed + 77)[0]
            out[a] = h
        else:
            out[a:b] = grams[w : w + b - a]
            out[a:b].sort()
    keep[1:] = out[1:] != out[:-1]
    keep[bounds[:-1][sizes > 0]] = True
    ahead = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], ahead[bounds]


def _set_hashes(grams: np.ndarray, bounds: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; 0 for empty ones."""
    out = np.zeros((2, len(bounds) - 1), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for i, s in enumerate((seed + 11, seed + 12)):
            out[i][full] = mix(np.bitwise_xor.reduceat(mix(grams, s), bounds[:-1][full]) + np.diff(bounds)[full].astype(np.uint64), s)
    return out[0], out[1]


def _segments(grams: np.ndarray, bounds: np.ndarray, full: np.ndarray, bands: Bands) -> Iterator[tuple[int, np.ndarray]]:
    """For each set numbered in ``full`` and each of its bands: the set's number and its d + 1 posted keys."""
    mixed = mix(grams, 5)
    for i in full:
        g, m = grams[bounds[i] : bounds[i + 1]], mixed[bounds[i] : bounds[i + 1]]
        for band in bands.of(len(g)):
            k, want = int(bands.k[band]), int(bands.d[band]) + 1
            # sorted hashes make each segment a run: segment = floor(hash * k / 2**64), on the upper 32 bits
            seg = ((g >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            begin = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            key = np.bitwise_xor.reduceat(m, begin)
            bits = np.diff(np.append(begin, len(g)))
            at = seg[begin]
            if len(begin) < want:  # the order ends with empty segments: only sets with so few others post them
                empty = np.setdiff1d(np.arange(k, dtype=np.uint64), at)
                key, bits, at = np.append(key, np.zeros(len(empty), np.uint64)), np.append(bits, np.zeros(len(empty), np.int64)), np.append(at, empty)
            key = mix(key ^ mix(at + np.uint64(band << 32), 9), 3)
            if len(key) > want:
                top = np.lexsort((key, -bits))[:want]
                key = key[top]
            yield i, key


def _sketch(grams: np.ndarray) -> bytes:
    at = (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 10)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=_SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def _classes(n: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in chunks(offsets):
                grams, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n, seed)
                h1, h2 = _set_hashes(grams, bounds, seed)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(bounds)), as_long(h1), as_long(h2)], ["doc_id", "n", "cls", "check"])

    return run


def _postings(n: int, seed: int, num: int, den: int):
    """Rows (slot, cls, rep, key). A key that several classes of a chunk post gets one row there, with the smallest, in
    slot = key; the others come with that rep in slots of their own. So a key that many classes share is thinned out
    before the shuffle, and a class is posted once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = None, np.zeros(0, np.uint64)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in chunks(offsets):
                grams, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n, seed)
                h1, _ = _set_hashes(grams, bounds, seed)
                names, first = np.unique(h1, return_index=True)
                new = (names != 0) & ~np.isin(names, seen)
                seen = np.union1d(seen[-_SEEN:], names)
                largest = int(np.diff(bounds).max(initial=1))
                if bands is None or largest >= bands.edges[-3]:
                    bands = Bands(num, den, 2 * largest)
                keys, of = [], []
                for i, key in _segments(grams, bounds, np.sort(first[new]), bands):
                    keys.append(key)
                    of.append(np.full(len(key), h1[i]))
                if not keys:
                    continue
                key, cls = np.concatenate(keys).view(np.int64), np.concatenate(of).view(np.int64)
                order = np.lexsort((cls, key))
                key, cls = key[order], cls[order]
                begin = np.append(True, key[1:] != key[:-1])
                rep = cls[begin][np.cumsum(begin) - 1]
                slot = np.where(begin, key, mix(cls.view(np.uint64) ^ mix(key.view(np.uint64), 31), 33).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(cls), pa.array(rep, mask=begin), pa.array(key, mask=begin)], ["slot", "cls", "rep", "key"])

    return run


def _sets(n: int, seed: int, needed, whole: bool):
    """Size and sketch, or the whole set, of each class that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in chunks(offsets):
                grams, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n, seed)
                h1, _ = _set_hashes(grams, bounds, seed)
                keep = np.flatnonzero(in_bitmap(needed.value, h1) & (h1 != 0) & ~np.isin(h1, seen))
                names, first = np.unique(h1[keep], return_index=True)
                keep, seen = np.sort(keep[first]), np.union1d(seen[-_SEEN:], names)
                if not len(keep):
                    continue
                parts = [grams[bounds[i] : bounds[i + 1]] for i in keep]
                if whole:
                    ends = pa.array(np.append(0, np.cumsum([len(g) for g in parts])), pa.int32())
                    yield pa.RecordBatch.from_arrays([as_long(h1[keep]), pa.ListArray.from_arrays(ends, as_long(np.concatenate(parts)))], ["cls", "grams"])
                else:
                    sizes, sketches = np.array([len(g) for g in parts]), [_sketch(g) for g in parts]
                    yield pa.RecordBatch.from_arrays([as_long(h1[keep]), pa.array(sizes), pa.array(sketches, pa.binary())], ["cls", "n", "sketch"])

    return run


def _verified(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            xs, ys = (np.frombuffer(c.values.buffers()[1], "<i8")[c.values.offset :] for c in (x, y))
            xo, yo = x.offsets.to_numpy(), y.offsets.to_numpy()
            linked = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                g, h = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
                common = len(np.intersect1d(g, h, assume_unique=True))
                linked[i] = common * den >= num * (len(g) + len(h) - common)
            keep = pa.array(linked)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _near_pairs(num: int, den: int):
    """Pairs of a cell's classes from different components that the sketches and sizes leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, begins in whole_groups(batches, ["key", "p", "q"]):
            cls, root, size = (whole.column(c).to_numpy() for c in ("cls", "root", "n"))
            side, same = whole.column("side").to_numpy(), whole.column("p").to_numpy() == whole.column("q").to_numpy()
            bits = np.frombuffer(b"".join(whole.column("sketch").to_pylist()), "<u8").reshape(len(cls), -1)
            left, right = [], []
            for s, e in zip(begins[:-1], begins[1:]):
                one = np.arange(s, e)
                xs, ys = (one, one) if same[s] else (one[side[s:e] == 0], one[side[s:e] == 1])
                for i in xs:
                    js = ys[ys > i] if same[s] else ys
                    js = js[(root[js] != root[i]) & (size[js] * den >= size[i] * num) & (size[i] * den >= size[js] * num)]
                    if len(js):
                        apart = np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1, dtype=np.int64)
                        js = js[apart * (den + num) <= (size[js] + size[i]) * (den - num)]
                        left.append(np.full(len(js), cls[i]))
                        right.append(cls[js])
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _sets_of(docs: DataFrame, pairs: DataFrame, n: int, seed: int, whole: bool) -> DataFrame:
    """Sketches or whole sets of the classes in ``pairs``, and of a few others that a bounded bitmap lets through."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls"))
    needed = docs.sparkSession.sparkContext.broadcast(bitmap_of(F.col("cls"), ends))
    columns = "cls long, grams array<long>" if whole else "cls long, n long, sketch binary"
    return docs.select("text").mapInArrow(_sets(n, seed, needed, whole), columns).dropDuplicates(["cls"])


def _links(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, n: int, seed: int, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold. Sketches and sizes drop most others before any set is moved."""
    one = lambda c, *also: sketches.select(F.col("cls").alias(c), *(F.col(x).alias(y) for x, y in also))
    near = pairs.join(one("a", ("n", "na"), ("sketch", "sa")), "a").join(one("b", ("n", "nb"), ("sketch", "sb")), "b")
    near = near.where(f"na * {den} >= nb * {num} and nb * {den} >= na * {num}")
    near = cut(near.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_apart(num, den), "a long, b long"))
    sets = _sets_of(docs, near, n, seed, whole=True)
    both = near.join(sets.select(F.col("cls").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("grams").alias("y")), "b")
    links = cut(both.select("a", "b", "x", "y").mapInArrow(_verified(num, den), "a long, b long"))
    tidy(docs.sparkSession)
    return links


def _apart(num: int, den: int):
    """Pairs whose sketches' Hamming distance allows the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u8").reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
                keep = pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) * (den + num) <= total * (den - num))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs``.

    Texts are lower-cased in A-Z; a set holds the distinct shingles of ``n`` words, or the whole sequence if there are
    fewer. Rows link when 100 * |A & B| >= (100 * num / den) * |A | B|; component_id is the smallest doc_id that links
    reach. Null, empty and blank texts have n_shingles 0 and are a component of their own. Rows that share a doc_id are
    judged by their texts, each for itself; a null doc_id is never the smallest. Extra columns are ignored.
    """
    docs, seed = docs.select("doc_id", "text"), 1
    while True:
        rows = cut(docs.mapInArrow(_classes(n, seed), docs.select("doc_id").schema.simpleString()[7:-1].replace(":", " ") + ", n long, cls long, check long"))
        mixed = rows.where("n > 0").groupBy("cls").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x != y").limit(1).count()
        if not mixed:
            break
        seed += 1  # two different sets got one 64-bit name: name all anew
    posted = docs.select("text").mapInArrow(_postings(n, seed, num, den), "slot long, cls long, rep long, key long")
    by_slot = Window.partitionBy("slot")
    posted = posted.withColumn("low", F.min("cls").over(by_slot)).withColumn("high", F.max("cls").over(by_slot))
    posted = posted.where("rep is not null or low < high").select(F.coalesce("key", "slot").alias("key"), "cls", F.coalesce("rep", "low").alias("rep"))
    posted = cut(posted)
    tidy(docs.sparkSession)
    star = cut(posted.where("cls != rep").select(F.least("cls", "rep").alias("a"), F.greatest("cls", "rep").alias("b")).distinct())
    sketches = cut(_sets_of(docs, star, n, seed, whole=False))
    links = _links(docs, star, sketches, n, seed, num, den)
    roots = components(links, "a", "b")

    members = posted.select("key", "cls").union(posted.select("key", F.col("rep").alias("cls"))).distinct()
    members = members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    open_keys = members.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size")).where("x != y and size > 2").select("key", "size")
    members = cut(members.join(open_keys, "key"))
    if members.limit(1).count():
        cells = _cells(members.join(sketches, "cls"))
        more = cells.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(_near_pairs(num, den), "a long, b long")
        more = cut(more.distinct().join(star, ["a", "b"], "left_anti"))
        links = links.union(_links(docs, more, sketches, n, seed, num, den))
        roots = components(links, "a", "b")
    some = rows.where("n > 0")
    classes = some.groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = cut(classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    least = cut(classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")))
    named = cut(join_frequent(classes.select("cls", "root", "copies"), least, "root", "classes").select("cls", "copies", "component_id"))
    out = join_frequent(some.select("doc_id", "n", "cls"), named, "cls", "copies").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _cells(members: DataFrame) -> DataFrame:
    """Deal the members of each posting to the cells of its pairwise comparison, at most two blocks in a cell."""
    blocks = F.ceil(F.col("size") / _BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls", F.lit(3)), blocks.cast("long")).cast("int")
    spread = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return spread.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cls", "root", "n", "sketch")
