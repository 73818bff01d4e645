"""Mixing sources to target weights by systematic sampling.

Within a source each document expects target / source size copies. The prefix sums of the expected copies, shifted by one
random offset per source, cross integers; a document is emitted once per integer that it crosses. Documents stand in order
of size, so that whichever of a few neighbours is taken hardly matters: what a source gives differs from its target by
about one document.

One document can be a good part of a source. Those of more than 1 / ``NEAR`` of the source's target are its certainty units,
as survey sampling calls them: their expected copies are whole numbers, the source's rate rounded down or up such that the
words still owed, carried from one to the next, stay least; the expected copies of the others make up for what is left.
There are fewer than ``NEAR`` * source size / target of them, and none in a source of many documents of like size.

Order and prefix sums are distributed: documents are range-partitioned by source, size and a hash, each knows its
place in its partition, and a table of one row per partition and source tells how many come before.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modweave.llm.runtime import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3  # times its own size that a source may be asked for
NEAR = 128  # a document of a larger share of the target than one in this many has whole expected copies
_OFFSETS = 1024  # offsets are odd multiples of 1 / (2 * _OFFSETS), which sums with whole numbers keep exactly


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, total: float = 1.0) -> DataFrame:
    """``sizes`` (source, source_size; one row per source) with target.

    Sources by code point, null last, take the weights in turn and share ``total`` of all sizes. A source gets at most
    ``most`` times its size and the rest is shared again by weight: target = min(most * size, level * weight) for the
    level at which the targets add up. Sources reach their bound in order of bound / weight, so the level is the one
    that the prefix sums of that order give for the first source that stays below its bound (later ones give less).
    """
    turn = Window.orderBy(F.col("source").isNull(), "source")  # one row per source
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w.cast("double")).withColumn("bound", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("bound") / F.col("w"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    s = s.withColumn("given", F.coalesce(F.sum("bound").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("wanted", F.sum("source_size").over(whole) * F.lit(float(total)))
    s = s.withColumn("level", (F.col("wanted") - F.col("given")) / F.col("rest"))
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("bound"), F.col("level"))).over(whole))
    return s.select("source", "source_size", F.least("bound", F.coalesce(F.col("level") * F.col("w"), "bound")).alias("target"))


def whole_copies(sizes: list[int], rate: float) -> list[int]:
    """``rate`` rounded down or up for documents of these sizes, such that the words owed after each are fewest."""
    out, owed, low = [], 0.0, math.floor(rate)
    for size in sizes:
        owed += rate * size
        copies = low + int(rate > low and abs(owed - (low + 1) * size) < abs(owed - low * size))
        owed -= copies * size
        out.append(copies)
    return out


def _certain(table: pa.Table) -> pa.Table:
    table = table.sort_by([("rank", "descending")])
    copies = whole_copies(table.column("size").to_pylist(), table.column("rate")[0].as_py())
    return table.append_column("copies", pa.array(copies, pa.int64()))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, total: float = 1.0, seed: int = 7) -> DataFrame:
    """``(doc_id, tag, source, size, source_size, target, copies, taken)`` for each row of ``docs``.

    size is the number of words (0 for null and blank texts), copies how often the mix holds the document and taken
    copies * size; tag is a hash of the text. Null is a source of its own. A source whose texts have no words has target 0
    and no copies. Repeated rows are documents of their own. Reruns on the same rows give the same copies. Extra columns
    are ignored.
    """
    sized = cut(docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("tag")))  # texts are read once
    key = [F.col("source").isNull(), F.col("source"), F.col("size"), F.xxhash64("doc_id", "tag", F.lit(seed)), F.col("doc_id"), F.col("tag")]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = sized.repartitionByRange(n, *key).sortWithinPartitions(*key)
    # an id holds its partition in the upper bits and the place there in the lower 33
    ordered = cut(ordered.withColumn("at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("part", F.shiftright("at", 33)).withColumn("place", F.expr("at & 8589934591L"))
    parts = ordered.groupBy("source", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.sum("size").alias("size"))
    parts = cut(parts)  # one row per partition and source in it
    goal = targets(parts.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, total)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = (F.pmod(F.xxhash64(F.coalesce("source", F.lit("")), F.lit(seed)), F.lit(_OFFSETS)) * 2 + 1) / F.lit(2.0 * _OFFSETS)
    goal = goal.select(F.col("source").alias("__source"), "source_size", "target", rate.alias("rate"), offset.alias("offset"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", F.col("part").alias("__part"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("before"))
    parts = cut(parts.join(goal, F.col("source").eqNullSafe(F.col("__source"))).drop("source"))

    def placed(parts: DataFrame) -> DataFrame:
        out = ordered.join(parts, (F.col("part") == F.col("__part")) & F.col("source").eqNullSafe(F.col("__source")))
        return out.withColumn("rank", F.col("place") + F.col("before")).select("doc_id", "tag", "source", "size", "source_size", "target", "rate", "offset", "rank")

    large = F.col("size") * NEAR > F.col("target")
    some = placed(parts).where(large)
    certain = cut(some.groupBy("source").applyInArrow(_certain, some.withColumn("copies", F.lit(0).cast("long")).schema))
    given = certain.groupBy(F.col("source").alias("__of")).agg(F.sum(F.col("copies") * F.col("size")).alias("given"), F.sum("size").alias("words"))
    rest = F.col("source_size") - F.coalesce("words", F.lit(0))
    rate = F.when(rest > 0, F.least(F.greatest((F.col("target") - F.coalesce("given", F.lit(0))) / F.greatest(rest, F.lit(1)), F.lit(0.0)), F.lit(float(most)))).otherwise(0.0)
    parts = parts.join(given, F.col("__source").eqNullSafe(F.col("__of")), "left").withColumn("rate", rate).drop("__of", "given", "words")
    crossed = F.floor((F.col("rank") + 1) * F.col("rate") + F.col("offset")) - F.floor(F.col("rank") * F.col("rate") + F.col("offset"))
    sampled = placed(parts).where(~large).withColumn("copies", F.least(crossed, F.ceil("rate")).cast("long"))
    out = sampled.unionByName(certain).select("doc_id", "tag", "source", "size", "source_size", "target", "copies")
    return out.withColumn("taken", F.col("copies") * F.col("size"))
