"""Report tables: module ids, summary, collapsed views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modweave.functions import paths
from modweave.functions.storage import cut


def module_ids(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with id ``m<rank>``, ranks by path component from 0.

    Files are range-partitioned by path; a row's rank is its place in its partition and the partitions' counts before,
    so no task sorts all of them.
    """
    ordered = files.repartitionByRange(*[F.split(path, "/")]).sortWithinPartitions(F.split(path, "/"))
    ordered = cut(ordered.withColumn("__at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("__part", F.shiftright("__at", 33)).withColumn("__nth", F.expr("__at & 8589934591L"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    counts = ordered.groupBy("__part").agg(F.count("*").alias("n"), F.min("__nth").alias("first"))
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).select("__part", "base")
    out = ordered.join(counts, "__part")
    return out.withColumn("id", F.concat(F.lit("m"), (F.col("base") + F.col("__nth")).cast("string"))).drop("__part", "__at", "__nth", "base")


def directory_level(files: DataFrame, most: int, path: str = "path") -> int:
    """The deepest directory depth with at most ``most`` groups; 0 if every depth has more."""
    deepest = files.agg(F.max(paths.depth_of(path))).first()[0] or 0
    if not deepest:
        return 0
    counts = files.agg(*[F.countDistinct(paths.directory_prefix(path, d)).alias(str(d)) for d in range(1, deepest + 1)]).first()
    return max((d for d in range(1, deepest + 1) if counts[str(d)] <= most), default=0)


def directory_rollup(files: DataFrame, depth: int) -> DataFrame:
    """``files`` (path, is_barrel, in_cycle) per directory at ``depth``: module_count and whether any is a barrel or in a cycle."""
    return files.groupBy(paths.directory_prefix("path", depth).alias("directory")).agg(F.count("*").alias("module_count"), F.bool_or("is_barrel").alias("has_barrel"), F.bool_or("in_cycle").alias("has_cycle"))


def collapsed_edges(edges: DataFrame, depth: int) -> DataFrame:
    """Distinct (src, dst, kind) between different directories at ``depth``; src and dst of ``edges`` are file paths."""
    a, b = paths.directory_prefix("src", depth), paths.directory_prefix("dst", depth)
    return edges.select(a.alias("src"), b.alias("dst"), "kind").where("src != dst").distinct()
