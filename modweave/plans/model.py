"""The encoded graph of one data folder, each table computed once per session."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modweave.functions.storage import cut
from modweave.operators import analyses, graph, symbols
from modweave.plans.encode import encoded

_known: dict[tuple[str, str], Model] = {}


def model(spark: SparkSession, sf_dir: str) -> Model:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _known:
        _known[key] = Model(spark, sf_dir)
    return _known[key]


def forget() -> None:
    """Drop every known model and what it holds; the next query reads its folder anew."""
    for m in _known.values():
        m.release()
    _known.clear()


class Model:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._held: list[DataFrame] = []

    def release(self) -> None:
        for df in self._held:
            df.unpersist()
        self._held.clear()

    def _kept(self, df: DataFrame) -> DataFrame:
        """Held in memory or on disk, recomputed from its sources if an executor is lost; unions come in as many parts as shuffles."""
        self._held.append(df.coalesce(int(self.spark.conf.get("spark.sql.shuffle.partitions"))).persist())
        return self._held[-1]

    def _encoded(self, name: str) -> DataFrame:
        """Written once: what is only persisted is found by its plan, and that of a WITH changes in joins and in unions, so these would compute it again."""
        df = encoded(self.spark, self.sf_dir, name)
        return cut(df.coalesce(int(self.spark.conf.get("spark.sql.shuffle.partitions"))))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def modules(self) -> DataFrame:
        return self._encoded("modules")

    @cached_property
    def exports(self) -> DataFrame:
        return self._encoded("exports")

    @cached_property
    def imports(self) -> DataFrame:
        return self._encoded("imports")

    @cached_property
    def bindings(self) -> DataFrame:
        return self._encoded("bindings")

    @cached_property
    def edges(self) -> DataFrame:
        return self._kept(graph.build_edges(self.modules, self.imports, self.exports))

    @cached_property
    def links(self) -> DataFrame:
        return self._kept(graph.adjacency(self.edges))

    @cached_property
    def typed_links(self) -> DataFrame:
        return self._kept(graph.adjacency(self.edges, types=True))

    @cached_property
    def barrels(self) -> DataFrame:
        return self._kept(analyses.barrels(self.modules, self.exports))

    @cached_property
    def import_seeds(self) -> DataFrame:
        named = self.bindings.where("imported != '*'").join(self.imports, ["module", "ord"])
        return named.select(F.col("target").alias("module"), F.col("imported").alias("name")).distinct()

    @cached_property
    def verdicts(self) -> DataFrame:
        seeds = self.import_seeds.unionByName(symbols.exported_names(self.exports))
        return self._kept(symbols.resolve(seeds, self.modules, self.exports))

    @cached_property
    def sites(self) -> DataFrame:
        return self._kept(analyses.import_sites(self.imports, self.barrels))

    @cached_property
    def site_verdicts(self) -> DataFrame:
        """The verdicts of what sites import; all of them if they are known already."""
        if "verdicts" in self.__dict__:
            return self.verdicts
        seeds = self.sites.join(self.bindings.where("imported != '*'"), ["module", "ord"])
        return symbols.resolve(seeds.select(F.col("target").alias("module"), F.col("imported").alias("name")).distinct(), self.modules, self.exports, narrow=True)

    @cached_property
    def symbols(self) -> DataFrame:
        return self._kept(analyses.site_symbols(self.sites, self.bindings, self.site_verdicts))

    @cached_property
    def costs(self) -> DataFrame:
        return self._kept(analyses.site_costs(self.sites, self.symbols, self.links))

    @cached_property
    def scc(self) -> DataFrame:
        return self._kept(graph.components(self.links))

    @cached_property
    def files(self) -> DataFrame:
        """Modules with a file path for each: kind, last digit of the key, key."""
        kind, key = F.substring_index("path", ":", 1), F.substring_index("path", ":", -1)
        return self._kept(self.modules.withColumn("file", F.concat_ws("/", kind, (key.cast("long") % 10).cast("string"), key, F.lit("index"))))
