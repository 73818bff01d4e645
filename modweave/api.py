"""The analysis of a workspace: tables by method, one report, a rewrite plan."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modweave.functions import paths, render
from modweave.operators import analyses, graph, report, rewrite, symbols
from modweave.plans import codemod
from modweave.sources.config import Config
from modweave.sources.workspace import Workspace

SCHEMA_VERSION = 2


def _camel(name: str) -> str:
    return re.sub("_([a-z])", lambda m: m[1].upper(), name)


def _rows(df: DataFrame) -> list[dict]:
    """Rows of a report table, for rendering; keys in camel case."""
    return [{_camel(k): v for k, v in r.asDict(recursive=True).items()} for r in df.collect()]


class Analysis:
    """What the graph of a source tree, or of given tables, says. ``include_type_edges`` holds for all but dead exports."""

    def __init__(self, spark: SparkSession, modules: DataFrame, imports: DataFrame, bindings: DataFrame, exports: DataFrame, config: Config | None = None, include_type_edges: bool = False, locals_: DataFrame | None = None, workspace: Workspace | None = None):
        self.spark, self.modules, self.imports, self.bindings, self.exports = spark, modules, imports, bindings, exports
        self.config, self.types, self.locals, self.workspace = config or Config(), include_type_edges, locals_, workspace

    @classmethod
    def from_path(cls, spark: SparkSession, root: str, config: Config | None = None, include_type_edges: bool = False) -> Analysis:
        return cls.from_workspace(Workspace.from_path(spark, root, config), include_type_edges)

    @classmethod
    def from_workspace(cls, w: Workspace, include_type_edges: bool = False) -> Analysis:
        return cls(w.spark, w.modules, w.imports, w.bindings, w.exports, w.config, include_type_edges, w.locals, w)

    @cached_property
    def edges(self) -> DataFrame:
        return graph.build_edges(self.modules, self.imports, self.exports).persist()

    @cached_property
    def links(self) -> DataFrame:
        return graph.adjacency(self.edges, self.types).persist()

    @cached_property
    def barrels(self) -> DataFrame:
        return analyses.barrels(self.modules, self.exports, self.config.barrel.reexport_ratio, self.config.barrel.max_own_decls).persist()

    @cached_property
    def verdicts(self) -> DataFrame:
        named = self.bindings.where("imported != '*'").join(self.imports, ["module", "ord"]).select(F.col("target").alias("module"), F.col("imported").alias("name"))
        return symbols.resolve(named.unionByName(symbols.exported_names(self.exports)), self.modules, self.exports, self.locals).persist()

    @cached_property
    def sites(self) -> DataFrame:
        return analyses.import_sites(self.imports, self.barrels, self.types).persist()

    @cached_property
    def symbols(self) -> DataFrame:
        return analyses.site_symbols(self.sites, self.bindings.select("module", "ord", "bord", "imported"), self.verdicts).persist()

    @cached_property
    def costs(self) -> DataFrame:
        return analyses.site_costs(self.sites, self.symbols, self.links).persist()

    def barrel_amplification(self) -> DataFrame:
        return analyses.barrel_amplification(self.costs)

    @cached_property
    def scc(self) -> DataFrame:
        return graph.components(self.links).persist()

    def cycles(self) -> DataFrame:
        return analyses.cycles(self.scc).join(analyses.shortest_cycles(self.links, self.scc), "scc").select("members", "size", "path").orderBy(F.desc("size"), "members")

    def fan(self, direction: str, limit: int | None = None) -> DataFrame:
        return analyses.fan(self.links, direction, limit)

    def projection(self, entrypoints: list[str] | None = None) -> DataFrame | None:
        chosen = self.config.entrypoints if entrypoints is None else entrypoints
        if not chosen:
            return None
        starts = self.spark.createDataFrame([(p,) for p in chosen], "path string")
        return analyses.entrypoint_projection(self.links, self.costs, self.symbols, starts, self.modules)

    def dead_exports(self) -> DataFrame:
        every = graph.adjacency(self.edges, types=True)
        defined = analyses.definitions(self.verdicts.join(symbols.exported_names(self.exports), ["module", "name"], "left_semi"))
        used = analyses.used_definitions(self.bindings, self.imports, self.verdicts)
        unsure = analyses.with_closure(every, analyses.uncertain_roots(self.imports, self.bindings, self.exports))
        entries = self.spark.createDataFrame([(p,) for p in self.config.entrypoints], "path string")
        roots = self.workspace.packages.select(F.explode("public_entrypoints").alias("src")) if self.workspace else self.modules.select(F.col("path").alias("src")).limit(0)
        return analyses.dead_exports(defined, used, entries, analyses.with_closure(every, roots), unsure)

    def plan(self, only: str | None = None, barrel: str | None = None) -> DataFrame:
        """(path, original, rewritten) of the files that going straight to definitions changes; ``only`` is a regular expression on importers."""
        w = self.workspace
        sites = rewrite.scope(analyses.import_sites(self.imports.withColumn("type_only", F.lit(False)), self.barrels), only, barrel)
        some = analyses.site_symbols(sites, self.bindings.select("module", "ord", "bord", "imported"), self.verdicts)
        conflicts = rewrite.merge_conflicts(some, self.imports, self.bindings.select("module", "ord", "bord", "imported"))
        return codemod.changes(w.files, w.imports, w.bindings, some, conflicts, w.aliases, w.owners, self.config.codemod.import_style)

    def warnings(self) -> DataFrame:
        """Barrels whose worst import is amplified beyond the configured threshold, strictly."""
        return self.barrel_amplification().where(F.col("max_amplification") > self.config.thresholds.max_amplification)

    def nodes(self, most: int | None = None) -> tuple[list[dict], list[dict]]:
        """Nodes and edges to draw: modules, or the deepest directories that are at most ``most``."""
        flag = lambda df, c, name: df.select(F.col(c).alias("path")).distinct().withColumn(name, F.lit(True))
        rows = self.modules.select("path").join(flag(self.barrels, "path", "is_barrel"), "path", "left").join(flag(self.scc, "node", "in_cycle"), "path", "left").na.fill(False, ["is_barrel", "in_cycle"])
        shown = self.edges  # type edges too, in a style of their own
        if most is None or rows.count() <= most:
            ids = report.module_ids(rows).select("id", F.col("path").alias("label"), "is_barrel", "in_cycle")
        else:
            depth = report.directory_level(rows, most)
            shown = report.collapsed_edges(shown, depth)
            ids = report.directory_rollup(rows, depth).select(F.col("directory").alias("label"), F.col("has_barrel").alias("is_barrel"), F.col("has_cycle").alias("in_cycle"))
            ids = report.module_ids(ids, "label").withColumn("id", F.regexp_replace("id", "^m", "d"))
        a, b = ids.select(F.col("id").alias("a"), F.col("label").alias("src")), ids.select(F.col("id").alias("b"), F.col("label").alias("dst"))
        drawn = shown.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "kind").orderBy("src", "dst", graph.kind_rank())
        return [r.asDict() for r in ids.orderBy(F.split("label", "/")).collect()], [r.asDict() for r in drawn.collect()]

    def _modules(self) -> DataFrame:
        """Modules as the report lists them: id, path, directory, has_side_effects, barrel (null for others), in_cycle."""
        barrel = self.barrels.select("path", F.struct("kind", "export_count", "reexport_count", "own_decl_count", "has_side_effects").alias("barrel"))
        loop = self.scc.select(F.col("node").alias("path"), F.lit(True).alias("in_cycle")).distinct()
        rows = self.modules.select("path", "has_side_effects").join(barrel, "path", "left").join(loop, "path", "left").na.fill(False, ["in_cycle"])
        return report.module_ids(rows).select("id", "path", paths.directory_of("path").alias("directory"), "has_side_effects", "barrel", "in_cycle").orderBy(F.split("path", "/"))

    def report(self) -> dict:
        """The whole report as a dictionary. A report is as long as the workspace; what is drawn is bounded in ``nodes``."""
        sites = self.costs.withColumn("amplification", F.round("amplification", 6)).orderBy(F.desc("excess"), F.split("module", "/"), "ord")
        projection, w = self.projection(), self.workspace
        out = {
            "schemaVersion": SCHEMA_VERSION,
            "includeTypeEdges": self.types,
            "workspace": {"kind": w.kind, "packages": _rows(w.packages.select("root", "name", "tsconfig", F.col("side_effects_false").alias("side_effects_free"), "public_entrypoints").orderBy(F.split("root", "/")))} if w else None,
            "modules": _rows(self._modules()),
            "edges": self.nodes()[1],
            "barrels": _rows(self.barrel_amplification()),
            "sites": _rows(sites),
            "skipCounts": _rows(analyses.skip_counts(self.symbols)),
            "cycles": _rows(self.cycles()),
            "deadExports": _rows(self.dead_exports()),
            "fanIn": _rows(self.fan("in")),
            "fanOut": _rows(self.fan("out")),
            "entrypoints": _rows(projection) if projection is not None else [],
            "danglingEdges": _rows(graph.dangling_edges(self.modules, self.imports.where("target not like '?%'"), self.exports.where("src is null or src not like '?%'"))),
            "unresolved": _rows(w.unresolved) if w else [],
            "externalPackages": [r.package for r in w.external_packages.collect()] if w else [],
            "failures": _rows(w.failures) if w else [],
        }
        out["summary"] = {
            "filesAnalyzed": len(out["modules"]),
            "packages": len(out["workspace"]["packages"]) if w else 0,
            "modules": len(out["modules"]),
            "edges": self.edges.count(),
            "externalPackages": len(out["externalPackages"]),
            "unresolvedSpecifiers": len(out["unresolved"]),
            "parseFailures": len(out["failures"]),
            "cycles": len(out["cycles"]),
            "deadExports": len(out["deadExports"]),
            "classifiedBarrels": sum(m["barrel"] is not None for m in out["modules"]),
            "importedBarrels": len(out["barrels"]),
            "sites": len(out["sites"]),
            "totalExcess": sum(s["excess"] for s in out["sites"]),
            "worstExcess": max((s["excess"] for s in out["sites"]), default=0),
        }
        return out

    def render(self, format: str, most: int = 150) -> str:
        return rendered(format, self.report() if format in ("json", "terminal", "html") else None, self.nodes(most) if format in ("html", "dot", "mermaid") else None)


def rendered(format: str, whole: dict | None, drawn: tuple[list[dict], list[dict]] | None) -> str:
    """A report, or what is drawn of it, in one of the formats; ``most`` nodes bound the drawing alone."""
    if format == "json":
        return render.to_json(whole)
    if format == "terminal":
        return render.to_terminal(whole)
    if format == "html":
        return render.to_html(whole, *drawn)
    return {"dot": render.to_dot, "mermaid": render.to_mermaid}[format](*drawn)


__all__ = ["Analysis", "Config", "Workspace", "paths"]
