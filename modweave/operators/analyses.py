"""Barrels, amplification, cycles, dead exports and fan: what the graph says about imports."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modweave.functions.storage import cut
from modweave.operators import graph

SKIPS = ("ambiguous", "cyclic", "external", "notFound", "namespaceImport", "barrelHasSideEffects", "mergeConflict")  # in sort order
REEXPORTS = ("named", "star", "namespaceStar")


def export_shapes(modules: DataFrame, exports: DataFrame) -> DataFrame:
    """Every module with export_count, reexport_count and reexport_ratio (0 without exports)."""
    counted = exports.groupBy(F.col("module").alias("path")).agg(F.count("*").alias("export_count"), F.count_if(F.col("kind").isin(*REEXPORTS) & F.col("src").isNotNull()).alias("reexport_count"))
    out = modules.join(counted, "path", "left").na.fill(0, ["export_count", "reexport_count"])
    return out.withColumn("reexport_ratio", F.when(F.col("export_count") > 0, F.col("reexport_count") / F.greatest("export_count", F.lit(1))).otherwise(0.0))


def barrels(modules: DataFrame, exports: DataFrame, ratio: float = 0.8, max_own: int = 2) -> DataFrame:
    """Modules that mostly re-export: at least one export, ``ratio`` of them re-exports, at most ``max_own`` declarations."""
    found = export_shapes(modules, exports).where((F.col("export_count") > 0) & (F.col("reexport_ratio") >= ratio) & (F.col("own_decls") <= max_own))
    kind = F.when(F.col("own_decls") == 0, "pure").otherwise("mixed")
    return found.select("path", kind.alias("kind"), "export_count", "reexport_count", F.col("own_decls").cast("long").alias("own_decl_count"), "has_side_effects", "reexport_ratio")


def import_sites(imports: DataFrame, hubs: DataFrame, types: bool = False) -> DataFrame:
    """Import statements that target a barrel: (module, ord, target, kind, side_effects); type-only and self-imports left out."""
    hub = hubs.select(F.col("path").alias("target"), F.col("has_side_effects").alias("side_effects"))
    sites = imports.where("module != target").where("true" if types else "not type_only")
    return sites.select("module", "ord", "target", "kind").join(hub, "target").select("module", "ord", "target", "kind", "side_effects")


def site_symbols(sites: DataFrame, bindings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per binding of a site with its verdict, definition and skip reason (null: can be rewritten)."""
    named = sites.join(bindings, ["module", "ord"])
    v = verdicts.select(F.col("module").alias("target"), F.col("name").alias("imported"), "verdict", "def_module", "def_name")
    out = named.join(v, ["target", "imported"], "left")
    verdict = F.when(F.col("imported") == "*", "namespaceImport").otherwise(F.col("verdict"))
    skip = F.when(verdict != "definition", verdict).when(F.col("side_effects"), "barrelHasSideEffects")
    return out.withColumn("skip", skip)


def site_costs(sites: DataFrame, symbols: DataFrame, links: DataFrame) -> DataFrame:
    """Each site with actual and minimal cost, excess, amplification, rewritable and skipped symbols, fully_rewritable.

    actual is what the barrel reaches and one more. minimal counts the union of what the definitions reach and the
    definitions; whatever cannot be traced adds the barrel itself, external symbols add nothing.
    """
    need = symbols.select("module", "ord", F.when(F.col("verdict") == "definition", F.col("def_module")).when(F.col("verdict") == "external", F.lit(None)).otherwise(F.col("target")).alias("root"), F.col("skip").isNull().alias("free"))
    # sites that need the same set of modules share one cost
    per = need.groupBy("module", "ord").agg(F.array_sort(F.collect_set("root")).alias("roots"), F.count_if("free").alias("rewritable"), F.count_if(~F.col("free")).alias("skipped"))
    out = sites.join(per, ["module", "ord"], "left").withColumn("roots", F.coalesce("roots", F.array("target"))).na.fill(0, ["rewritable", "skipped"])
    out = cut(out.withColumn("set_id", F.xxhash64("roots")))
    starts = out.select(F.col("target").alias("src")).unionByName(out.select(F.explode("roots").alias("src"))).distinct()
    links = graph.led_to(links, starts)
    minimal = graph.union_sizes(links, out.select("set_id", "roots").where(F.size("roots") > 0).distinct()).withColumnRenamed("n", "minimal_cost")
    actual = graph.closure_sizes(links, sites.select(F.col("target").alias("src"))).select(F.col("src").alias("target"), (F.col("n") + 1).alias("actual_cost"))
    out = out.join(actual, "target").join(minimal, "set_id", "left").na.fill(0, ["minimal_cost"])
    out = out.withColumn("excess", F.greatest(F.col("actual_cost") - F.col("minimal_cost"), F.lit(0).cast("long")))
    out = out.withColumn("amplification", F.col("actual_cost") / F.greatest(F.col("minimal_cost"), F.lit(1)))
    out = out.withColumn("fully_rewritable", (F.col("rewritable") > 0) & (F.col("skipped") == 0))
    return out.drop("roots", "set_id", "side_effects")


def barrel_amplification(costs: DataFrame) -> DataFrame:
    """Per imported barrel: sites, cost, worst and total excess, worst amplification, symbol counts; ordered by total excess."""
    per = costs.groupBy(F.col("target").alias("barrel")).agg(
        F.count("*").alias("site_count"),
        F.max("actual_cost").alias("actual_cost"),
        F.max("excess").alias("max_excess"),
        F.sum("excess").alias("total_excess"),
        F.round(F.max("amplification"), 6).alias("max_amplification"),
        F.sum("rewritable").alias("rewritable_symbols"),
        F.sum("skipped").alias("skipped_symbols"),
    )
    return per.orderBy(F.desc("total_excess"), F.split("barrel", "/"))


def skip_counts(symbols: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, SKIPS)), F.col("reason"))
    return symbols.where("skip is not null").groupBy(F.col("skip").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), rank)


def entrypoint_projection(links: DataFrame, costs: DataFrame, symbols: DataFrame, entrypoints: DataFrame, modules: DataFrame) -> DataFrame:
    """What each entrypoint (path) reaches before and after fully rewritable sites import definitions directly.

    before counts the reached modules and one more, after the reached modules and the entrypoint. A redirect replaces
    every edge between its importer and barrel, by definitions that the barrel reaches.
    """
    full = costs.where("fully_rewritable").select("module", "ord", F.col("target").alias("barrel"))
    redirects = full.select(F.col("module").alias("src"), F.col("barrel").alias("dst")).distinct()
    starts = entrypoints.join(modules, "path", "left_semi").select(F.col("path").alias("src"))
    direct = graph.reachable(links, full.join(symbols.select("module", "ord", "def_module"), ["module", "ord"]), "barrel", "def_module")
    changed = links.join(redirects, ["src", "dst"], "left_anti").unionByName(direct.select(F.col("module").alias("src"), F.col("def_module").alias("dst"))).distinct()
    before = graph.closure_sizes(links, starts).select(F.col("src").alias("entrypoint"), (F.col("n") + 1).alias("before"))
    alone = starts.distinct().select(F.col("src").alias("set_id"), F.array("src").alias("roots"))
    after = graph.union_sizes(cut(changed), alone).select(F.col("set_id").alias("entrypoint"), F.col("n").alias("after"))
    out = before.join(after, "entrypoint")
    return out.withColumn("removed", F.greatest(F.col("before") - F.col("after"), F.lit(0).cast("long")))


def cycles(scc: DataFrame) -> DataFrame:
    """Per cycle: its smallest member, members in order, size; largest first."""
    rows = scc.groupBy("scc").agg(F.array_sort(F.collect_list("node")).alias("members"), F.count("*").alias("size"))
    return rows.orderBy(F.desc("size"), "members")


def shortest_cycles(links: DataFrame, scc: DataFrame) -> DataFrame:
    """(scc, length, path): the lexicographically least shortest closed path through each cycle's smallest member."""
    shared = graph.share(links)
    if shared is None:
        links = inside_cycles(links, scc).select("src", "dst")
        shared = graph.share(links)
    if shared is None:
        return join_shortest_cycles(links, scc)

    def run(batches):
        adjacency = shared.value
        begin, to = adjacency.links
        names = adjacency.names
        for batch in batches:
            roots, paths = [], []
            for root in adjacency.numbers(batch.column("scc").cast(pa.large_string())).tolist():
                # numbers follow names, so the first path to a node in breadth-first order is the least of the shortest
                came, wave = {}, [root]
                while root not in came:
                    ahead = []
                    for v in wave:
                        for w in to[begin[v] : begin[v + 1]].tolist():
                            if w not in came:
                                came[w] = v
                                ahead.append(w)
                    wave = ahead
                path = [root, came[root]]
                while path[-1] != root:
                    path.append(came[path[-1]])
                roots.append(root)
                paths.append(names.take(pa.array(path[::-1])).to_pylist())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(roots, pa.int64())).cast(pa.string()), pa.array([len(p) - 1 for p in paths], pa.int64()), pa.array(paths, pa.list_(pa.string()))], ["scc", "length", "path"])

    return scc.select("scc").distinct().mapInArrow(run, "scc string, length long, path array<string>")


def inside_cycles(links: DataFrame, scc: DataFrame) -> DataFrame:
    """The links (src, dst, scc) within components."""
    ends = links.join(scc.select(F.col("node").alias("src"), "scc"), "src").join(scc.select(F.col("node").alias("dst"), F.col("scc").alias("other")), "dst")
    return cut(ends.where("scc = other").select("src", "dst", "scc"))


def join_shortest_cycles(links: DataFrame, scc: DataFrame) -> DataFrame:
    """The same by joins: paths grow by one edge a round inside their component; of those that end in one node the least is kept."""
    inside = inside_cycles(links, scc)
    wave = cut(inside.where("src = scc").select("scc", F.col("dst").alias("at"), F.array("src", "dst").alias("path")))
    seen, done = None, None
    while wave.limit(1).count():
        closed = wave.where("at = scc").groupBy("scc").agg(F.min("path").alias("path"))
        done = closed if done is None else done.unionByName(closed)
        done = cut(done)
        seen = wave.select("scc", "at") if seen is None else seen.unionByName(wave.select("scc", "at"))
        ahead = wave.join(done, "scc", "left_anti").join(inside.select("scc", F.col("src").alias("at"), "dst"), ["scc", "at"])
        ahead = ahead.groupBy("scc", F.col("dst").alias("at")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        wave = cut(ahead.join(seen, ["scc", "at"], "left_anti"))
    if done is None:
        done = wave.select("scc", "path")
    return done.select("scc", (F.size("path") - 1).cast("long").alias("length"), "path")


def fan(links: DataFrame, direction: str, limit: int | None = None) -> DataFrame:
    """Modules with direct and transitive fan (``in`` or ``out``), most transitive first, none that have neither."""
    end = "src" if direction == "out" else "dst"
    direct = links.groupBy(F.col(end).alias("path")).agg(F.count("*").alias("direct"))
    transitive = graph.closure_sizes(links, links.select(F.col(end).alias("src")), back=direction == "in").select(F.col("src").alias("path"), F.col("n").alias("transitive"))
    out = direct.join(transitive, "path", "full_outer").na.fill(0, ["direct", "transitive"]).where("direct > 0 or transitive > 0")
    out = out.orderBy(F.desc("transitive"), F.desc("direct"), F.split("path", "/"))
    return out if limit is None else out.limit(limit)


def definitions(resolved: DataFrame) -> DataFrame:
    """Distinct definitions that exported names lead to."""
    return resolved.where("verdict = 'definition'").select(F.col("def_module").alias("module"), F.col("def_name").alias("name")).distinct()


def used_definitions(bindings: DataFrame, imports: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Distinct definitions that import bindings lead to."""
    named = bindings.where("imported != '*'").join(imports.select("module", "ord", "target"), ["module", "ord"])
    v = verdicts.where("verdict = 'definition'").select(F.col("module").alias("target"), F.col("name").alias("imported"), "def_module", "def_name")
    return named.join(v, ["target", "imported"]).select(F.col("def_module").alias("module"), F.col("def_name").alias("name")).distinct()


def uncertain_roots(imports: DataFrame, bindings: DataFrame, exports: DataFrame) -> DataFrame:
    """Modules (src) whose exports may be used in ways that cannot be traced: namespace, dynamic and bare imports by ``*``, and stars."""
    whole = bindings.where("imported = '*'").select("module", "ord").distinct()
    seeds = imports.join(whole, ["module", "ord"], "left_semi").select(F.col("target").alias("src"))
    dynamic = imports.where("kind = 'dynamic'").select(F.col("target").alias("src"))
    stars = exports.where("kind = 'star'").select(F.col("src"))
    return seeds.unionByName(dynamic).unionByName(stars).where(~F.startswith("src", F.lit("ext:"))).distinct()


def dead_exports(defined: DataFrame, used: DataFrame, entry_modules: DataFrame, public: DataFrame, uncertain: DataFrame) -> DataFrame:
    """Definitions that nothing refers to: (module, name, low_confidence). ``entry_modules``, ``public`` and ``uncertain`` hold paths."""
    out = defined.join(used, ["module", "name"], "left_anti")
    for known in (entry_modules, public):
        out = out.join(known.select(F.col("path").alias("module")), "module", "left_anti")
    flagged = uncertain.select(F.col("path").alias("module")).distinct().withColumn("flag", F.lit(True))
    return out.join(flagged, "module", "left").select("module", "name", F.coalesce("flag", F.lit(False)).alias("low_confidence")).orderBy(F.split("module", "/"), "name")


def with_closure(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct (path) of the roots (src) and all that they reach."""
    roots = cut(roots.select("src").distinct())
    return roots.select(F.col("src").alias("path")).unionByName(graph.reached(links, roots).select(F.col("dst").alias("path"))).distinct()
