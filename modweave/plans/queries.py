"""The queries of the module-graph engine over the encoded tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modweave.functions import paths
from modweave.operators import analyses, graph, report, resolution, rewrite, symbols
from modweave.plans.encode import ENCODING
from modweave.plans.model import Model, model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_GRAPH = """
refs AS (
  SELECT module AS src, target AS dst, CASE WHEN type_only THEN 'typeOnly' WHEN kind = 'dynamic' THEN 'dynamic' WHEN kind = 'sideEffect' THEN 'sideEffectOnly' ELSE 'static' END AS kind FROM imports
  UNION ALL SELECT module, src, CASE WHEN kind = 'named' AND type_only THEN 'typeOnly' ELSE 'reExport' END FROM exports WHERE src IS NOT NULL),
edges AS (SELECT DISTINCT src, dst, kind FROM refs WHERE dst NOT LIKE 'ext:%'),
rt AS (SELECT DISTINCT src, dst FROM edges WHERE kind <> 'typeOnly'),
tt AS (SELECT DISTINCT src, dst FROM edges),
reach AS (SELECT src, dst FROM rt UNION SELECT reach.src, rt.dst FROM reach JOIN rt ON reach.dst = rt.src),
treach AS (SELECT src, dst FROM tt UNION SELECT treach.src, tt.dst FROM treach JOIN tt ON treach.dst = tt.src),
shapes AS (SELECT path, any_value(has_side_effects) AS fx, any_value(own_decls) AS own, count(e.module) AS n, count(*) FILTER (WHERE e.kind IN ('named', 'star') AND e.src IS NOT NULL) AS re FROM modules LEFT JOIN exports e ON e.module = path GROUP BY path),
barrels AS (SELECT path, CASE WHEN own = 0 THEN 'pure' ELSE 'mixed' END AS kind, n AS export_count, re AS reexport_count, CAST(own AS BIGINT) AS own_decl_count, fx AS has_side_effects FROM shapes WHERE n > 0 AND re / n >= 0.8 AND own <= 2),
first_exp AS (SELECT module, name, arg_min(kind, ord) AS kind, arg_min(coalesce(local, name), ord) AS local, arg_min(coalesce(imported, ''), ord) AS imported, nullif(arg_min(coalesce(src, ''), ord), '') AS src FROM exports WHERE name IS NOT NULL GROUP BY 1, 2),
seeds AS (
  SELECT target AS rm, imported AS rn FROM imports JOIN bindings USING (module, ord) WHERE imported <> '*'
  UNION SELECT module, name FROM exports WHERE name IS NOT NULL),
walk AS (
  SELECT rm, rn, rm AS m, rn AS n, [rm || '~' || rn] AS seen, 'open' AS st, CAST(NULL AS VARCHAR) AS leaf FROM seeds
  UNION ALL
  SELECT rm, rn, m2, n2, list_append(seen, m2 || '~' || n2), CASE WHEN k = 'local' THEN 'definition' WHEN m2 LIKE 'ext:%' THEN 'external' WHEN list_contains(seen, m2 || '~' || n2) THEN 'cyclic' ELSE 'open' END,
    CASE WHEN k = 'local' THEN m2 || '~' || n2 WHEN m2 LIKE 'ext:%' THEN m2 END
  FROM (SELECT w.rm, w.rn, w.seen, e.kind AS k, CASE WHEN e.kind = 'local' THEN w.m ELSE coalesce(e.src, s.src) END AS m2, CASE WHEN e.kind = 'local' THEN e.local WHEN e.kind = 'named' THEN e.imported ELSE w.n END AS n2
    FROM walk w LEFT JOIN first_exp e ON e.module = w.m AND e.name = w.n LEFT JOIN exports s ON e.module IS NULL AND s.module = w.m AND s.kind = 'star'
    WHERE w.st = 'open' AND (e.module IS NOT NULL OR s.module IS NOT NULL))),
verdicts AS (
  SELECT rm AS module, rn AS name, CASE WHEN h > 1 THEN 'ambiguous' WHEN h = 1 THEN st WHEN c > 0 THEN 'cyclic' ELSE 'notFound' END AS verdict,
    CASE WHEN h = 1 AND st = 'definition' THEN split_part(leaf, '~', 1) END AS def_module, CASE WHEN h = 1 AND st = 'definition' THEN split_part(leaf, '~', 2) END AS def_name, CASE WHEN h = 1 AND st = 'external' THEN substring(leaf, 5) END AS package
  FROM (SELECT rm, rn, count(DISTINCT leaf) AS h, count(*) FILTER (WHERE st = 'cyclic') AS c, min(leaf) AS leaf, min(st) FILTER (WHERE leaf IS NOT NULL) AS st FROM walk GROUP BY rm, rn)),
sites AS (SELECT i.module, i.ord, i.target, i.kind, b.has_side_effects AS fx FROM imports i JOIN barrels b ON b.path = i.target WHERE i.module <> i.target AND NOT i.type_only),
syms AS (
  SELECT s.*, b.bord, b.imported, v.verdict, v.def_module, v.def_name, CASE WHEN b.imported = '*' THEN 'namespaceImport' WHEN v.verdict <> 'definition' THEN v.verdict WHEN s.fx THEN 'barrelHasSideEffects' END AS skip
  FROM sites s JOIN bindings b USING (module, ord) LEFT JOIN verdicts v ON v.module = s.target AND v.name = b.imported),
needs AS (
  SELECT module, ord, CASE WHEN verdict = 'definition' THEN def_module WHEN verdict = 'external' THEN NULL ELSE target END AS root FROM syms
  UNION SELECT module, ord, target FROM sites s WHERE NOT EXISTS (SELECT 1 FROM bindings b WHERE b.module = s.module AND b.ord = s.ord)),
minimal AS (SELECT module, ord, count(DISTINCT p) AS minimal_cost FROM (SELECT module, ord, root AS p FROM needs WHERE root IS NOT NULL UNION SELECT module, ord, dst FROM needs JOIN reach ON src = root) GROUP BY 1, 2),
tally AS (SELECT module, ord, count(*) FILTER (WHERE skip IS NULL) AS rewritable, count(skip) AS skipped FROM syms GROUP BY 1, 2),
reached AS (SELECT src, count(*) AS n FROM reach GROUP BY src),
costs0 AS (
  SELECT s.module, s.ord, s.target, s.kind, coalesce(r.n, 0) + 1 AS actual_cost, coalesce(m.minimal_cost, 0) AS minimal_cost, coalesce(t.rewritable, 0) AS rewritable, coalesce(t.skipped, 0) AS skipped
  FROM sites s LEFT JOIN reached r ON r.src = s.target LEFT JOIN minimal m ON m.module = s.module AND m.ord = s.ord LEFT JOIN tally t ON t.module = s.module AND t.ord = s.ord),
costs AS (SELECT *, greatest(actual_cost - minimal_cost, 0) AS excess, actual_cost / greatest(minimal_cost, 1) AS amplification, rewritable > 0 AND skipped = 0 AS fully_rewritable FROM costs0),
scc AS (SELECT a.src AS node, min(a.dst) AS scc FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
files AS (SELECT path, split_part(path, ':', 1) || '/' || CAST(CAST(split_part(path, ':', 2) AS BIGINT) % 10 AS VARCHAR) || '/' || split_part(path, ':', 2) || '/index' AS file FROM modules)
"""


def query(name: str, sql: str | None = None):
    """Register a query of a ``Model`` and its SQL over the encoded graph (raw SQL if it begins with WITH or names no graph table)."""

    def add(f: Callable[[Model], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(model(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql if sql.startswith("--raw") else f"WITH RECURSIVE {ENCODING}, {_GRAPH} {sql}"
        return f

    return add


# Graph


@query("build_edges", "SELECT src, dst, kind FROM edges")
def _(m):
    return m.edges


@query("edge_kinds", "SELECT kind, count(*) AS n FROM refs WHERE dst NOT LIKE 'ext:%' GROUP BY kind")
def _(m):
    return graph.references(m.imports, m.exports).groupBy("kind").agg(F.count("*").alias("n"))


@query("edge_kind_counts", "SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def _(m):
    return m.edges.groupBy("kind").agg(F.count("*").alias("n")).orderBy(graph.kind_rank())


@query("dangling_edges", "SELECT DISTINCT src, dst FROM edges WHERE dst LIKE 's:%0'")
def _(m):
    return graph.dangling_edges(m.modules.where("path not like 's:%0'"), m.imports, m.exports)


for _types, _name, _rel in ((False, "runtime_neighbors", "rt"), (True, "runtime_neighbors_with_types", "tt")):

    @query(_name, f"SELECT src, dst FROM {_rel}")
    def _(m, types=_types):
        return m.typed_links if types else m.links


@query("closure_from_roots", "SELECT 'c:' || CAST(i AS VARCHAR) AS path FROM range(5) t(i) UNION SELECT dst FROM reach WHERE src IN ('c:0', 'c:1', 'c:2', 'c:3', 'c:4')")
def _(m):
    return analyses.with_closure(m.links, m.modules.where("path in ('c:0', 'c:1', 'c:2', 'c:3', 'c:4')").select(F.col("path").alias("src")))


@query("scc", "SELECT node, scc FROM scc")
def _(m):
    return m.scc


@query("reach_forward", "SELECT src, dst FROM reach")
def _(m):
    return graph.closure(m.links, m.links.select("src"))


@query("reach_forward_with_types", "SELECT src, dst FROM treach")
def _(m):
    return graph.closure(m.typed_links, m.typed_links.select("src"))


@query("reach_reverse", "SELECT dst AS path, count(*) AS n FROM reach GROUP BY dst")
def _(m):
    return graph.closure_sizes(m.links, m.links.select(F.col("dst").alias("src")), back=True).select(F.col("src").alias("path"), "n")


@query("reach_union_count", "SELECT r AS region, count(DISTINCT p) AS n FROM (SELECT module AS r, src AS p FROM exports WHERE kind = 'star' UNION SELECT e.module, reach.dst FROM exports e JOIN reach ON reach.src = e.src WHERE e.kind = 'star') GROUP BY r")
def _(m):
    groups = m.exports.where("kind = 'star'").groupBy(F.col("module").alias("set_id")).agg(F.collect_set("src").alias("roots"))
    return graph.union_sizes(m.links, groups).withColumnRenamed("set_id", "region")


# Barrels and amplification


@query("barrels", "SELECT path, kind, export_count, reexport_count, own_decl_count, has_side_effects FROM barrels")
def _(m):
    return m.barrels.drop("reexport_ratio").orderBy(F.split("path", "/"))


@query("barrel_kind_counts", "SELECT kind, count(*) AS n FROM barrels GROUP BY kind")
def _(m):
    return m.barrels.groupBy("kind").agg(F.count("*").alias("n"))


@query("reexport_ratio", "SELECT path, round(CASE WHEN n = 0 THEN 0.0 ELSE re / n END, 6) AS reexport_ratio FROM shapes")
def _(m):
    return analyses.export_shapes(m.modules, m.exports).select("path", F.round("reexport_ratio", 6).alias("reexport_ratio"))


@query("symbol_resolution", "SELECT module, name, verdict, def_module, def_name, package FROM verdicts WHERE (module, name) IN (SELECT target, imported FROM imports JOIN bindings USING (module, ord))")
def _(m):
    return m.verdicts.drop("n_ends").join(m.import_seeds, ["module", "name"], "left_semi")


@query("resolution_kind_counts", "SELECT verdict, count(*) AS n FROM verdicts GROUP BY verdict")
def _(m):
    return m.verdicts.groupBy("verdict").agg(F.count("*").alias("n"))


@query("all_exports_resolved", "SELECT module, name, verdict, def_module, def_name FROM verdicts WHERE (module, name) IN (SELECT module, name FROM exports)")
def _(m):
    return m.verdicts.join(symbols.exported_names(m.exports), ["module", "name"], "left_semi").select("module", "name", "verdict", "def_module", "def_name")


@query("import_sites", "SELECT module, ord, target, kind FROM sites")
def _(m):
    return m.sites.drop("side_effects")


@query("site_costs", "SELECT module, ord, target, actual_cost, minimal_cost, excess, rewritable, skipped, fully_rewritable FROM costs")
def _(m):
    return m.costs.select("module", "ord", "target", "actual_cost", "minimal_cost", "excess", "rewritable", "skipped", "fully_rewritable")


@query("amplification_ratio", "SELECT module, ord, round(amplification, 6) AS amplification FROM costs")
def _(m):
    return m.costs.select("module", "ord", F.round("amplification", 6).alias("amplification"))


@query("worst_sites_topk", "SELECT module, ord, target, excess FROM costs ORDER BY excess DESC, string_split(module, '/'), ord LIMIT 20")
def _(m):
    return m.costs.orderBy(F.desc("excess"), F.split("module", "/"), "ord").limit(20).select("module", "ord", "target", "excess")


_PER_BARREL = "SELECT target AS barrel, count(*) AS site_count, max(actual_cost) AS actual_cost, max(excess) AS max_excess, CAST(sum(excess) AS BIGINT) AS total_excess, round(max(amplification), 6) AS max_amplification, CAST(sum(rewritable) AS BIGINT) AS rewritable_symbols, CAST(sum(skipped) AS BIGINT) AS skipped_symbols FROM costs GROUP BY target"


@query("barrel_amplification", _PER_BARREL)
def _(m):
    return analyses.barrel_amplification(m.costs)


@query("barrels_min_amplification", f"SELECT * FROM ({_PER_BARREL}) WHERE max_amplification >= 20")
def _(m):
    return analyses.barrel_amplification(m.costs).where("max_amplification >= 20")


@query("amplification_warnings", f"SELECT barrel, max_amplification FROM ({_PER_BARREL}) WHERE max_amplification > 5")
def _(m):
    return analyses.barrel_amplification(m.costs).where("max_amplification > 5").select("barrel", "max_amplification")


@query("skip_reason_counts", "SELECT skip AS reason, count(*) AS n FROM syms WHERE skip IS NOT NULL GROUP BY skip")
def _(m):
    return analyses.skip_counts(m.symbols)


_REWIRED = """, redir AS (SELECT DISTINCT module AS src, target AS dst FROM costs WHERE fully_rewritable),
rt2 AS (
  SELECT src, dst FROM rt WHERE (src, dst) NOT IN (SELECT src, dst FROM redir)
  UNION SELECT c.module, y.def_module FROM costs c JOIN syms y USING (module, ord) JOIN reach ON reach.src = c.target AND reach.dst = y.def_module WHERE c.fully_rewritable),
after AS (SELECT path AS src, path AS dst FROM modules WHERE path LIKE 'c:%' AND length(path) = 3 UNION SELECT after.src, rt2.dst FROM after JOIN rt2 ON after.dst = rt2.src)
SELECT entrypoint, b AS before, a AS after, greatest(b - a, 0) AS removed FROM (SELECT src AS entrypoint, count(*) AS a FROM after GROUP BY src) JOIN (SELECT path, count(dst) + 1 AS b FROM modules LEFT JOIN reach ON src = path GROUP BY path) ON path = entrypoint"""


@query("entrypoint_projection", _REWIRED)
def _(m):
    starts = m.modules.where("path like 'c:%' and length(path) = 3").select("path")
    return analyses.entrypoint_projection(m.links, m.costs, m.symbols, starts, m.modules)


# Cycles


@query("cycles", "SELECT scc, string_agg(node, ',' ORDER BY node) AS members, count(*) AS size FROM scc GROUP BY scc")
def _(m):
    return analyses.cycles(m.scc).select("scc", F.array_join("members", ",").alias("members"), "size")


@query("cycle_members", "SELECT scc, node FROM scc")
def _(m):
    return m.scc.select("scc", "node")


_SHORTEST = """, paths AS (
  SELECT s.scc, rt.dst AS cur, rt.src || '>' || rt.dst AS path, 1 AS len FROM scc s JOIN rt ON rt.src = s.scc JOIN scc t ON t.node = rt.dst AND t.scc = s.scc WHERE s.node = s.scc
  UNION SELECT p.scc, rt.dst, p.path || '>' || rt.dst, p.len + 1 FROM paths p JOIN rt ON rt.src = p.cur JOIN scc t ON t.node = rt.dst AND t.scc = p.scc WHERE p.cur <> p.scc AND p.len < 12)
SELECT scc, CAST(min(len) AS BIGINT) AS length FROM paths WHERE cur = scc GROUP BY scc"""


@query("shortest_cycle_length", _SHORTEST)
def _(m):
    return analyses.shortest_cycles(m.links, m.scc).select("scc", "length")


# Dead exports

_DEAD = """, defined AS (SELECT DISTINCT def_module AS module, def_name AS name FROM verdicts WHERE verdict = 'definition' AND (module, name) IN (SELECT module, name FROM exports WHERE name IS NOT NULL)),
used AS (SELECT DISTINCT def_module AS module, def_name AS name FROM imports i JOIN bindings b USING (module, ord) JOIN verdicts v ON v.module = i.target AND v.name = b.imported WHERE verdict = 'definition'),
public AS (SELECT path FROM modules WHERE path LIKE 's:%0' UNION SELECT dst FROM treach WHERE src LIKE 's:%0'),
unsure0 AS (SELECT target AS path FROM imports JOIN bindings USING (module, ord) WHERE imported = '*' UNION SELECT target FROM imports WHERE kind = 'dynamic' UNION SELECT src FROM exports WHERE kind = 'star'),
unsure AS (SELECT path FROM unsure0 UNION SELECT dst FROM treach WHERE src IN (SELECT path FROM unsure0)),
dead AS (SELECT module, name, module IN (SELECT path FROM unsure) AS low_confidence FROM defined WHERE (module, name) NOT IN (SELECT module, name FROM used) AND module NOT IN (SELECT path FROM public) AND module NOT IN ('p:1', 'p:2'))
"""


def _public(m: Model) -> DataFrame:
    return analyses.with_closure(m.typed_links, m.modules.where("path like 's:%0'").select(F.col("path").alias("src")))


def _dead(m: Model) -> DataFrame:
    defined = analyses.definitions(m.verdicts.join(symbols.exported_names(m.exports), ["module", "name"], "left_semi"))
    used = analyses.used_definitions(m.bindings, m.imports, m.verdicts)
    unsure = analyses.with_closure(m.typed_links, analyses.uncertain_roots(m.imports, m.bindings, m.exports))
    return analyses.dead_exports(defined, used, m.modules.where("path in ('p:1', 'p:2')").select("path"), _public(m), unsure)


@query("dead_exports", _DEAD + "SELECT module, name, low_confidence FROM dead")
def _(m):
    return _dead(m)


@query("low_confidence_exports", _DEAD + "SELECT module, name FROM dead WHERE low_confidence")
def _(m):
    return _dead(m).where("low_confidence").select("module", "name")


@query("used_definitions", _DEAD + "SELECT module, name FROM used")
def _(m):
    return analyses.used_definitions(m.bindings, m.imports, m.verdicts)


@query("public_api_closure", _DEAD + "SELECT path FROM public")
def _(m):
    return _public(m)


# Fan


def _fan_sql(links: str, reach: str, a: str, b: str) -> str:
    return f"SELECT path, coalesce(d, 0) AS direct, coalesce(t, 0) AS transitive FROM (SELECT {a} AS path, count(*) AS d FROM {links} GROUP BY 1) FULL JOIN (SELECT {a} AS path, count(*) AS t FROM {reach} GROUP BY 1) USING (path)"


for _types, _suffix, _l, _r in ((False, "", "rt", "reach"), (True, "_with_types", "tt", "treach")):
    for _way, _a, _b in (("out", "src", "dst"), ("in", "dst", "src")):

        @query(f"fan_{_way}{_suffix}", _fan_sql(_l, _r, _a, _b))
        def _(m, types=_types, way=_way):
            return analyses.fan(m.typed_links if types else m.links, way)


# Report


@query("module_ids", "SELECT 'm' || CAST(row_number() OVER (ORDER BY string_split(file, '/')) - 1 AS VARCHAR) AS id, path FROM files")
def _(m):
    return report.module_ids(m.files, "file").select("id", "path")


@query(
    "summary",
    """SELECT (SELECT count(*) FROM modules) AS modules, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM barrels) AS barrels, (SELECT count(*) FROM sites) AS sites, (SELECT CAST(sum(excess) AS BIGINT) FROM costs) AS total_excess,
(SELECT max(excess) FROM costs) AS worst_excess, (SELECT count(DISTINCT scc) FROM scc) AS cycles, (SELECT count(DISTINCT src) FROM exports WHERE src LIKE 'ext:%') AS externals""",
)
def _(m):
    one = lambda df, what, name: df.agg(what.alias(name))  # noqa: E731  scalars, one row each
    out = one(m.modules, F.count("*"), "modules")
    for df, what, name in (
        (m.edges, F.count("*"), "edges"),
        (m.barrels, F.count("*"), "barrels"),
        (m.sites, F.count("*"), "sites"),
        (m.costs, F.sum("excess"), "total_excess"),
        (m.costs, F.max("excess"), "worst_excess"),
        (m.scc, F.countDistinct("scc"), "cycles"),
        (m.exports.where("src like 'ext:%'"), F.countDistinct("src"), "externals"),
    ):
        out = out.crossJoin(one(df, what, name))
    return out


@query("module_report", "SELECT m.path, has_side_effects, m.path IN (SELECT path FROM barrels) AS is_barrel, m.path IN (SELECT node FROM scc) AS in_cycle FROM modules m")
def _(m):
    flag = lambda df, c, name: df.select(F.col(c).alias("path")).distinct().withColumn(name, F.lit(True))
    out = m.modules.join(flag(m.barrels, "path", "is_barrel"), "path", "left").join(flag(m.scc, "node", "in_cycle"), "path", "left")
    return out.select("path", "has_side_effects", F.coalesce("is_barrel", F.lit(False)).alias("is_barrel"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))


@query("edge_report", ", ids AS (SELECT 'm' || CAST(row_number() OVER (ORDER BY string_split(file, '/')) - 1 AS VARCHAR) AS id, path FROM files) SELECT a.id AS src, b.id AS dst, kind FROM edges JOIN ids a ON a.path = src JOIN ids b ON b.path = dst")
def _(m):
    ids = report.module_ids(m.files, "file").select("id", "path")
    a, b = ids.select(F.col("id").alias("a"), F.col("path").alias("src")), ids.select(F.col("id").alias("b"), F.col("path").alias("dst"))
    return m.edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "kind").orderBy("src", "dst", graph.kind_rank())


@query("directory_of", "SELECT file, regexp_replace(file, '/[^/]*$', '') AS directory FROM files")
def _(m):
    return m.files.select("file", paths.directory_of("file").alias("directory"))


@query("directory_prefix", "SELECT file, split_part(file, '/', 1) || '/' || split_part(file, '/', 2) AS prefix FROM files")
def _(m):
    return m.files.select("file", paths.directory_prefix("file", 2).alias("prefix"))


def _flagged(m: Model) -> DataFrame:
    rows = QUERIES["module_report"](m.spark, m.sf_dir).join(m.files.select("path", "file"), "path")
    return rows.select(F.col("file").alias("path"), "is_barrel", "in_cycle")


@query(
    "directory_rollup",
    "SELECT split_part(file, '/', 1) || '/' || split_part(file, '/', 2) AS directory, count(*) AS module_count, bool_or(path IN (SELECT path FROM barrels)) AS has_barrel, bool_or(path IN (SELECT node FROM scc)) AS has_cycle FROM files GROUP BY 1",
)
def _(m):
    rows = _flagged(m)
    return report.directory_rollup(rows, report.directory_level(rows, 60))


@query("collapsed_edges", "SELECT DISTINCT split_part(src, ':', 1) AS src, split_part(dst, ':', 1) AS dst, kind FROM edges WHERE split_part(src, ':', 1) <> split_part(dst, ':', 1)")
def _(m):
    a, b = m.files.select(F.col("path").alias("src"), F.col("file").alias("a")), m.files.select(F.col("path").alias("dst"), F.col("file").alias("b"))
    return report.collapsed_edges(m.edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "kind"), 1)


# Rewrite plan

_SKIPPED = """, skips AS (SELECT module, ord, CASE WHEN bool_or(fx) THEN 'barrelHasSideEffects' WHEN bool_or(imported = '*') THEN 'namespaceImport' ELSE arg_min(skip, bord) FILTER (WHERE skip IS NOT NULL) END AS reason FROM syms GROUP BY 1, 2),
stay AS (SELECT * FROM skips WHERE reason IS NOT NULL),
goals AS (SELECT module, ord, def_module, string_agg(def_name, ', ' ORDER BY bord) AS names FROM (SELECT module, ord, def_module, def_name, min(bord) AS bord FROM syms WHERE (module, ord) NOT IN (SELECT module, ord FROM stay) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
"""


@query("rewrite_skips", _SKIPPED + "SELECT reason, count(*) AS n FROM stay GROUP BY reason")
def _(m):
    return rewrite.skip_totals(rewrite.statement_skips(m.symbols))


@query("rewrite_targets", _SKIPPED + "SELECT module, ord, def_module, names FROM goals")
def _(m):
    return rewrite.targets(m.symbols, rewrite.statement_skips(m.symbols))


@query("rewrite_scope", "SELECT module, ord FROM sites WHERE regexp_matches(module, '^c:[0-9]*5$') AND target = 'n:3'")
def _(m):
    return rewrite.scope(m.sites, only="^c:[0-9]*5$", barrel="n:3").select("module", "ord")


_WHOLE = """, whole AS (SELECT module, ord, target FROM imports JOIN bindings USING (module, ord) WHERE imported = '*' UNION SELECT module, 99, def_module FROM syms WHERE verdict = 'definition' AND CAST(substring(module, 3) AS BIGINT) % 4 = 0)
SELECT DISTINCT y.module, y.ord FROM syms y JOIN whole w ON w.module = y.module AND w.target = y.def_module WHERE y.verdict = 'definition' AND w.ord <> y.ord"""


@query("merge_conflicts", _WHOLE)
def _(m):
    # every fourth importer has a definition module as a namespace, too
    more = m.symbols.where("verdict = 'definition' and cast(substring(module, 3) as bigint) % 4 = 0").select("module", F.lit(99).cast("long").alias("ord"), F.col("def_module").alias("target")).distinct()
    bindings = more.select("module", "ord", F.lit(0).cast("long").alias("bord"), F.lit("*").alias("imported"))
    return rewrite.merge_conflicts(m.symbols, m.imports.select("module", "ord", "target").unionByName(more), m.bindings.unionByName(bindings))


_RELATIVE = """CASE WHEN split_part(a.file, '/', 1) <> split_part(b.file, '/', 1) THEN '../../../' || b.file
WHEN split_part(a.file, '/', 2) <> split_part(b.file, '/', 2) THEN '../../' || substring(b.file, length(split_part(b.file, '/', 1)) + 2)
WHEN split_part(a.file, '/', 3) <> split_part(b.file, '/', 3) THEN '../' || split_part(b.file, '/', 3) || '/index' ELSE './index' END"""


def _specifiers(m: Model, pairs: DataFrame, src: str, dst: str) -> DataFrame:
    a, b = m.files.select(F.col("path").alias(src), F.col("file").alias("__a")), m.files.select(F.col("path").alias(dst), F.col("file").alias("__b"))
    return pairs.join(a, src).join(b, dst).withColumn("specifier", paths.relative_specifier("__a", "__b")).drop("__a", "__b")


@query("relative_specifier", f"SELECT src, dst, {_RELATIVE} AS specifier FROM rt JOIN files a ON a.path = src JOIN files b ON b.path = dst")
def _(m):
    return _specifiers(m, m.links, "src", "dst").select("src", "dst", "specifier")


@query("rewrite_plan", _SKIPPED + f", lines AS (SELECT g.module, g.ord, 'import {{ ' || names || ' }} from ''' || {_RELATIVE} || ''';' AS line FROM goals g JOIN files a ON a.path = g.module JOIN files b ON b.path = def_module) SELECT module, ord, string_agg(line, chr(10) ORDER BY line) AS statements FROM lines GROUP BY 1, 2")
def _(m):
    goals = _specifiers(m, rewrite.targets(m.symbols, rewrite.statement_skips(m.symbols)), "module", "def_module")
    line = F.concat(F.lit("import { "), "names", F.lit(" } from '"), "specifier", F.lit("';"))
    return goals.groupBy("module", "ord").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("statements"))


@query("import_style_vote", ", sp AS (SELECT module, ord, CASE WHEN CAST(substring(target, 3) AS BIGINT) % 3 = 0 THEN '@/' ELSE './' END || target AS specifier FROM imports) SELECT module, CASE WHEN r > n - r THEN 'relative' WHEN r < n - r THEN 'alias' WHEN f LIKE '.%' THEN 'relative' ELSE 'alias' END AS style FROM (SELECT module, count(*) AS n, count(*) FILTER (WHERE specifier LIKE '.%') AS r, arg_min(specifier, ord) AS f FROM sp GROUP BY module)")
def _(m):
    third = F.substring("target", 3, 20).cast("long") % 3 == 0
    return rewrite.style_vote(m.imports.select("module", "ord", F.concat(F.when(third, F.lit("@/")).otherwise(F.lit("./")), "target").alias("specifier")))
