"""Queries of discovery, extraction and resolution, over paths and statements that the tables spell out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modweave.functions import paths
from modweave.operators import resolution, symbols
from modweave.plans.model import Model
from modweave.plans.queries import query
from modweave.sources.workspace import FACTS, _facts, export_target_expand, type_only

_PATHS = """'src/' || lower(p_brand) || CASE p_size % 5 WHEN 0 THEN '/node_modules' WHEN 1 THEN '/dist' ELSE '/lib' END || '/f' || cast(p_partkey AS STRING)
  || CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.js' ELSE '.md' END"""
_TREE = f"(SELECT p_partkey, {_PATHS} AS path FROM part)"


def _tree(m: Model) -> DataFrame:
    """One path for each part."""
    return m.table("part").select("p_partkey", F.expr(_PATHS).alias("path"))


@query("path_prune", f"--raw\nSELECT path FROM {_TREE} WHERE path NOT LIKE '%/node_modules/%' AND path NOT LIKE '%/dist/%'")
def _(m):
    return resolution.prune(_tree(m)).select("path")


@query("glob_filter", f"--raw\nSELECT path FROM {_TREE} WHERE regexp_matches(path, '^src/.*[.](ts|js)$') AND path NOT LIKE '%/f1%'")
def _(m):
    return resolution.glob_filter(_tree(m), ["src/**/*.{ts,js}"], ["**/f1*"]).select("path")


@query("path_normalize", "--raw\nSELECT p_partkey, 'a/' || p_brand || '/' || CAST(p_partkey AS VARCHAR) AS path FROM part")
def _(m):
    messy = F.concat(F.lit("//?/a\\.//x/../"), "p_brand", F.lit("/./y/z/../../"), F.col("p_partkey").cast("string"), F.lit("/"))
    return m.table("part").select("p_partkey", paths.normalize(messy).alias("path"))


@query(
    "longest_prefix_join",
    f"--raw\nSELECT path, CASE WHEN path LIKE 'src/brand#1/lib/%' THEN 'src/brand#1/lib' WHEN path LIKE 'src/brand#1/%' THEN 'src/brand#1' WHEN path LIKE 'src/brand#2/%' THEN 'src/brand#2' ELSE '' END AS root FROM {_TREE}",
)
def _(m):
    packages = m.spark.createDataFrame([("",), ("src/brand#1",), ("src/brand#1/lib",), ("src/brand#2",), ("src/bran",)], "root string")
    return resolution.owning_package(_tree(m).select("path"), packages)


@query("export_target_expand", f"--raw\nSELECT DISTINCT path FROM {_TREE} WHERE path LIKE 'src/brand#3/lib/%' OR path LIKE 'src/brand#4/lib/%.ts'")
def _(m):
    tree = _tree(m).select("path")
    exact = tree.where("path like 'src/brand#4/lib/%.ts'").select(F.lit("b").alias("root"), F.regexp_replace("path", r"\.ts$", ".js").alias("target"))
    targets = exact.unionByName(m.spark.createDataFrame([("a", "src/brand#3/lib/*"), ("a", "src/brand#3/lib/f-*")], "root string, target string"))
    return export_target_expand(targets, tree).select("path").distinct()


_HASH = "sha256(CASE WHEN text IS NULL THEN 'none' ELSE 'text' || text END)"


@query("content_fingerprint", f"--raw\nSELECT lang, count(*) AS n, CAST(sum(CAST('0x' || substring({_HASH}, 1, 14) AS BIGINT)) AS VARCHAR) AS first, CAST(sum(CAST('0x' || substring({_HASH}, 15, 14) AS BIGINT)) AS VARCHAR) AS second FROM documents GROUP BY lang")
def _(m):
    h = F.sha2(F.when(F.col("text").isNull(), "none").otherwise(F.concat(F.lit("text"), "text")), 256)
    part = lambda at: F.sum(F.conv(F.substring(h, at, 14), 16, 10).cast("decimal(38,0)")).cast("string")  # noqa: E731  addition forgets order, so nothing is gathered
    return m.table("documents").groupBy("lang").agg(F.count("*").alias("n"), part(1).alias("first"), part(15).alias("second"))


@query("type_only_imports", "SELECT module, ord FROM imports WHERE type_only")
def _(m):
    names = m.bindings.groupBy("module", "ord").agg(F.collect_list(F.struct("bord", "imported", F.lit(False).alias("type_only"))).alias("bindings"))
    none = F.expr("cast(array() as array<struct<bord: bigint, imported: string, type_only: boolean>>)")
    return m.imports.join(names, ["module", "ord"], "left").withColumn("bindings", F.coalesce("bindings", none)).where(type_only()).select("module", "ord")


@query("distinct_specifiers", "SELECT module, specifier, min(ord) AS first FROM (SELECT module, target AS specifier, ord FROM imports UNION ALL SELECT module, src, 1000000 + ord FROM exports WHERE src IS NOT NULL) GROUP BY 1, 2")
def _(m):
    again = m.exports.where("src is not null").select("module", F.col("src").alias("specifier"), (F.col("ord") + 1000000).alias("ord"))
    return m.imports.select("module", F.col("target").alias("specifier"), "ord").unionByName(again).groupBy("module", "specifier").agg(F.min("ord").alias("first"))


_STATEMENTS = """statements AS (SELECT p_partkey, CASE p_partkey % 5
  WHEN 0 THEN 'import { a' || cast(p_partkey AS STRING) || ' as b } from "./m' || cast(p_size AS STRING) || '";'
  WHEN 1 THEN 'import type D from "./t"' WHEN 2 THEN 'import * as n from "x"; // import y from "y"'
  WHEN 3 THEN 'import "./side"' ELSE 'export * from "./s' || cast(p_size AS STRING) || '"; export { q as r } from "./q"; export const z = 1' END AS source FROM part)"""


def _scanned(m: Model) -> DataFrame:
    sources = m.spark.sql(f"WITH part AS (SELECT * FROM parquet.`{m.sf_dir}/part.parquet`), {_STATEMENTS} SELECT * FROM statements")
    return sources.select(F.col("p_partkey").cast("string").alias("path"), F.encode("source", "utf-8").alias("content")).mapInArrow(_facts, FACTS)


@query(
    "import_extract",
    """--raw
SELECT CAST(p_partkey AS VARCHAR) AS path, CASE p_partkey % 5 WHEN 0 THEN './m' || CAST(p_size AS VARCHAR) WHEN 1 THEN './t' WHEN 2 THEN 'x' ELSE './side' END AS specifier,
CASE p_partkey % 5 WHEN 0 THEN 'named' WHEN 1 THEN 'default' WHEN 2 THEN 'namespace' ELSE 'sideEffect' END AS kind, p_partkey % 5 = 1 AS type_only,
CASE p_partkey % 5 WHEN 0 THEN 'a' || CAST(p_partkey AS VARCHAR) || '>b' WHEN 1 THEN 'default>D' WHEN 2 THEN '*>n' ELSE '' END AS names FROM part WHERE p_partkey % 5 < 4""",
)
def _(m):
    rows = _scanned(m).select("path", F.explode("imports").alias("i"))
    names = F.array_join(F.transform("i.bindings", lambda b: F.concat(b["imported"], F.lit(">"), b["local"])), ",")
    return rows.select("path", "i.specifier", "i.kind", "i.type_only", names.alias("names"))


@query(
    "export_extract",
    "--raw\nSELECT CAST(p_partkey AS VARCHAR) AS path, kind, name, CASE kind WHEN 'star' THEN './s' || CAST(p_size AS VARCHAR) WHEN 'named' THEN './q' END AS src FROM part, (VALUES ('star', NULL), ('named', 'r'), ('local', 'z')) t(kind, name) WHERE p_partkey % 5 = 4",
)
def _(m):
    return _scanned(m).select("path", F.explode("exports").alias("e")).select("path", "e.kind", "e.name", "e.src")


_REQUESTS = f"""requests AS (SELECT p_partkey, path AS importer, CASE p_partkey % 7 WHEN 0 THEN './f' || cast(p_partkey AS STRING) WHEN 1 THEN 'fs' WHEN 2 THEN 'node:anything' WHEN 3 THEN '@scope/pkg/deep' WHEN 4 THEN './gone'
  WHEN 5 THEN '@lib/' || substring(regexp_replace(path, '[.][a-z]+$', ''), 5) ELSE 'fs/promises' END AS specifier FROM {_TREE})"""


def _requests(m: Model) -> DataFrame:
    return m.spark.sql(f"WITH part AS (SELECT * FROM parquet.`{m.sf_dir}/part.parquet`), {_REQUESTS} SELECT importer, specifier FROM requests")


@query("builtin_semi_join", f"--raw\nWITH {_REQUESTS} SELECT importer, specifier FROM requests WHERE specifier IN ('fs', 'node:anything')")
def _(m):
    return _requests(m).where(resolution.is_builtin())


@query("extension_probe", f"--raw\nSELECT regexp_replace(path, '[.][a-z]+$', '') AS base, CASE WHEN path NOT LIKE '%.md' THEN path END AS path FROM {_TREE}")
def _(m):
    tree = _tree(m).select("path")
    return resolution.probe(tree.select(F.regexp_replace("path", r"\.[a-z]+$", "").alias("base")), tree).select("base", "path")


@query("alias_pattern_join", f"--raw\nWITH {_REQUESTS} SELECT importer, specifier, CASE WHEN specifier = 'fs' THEN 'src/one' WHEN specifier LIKE '@lib/%' THEN 'src/' || substring(specifier, 6) ELSE 'other/' || substring(specifier, 2) END AS base FROM requests WHERE specifier LIKE '@%' OR specifier = 'fs'")
def _(m):
    aliases = m.spark.createDataFrame([("@lib/*", "src/*"), ("@*", "other/*"), ("fs", "src/one")], "pattern string, target string")
    return resolution.alias_bases(_requests(m), aliases)


def _resolved(m: Model) -> DataFrame:
    aliases = m.spark.createDataFrame([("@lib/*", "src/*")], "pattern string, target string")
    installed = m.spark.createDataFrame([("node_modules/@scope/pkg/package.json",)], "path string")
    return resolution.resolve(_requests(m), _tree(m).select("path").unionByName(installed), aliases)


_RESOLVED = f"""--raw
WITH {_REQUESTS}, done AS (SELECT importer, specifier, CASE WHEN p_partkey % 7 IN (1, 2) THEN 'builtin' WHEN p_partkey % 7 = 3 THEN 'external' WHEN p_partkey % 7 IN (4, 6) OR importer LIKE '%.md' THEN 'unresolved'
  WHEN importer LIKE '%node_modules/%' THEN 'external' ELSE 'internal' END AS kind FROM requests)
"""


@query("specifier_resolution", _RESOLVED + "SELECT importer, specifier, kind FROM done")
def _(m):
    return _resolved(m).select("importer", "specifier", "kind")


@query("unresolved_anti_join", _RESOLVED + "SELECT importer, specifier FROM done WHERE kind = 'unresolved'")
def _(m):
    return _requests(m).distinct().join(_resolved(m).where("kind != 'unresolved'"), ["importer", "specifier"], "left_anti").select("importer", "specifier")


@query("external_packages", "SELECT DISTINCT substring(src, 5) AS package FROM exports WHERE src LIKE 'ext:%'")
def _(m):
    return m.exports.where("src like 'ext:%'").select(symbols.package_of("src").alias("package")).distinct().orderBy("package")


@query(
    "classify_path",
    f"--raw\nSELECT path, CASE WHEN path LIKE '%/node_modules/%' THEN 'external' WHEN path LIKE 'src/%' THEN 'internal' ELSE 'external' END AS kind, CASE WHEN path LIKE '%/node_modules/%' THEN regexp_extract(path, 'node_modules/([^/]+)', 1) END AS package FROM {_TREE}",
)
def _(m):
    return _tree(m).select("path", resolution.classify("path", "src/").alias("kind"), resolution.package_name().alias("package"))
