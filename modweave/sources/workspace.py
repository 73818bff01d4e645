"""A source tree as tables: files, packages, modules, imports, bindings, exports, resolutions."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modweave.functions import paths
from modweave.functions.storage import cut
from modweave.operators import resolution
from modweave.sources.config import Config
from modweave.sources.scan import scan

_BINDING = "struct<local: string, imported: string, type_only: boolean>"
_IMPORT = f"struct<specifier: string, kind: string, type_only: boolean, start: int, end: int, bindings: array<{_BINDING}>>"
_EXPORT = "struct<kind: string, name: string, local: string, imported: string, src: string, type_only: boolean>"
FACTS = f"path string, imports array<{_IMPORT}>, exports array<{_EXPORT}>, own_decls int, has_side_effects boolean, errors array<string>"
LOCKFILES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb")


def without_comments(text: str) -> str:
    """JSON with comments and trailing commas as JSON."""
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or "", text)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", text)


def _json(text: str | None) -> dict:
    try:
        found = json.loads(without_comments(text or ""))
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def export_targets(value) -> list[str]:
    """All strings that begin with ``.`` in an exports map, under any condition."""
    if isinstance(value, str):
        return [value] if value.startswith(".") else []
    inner = value if isinstance(value, list) else value.values() if isinstance(value, dict) else []
    return [t for v in inner for t in export_targets(v)]


def read_manifests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_json(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("root"),
                pa.array([r.get("name") if isinstance(r.get("name"), str) else None for r in rows], pa.string()),
                pa.array([r.get("sideEffects") is False for r in rows]),
                pa.array(["workspaces" in r for r in rows]),
                pa.array([export_targets(r.get("exports")) for r in rows], pa.list_(pa.string())),
            ],
            ["root", "name", "side_effects_false", "workspaces", "targets"],
        )


# Conditions of an exports map that hold, and fields that name a package's main file, in order.
CONDITIONS = ("import", "module", "browser", "default")
MAIN_FIELDS = ("module", "browser", "main")


def condition_target(value, conditions: frozenset[str]) -> str | None:
    """The first target of an exports value whose conditions hold, in the order that the manifest writes them."""
    if isinstance(value, str):
        return value if value.startswith("./") else None
    if isinstance(value, dict):
        value = [v for k, v in value.items() if k in conditions]
    for v in value if isinstance(value, list) else []:
        found = condition_target(v, conditions)
        if found is not None:
            return found
    return None


def subpaths(manifest: dict, conditions: frozenset[str]) -> list[tuple[str, str]]:
    """(subpath, target) of a package: its exports map, or else its main files and everything below it."""
    exports = manifest.get("exports")
    if exports is None:
        mains = [manifest[f] for f in MAIN_FIELDS if isinstance(manifest.get(f), str)]
        return [*((".", m) for m in mains), (".", "index"), ("./*", "*")]
    if not isinstance(exports, dict) or not any(k.startswith(".") for k in exports):
        exports = {".": exports}
    found = [(sub, condition_target(value, conditions)) for sub, value in exports.items()]
    return [(sub, target) for sub, target in found if target is not None]


def _entries(conditions: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for directory, text in zip(batch.column("dir").to_pylist(), batch.column("text").to_pylist()):
                manifest = _json(text)
                name = manifest.get("name") if isinstance(manifest.get("name"), str) else None
                out += [(directory, name, sub, target, nth) for nth, (sub, target) in enumerate(subpaths(manifest, conditions))]
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["dir", "name", "sub", "target", "nth"])

    return run


def _beside(path: str, other: str) -> str | None:
    """The path that ``other`` means in the file ``path``; null outside the tree."""
    found = posixpath.normpath(posixpath.join(posixpath.dirname(path), other))
    return None if found.startswith("..") else found.lstrip("/")


_REFERENCE = 1000  # places from which on a configuration is referenced, not extended


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What configurations (root, place, path, text) extend or refer to: candidates (root, place, rank, path)."""
    for batch in batches:
        out = []
        for root, place, path, text in zip(*(batch.column(c).to_pylist() for c in ("root", "place", "path", "text"))):
            config = _json(text)
            extended = config.get("extends") or []
            extended = [extended] if isinstance(extended, str) else extended
            for k, name in enumerate(reversed([e for e in extended if isinstance(e, str)])):  # later ones win
                if name.startswith("."):
                    tried = [_beside(path, name), _beside(path, f"{name}.json"), _beside(path, f"{name}/tsconfig.json")]
                else:
                    up = posixpath.dirname(path).split("/")
                    above = ["/".join([*up[:n], "node_modules", name]).lstrip("/") for n in range(len(up), -1, -1)]
                    tried = [f"{a}{end}" for a in above for end in ("", ".json", "/tsconfig.json")]
                out += [(root, [*place, 1 + k], rank, t) for rank, t in enumerate(tried) if t]
            for k, other in enumerate(config.get("references") or []):
                if isinstance(other, dict) and isinstance(other.get("path"), str):
                    tried = [_beside(path, other["path"]), _beside(path, f"{other['path']}/tsconfig.json")]
                    out += [(root, [*place, _REFERENCE + k], rank, t) for rank, t in enumerate(tried) if t]
        kinds = (pa.string(), pa.list_(pa.int32()), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["root", "place", "rank", "path"])


def _alias_rules(table: pa.Table) -> pa.Table:
    """Rules (root, pattern, target, nth) of one package from its configurations (root, place, path, text), nearest first."""
    units: dict[tuple, dict] = {}
    for row in sorted(table.to_pylist(), key=lambda r: r["place"]):
        unit = tuple(row["place"][: max([0, *(i + 1 for i, k in enumerate(row["place"]) if k >= _REFERENCE)])])
        options = _json(row["text"]).get("compilerOptions")
        options, found = options if isinstance(options, dict) else {}, units.setdefault(unit, {})
        here = posixpath.dirname(row["path"])
        if "base" not in found and isinstance(options.get("baseUrl"), str):
            found["base"] = posixpath.join(here, options["baseUrl"])
        if "paths" not in found and isinstance(options.get("paths"), dict):
            found["paths"], found["here"] = options["paths"], here
    out = []
    for k, found in enumerate(units.values()):
        base = found.get("base", found.get("here"))
        for pattern, targets in found.get("paths", {}).items():
            out += [(pattern, posixpath.join(base, t), (k << 12) + nth) for nth, t in enumerate(targets if isinstance(targets, list) else []) if isinstance(t, str)]
        if "base" in found:
            out.append(("*", posixpath.join(base, "*"), 1 << 20))  # after the targets that paths gives to "*"
    kinds = (pa.string(), pa.string(), pa.int32())
    columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
    return pa.table([pa.array([table.column("root")[0].as_py()] * len(out), pa.string()), *columns], ["root", "pattern", "target", "nth"])


def _ignore_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of ignore files (dir, text) as rules (dir, nth, pattern, negated, only_dir)."""
    for batch in batches:
        out = []
        for directory, text in zip(batch.column("dir").to_pylist(), batch.column("text").to_pylist()):
            for nth, line in enumerate((text or "").splitlines()):
                line = line.rstrip()
                negated = line.startswith("!")
                body = line[negated:].removeprefix("\\").rstrip("/")
                if not body.strip("/") or line.startswith("#"):
                    continue
                anchored = "/" in body
                pattern = resolution.glob_pattern(body.lstrip("/"))[1:-1]
                out.append((directory, nth, ("^" if anchored else "^(?:.*/)?") + pattern + "$", negated, line.endswith("/")))
        kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["dir", "nth", "pattern", "negated", "only_dir"])


def _directory(path: str = "path"):
    return F.when(paths.directory_of(path) == ".", "").otherwise(paths.directory_of(path))


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for raw in batch.column("content").to_pylist():
            try:
                found.append(scan((raw or b"").decode("utf-8")))
            except UnicodeDecodeError as problem:
                facts = scan("")
                facts.errors.append(str(problem))
                found.append(facts)
        binding = pa.struct([("local", pa.string()), ("imported", pa.string()), ("type_only", pa.bool_())])
        one = pa.struct([("specifier", pa.string()), ("kind", pa.string()), ("type_only", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("bindings", pa.list_(binding))])
        export = pa.struct([("kind", pa.string()), ("name", pa.string()), ("local", pa.string()), ("imported", pa.string()), ("src", pa.string()), ("type_only", pa.bool_())])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("path"),
                pa.array([f.imports for f in found], pa.list_(one)),
                pa.array([f.exports for f in found], pa.list_(export)),
                pa.array([f.own_decls for f in found], pa.int32()),
                pa.array([f.has_side_effects for f in found]),
                pa.array([f.errors for f in found], pa.list_(pa.string())),
            ],
            ["path", "imports", "exports", "own_decls", "has_side_effects", "errors"],
        )


class Workspace:
    """Tables of a source tree; each is computed once, written to shared storage and read again by what follows."""

    def __init__(self, spark: SparkSession, everything: DataFrame, config: Config | None = None):
        self.spark, self.everything, self.config = spark, everything, config or Config()

    @classmethod
    def from_path(cls, spark: SparkSession, root: str, config: Config | None = None) -> Workspace:
        """All files below ``root``, hidden ones too, by paths relative to it."""
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        clean = F.regexp_replace("path", "^[a-z]+:/+", "/")
        top = "/" + re.sub("^[a-z]+:/+", "", root).strip("/") + "/"
        rows = raw.withColumn("__p", clean).select(F.substring("__p", len(top) + 1, 1 << 20).alias("path"), "content")
        return cls(spark, rows, config)

    @classmethod
    def from_files(cls, spark: SparkSession, files: dict[str, str], config: Config | None = None) -> Workspace:
        rows = [(p, bytearray(t.encode())) for p, t in files.items()]
        return cls(spark, spark.createDataFrame(rows, "path string, content binary"), config)

    @cached_property
    def files(self) -> DataFrame:
        """Files outside pruned and ignored directories that anything here reads, with content."""
        kept = resolution.prune(self.everything)
        written = kept.where(paths.file_name("path") == ".gitignore").select(_directory().alias("dir"), F.decode("content", "utf-8").alias("text"))
        rules = cut(written.mapInArrow(_ignore_rules, "dir string, nth int, pattern string, negated boolean, only_dir boolean"))
        if rules.limit(1).count():
            kept = kept.join(resolution.ignored(kept, rules), "path", "left_anti")
        name = paths.file_name("path")
        needed = name.isin(*LOCKFILES, ".gitignore", "pnpm-workspace.yaml", "pnpm-workspace.yml") | F.endswith(name, F.lit(".json"))
        return cut(kept.where(needed | resolution.wanted(self.config.include, self.config.exclude)))

    @cached_property
    def sources(self) -> DataFrame:
        plain = self.files.where(paths.file_name("path") != "package.json")
        return resolution.glob_filter(plain, self.config.include, self.config.exclude)

    @cached_property
    def packages(self) -> DataFrame:
        """(root, name, tsconfig, side_effects_false, public_entrypoints); the workspace's root is always one."""
        manifests = self.files.where(paths.file_name("path") == "package.json")
        directory = F.when(paths.directory_of("path") == ".", "").otherwise(paths.directory_of("path"))
        read = manifests.select(directory.alias("root"), F.decode("content", "utf-8").alias("text")).mapInArrow(read_manifests, "root string, name string, side_effects_false boolean, workspaces boolean, targets array<string>")
        top = self.spark.createDataFrame([("",)], "root string").join(read, "root", "left_anti")
        read = read.unionByName(top.select("root", F.lit(None).cast("string").alias("name"), F.lit(False).alias("side_effects_false"), F.lit(False).alias("workspaces"), F.expr("cast(array() as array<string>)").alias("targets")))
        read = cut(read)
        wanted = read.select("root", F.explode("targets").alias("target"))
        target = paths.normalize(F.concat(F.when(F.col("root") == "", "").otherwise(F.concat("root", F.lit("/"))), "target"))
        public = export_target_expand(wanted.select("root", target.alias("target")), self.sources.select("path"))
        public = public.groupBy("root").agg(F.array_sort(F.collect_set("path")).alias("public_entrypoints"))
        config = self.files.where(paths.file_name("path").isin("tsconfig.json", "jsconfig.json")).select(
            F.when(paths.directory_of("path") == ".", "").otherwise(paths.directory_of("path")).alias("dir"), F.col("path").alias("tsconfig")
        )
        near = read.select("root", F.explode(paths.ancestors("root")).alias("dir")).join(config, "dir").groupBy("root").agg(F.max_by("tsconfig", F.struct(F.length("dir"), F.endswith("tsconfig", F.lit("tsconfig.json")))).alias("tsconfig"))
        out = read.join(near, "root", "left").join(public, "root", "left")
        return cut(out.select("root", "name", "tsconfig", "side_effects_false", "workspaces", F.coalesce("public_entrypoints", F.expr("cast(array() as array<string>)")).alias("public_entrypoints")))

    @cached_property
    def kind(self) -> str:
        if self.files.where("path in ('pnpm-workspace.yaml', 'pnpm-workspace.yml')").limit(1).count():
            return "pnpm"
        return "npmWorkspaces" if self.packages.where("root = '' and workspaces").limit(1).count() else "single"

    @cached_property
    def facts(self) -> DataFrame:
        return cut(self.sources.select("path", "content").mapInArrow(_facts, FACTS))

    @cached_property
    def owners(self) -> DataFrame:
        """(path, root) of each module and the package that it belongs to."""
        return cut(resolution.owning_package(self.facts.select("path"), self.packages))

    @cached_property
    def modules(self) -> DataFrame:
        owned = self.owners.join(self.packages.select("root", "side_effects_false"), "root")
        return self.facts.select("path", "has_side_effects", "own_decls").join(owned.select("path", F.col("side_effects_false").alias("package_side_effects_free")), "path")

    @cached_property
    def failures(self) -> DataFrame:
        """(path, message, errors) of files with errors: the first one and all of them."""
        return self.facts.where(F.size("errors") > 0).select("path", F.element_at("errors", 1).alias("message"), "errors").orderBy(F.split("path", "/"))

    @cached_property
    def import_facts(self) -> DataFrame:
        """(module, ord, specifier, kind, type_only, start, end, bindings); type_only also where all bindings are."""
        rows = self.facts.select(F.col("path").alias("module"), F.posexplode("imports").alias("ord", "i")).select("module", F.col("ord").cast("long").alias("ord"), "i.*")
        return rows.withColumn("statement_type_only", F.col("type_only")).withColumn("type_only", type_only())

    @cached_property
    def specifiers(self) -> DataFrame:
        """Distinct (importer, specifier)."""
        both = self.import_facts.select(F.col("module").alias("importer"), "specifier").unionByName(self.facts.select(F.col("path").alias("importer"), F.explode("exports").alias("e")).where("e.src is not null").select("importer", F.col("e.src").alias("specifier")))
        return both.distinct()

    @cached_property
    def entries(self) -> DataFrame:
        """(dir, name, installed, sub, target, nth): what the subpaths of installed and of the workspace's packages lead to."""
        manifests = self.everything.where(paths.file_name("path") == "package.json")
        installed = F.contains("path", F.lit("node_modules/"))
        own = resolution.prune(manifests.where(~installed)).join(self.files.select("path"), "path", "left_semi")
        read = manifests.where(installed).unionByName(own).select(_directory().alias("dir"), F.decode("content", "utf-8").alias("text"))
        conditions = frozenset([*self.config.resolve.conditions, *CONDITIONS])
        rows = read.mapInArrow(_entries(conditions), "dir string, name string, sub string, target string, nth int")
        return cut(rows.withColumn("installed", F.contains("dir", F.lit("node_modules/"))))

    @cached_property
    def aliases(self) -> DataFrame:
        """(root, pattern, target, nth) of each package's nearest tsconfig and what it extends or refers to: paths below baseUrl,
        all targets of a pattern in order."""
        texts = self.everything.where(F.endswith("path", F.lit(".json"))).select("path", F.decode("content", "utf-8").alias("text"))
        wanted = self.packages.where("tsconfig is not null").select("root", F.expr("cast(array() as array<int>)").alias("place"), F.lit(0).alias("rank"), F.col("tsconfig").alias("path"))
        every = None
        while True:
            found = wanted.join(texts.select("path"), "path", "left_semi").groupBy("root", "place").agg(F.min_by("path", "rank").alias("path"))
            if every is not None:  # a configuration counts once, where it is nearest
                found = found.join(every.select("root", "path"), ["root", "path"], "left_anti").groupBy("root", "path").agg(F.min("place").alias("place"))
            new = cut(found.join(texts, "path").select("root", "place", "path", "text"))
            every = new if every is None else every.unionByName(new)
            if not new.limit(1).count():
                break
            wanted = new.mapInArrow(_wanted, "root string, place array<int>, rank int, path string")
        found = every.groupBy("root").applyInArrow(_alias_rules, "root string, pattern string, target string, nth int")  # a handful per package
        return cut(found.withColumn("target", paths.normalize("target")))

    @cached_property
    def resolutions(self) -> DataFrame:
        """(importer, specifier, kind, path, package)."""
        owned = self.owners.select(F.col("path").alias("importer"), "root")
        return cut(resolution.resolve(self.specifiers.join(owned, "importer"), self.everything.select("path"), self.aliases, self.entries))

    def _target(self):
        """What a resolution is called in the graph: the path, ``ext:<package>``, or null where it leads nowhere."""
        return F.when(F.col("r_kind") == "internal", F.col("r_path")).when(F.col("r_kind") == "external", F.concat(F.lit("ext:"), F.col("r_package"))).when(F.col("r_kind") == "builtin", F.concat(F.lit("ext:"), F.col("specifier")))

    def _resolved(self, rows: DataFrame, module: str = "module") -> DataFrame:
        r = self.resolutions.select(F.col("importer").alias(module), "specifier", F.col("kind").alias("r_kind"), F.col("path").alias("r_path"), F.col("package").alias("r_package"))
        return rows.join(r, [module, "specifier"], "left").withColumn("target", F.coalesce(self._target(), F.concat(F.lit("?"), F.col("specifier")))).drop("r_kind", "r_path", "r_package")

    @cached_property
    def imports(self) -> DataFrame:
        return cut(self._resolved(self.import_facts).select("module", "ord", "target", "kind", "type_only", "specifier", "start", "end", "statement_type_only"))

    @cached_property
    def bindings(self) -> DataFrame:
        rows = self.import_facts.select("module", "ord", F.posexplode("bindings").alias("bord", "b"))
        return cut(rows.select("module", "ord", F.col("bord").cast("long").alias("bord"), "b.imported", "b.local", "b.type_only"))

    @cached_property
    def exports(self) -> DataFrame:
        rows = self.facts.select(F.col("path").alias("module"), F.posexplode("exports").alias("ord", "e")).select("module", F.col("ord").cast("long").alias("ord"), "e.*")
        forward = self._resolved(rows.where("src is not null").withColumnRenamed("src", "specifier")).withColumn("src", F.col("target")).drop("target", "specifier")
        return cut(rows.where("src is null").unionByName(forward.select(*rows.columns)))

    @cached_property
    def locals(self) -> DataFrame:
        """(module, local, via, what): what a name that a module imports stands for; of several the last one counts."""
        rows = self.bindings.where("imported != '*'").join(self.imports.select("module", "ord", "target"), ["module", "ord"])
        last = F.max_by(F.struct("target", "imported"), F.struct("ord", "bord"))
        return rows.groupBy("module", "local").agg(last.alias("x")).select("module", "local", F.col("x.target").alias("via"), F.col("x.imported").alias("what"))

    @cached_property
    def unresolved(self) -> DataFrame:
        """(importer, specifier, start) by importer and place; re-export-only specifiers stand at 0."""
        at = self.import_facts.groupBy(F.col("module").alias("importer"), "specifier").agg(F.min("start").alias("start"))
        rows = self.resolutions.where("kind = 'unresolved'").select("importer", "specifier").join(at, ["importer", "specifier"], "left").na.fill(0, ["start"])
        return rows.orderBy(F.split("importer", "/"), "start")

    @cached_property
    def external_packages(self) -> DataFrame:
        return self.resolutions.where("kind = 'external'").select("package").distinct().orderBy("package")

    @cached_property
    def fingerprint(self) -> str:
        """One hash of all files that a result depends on, in path order."""
        name = paths.file_name("path")
        used = self.files.where(name.isin("package.json", *LOCKFILES) | name.rlike(r"^(ts|js)config.*\.json$") | F.col("path").isin(".gitignore")).select("path", "content").unionByName(self.sources.select("path", "content"))
        per = used.distinct().select(F.sha2(F.concat(F.encode("path", "utf-8"), F.lit(b"\0"), "content"), 256).alias("h"))
        # addition forgets order, so nothing is sorted or gathered
        parts = [F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
        row = per.agg(F.count("*"), *parts).first()
        return "-".join(str(v) for v in (*row, hash_of(self.config)))


def hash_of(config: Config) -> str:
    import dataclasses
    import hashlib

    return hashlib.sha256(json.dumps(dataclasses.asdict(config), sort_keys=True).encode()).hexdigest()[:16]


def type_only():
    return F.col("type_only") | ((F.size("bindings") > 0) & F.forall("bindings", lambda b: b["type_only"]))


def export_target_expand(targets: DataFrame, files: DataFrame) -> DataFrame:
    """(root, path): files that export targets (root, target) name; ``*`` stands for all below the directory before it."""
    star = F.contains("target", F.lit("*"))
    head = F.substring_index("target", "*", 1)
    whole = targets.where(star & F.endswith(head, F.lit("/"))).select("root", F.regexp_replace(head, "/$", "").alias("dir"))
    below = files.select("path", F.explode(paths.ancestors("path")).alias("dir")).join(whole, "dir").select("root", "path")
    exact = resolution.probe(targets.where(~star), files, "target").where("path is not null").select("root", "path")
    return exact.unionByName(below).distinct()
