"""Discovery filters and specifier resolution as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modweave.functions import paths

# Directories that discovery never enters.
PRUNED = ("node_modules", "dist", "build", ".next", ".turbo", ".output", "out", "coverage", ".nyc_output", ".git", ".modweave")
# Extensions of source files, and the order in which resolution tries them.
SOURCES = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")
PROBED = (*SOURCES, "json")
# Which files a written extension may stand for, in order.
ALIASES = {"js": ("ts", "tsx", "js"), "mjs": ("mts", "mjs"), "cjs": ("cts", "cjs")}
# Builtin modules of the runtime.
BUILTINS = (
    "assert", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "dns", "domain", "events", "fs", "http", "http2", "https", "inspector", "module", "net", "os", "path",
    "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "worker_threads", "zlib",
)


def prune(files: DataFrame, path: str = "path") -> DataFrame:
    """Files outside pruned directories."""
    inside = F.slice(paths.parts(path), 1, F.greatest(F.size(paths.parts(path)) - 1, F.lit(0)))
    return files.where(~F.arrays_overlap(inside, F.array(*map(F.lit, PRUNED))))


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ``**`` crosses directories, ``*`` and ``?`` do not, ``{a,b}`` are alternatives."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c in "*?":
            out += "[^/]*" if c == "*" else "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += "\\" + c if c in r"\.^$+()[]|{}" else c
        i += 1
    return f"^{out}$"


def wanted(include: list[str], exclude: list[str], path: str = "path"):
    """Whether an include glob matches (source files, if none is given) and no exclude glob."""
    globs = [glob_pattern(g) for g in include] or [rf"\.({'|'.join(SOURCES)})$"]
    out = F.col(path).rlike("|".join(globs))
    return out & ~F.col(path).rlike("|".join(map(glob_pattern, exclude))) if exclude else out


def glob_filter(files: DataFrame, include: list[str], exclude: list[str], path: str = "path") -> DataFrame:
    """Files that an include glob matches (source files, if none is given) and no exclude glob."""
    return files.where(wanted(include, exclude, path))


def owning_package(files: DataFrame, packages: DataFrame) -> DataFrame:
    """``files`` (path) with the longest package root (root) that is a prefix by component; the empty root owns the rest."""
    up = files.withColumn("root", F.explode(paths.ancestors("path")))
    owned = up.join(packages.select("root"), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return files.join(owned, "path", "left").na.fill("", ["root"])


def is_builtin(specifier: str = "specifier"):
    """``node:`` anything, or the exact name of a builtin."""
    return F.startswith(specifier, F.lit("node:")) | F.col(specifier).isin(*BUILTINS)


def probes(base: str = "base"):
    """Candidate files of a path, in order: what its written extension stands for or itself, with each extension, as a directory's index."""
    b = F.col(base)
    written = F.regexp_extract(base, r"\.([a-z]+)$", 1)
    stem = F.regexp_replace(base, r"\.[a-z]+$", "")
    swapped = F.lit(None)
    for ext, stands in ALIASES.items():
        swapped = F.when(written == ext, F.array(*[F.concat(stem, F.lit(f".{s}")) for s in stands])).otherwise(swapped)
    ends = F.array(*[F.concat(b, F.lit(f".{e}")) for e in PROBED], *[F.concat(b, F.lit(f"/index.{e}")) for e in PROBED])
    return F.concat(F.coalesce(swapped, F.array(b)), ends)


def probe(requests: DataFrame, files: DataFrame, base: str = "base") -> DataFrame:
    """``requests`` with ``path``, the first candidate of ``base`` that is a file; null if none is."""
    tried = requests.select(base).distinct().select(base, F.posexplode(probes(base)).alias("rank", "path"))
    hits = tried.join(files.select("path"), "path", "left_semi").groupBy(base).agg(F.min_by("path", "rank").alias("path"))
    return requests.join(hits, base, "left")


def joined_path(importer: str = "importer", specifier: str = "specifier"):
    """The path that a relative specifier means from its importer."""
    directory = paths.directory_of(importer)
    return paths.normalize(F.concat(F.when(directory == ".", F.lit("")).otherwise(F.concat(directory, F.lit("/"))), F.col(specifier)))


def alias_targets(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """``requests`` (importer, specifier) with (nth, base): all targets of the alias rule that fits with the longest prefix.

    Rules are (pattern, target; one ``*`` in each, or none) with nth, the target's place in its pattern, if there are several.
    Where requests and rules have a root, a rule holds for the requests of its own root.
    """
    own = ["root"] if "root" in requests.columns and "root" in aliases.columns else []
    nth = F.col("nth") if "nth" in aliases.columns else F.lit(0)
    rules = aliases.select(*[F.col(c).alias("__of") for c in own], F.substring_index("pattern", "*", 1).alias("pre"), F.when(F.contains("pattern", F.lit("*")), F.substring_index("pattern", "*", -1)).alias("post"), "target", nth.alias("nth"))
    # a handful of rules per package, from its configuration
    fits = F.when(F.col("post").isNull(), F.col("specifier") == F.col("pre")).otherwise(F.startswith("specifier", F.col("pre")) & F.endswith("specifier", F.col("post")) & (F.length("specifier") >= F.length("pre") + F.length("post")))
    middle = F.expr("substring(specifier, length(pre) + 1, length(specifier) - length(pre) - length(coalesce(post, '')))")
    base = F.when(F.col("post").isNull(), F.col("target")).otherwise(F.concat(F.substring_index("target", "*", 1), F.when(F.contains("target", F.lit("*")), F.concat(middle, F.substring_index("target", "*", -1))).otherwise("")))
    rank = F.struct(F.length("pre").alias("pre"), F.col("post").isNull().alias("exact"), F.coalesce(F.length("post"), F.lit(0)).alias("post"))
    found = requests.join(rules, fits & (F.col("root") == F.col("__of")) if own else fits).withColumn("base", base).withColumn("rank", rank)
    best = found.groupBy("importer", "specifier").agg(F.max("rank").alias("most"), F.collect_set(F.struct("rank", "nth", "base")).alias("all"))
    return best.select("importer", "specifier", F.explode(F.filter("all", lambda x: x["rank"] == F.col("most"))).alias("x")).select("importer", "specifier", "x.nth", "x.base")


def alias_bases(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """``requests`` (importer, specifier) with ``base``, the first target of the alias rule with the longest prefix."""
    return alias_targets(requests, aliases).groupBy("importer", "specifier").agg(F.min_by("base", F.struct("nth", "base")).alias("base"))


def alias_files(requests: DataFrame, aliases: DataFrame, files: DataFrame) -> DataFrame:
    """(importer, specifier, path): the file of the first alias target that has one."""
    hit = probe(alias_targets(requests, aliases), files).where("path is not null")
    return hit.groupBy("importer", "specifier").agg(F.min_by("path", F.struct("nth", "path")).alias("path"))


def package_name(path: str = "path"):
    """The package of a path below the last ``node_modules``, with its scope; null elsewhere."""
    rest = F.substring_index(path, "node_modules/", -1)
    name = F.regexp_extract(rest, "^((?:@[^/]+/)?[^/]+)", 1)
    return F.when(F.contains(path, F.lit("node_modules/")), name)


def classify(path: str = "path", root: str = ""):
    """internal below ``root`` and outside node_modules, else external."""
    return F.when(package_name(path).isNotNull(), "external").when(F.startswith(path, F.lit(root)), "internal").otherwise("external")


def package_files(requests: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """``requests`` (importer, specifier) whose package is known, with (installed, package, path; null if nothing is there).

    ``entries`` (dir, name, installed, sub, target, nth) say what a package's subpaths lead to, ``.`` being the package
    itself; both may hold one ``*``. The nearest node_modules directory that holds the package counts, else the package of the
    workspace with that name. Of its entries an exact subpath beats patterns and a longer prefix a shorter one; of several
    targets the first that is a file is taken.
    """
    name = F.regexp_extract("specifier", "^((?:@[^/]+/)?[^/]+)", 1)
    asked = requests.select("importer", "specifier", name.alias("package")).distinct()
    asked = asked.withColumn("asked", F.concat(F.lit("."), F.expr("substring(specifier, length(package) + 1)")))
    known = entries.select("dir", "name", "installed").distinct()
    up = asked.select("*", F.posexplode(paths.ancestors(paths.directory_of("importer"))).alias("away", "at"))
    above = F.when(F.col("at").isin("", "."), F.lit("")).otherwise(F.concat("at", F.lit("/")))
    near = up.withColumn("dir", F.concat(above, F.lit("node_modules/"), "package")).join(known.where("installed").select("dir", "installed"), "dir")
    linked = asked.join(known.where("not installed").select(F.col("name").alias("package"), "dir", "installed"), "package").withColumn("away", F.lit(1 << 20))
    both = near.select("importer", "specifier", "package", "asked", "dir", "installed", "away").unionByName(linked.select("importer", "specifier", "package", "asked", "dir", "installed", "away"))
    one = both.groupBy("importer", "specifier", "package", "asked").agg(F.min(F.struct("away", "dir", "installed")).alias("x")).select("importer", "specifier", "package", "asked", "x.dir", "x.installed")
    pre, post = F.substring_index("sub", "*", 1), F.substring_index("sub", "*", -1)
    star = F.contains("sub", F.lit("*"))
    fits = F.when(star, F.startswith("asked", pre) & F.endswith("asked", post) & (F.length("asked") >= F.length(pre) + F.length(post))).otherwise(F.col("asked") == F.col("sub"))
    middle = F.expr("substring(asked, length(substring_index(sub, '*', 1)) + 1, length(asked) - length(sub) + 1)")
    found = one.join(entries.select("dir", "sub", "target", "nth"), "dir").where(fits)
    found = found.withColumn("rank", F.struct((~star).alias("exact"), F.length(pre).alias("pre"))).withColumn("target", F.when(star, F.replace("target", F.lit("*"), middle)).otherwise(F.col("target")))
    best = found.groupBy("importer", "specifier").agg(F.max("rank").alias("most"))
    found = found.join(best, ["importer", "specifier"]).where("rank = most").withColumn("base", paths.normalize(F.concat("dir", F.lit("/"), "target")))
    hit = probe(found.select("importer", "specifier", "nth", "base"), files).where("path is not null").groupBy("importer", "specifier").agg(F.min_by("path", "nth").alias("path"))
    return one.select("importer", "specifier", "installed", "package").join(hit, ["importer", "specifier"], "left")


def resolve(requests: DataFrame, files: DataFrame, aliases: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """``requests`` (importer, specifier) with kind (internal, external, builtin, unresolved), path and package.

    Builtins first, relative specifiers by probing, then aliases (of the request's root, where there is one), then packages: a
    bare specifier that no alias maps to a file is external if node_modules holds its package, internal where a package of the
    workspace leads to a file, else unresolved.
    """
    requests = requests.distinct().withColumn("builtin", is_builtin())
    relative = requests.where("not builtin and specifier rlike '^[.]{1,2}(/|$)'").withColumn("base", joined_path())
    hit = probe(relative, files).select("importer", "specifier", "path")
    bare = requests.where("not builtin and not specifier rlike '^[.]{1,2}(/|$)'").drop("builtin")
    if aliases is not None:
        hit = hit.unionByName(alias_files(bare, aliases, files))
    rest = bare.select("importer", "specifier").join(hit.select("importer", "specifier"), ["importer", "specifier"], "left_anti")
    name = F.regexp_extract("specifier", "^((?:@[^/]+/)?[^/]+)", 1)
    if entries is not None:
        rest = rest.join(package_files(rest, entries, files), ["importer", "specifier"], "left")
    else:
        rest = rest.select("*", F.lit(None).cast("boolean").alias("installed"), F.lit(None).cast("string").alias("package"), F.lit(None).cast("string").alias("path"))
    installed = files.where(F.contains("path", F.lit("node_modules/"))).select(package_name().alias("__held")).distinct()
    rest = rest.withColumn("__name", name).join(installed, F.col("__name") == F.col("__held"), "left")
    outside = F.col("__held").isNotNull() & ~F.col("installed").eqNullSafe(False)
    kind = F.when(outside, "external").when(F.col("path").isNotNull(), classify()).otherwise("unresolved")
    none = F.lit(None).cast("string")
    found = hit.select("importer", "specifier", F.when(F.col("path").isNull(), "unresolved").otherwise(classify()).alias("kind"), "path", package_name().alias("package"))
    return (
        found.unionByName(requests.where("builtin").select("importer", "specifier", F.lit("builtin").alias("kind"), none.alias("path"), none.alias("package")))
        .unionByName(rest.select("importer", "specifier", kind.alias("kind"), F.when(kind == "internal", F.col("path")).alias("path"), F.when(outside, F.col("__name")).alias("package")))
    )


def ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path) of the files that ignore rules (dir, nth, pattern, negated, only_dir) leave out.

    A rule of a directory holds below it; ``pattern`` is a regular expression on the path from there. The last rule that
    matches decides, those of deeper directories being later; nothing below a directory that is left out comes back.
    """
    whole = files.select("path").distinct()
    up = whole.select("path", F.posexplode(paths.ancestors("path")).alias("up", "at")).where("at != ''")
    tried = up.select("at", (F.col("up") > 0).alias("is_dir")).distinct()
    inside = tried.select("at", "is_dir", F.explode(F.slice(paths.ancestors("at"), 2, 1 << 20)).alias("dir")).join(rules, "dir")
    rest = F.when(F.col("dir") == "", F.col("at")).otherwise(F.expr("substring(at, length(dir) + 2)"))
    matched = inside.withColumn("rest", rest).where("rest rlike pattern and (is_dir or not only_dir)")
    last = matched.groupBy("at", "is_dir").agg(F.max_by("negated", F.struct(F.length("dir"), "nth")).alias("negated")).where("not negated")
    return up.select("path", "at", (F.col("up") > 0).alias("is_dir")).join(last.select("at", "is_dir"), ["at", "is_dir"], "left_semi").select("path").distinct()
