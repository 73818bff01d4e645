"""Applying the rewrite plan to sources: statements, byte-exact edits, diffs."""

from __future__ import annotations

import difflib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modweave.functions import paths
from modweave.functions.storage import cut
from modweave.operators import rewrite
from modweave.sources.scan import scan


@dataclass
class Change:
    path: str
    original: bytes
    rewritten: bytes

    def diff(self) -> str:
        a, b = (x.decode("utf-8", "replace").splitlines(keepends=True) for x in (self.original, self.rewritten))
        return "".join(difflib.unified_diff(a, b, self.path, self.path, n=3))


def render_import(names: list[tuple[str, str, bool]], specifier: str, semicolon: bool = True) -> str:
    """Statements that import (imported, local, type_only) names from ``specifier``: values in one, types in another."""
    end = ";" if semicolon else ""
    lines = []
    for typed in (False, True):
        some = [(i, a) for i, a, t in names if t == typed]
        word = "import type" if typed else "import"
        default = [a for i, a in some if i == "default"]
        named = [i if i == a else f"{i} as {a}" for i, a in some if i != "default"]
        braces = f"{{ {', '.join(named)} }}" if named else ""
        if typed and default and named:  # a type-only statement has either
            lines += [f"{word} {default[0]} from '{specifier}'{end}", f"{word} {braces} from '{specifier}'{end}"]
        elif default or named:
            lines.append(f"{word} {', '.join([*default[:1], *([braces] if braces else [])])} from '{specifier}'{end}")
        lines += [f"{word} {a} from '{specifier}'{end}" for a in default[1:]]
    return "\n".join(lines)


def apply_edits(source: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    """Replace byte ranges, last first."""
    for start, end, text in sorted(edits, reverse=True):
        source = source[:start] + text + source[end:]
    return source


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, content, plan in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "plan"))):
            out.append((path, content, rewritten(bytes(content), [json.loads(p) for p in plan])))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary())], ["path", "original", "rewritten"])


def rewritten(content: bytes, plan: list[dict]) -> bytes:
    """One file by its plan of (ord, start, end, specifier, def_module, names): merged into imports that are there, else new statements at the first place."""
    facts = scan(content.decode("utf-8")).imports
    gone = {(p["start"], p["end"]) for p in plan}
    by_module: dict[str, dict] = {}
    for p in sorted(plan, key=lambda p: (p["start"], p["bord"])):
        m = by_module.setdefault(p["def_module"], {"specifier": p["specifier"], "names": [], "anchor": p.get("anchor")})
        if (name := (p["def_name"], p["local"], p["type_only"])) not in m["names"]:
            m["names"].append(name)
    edits: dict[tuple[int, int], list[str]] = {}
    fresh: list[tuple[str, str]] = []
    first = min(gone)
    tail = lambda a, b: content[a:b].rstrip().endswith(b";")
    for m in by_module.values():
        anchor = next((i for i in facts if i["specifier"] in (m["anchor"] or []) and i["bindings"] and i["kind"] in ("named", "default") and (i["start"], i["end"]) not in gone), None)
        if anchor is not None:
            own = [(b["imported"], b["local"], b["type_only"]) for b in anchor["bindings"]]
            key = (anchor["start"], anchor["end"])
            names = own + [n for n in m["names"] if n not in own]
            edits[key] = [render_import(names, anchor["specifier"], tail(*key))]
        else:
            fresh.append((m["specifier"], render_import(m["names"], m["specifier"], tail(*first))))
    changes = [(a, b, "\n".join(t).encode()) for (a, b), t in edits.items()]
    for a, b in gone:
        text = "\n".join(line for _, line in sorted(fresh)).encode() if (a, b) == first else b""
        if not text and content[b : b + 1] == b"\n":
            b += 1  # the statement's line goes with it
        changes.append((a, b, text))
    return apply_edits(content, changes)


def changes(files: DataFrame, imports: DataFrame, bindings: DataFrame, symbols: DataFrame, conflicts: DataFrame, aliases: DataFrame, owners: DataFrame, style: str = "preserve") -> DataFrame:
    """(path, original, rewritten) of files that the plan changes.

    A statement is rewritten whole or not at all. Specifiers are aliases where the style (alias, or by the module's
    majority) asks for one and a rule of the module's package (``owners``: path, root) fits, the shortest first; else relative,
    with .js and its like where the module writes them.
    """
    stay = rewrite.statement_skips(symbols).select("module", "ord").unionByName(conflicts)
    picked = symbols.join(stay, ["module", "ord"], "left_anti").where("skip is null")
    spans = imports.select("module", "ord", "start", "end", "specifier", "statement_type_only")
    picked = picked.join(spans, ["module", "ord"]).join(bindings.select("module", "ord", "bord", "local", F.col("type_only").alias("binding_type_only")), ["module", "ord", "bord"])
    votes = rewrite.style_vote(imports.where("not startswith(target, 'ext:') and not startswith(target, '?')").select("module", "ord", "specifier"))
    relative = paths.relative_specifier("module", "def_module")
    suffix = F.regexp_extract("specifier", r"(\.[cm]?js)$", 1)
    rules = aliases.select("root", F.substring_index("pattern", "*", 1).alias("pre"), F.substring_index("target", "*", 1).alias("dir")).where("pre != ''").distinct()
    asked = picked.select("module", "def_module").distinct().join(owners.select(F.col("path").alias("module"), "root"), "module")
    # a rule's directory is one of those above the file that it names
    above = asked.select("*", F.explode(paths.ancestors("def_module")).alias("up")).withColumn("dir", F.when(F.col("up") == "", "").otherwise(F.concat("up", F.lit("/"))))
    fits = above.join(rules.where("dir = '' or endswith(dir, '/')"), ["root", "dir"])
    other = rules.where("dir != '' and not endswith(dir, '/')")
    fits = fits.select("module", "def_module", "pre", "dir").unionByName(asked.join(other, (asked["root"] == other["root"]) & F.startswith("def_module", F.col("dir"))).select("module", "def_module", "pre", "dir"))
    alias = F.concat("pre", F.expr("substring(regexp_replace(def_module, '(/index)?[.](d[.]ts|[cm]?[jt]sx?)$', ''), length(dir) + 1)"))
    short = fits.groupBy("module", "def_module").agg(F.min(F.struct(F.length(alias), alias)).alias("a")).select("module", "def_module", F.col("a.col2").alias("alias"))
    picked = picked.join(votes, "module", "left").join(short, ["module", "def_module"], "left")
    want = F.lit(style) if style != "preserve" else F.col("style")
    specifier = F.when((want == "alias") & F.col("alias").isNotNull(), F.col("alias")).otherwise(F.concat(relative, suffix))
    there = imports.groupBy("module", F.col("target").alias("def_module")).agg(F.collect_set("specifier").alias("anchor"))
    picked = picked.withColumn("new", specifier).join(there, ["module", "def_module"], "left")
    row = F.to_json(F.struct("start", "end", "bord", F.col("new").alias("specifier"), "def_module", "def_name", "local", F.col("binding_type_only").alias("type_only"), "anchor"))
    plan = picked.groupBy(F.col("module").alias("path")).agg(F.collect_list(row).alias("plan"))
    return cut(plan.join(files.select("path", "content"), "path").select("path", "content", "plan").mapInArrow(_rewritten, "path string, original binary, rewritten binary").where("original != rewritten"))
