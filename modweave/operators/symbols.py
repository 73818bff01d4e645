"""Where an exported symbol is defined, through re-export chains.

A state is a (module, name) that is looked up. An explicit export beats all stars, the first in source order beats the
rest. The states that seeds lead to are explored once for all seeds, round by round, with those already known left
out; a seed's verdict is the number of distinct definitions and packages among the ends that it reaches.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modweave.functions.storage import cut, tidy

NAMESPACE = "*"
BROADCAST_EXPORTS = 500_000  # exports up to which they are broadcast, some 100 MB as dictionaries
BROADCAST_BYTES = 64 << 20  # of their names


def explicit_exports(exports: DataFrame) -> DataFrame:
    """The first export of each (module, name)."""
    first = F.min(F.struct("ord", "kind", F.coalesce("local", "name").alias("local"), "imported", "src"))
    return exports.where("name is not null").groupBy("module", "name").agg(first.alias("e")).select("module", "name", "e.kind", "e.local", "e.imported", "e.src")


def _steps(states: DataFrame, explicit: DataFrame, stars: DataFrame, locals_: DataFrame | None) -> DataFrame:
    """(module, name, kind, m2, n2): where each state leads; kind is definition, external or follow."""
    found = states.join(explicit, ["module", "name"], "left")
    own = found.where("kind is not null")
    if locals_ is not None:
        # an export of something imported follows the import; of several bindings the last one counts
        own = own.join(locals_, ["module", "local"], "left")
        own = own.withColumn("src", F.when(F.col("kind").isin("local", "default"), F.col("via")).otherwise(F.col("src")))
        own = own.withColumn("imported", F.when(F.col("kind").isin("local", "default"), F.col("what")).otherwise(F.col("imported")))
    package = F.regexp_extract("src", "^ext:(.*)$", 1)
    ends = own.select(
        "module",
        "name",
        F.when(F.col("src").isNull() & F.col("kind").isin("local", "default"), "definition").when(F.startswith("src", F.lit("ext:")), "external").when(F.col("kind") == "namespaceStar", "definition").otherwise("follow").alias("step"),
        F.when(F.col("src").isNull(), F.col("module")).when(F.startswith("src", F.lit("ext:")), package).otherwise(F.col("src")).alias("m2"),
        F.when(F.col("src").isNull(), F.col("local")).when(F.startswith("src", F.lit("ext:")), F.lit("")).when(F.col("kind") == "namespaceStar", NAMESPACE).otherwise(F.col("imported")).alias("n2"),
    )
    others = found.where("kind is null").select("module", "name").join(stars, "module")
    others = others.select("module", "name", F.when(F.startswith("to", F.lit("ext:")), "external").otherwise("follow").alias("step"), F.when(F.startswith("to", F.lit("ext:")), package_of("to")).otherwise(F.col("to")).alias("m2"), F.when(F.startswith("to", F.lit("ext:")), F.lit("")).otherwise(F.col("name")).alias("n2"))
    return ends.unionByName(others)


def package_of(target: str):
    return F.regexp_extract(target, "^ext:(.*)$", 1)


class Lookup:
    """The states of a module graph whose exports fit the broadcast budget."""

    def __init__(self, modules: DataFrame, explicit: DataFrame, stars: DataFrame, locals_: DataFrame | None):
        rows = lambda df, *names: zip(*(c.to_pylist() for c in df.select(*names).toArrow().columns))
        self.known = {path for (path,) in rows(modules, "path")}
        self.explicit = {(m, n): e for m, n, *e in rows(explicit, "module", "name", "kind", "local", "imported", "src")}
        self.stars: dict[str, list[str]] = {}
        for module, to in rows(stars, "module", "to"):
            self.stars.setdefault(module, []).append(to)
        self.locals = {(m, local): (via, what) for m, local, via, what in rows(locals_, "module", "local", "via", "what")} if locals_ is not None else {}

    def ways(self, state: tuple[str, str]) -> Iterator[tuple[str, str, str]]:
        """(step, module, name) for each way on from a state."""
        module, name = state
        e = self.explicit.get(state)
        if e is None:
            goals = [(to, name) for to in self.stars.get(module, ())]
        else:
            kind, local, imported, src = e
            goals = [(src, imported)]
            if kind in ("local", "default"):
                goals = [self.locals[module, local]] if (module, local) in self.locals else []
                if not goals:
                    yield "definition", module, local
            elif kind == "namespaceStar" and not src.startswith("ext:"):
                yield "definition", src, NAMESPACE
                goals = []
        for to, what in goals:
            yield ("external", to[4:], "") if to.startswith("ext:") else ("follow", to, what)

    def verdict(self, seed: tuple[str, str]) -> tuple:
        ends, loops, done, path = set(), False, set(), {seed}
        stack = [(seed, self.ways(seed))] if seed[0] in self.known else []
        while stack:
            state, ways = stack[-1]
            step = next(ways, None)
            if step is None:
                stack.pop()
                path.discard(state)
                done.add(state)
            elif step[0] != "follow":
                ends.add(step)
            elif (to := step[1:]) in path:
                loops = True
            elif to not in done and to[0] in self.known:
                path.add(to)
                stack.append((to, self.ways(to)))
        only = next(iter(ends)) if len(ends) == 1 else (None, None, None)
        kind = "ambiguous" if len(ends) > 1 else only[0] or ("cyclic" if loops else "notFound")
        single = kind == "definition"
        return (*seed, kind, only[1] if single else None, only[2] if single else None, only[1] if kind == "external" else None, len(ends))


def _kernel(shared):
    names = ["module", "name", "verdict", "def_module", "def_name", "package", "n_ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value.verdict(s) for s in zip(batch.column("module").to_pylist(), batch.column("name").to_pylist())]
            columns = [[r[i] for r in rows] for i in range(7)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:6]), pa.array(columns[6], pa.int64())], names)

    return run


def led_to(seeds: DataFrame, modules: DataFrame, exports: DataFrame, locals_: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The modules and exports that seeds can lead to: those of their own modules and of modules that any export or binding comes from."""
    ends = [seeds.select("module"), exports.select(F.col("src").alias("module")), *([locals_.select(F.col("via").alias("module"))] if locals_ is not None else [])]
    ends = cut(functools.reduce(DataFrame.unionByName, ends).where("module is not null").distinct())
    return cut(modules.join(ends.withColumnRenamed("module", "path"), "path", "left_semi")), cut(exports.join(ends, "module", "left_semi"))


def _fits(modules: DataFrame, exports: DataFrame, locals_: DataFrame | None) -> bool:
    held = [(modules, ["path"]), (exports, ["module", "name", "local", "imported", "src"]), *([(locals_, ["module", "local", "via", "what"])] if locals_ is not None else [])]
    sizes = [t.select(F.lit(1).alias("n"), sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in names), F.lit(0)).alias("bytes")) for t, names in held]
    size = functools.reduce(DataFrame.unionByName, sizes).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    return (size.n or 0) <= BROADCAST_EXPORTS and (size.bytes or 0) <= BROADCAST_BYTES


def resolve(seeds: DataFrame, modules: DataFrame, exports: DataFrame, locals_: DataFrame | None = None, narrow: bool = False) -> DataFrame:
    """``(module, name, verdict, def_module, def_name, package, n_ends)`` for each distinct seed (module, name).

    verdict is definition, external, ambiguous (two or more distinct ends), cyclic (no end, but a cycle of re-exports)
    or notFound. ``locals_`` (module, local, via, what) are import bindings that exports may refer to. Where modules,
    exports and bindings fit the broadcast budget, tasks walk them for their seeds; beyond it, joins do. ``narrow``, for
    seeds of few modules: beyond it, what they can't lead to is left out first.
    """
    spark = seeds.sparkSession
    fits = _fits(modules, exports, locals_)
    if not fits and narrow:
        seeds = cut(seeds.select("module", "name").distinct())
        modules, exports = led_to(seeds, modules, exports, locals_)
        tidy(spark)
        fits = _fits(modules, exports, locals_)
    if not fits:
        return join_resolve(seeds, modules, exports, locals_)
    stars = exports.where("kind = 'star'").select("module", F.col("src").alias("to")).distinct()
    lookup = Lookup(modules, explicit_exports(exports), stars, locals_)
    some = seeds.select("module", "name").distinct().repartition(max(8, spark.sparkContext.defaultParallelism))
    return some.mapInArrow(_kernel(spark.sparkContext.broadcast(lookup)), "module string, name string, verdict string, def_module string, def_name string, package string, n_ends long")


def join_resolve(seeds: DataFrame, modules: DataFrame, exports: DataFrame, locals_: DataFrame | None = None) -> DataFrame:
    """The same verdicts by joins: states that seeds lead to are explored once for all seeds, round by round."""
    explicit, stars = cut(explicit_exports(exports)), cut(exports.where("kind = 'star'").select("module", F.col("src").alias("to")).distinct())
    known = modules.select(F.col("path").alias("module"))
    seeds = cut(seeds.select("module", "name").distinct())
    new = cut(seeds.join(known, "module", "left_semi"))
    states, steps = new, None
    while new.limit(1).count():
        more = cut(_steps(new, explicit, stars, locals_))
        steps = more if steps is None else steps.unionByName(more)
        ahead = more.where("step = 'follow'").select(F.col("m2").alias("module"), F.col("n2").alias("name")).distinct()
        new = cut(ahead.join(known, "module", "left_semi").join(states, ["module", "name"], "left_anti"))
        states = states.unionByName(new)
        tidy(seeds.sparkSession)  # a driver of little memory can't keep every round's plans
    if steps is None:
        steps = _steps(new, explicit, stars, locals_)
    follow = cut(steps.where("step = 'follow'").select("module", "name", "m2", "n2").join(known.withColumnRenamed("module", "m2"), "m2", "left_semi").distinct())
    ends = cut(steps.where("step != 'follow'").distinct())
    # seeds times the states that they reach, as (seed, state)
    wave = cut(seeds.select(F.col("module").alias("sm"), F.col("name").alias("sn"), "module", "name"))
    reached = wave
    while wave.limit(1).count():
        ahead = wave.join(follow, ["module", "name"]).select("sm", "sn", F.col("m2").alias("module"), F.col("n2").alias("name")).distinct()
        wave = cut(ahead.join(reached, ["sm", "sn", "module", "name"], "left_anti"))
        reached = reached.unionByName(wave)
        tidy(seeds.sparkSession)
    hits = reached.join(ends, ["module", "name"]).select("sm", "sn", "step", "m2", "n2").distinct()
    one = hits.groupBy("sm", "sn").agg(F.count("*").alias("n_ends"), F.min(F.struct("step", "m2", "n2")).alias("end"))
    # states that lead into a cycle are those left when states without a way on are peeled off
    loop = follow
    while True:
        n = loop.count()
        inner = cut(loop.join(loop.select(F.col("module").alias("m2"), F.col("name").alias("n2")).distinct(), ["m2", "n2"], "left_semi"))
        loop = inner
        if inner.count() == n:
            break
    cyclic = loop.select(F.col("module").alias("sm"), F.col("name").alias("sn")).distinct().withColumn("loops", F.lit(True))
    tidy(seeds.sparkSession)
    out = seeds.select(F.col("module").alias("sm"), F.col("name").alias("sn")).join(one, ["sm", "sn"], "left").join(cyclic, ["sm", "sn"], "left")
    verdict = F.when(F.col("n_ends") > 1, "ambiguous").when(F.col("n_ends") == 1, F.col("end.step")).when(F.col("loops"), "cyclic").otherwise("notFound")
    single = lambda c: F.when(verdict == "definition", F.col(c))
    return out.select(F.col("sm").alias("module"), F.col("sn").alias("name"), verdict.alias("verdict"), single("end.m2").alias("def_module"), single("end.n2").alias("def_name"), F.when(verdict == "external", F.col("end.m2")).alias("package"), F.coalesce("n_ends", F.lit(0)).cast("long").alias("n_ends"))


def exported_names(exports: DataFrame) -> DataFrame:
    """Distinct (module, name) of explicit exports; stars contribute none."""
    return exports.where("name is not null").select("module", "name").distinct()
