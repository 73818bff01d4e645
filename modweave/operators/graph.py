"""Edges, neighbours, closures and strongly connected components of a module graph.

Tables: modules (path, has_side_effects, own_decls), imports (module, ord, target, kind, type_only), bindings (module,
ord, bord, imported), exports (module, ord, kind, name, local, imported, src, type_only). A target or src is a module
path, or ``ext:<package>``.
"""

from __future__ import annotations

import weakref
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modweave.functions.storage import cut, tidy

KINDS = ("static", "dynamic", "typeOnly", "reExport", "sideEffectOnly")  # in sort order
BROADCAST_EDGES = 1_000_000  # distinct edges up to which the adjacency is broadcast: 24 MB and the names
BROADCAST_BYTES = 256 << 20  # of the names at both ends of the edges
FOLD_EDGES = 100_000  # distinct edges up to which a graph is searched as it is
_PAIRS = 1 << 16  # pairs of a result batch, about
ALIKE = 1000  # sources alike whose pairs one key holds, about


def kind_rank(kind: str = "kind"):
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind)) - 1


def references(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """Every internal reference (src, dst, kind), before targets are checked."""
    kind = F.when(F.col("type_only"), "typeOnly").when(F.col("kind") == "dynamic", "dynamic").when(F.col("kind") == "sideEffect", "sideEffectOnly").otherwise("static")
    by_import = imports.select(F.col("module").alias("src"), F.col("target").alias("dst"), kind.alias("kind"))
    again = F.when((F.col("kind") == "named") & F.col("type_only"), "typeOnly").otherwise("reExport")
    by_export = exports.where("src is not null").select(F.col("module").alias("src"), F.col("src").alias("dst"), again.alias("kind"))
    return by_import.unionByName(by_export).where(~F.startswith("dst", F.lit("ext:")))


def build_edges(modules: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """Distinct (src, dst, kind) between known modules."""
    known = modules.select(F.col("path").alias("dst"))
    return references(imports, exports).distinct().join(known, "dst", "left_semi").select("src", "dst", "kind")


def dangling_edges(modules: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """Distinct (src, dst) whose target was resolved but is no known module."""
    return references(imports, exports).select("src", "dst").distinct().join(modules.select(F.col("path").alias("dst")), "dst", "left_anti").select("src", "dst")


def adjacency(edges: DataFrame, types: bool = False) -> DataFrame:
    """Distinct (src, dst) of runtime edges, or of all."""
    return (edges if types else edges.where("kind != 'typeOnly'")).select("src", "dst").distinct()


class Adjacency:
    """Edges of a graph within the broadcast budget as compressed rows of numbers. Numbers follow the order of names.

    Searches go over its components, both ways: they end after as many waves as a path without cycles is long. A node may
    stand for several (``weights`` of named nodes, 1 for the rest).
    """

    def __init__(self, src: pa.Array, dst: pa.Array, weights: tuple[pa.Array, np.ndarray] | None = None):
        names = pc.unique(pa.concat_arrays([src, dst]))
        self.names = names.take(pc.array_sort_indices(names))
        n = len(self.names)
        a, b = (pc.index_in(c, self.names).to_numpy() for c in (src, dst))
        self.links = self._rows(a, b, n)
        self.part, self.cyclic = self._parts(np.bincount(b, minlength=n) > 0)
        self.members = self._rows(self.part, np.arange(n), len(self.cyclic))
        each = np.ones(n, np.int64)
        if weights is not None:
            at = self.numbers(weights[0])
            each[at[at >= 0]] = weights[1][at >= 0]
        self.weight = np.bincount(self.part, each, len(self.cyclic)).astype(np.int64)
        ways = np.unique(self.part[a].astype(np.int64) * len(self.cyclic) + self.part[b])
        a, b = ways // max(1, len(self.cyclic)), ways % max(1, len(self.cyclic))
        a, b = a[a != b], b[a != b]
        self.ways = {False: self._rows(a, b, len(self.cyclic)), True: self._rows(b, a, len(self.cyclic))}

    @staticmethod
    def _rows(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((b, a))
        return np.searchsorted(a[order], np.arange(n + 1)), b[order].astype(np.int32)

    def numbers(self, names: pa.Array) -> np.ndarray:
        """The numbers of nodes, -1 for unknown ones."""
        return pc.fill_null(pc.index_in(names, self.names), -1).to_numpy().astype(np.int64)

    @staticmethod
    def next(rows: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
        """The entries of rows, one row's after another's."""
        begin, to = rows
        size = begin[at + 1] - begin[at]
        return to[np.repeat(begin[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def searcher(self, back: bool = False):
        """A function from distinct components to those that they reach by one edge or more; they themselves only if they are cycles or another one reaches them."""
        ways = self.ways[back]
        seen = np.zeros(len(self.cyclic), bool)
        mark = np.zeros(len(self.cyclic), np.int32)

        def reach(start: np.ndarray) -> np.ndarray:
            wave = start[self.cyclic[start]]
            seen[wave] = True
            found, wave = [wave], start
            while len(wave):
                wave = self.next(ways, wave)
                wave = wave[~seen[wave]]
                mark[wave] = np.arange(len(wave))  # the last one of equal nodes stands for all
                wave = wave[mark[wave] == np.arange(len(wave))]
                seen[wave] = True
                found.append(wave)
            out = np.concatenate(found)
            seen[out] = False
            return out

        return reach

    def components(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, smallest node of its component) for the nodes on cycles."""
        nodes = np.flatnonzero(self.cyclic[self.part])
        begin, to = self.members
        return nodes, to[begin[self.part[nodes]]].astype(np.int64)

    def _parts(self, entered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(component of each node, whether it is a cycle): one depth-first search over the nodes with ways in and out, without recursion, in four bytes a node and list."""
        begin, to = self.links
        n = len(begin) - 1
        part, cyclic, count, found = array("i", [-1]) * n, bytearray(), 0, 0
        first, edges = array("i", begin.astype(np.int32).tobytes()), array("i", to.tobytes())
        index, low, at = array("i", [0]) * n, array("i", [0]) * n, first[:n]
        stack, path = array("i"), array("i")
        for start in np.flatnonzero(entered & (begin[1:] > begin[:-1])).tolist():
            if index[start]:
                continue
            path.append(start)
            while path:
                v = path[-1]
                if not index[v]:
                    count += 1
                    index[v] = low[v] = count
                    stack.append(v)
                if at[v] < first[v + 1]:
                    w = edges[at[v]]
                    at[v] += 1
                    if not index[w]:
                        path.append(w)
                    elif part[w] < 0 and index[w] < low[v]:
                        low[v] = index[w]
                    continue
                path.pop()
                if path and low[v] < low[path[-1]]:
                    low[path[-1]] = low[v]
                if low[v] == index[v]:
                    w, size = -1, 0
                    while w != v:
                        w = stack.pop()
                        part[w] = found
                        size += 1
                    cyclic.append(size > 1 or v in edges[first[v] : first[v + 1]])
                    found += 1
        part = np.array(part, np.int32)
        alone = np.flatnonzero(part < 0)
        part[alone] = found + np.arange(len(alone))
        return part, np.concatenate([np.frombuffer(bytes(cyclic), bool), np.zeros(len(alone), bool)])


_shared: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_folded: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _size(links: DataFrame):
    return links.agg(F.count("*").alias("n"), F.sum(F.octet_length("src") + F.octet_length("dst")).alias("bytes")).first()


def _column(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays([x.cast(pa.large_string()) for x in table.column(name).chunks] or [pa.array([], pa.large_string())])


def share(links: DataFrame, weights: DataFrame | None = None):
    """The adjacency of links (src, dst) as a broadcast variable, made once for a DataFrame; None if it is beyond the budget, which is measured first."""
    if links not in _shared:
        size = _size(links)
        fits = size.n <= BROADCAST_EDGES and (size.bytes or 0) <= BROADCAST_BYTES
        table = links.select("src", "dst").toArrow() if fits else None
        heavy = weights.select("rep", "weight").toArrow() if fits and weights is not None else None
        heavy = (_column(heavy, "rep"), heavy.column("weight").to_numpy()) if heavy is not None else None
        _shared[links] = links.sparkSession.sparkContext.broadcast(Adjacency(_column(table, "src"), _column(table, "dst"), heavy)) if fits else None
        del table
        pa.default_memory_pool().release_unused()
    return _shared[links]


class Folded:
    """A graph whose nodes that nothing leads to, and those that lead to nothing, are one node where their neighbours are the same and at most two.

    ``names`` (name, rep) and ``weights`` (rep, weight) hold the nodes that stand for several, None for a graph as it is.
    Such nodes lie on no cycle and do not reach each other, so what one reaches, or what reaches it, holds for all.
    """

    def __init__(self, links: DataFrame):
        self.links, self.names, self.weights = links, None, None
        size = _size(links)
        if size.n > min(FOLD_EDGES, BROADCAST_EDGES) or (size.bytes or 0) > BROADCAST_BYTES:
            ahead = _alike(links, "src", "dst")
            links = cut(self._renamed(links.select("src", "dst"), ahead, "src").distinct())
            tidy(links.sparkSession)
            behind = _alike(links, "dst", "src")
            self.links = cut(self._renamed(links, behind, "dst").distinct())
            self.names = cut(ahead.unionByName(behind))
            self.weights = cut(self.names.groupBy("rep").agg(F.count("*").alias("weight")))
            tidy(links.sparkSession)
        self.shared = share(self.links, self.weights)
        if self.names is not None:
            tidy(links.sparkSession)

    @staticmethod
    def _renamed(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
        """``df`` with the node that stands for the one in ``column``."""
        known = names.select(F.col("name").alias("__name"), F.col("rep").alias("__rep"))
        return df.join(known, F.col(column) == F.col("__name"), "left").withColumn(column, F.coalesce("__rep", column)).drop("__name", "__rep")

    def rep(self, df: DataFrame, column: str) -> DataFrame:
        return df if self.names is None else self._renamed(df, self.names, column)

    def members(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with a row per node that the one in ``column`` stands for."""
        if self.names is None:
            return df
        known = self.names.select(F.col("name").alias("__name"), F.col("rep").alias("__rep"))
        return df.join(known, F.col(column) == F.col("__rep"), "left").withColumn(column, F.coalesce("__name", column)).drop("__name", "__rep")

    def weighed(self, df: DataFrame, column: str) -> DataFrame:
        if self.weights is None:
            return df.withColumn("weight", F.lit(1).cast("long"))
        return df.join(self.weights.withColumnRenamed("rep", column), column, "left").na.fill(1, ["weight"])


def _alike(links: DataFrame, end: str, other: str) -> DataFrame:
    """(name, rep): nodes that are only an ``end`` of links, with one or two others; of those with the same others the least is rep."""
    rows = links.select(F.col(end).alias("name"), F.col(other).alias("other")).unionByName(links.select(F.col(other).alias("name"), F.lit(None).cast("string").alias("other")))
    per = rows.groupBy("name").agg(F.count("*").alias("n"), F.count("other").alias("k"), F.min("other").alias("lo"), F.max("other").alias("hi"))
    per = cut(per.where("n = k and k <= 2").select("name", "lo", "hi"))
    rep = per.groupBy("lo", "hi").agg(F.min("name").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    return cut(per.join(rep, ["lo", "hi"]).select("name", "rep"))


def fold(links: DataFrame) -> Folded:
    """The folded graph, made once for a DataFrame."""
    if links not in _folded:
        _folded[links] = Folded(links)
    return _folded[links]


def _named(graph: Adjacency, nodes: np.ndarray) -> pa.Array:
    return graph.names.take(pa.array(nodes)).cast(pa.string())


def _pairs(shared, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph: Adjacency = shared.value
        reach = graph.searcher(back)
        src: list[np.ndarray] = []
        dst: list[np.ndarray] = []
        held = 0

        def flush():
            return pa.RecordBatch.from_arrays([_named(graph, np.concatenate(c)) for c in (src, dst)], ["src", "dst"])

        for batch in batches:
            for v in graph.numbers(batch.column("src").cast(pa.large_string())):
                found = graph.next(graph.members, reach(graph.part[[v]])) if v >= 0 else np.zeros(0, np.int32)
                for a in range(0, len(found), _PAIRS):
                    part = found[a : a + _PAIRS]
                    src.append(np.full(len(part), v))
                    dst.append(part)
                    held += len(part)
                    if held >= _PAIRS:
                        yield flush()
                        src, dst, held = [], [], 0
        if held:
            yield flush()

    return run


def _reached(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph: Adjacency = shared.value
        start = [graph.numbers(batch.column("src").cast(pa.large_string())) for batch in batches]
        start = np.concatenate(start) if start else np.zeros(0, np.int64)
        found = graph.next(graph.members, graph.searcher()(np.unique(graph.part[start[start >= 0]])))
        for a in range(0, len(found), _PAIRS):
            yield pa.RecordBatch.from_arrays([_named(graph, found[a : a + _PAIRS])], ["dst"])

    return run


def _sizes(shared, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph: Adjacency = shared.value
        reach = graph.searcher(back)
        for batch in batches:
            numbers = graph.numbers(batch.column("src").cast(pa.large_string()))
            parts, which = np.unique(graph.part[numbers[numbers >= 0]], return_inverse=True)
            out = np.zeros(len(numbers), np.int64)
            out[numbers >= 0] = np.array([graph.weight[reach(parts[i : i + 1])].sum() for i in range(len(parts))], np.int64)[which]
            yield pa.RecordBatch.from_arrays([batch.column("src"), pa.array(out)], ["src", "n"])

    return run


def _unions(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph: Adjacency = shared.value
        reach = graph.searcher()
        among = np.zeros(len(graph.cyclic), bool)
        for batch in batches:
            roots, out = batch.column("roots"), []
            at, names = roots.offsets.to_numpy(), roots.values
            numbers, counts = graph.numbers(names.field("rep").cast(pa.large_string())), names.field("n").to_numpy()
            for a, b in zip(at[:-1], at[1:]):
                v, n = numbers[a:b], counts[a:b]
                parts = graph.part[v[v >= 0]]
                found = reach(np.unique(parts))
                among[found] = True
                out.append(int(graph.weight[found].sum() + n[v < 0].sum() + n[v >= 0][~among[parts]].sum()))
                among[found] = False
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array(out, pa.int64())], ["set_id", "n"])

    return run


def _spread(df: DataFrame) -> DataFrame:
    return df.repartition(max(8, df.sparkSession.sparkContext.defaultParallelism))


def led_to(links: DataFrame, starts: DataFrame) -> DataFrame:
    """The links that paths from ``starts`` (src) can take: those from a start or from where another link leads. A graph that is searched as it is, or known folded, stays."""
    if links in _folded or _size(links).n <= FOLD_EDGES:
        return links
    ends = links.select(F.col("dst").alias("src")).unionByName(starts.select("src")).distinct()
    return cut(links.join(ends, "src", "left_semi").select("src", "dst"))


def _turned(links: DataFrame, back: bool) -> DataFrame:
    return links.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if back else links


def _reps_closure(g: Folded, sources: DataFrame, back: bool) -> DataFrame:
    if g.shared is None:
        return join_closure(_turned(g.links, back), sources)
    return _spread(sources).mapInArrow(_pairs(g.shared, back), "src string, dst string")


def closure(links: DataFrame, sources: DataFrame, back: bool = False) -> DataFrame:
    """Distinct (src, dst): what each source (column src) reaches over ``links`` by one edge or more; against the edges if ``back``.

    A breadth-first search per source over the broadcast adjacency where that fits its budget. Beyond it, the pairs of
    the folded graph, whose ends are named last.
    """
    shared, sources = share(links), sources.select("src").distinct()
    if shared is not None:
        return _spread(sources).mapInArrow(_pairs(shared, back), "src string, dst string")
    g = fold(links)
    named = g.rep(sources.withColumn("rep", F.col("src")), "rep")
    pairs = g.members(_reps_closure(g, named.select(F.col("rep").alias("src")).distinct(), back), "dst").withColumnRenamed("src", "rep")
    # a node may stand for very many sources: so many at a time are a key of their own, and the keys' tasks are not put together
    part = F.pmod(F.xxhash64("src"), F.ceil(F.col("n") / ALIKE))
    named = cut(named.join(named.groupBy("rep").agg(F.count("*").alias("n")), "rep").select("rep", part.alias("part"), "src"))
    dealt = pairs.join(named.select("rep", "part").distinct(), "rep").repartition(max(128, 8 * links.sparkSession.sparkContext.defaultParallelism), "rep", "part")
    return dealt.join(named, ["rep", "part"]).select("src", "dst")


def reachable(links: DataFrame, pairs: DataFrame, src: str, dst: str) -> DataFrame:
    """The rows of ``pairs`` whose ``dst`` is reached from ``src`` by one edge or more; few distinct ``src`` are meant."""
    g = fold(links)
    named = g.rep(g.rep(pairs.withColumn("__a", F.col(src)).withColumn("__b", F.col(dst)), "__a"), "__b")
    known = _reps_closure(g, named.select(F.col("__a").alias("src")).distinct(), False).select(F.col("src").alias("__a"), F.col("dst").alias("__b"))
    return named.join(known, ["__a", "__b"], "left_semi").drop("__a", "__b")


def reached(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct (dst): what the sources (column src) reach together by one edge or more, without pairs."""
    g = fold(links)
    roots = g.rep(sources.select("src"), "src").distinct()
    if g.shared is not None:
        return g.members(_spread(roots).mapInArrow(_reached(g.shared), "dst string").distinct(), "dst")
    wave = cut(g.links.join(roots, "src", "left_semi").select("dst").distinct())
    found = wave
    while wave.limit(1).count():
        wave = cut(g.links.join(wave.withColumnRenamed("dst", "src"), "src", "left_semi").select("dst").distinct().join(found, "dst", "left_anti"))
        found = found.unionByName(wave)
    return g.members(found, "dst")


def closure_sizes(links: DataFrame, sources: DataFrame, back: bool = False) -> DataFrame:
    """(src, n): how many modules each source reaches."""
    g, sources = fold(links), sources.select("src").distinct()
    named = g.rep(sources.withColumn("rep", F.col("src")), "rep")
    reps = named.select(F.col("rep").alias("src")).distinct()
    if g.shared is not None:
        sizes = _spread(reps).mapInArrow(_sizes(g.shared, back), "src string, n long")
    else:
        sizes = g.weighed(join_closure(_turned(g.links, back), reps), "dst").groupBy("src").agg(F.sum("weight").alias("n"))
    return named.join(sizes.withColumnRenamed("src", "rep"), "rep", "left").select("src", "n").na.fill(0, ["n"])


def union_sizes(links: DataFrame, sets: DataFrame) -> DataFrame:
    """(set_id, n) for sets (set_id, roots): how many modules the roots are and reach together."""
    g, kind = fold(links), sets.schema["set_id"].dataType.simpleString()
    members = sets.select("set_id", F.explode(F.array_distinct("roots")).alias("rep"))
    members = g.rep(members, "rep").groupBy("set_id", "rep").agg(F.count("*").alias("n"))
    if g.shared is not None:
        grouped = members.groupBy("set_id").agg(F.collect_list(F.struct("rep", "n")).alias("roots"))
        return _spread(grouped).mapInArrow(_unions(g.shared), f"set_id {kind}, n long")
    members = cut(members)
    reach = cut(members.select("set_id", F.col("rep").alias("src")).join(join_closure(g.links, members.select(F.col("rep").alias("src"))), "src").select("set_id", F.col("dst").alias("rep")).distinct())
    alone = members.join(reach, ["set_id", "rep"], "left_anti")
    return g.weighed(reach, "rep").select("set_id", F.col("weight").alias("n")).unionByName(alone.select("set_id", "n")).groupBy("set_id").agg(F.sum("n").alias("n"))


def join_closure(links: DataFrame, sources: DataFrame) -> DataFrame:
    """The same closure by joins: each round extends, and writes, only what the round before found."""
    step = links.select(F.col("src").alias("via"), F.col("dst").alias("to"))
    new = cut(links.join(sources.select("src").distinct(), "src", "left_semi").select("src", "dst").distinct())
    found = new
    while new.limit(1).count():
        further = new.join(step, F.col("dst") == F.col("via")).select("src", F.col("to").alias("dst")).distinct()
        new = cut(further.join(found, ["src", "dst"], "left_anti"))
        found = found.unionByName(new)
    return found


def trimmed(links: DataFrame) -> DataFrame:
    """The links between nodes that have a way in and a way out, as every node on a cycle has."""
    inner = links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    return cut(inner.select("src", "dst"))


def components(links: DataFrame) -> DataFrame:
    """(node, scc) of the nodes that lie on cycles: scc is the smallest member. Linear on the broadcast adjacency; beyond
    its budget nodes without a way in or out are trimmed until the rest fits it, and by joins if it never does."""
    shared, all_links = share(links), links
    left = links.count() if shared is None else 0
    while shared is None:
        links = trimmed(links)
        shared, now = share(links), links.count()
        if shared is None and now == left:
            return join_components(all_links)
        left = now
    nodes, roots = shared.value.components()
    spark = links.sparkSession
    if not len(nodes):
        return spark.createDataFrame([], "node string, scc string")
    return spark.createDataFrame(pa.table({"node": _named(shared.value, nodes), "scc": _named(shared.value, roots)}))


def _least_label(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): the least label among a node's own and those of the nodes that reach it."""
    labels = cut(labels)
    wave = labels
    while True:
        ahead = wave.join(links, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("label"))
        better = ahead.join(labels.withColumnRenamed("label", "had"), "node").where("label < had").select("node", "label")
        wave = cut(better)
        if not wave.limit(1).count():
            return labels
        labels = cut(labels.join(wave.withColumnRenamed("label", "new"), "node", "left").select("node", F.coalesce("new", "label").alias("label")))


def join_components(links: DataFrame) -> DataFrame:
    """The same by joins, without any pairs: nodes without a way in or out are trimmed; then each node takes the least name
    that reaches it, and those that reach the owner of their name back, within the name's nodes, are its component."""
    self_loops = links.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("scc"))
    links, done = cut(links.where("src != dst").select("src", "dst").distinct()), None
    while True:
        left = links.count()
        while left:  # a node on a cycle has a way in and a way out
            links = trimmed(links)
            now = links.count()
            if now == left:
                break
            left = now
        if not left:
            break
        nodes = links.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
        labels = cut(_least_label(links, nodes))
        a, b = labels.select(F.col("node").alias("src"), F.col("label").alias("__a")), labels.select(F.col("node").alias("dst"), F.col("label").alias("__b"))
        same = cut(links.join(a, "src").join(b, "dst").where("__a = __b").select("src", "dst", F.col("__a").alias("scc")))
        wave = cut(same.where("dst = scc").select(F.col("src").alias("node"), "scc").distinct())
        found = wave
        while wave.limit(1).count():
            ahead = same.join(wave.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "scc").distinct()
            wave = cut(ahead.join(found, ["node", "scc"], "left_anti"))
            found = found.unionByName(wave)
        found = cut(found)
        done = found if done is None else done.unionByName(found)
        gone = found.select("node")
        links = cut(links.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti"))
    return (self_loops if done is None else done.unionByName(self_loops.join(done, "node", "left_anti"))).distinct()
