"""Closures and symbol resolution: broadcast kernels, joins and plain search agree on random graphs."""

import gc
import random

import pytest

from modweave.functions import paths
from modweave.operators import analyses, graph, resolution, symbols
from modweave.plans.model import Model


def random_links(seed, n=25, m=45):
    r = random.Random(seed)
    return sorted({(f"v{r.randrange(n)}", f"v{r.randrange(n)}") for _ in range(m)})


def search(links):
    out = {}
    for a, _ in links:
        seen, todo = set(), [a]
        while todo:
            v = todo.pop()
            for x, y in links:
                if x == v and y not in seen:
                    seen.add(y)
                    todo.append(y)
        out[a] = seen
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_closures_agree(spark, seed):
    links = random_links(seed)
    df = spark.createDataFrame(links, "src string, dst string")
    expected = sorted((a, b) for a, s in search(links).items() for b in s)
    for reverse in (False, True):
        ways = df if not reverse else df.selectExpr("dst as src", "src as dst")
        flat = links if not reverse else [(b, a) for a, b in links]
        expected = sorted((a, b) for a, s in search(flat).items() for b in s)
        assert sorted(map(tuple, graph.closure(ways, ways.select("src")).collect())) == expected
        if not reverse:
            assert sorted(map(tuple, graph.join_closure(ways, ways.select("src")).collect())) == expected
    sizes = {r.src: r.n for r in graph.closure_sizes(df, df.select("src")).collect()}
    assert sizes == {a: len(s) for a, s in search(links).items()}


@pytest.mark.parametrize("seed", [1, 2, 5, 6])
def test_components_agree(spark, seed):
    links = random_links(seed, n=30, m=40)
    df = spark.createDataFrame(links, "src string, dst string")
    reach = search(links)
    expected = sorted((v, min(w for w in reach[v] if v in reach.get(w, ()))) for v in reach if v in reach[v])
    scc = graph.components(df)
    assert sorted(map(tuple, scc.collect())) == expected
    assert sorted(map(tuple, graph.join_components(df).collect())) == expected
    paths_ = [sorted(map(tuple, f(df, scc).collect())) for f in (analyses.shortest_cycles, analyses.join_shortest_cycles)]
    assert paths_[0] == paths_[1] and [p[0] for p in paths_[0]] == sorted({s for _, s in expected})


def test_unions_back_ways_and_the_budget(spark, monkeypatch):
    links = random_links(4)
    df, reach = spark.createDataFrame(links, "src string, dst string"), search(links)
    sets = [(0, ["v1"]), (1, ["v1", "v2", "nowhere"]), (2, ["nowhere"]), (3, sorted(reach)[:9])]
    expected = sorted((i, len({*roots, *(w for v in roots for w in reach.get(v, ()))})) for i, roots in sets)
    back = sorted((b, sum(b in s for s in reach.values())) for b in {b for _, b in links})
    table = spark.createDataFrame(sets, "set_id long, roots array<string>")
    results = []
    for most in (graph.BROADCAST_EDGES, 3):
        monkeypatch.setattr(graph, "BROADCAST_EDGES", most)
        ways = df.select("src", "dst")
        assert (graph.share(ways) is None) == (most == 3)
        assert sorted(map(tuple, graph.union_sizes(ways, table).collect())) == expected
        assert sorted(map(tuple, graph.closure_sizes(ways, ways.selectExpr("dst as src"), back=True).collect())) == back
        results.append(sorted(map(tuple, graph.closure(ways, ways.selectExpr("dst as src"), back=True).collect())))
    assert results[0] == results[1]


def test_a_long_chain_and_a_wide_cycle(spark):
    links = [(f"c{i:05}", f"c{i + 1:05}") for i in range(5000)] + [(f"r{i:05}", f"r{(i + 1) % 5000:05}") for i in range(5000)]
    df = spark.createDataFrame(links, "src string, dst string")
    found = graph.components(df).collect()
    assert len(found) == 5000 and {r.scc for r in found} == {"r00000"}
    assert graph.closure(df, df.where("src in ('c00000', 'r00007')")).groupBy("src").count().collect() is not None
    assert sorted(map(tuple, graph.closure_sizes(df, df.where("src in ('c00000', 'r00007')")).collect())) == [("c00000", 5000), ("r00007", 5000)]


def test_empty_graph(spark):
    df = spark.createDataFrame([], "src string, dst string")
    assert graph.closure(df, df.select("src")).count() == 0
    assert analyses.shortest_cycles(df, graph.components(graph.closure(df, df.select("src")))).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_symbols_by_joins_and_by_walks_agree(spark, seed):
    r = random.Random(seed)
    mods = [f"m{i}" for i in range(8)]
    rows = []
    for m in mods:
        for k in range(r.randrange(1, 5)):
            kind = r.choice(["star", "star", "named", "local", "namespaceStar"])
            to = r.choice([*mods, "ext:lib", "gone"])
            name = r.choice("abc")
            rows.append((m, k, kind, None if kind == "star" else name, name if kind == "local" else None, r.choice("abc") if kind == "named" else None, None if kind == "local" else to, False))
    exports = spark.createDataFrame(rows, "module string, ord long, kind string, name string, local string, imported string, src string, type_only boolean")
    modules = spark.createDataFrame([(m,) for m in mods], "path string")
    seeds = spark.createDataFrame([(m, n) for m in mods for n in "abcd"], "module string, name string")
    locals_ = spark.createDataFrame([("m0", "a", "m1", "b"), ("m2", "b", "ext:x", "default")], "module string, local string, via string, what string")
    pick = lambda df: sorted(tuple(map(str, x)) for x in df.collect())
    assert pick(symbols.resolve(seeds, modules, exports, locals_)) == pick(symbols.join_resolve(seeds, modules, exports, locals_))


@pytest.mark.parametrize(
    ("path", "expected"),
    [("a/../b", "b"), ("/a/./b//c", "/a/b/c"), ("../x", "x"), ("a\\b", "a/b"), ("//?/C:/x", "C:/x"), ("", ""), ("/..", "/")],
)
def test_normalize(spark, path, expected):
    assert spark.createDataFrame([(path,)], "p string").select(paths.normalize("p")).first()[0] == expected


@pytest.mark.parametrize(
    ("source", "target", "expected"),
    [("a/b.ts", "a/c.ts", "./c"), ("a/b/c.ts", "a/d.ts", "../d"), ("m.ts", "x/y/index.ts", "./x/y/index"), ("a/b.ts", "b/b.d.ts", "../b/b"), ("a/b/c.ts", "a/b/d/e.tsx", "./d/e")],
)
def test_relative_specifier(spark, source, target, expected):
    assert spark.createDataFrame([(source, target)], "a string, b string").select(paths.relative_specifier("a", "b")).first()[0] == expected


def test_component_order_and_directories(spark):
    df = spark.createDataFrame([("src/a/x.ts",), ("src/a.ts",), ("y.ts",)], "path string")
    assert [r.path for r in df.orderBy(paths.parts("path")).collect()] == ["src/a/x.ts", "src/a.ts", "y.ts"]
    rows = df.select("path", paths.directory_of("path").alias("d"), paths.directory_prefix("path", 1).alias("p"), paths.file_name("path").alias("f")).collect()
    assert {(r.d, r.p, r.f) for r in rows} == {("src/a", "src", "x.ts"), ("src", "src", "a.ts"), (".", ".", "y.ts")}


@pytest.mark.parametrize(
    ("glob", "path", "fits"),
    [("**/*.ts", "a/b/c.ts", True), ("**/*.ts", "c.ts", True), ("*.ts", "a/c.ts", False), ("src/**", "src/a/b", True), ("a?c", "abc", True), ("*.{ts,js}", "x.js", True), ("*.{ts,js}", "x.md", False), ("a.b", "aXb", False)],
)
def test_globs(glob, path, fits):
    import re

    assert bool(re.search(resolution.glob_pattern(glob), path)) == fits


def folding_links(seed):
    """Random links with nodes before and behind them that have the same neighbours."""
    r = random.Random(seed)
    links = set(random_links(seed, n=12, m=18))
    for i in range(20):
        links |= {(f"a{i:02}", f"v{v}") for v in r.choice([(1,), (1, 2), (3,)])} | {(f"v{v}", f"z{i:02}") for v in r.choice([(2,), (4, 5), (6,)])}
    return sorted(links | {(f"a{i:02}", f"z{i % 3:02}") for i in range(5)} | {("v0", "v0")})


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("most", [1_000_000, 40])
def test_folded_graphs_agree_with_search(spark, monkeypatch, seed, most):
    links = folding_links(seed)
    df, reach = spark.createDataFrame(links, "src string, dst string"), search(links)
    monkeypatch.setattr(graph, "FOLD_EDGES", 0)
    monkeypatch.setattr(graph, "BROADCAST_EDGES", most)
    g = graph.fold(df)
    assert g.names.count() > 20 and g.links.count() < len(links) and (g.shared is None) == (most == 40 and g.links.count() > 40)
    nodes = sorted({v for link in links for v in link})
    sources = spark.createDataFrame([(v,) for v in [*nodes, "nowhere"]], "src string")
    pairs = {(a, b) for a, s in reach.items() for b in s}
    assert {r.src: r.n for r in graph.closure_sizes(df, sources).collect()} == {**{v: len(reach.get(v, ())) for v in nodes}, "nowhere": 0}
    assert {r.src: r.n for r in graph.closure_sizes(df, sources, back=True).collect()} == {**{v: sum(v in s for s in reach.values()) for v in nodes}, "nowhere": 0}
    assert sorted(map(tuple, graph.closure(df, sources).collect())) == sorted(pairs)
    some = spark.createDataFrame([(a, b) for a in nodes[::3] for b in nodes[::2]], "a string, b string")
    assert {tuple(r) for r in graph.reachable(df, some, "a", "b").collect()} == {(a, b) for a in nodes[::3] for b in nodes[::2]} & pairs
    for roots in (["a00"], ["a01", "a07", "z01", "nowhere"], ["v0", "v1"], nodes):
        start = spark.createDataFrame([(v,) for v in roots], "src string")
        assert sorted(r.dst for r in graph.reached(df, start).collect()) == sorted({b for a, b in pairs if a in roots})
    sets = [(0, ["a00", "a01", "a01"]), (1, ["z01", "z02", "z03"]), (2, ["a02", "z01", "z05", "nowhere"]), (3, nodes)]
    expected = [(i, len({*roots, *(w for v in roots for w in reach.get(v, ()))})) for i, roots in sets]
    assert sorted(map(tuple, graph.union_sizes(df, spark.createDataFrame(sets, "set_id long, roots array<string>")).collect())) == expected


def test_components_beyond_the_budget_are_searched_once_trimmed(spark, monkeypatch):
    """Long rings among many links that lead nowhere: one search after a trim, not a round of joins per step of a ring."""
    rings = [(f"r{k}:{i:03}", f"r{k}:{(i + 1) % 300:03}") for k in range(2) for i in range(300)]
    df = spark.createDataFrame([*rings, *((f"c{i}", "r0:000") for i in range(900)), *(("r1:000", f"z{i}") for i in range(900)), ("s", "s")], "src string, dst string")
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 700)
    monkeypatch.setattr(graph, "join_components", None)
    monkeypatch.setattr(analyses, "join_shortest_cycles", None)
    scc = graph.components(df)
    assert sorted(map(tuple, scc.collect())) == sorted([*((a, a[:3] + "000") for a, _ in rings), ("s", "s")])
    assert sorted((r.scc, r.length) for r in analyses.shortest_cycles(df, scc).collect()) == [("r0:000", 300), ("r1:000", 300), ("s", 1)]


def left_behind(spark):
    """A weak reference to an object of the driver's JVM that only a Python object refers to, in a cycle that Python's collector has to find."""
    gc.collect()
    cycle = [spark._jvm.java.lang.Object()]
    cycle.append(cycle)
    return spark._jvm.java.lang.ref.WeakReference(cycle[0])


def test_what_is_left_behind_goes_before_a_folded_graph_is_searched(spark, monkeypatch):
    monkeypatch.setattr(graph, "FOLD_EDGES", 0)
    df = spark.createDataFrame(folding_links(1), "src string, dst string")
    ref = left_behind(spark)
    graph.fold(df)
    assert ref.get() is None


def test_pairs_of_sources_alike_are_many_tasks_work(spark, monkeypatch):
    links = [*((f"a{i:02}", "m0") for i in range(40)), *((f"m{i}", f"m{i + 1}") for i in range(5))]
    monkeypatch.setattr(graph, "FOLD_EDGES", 0)
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 20)
    monkeypatch.setattr(graph, "ALIKE", 4)
    df = spark.createDataFrame(links, "src string, dst string")
    rows = graph.closure(df, df.select("src")).selectExpr("src", "dst", "spark_partition_id() as task").collect()
    assert sorted((r.src, r.dst) for r in rows) == sorted((a, b) for a, s in search(links).items() for b in s)
    assert len({r.task for r in rows if r.src.startswith("a")}) > 3


def test_symbol_rounds_leave_nothing_behind(spark, monkeypatch):
    """Each round by joins lets the driver drop what it held; the verdict at the end of a chain is as before."""
    calls = []
    monkeypatch.setattr(symbols, "tidy", calls.append)
    kinds = "module string, ord long, kind string, name string, local string, imported string, src string, type_only boolean"
    chain = [(f"m{i}", 0, "named", "x", None, "x", f"m{i + 1}", False) for i in range(4)]
    exports = spark.createDataFrame([*chain, ("m4", 0, "local", "x", "x", None, None, False)], kinds)
    modules = spark.createDataFrame([(f"m{i}",) for i in range(5)], "path string")
    found = symbols.join_resolve(spark.createDataFrame([("m0", "x")], "module string, name string"), modules, exports).collect()
    assert [(r.verdict, r.def_module, r.def_name) for r in found] == [("definition", "m4", "x")]
    assert len(calls) >= 10  # five rounds each way


@pytest.mark.parametrize("seed", [6, 7])
def test_symbols_narrowed_to_what_seeds_lead_to_agree(spark, monkeypatch, seed):
    r = random.Random(seed)
    exports = [(f"m{i}", 0, "star", None, None, None, f"m{r.randrange(4)}") for i in range(4)] + [(f"m{i}", 1, "named", "x", None, "y", f"m{r.randrange(4)}") for i in (0, 1)] + [(f"m{i}", 2, "local", "y", "y", None, None) for i in (2, 3)]
    exports += [(f"far{i}", 0, "local", "x", "x", None, None) for i in range(40)]
    exports = spark.createDataFrame(exports, "module string, ord long, kind string, name string, local string, imported string, src string")
    modules = spark.createDataFrame([(m,) for m in [*(f"m{i}" for i in range(4)), *(f"far{i}" for i in range(40))]], "path string")
    seeds = spark.createDataFrame([(f"m{i}", n) for i in range(5) for n in ("x", "y", "z")], "module string, name string")
    pick = lambda df: sorted((tuple(row) for row in df.collect()), key=str)
    expected = pick(symbols.resolve(seeds, modules, exports))
    monkeypatch.setattr(symbols, "BROADCAST_EXPORTS", 30)  # of 92 rows; 12 are led to
    assert pick(symbols.resolve(seeds, modules, exports)) == expected
    monkeypatch.delattr(symbols, "join_resolve")
    assert pick(symbols.resolve(seeds, modules, exports, narrow=True)) == expected


@pytest.mark.parametrize("most", [0, 100_000])
def test_links_led_to_have_the_same_closures(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "FOLD_EDGES", most)
    links = random_links(9) + [(f"only{i}", f"v{i % 9}") for i in range(30)]
    df = spark.createDataFrame(links, "src string, dst string")
    starts = spark.createDataFrame([("v1",), ("only3",), ("none",)], "src string")
    fewer = graph.led_to(df, starts)
    expected = search(links)
    for found in (graph.closure(fewer, starts), graph.join_closure(fewer, starts)):
        assert sorted(map(tuple, found.collect())) == sorted((s, d) for s in ("v1", "only3") for d in expected.get(s, ()))
    assert {s for s, _ in fewer.collect() if s.startswith("only")} == ({"only3"} if most == 0 else {f"only{i}" for i in range(30)})


def test_encoded_tables_are_computed_once(spark):
    m = Model(spark, "/root/testdata/sf0.001")
    again = m.links.join(m.links.selectExpr("dst as src").unionByName(m.sites.select("module").toDF("src")), "src", "left_semi")
    for df in (again, m.sites.join(m.bindings, ["module", "ord"]), graph.references(m.imports, m.exports)):
        leaves = df._jdf.queryExecution().withCachedData().collectLeaves().iterator()
        names = set()
        while leaves.hasNext():
            names.add(leaves.next().nodeName())
        assert names <= {"LogicalRDD", "InMemoryRelation"}
    m.release()
