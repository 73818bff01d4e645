"""Small workspaces with the numbers that a whole report has to give for them, side by side in one tree."""

import pytest

from modweave.api import Analysis
from modweave.sources.config import Config
from modweave.sources.workspace import Workspace

TREES = {
    "plain": {
        "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"~/*": ["lib/*"]}}}',
        "package.json": '{"name": "plain"}',
        "lib/sum.ts": "export function sum(a: number, b: number): number {\n  return a + b;\n}\n",
        "lib/hail.ts": "export function hail(who: string): string {\n  return `hail ${who}`;\n}\n",
        "lib/start.ts": "import { sum } from './sum';\nimport { hail } from '~/hail';\nimport { readFile } from 'node:fs/promises';\n\nexport const total = sum(1, 2);\nexport const words = hail('all');\nexport const read = readFile;\n",
    },
    "pure": {
        "start.ts": "import { ant } from './zoo';\nexport const used = ant;\n",
        "zoo/index.ts": "".join(f"export {{ {n} }} from './{n}';\n" for n in ("ant", "bee", "cat", "dog", "elk")),
        **{f"zoo/{n}.ts": f"export const {n} = '{n}';\n" for n in ("ant", "bee", "cat", "dog", "elk")},
    },
    "nested": {
        "start.ts": "import { red } from './x';\nexport const used = red;\n",
        "x/index.ts": "export * from './y';\n",
        "x/y/index.ts": "export * from './z';\n",
        "x/y/z/index.ts": "export { red } from './red';\nexport { green } from './green';\nexport { blue } from './blue';\n",
        **{f"x/y/z/{n}.ts": f"export const {n} = 1;\n" for n in ("red", "green", "blue")},
    },
    "renames": {
        "start.ts": "import { Last } from './index';\nexport const used = Last;\n",
        "index.ts": "export { Middle as Last } from './deep';\n",
        "deep/index.ts": "export { First as Middle } from './impl';\n",
        "deep/impl.ts": "export const First = 'first';\n",
    },
    "effects": {
        "start.ts": "import { seen } from './index';\nexport const used = seen;\n",
        "index.ts": "export { seen } from './seen';\nexport { unseen } from './unseen';\n\nconsole.log('loaded');\n",
        "seen.ts": "export const seen = 1;\n",
        "unseen.ts": "export const unseen = 1;\n",
    },
    "bare": {
        "start.ts": "import './parts/index';\n\nexport async function go() {\n  await import('./parts/index');\n}\n",
        "parts/index.ts": "export { P } from './p';\nexport { Q } from './q';\nexport { R } from './r';\n",
        **{f"parts/{n.lower()}.ts": f"export class {n} {{\n  readonly name = '{n}';\n}}\n" for n in "PQR"},
    },
    "types": {
        "start.ts": "import type { Person } from './kinds';\nimport { FIRST, type Rank } from './kinds';\nimport { help } from './help';\n\nexport type { Person };\nexport const rank: Rank = FIRST;\nexport const given = help();\n",
        "kinds.ts": "export interface Person {\n  id: string;\n}\nexport type Rank = 'one' | 'two';\nexport const FIRST: Rank = 'one';\n",
        "help.ts": "export function help(): number {\n  return 1;\n}\n",
    },
    "typed": {
        "start.ts": "import { Shape, load } from './api';\n\nexport const shape: Shape = load();\n",
        "api/index.ts": "export type { Shape } from './models/Shape';\nexport type { Other } from './models/Other';\nexport { load } from './load';\n",
        "api/load.ts": "import type { Shape } from './models/Shape';\nimport { get } from './get';\n\nexport function load(): Shape {\n  return get<Shape>('shape');\n}\n",
        "api/get.ts": "export function get<T>(path: string): T {\n  return { path } as unknown as T;\n}\n",
        "api/models/Shape.ts": "export type Shape = { id: string };\n",
        "api/models/Other.ts": "export type Other = { name: string };\n",
    },
    "clash": {
        "start.ts": "import { both, west, here } from './index';\nexport const all = [both, west, here];\n",
        "index.ts": "export * from './west';\nexport * from './east';\nexport const here = 1;\n",
        "west.ts": "export const both = 'w';\nexport const west = 1;\n",
        "east.ts": "export const both = 'e';\nexport const east = 2;\n",
        "over.ts": "export * from './west';\nexport const both = 'own';\n",
    },
    "lost": {
        "start.ts": "import { here } from './here';\nimport { no } from './nowhere';\nimport never from 'not-there';\nexport const all = [here, no, never];\n",
        "here.ts": "export const here = 1;\n",
    },
    "broken": {"bad.ts": "export const x = `open\n", "good.ts": "export const y = 1;\n"},
    "loops": {
        "a.ts": "import './b';\n",
        "b.ts": "import './a';\n",
        "w.ts": "import './x';\n",
        "x.ts": "import './y';\nimport './z';\n",
        "y.ts": "import './z';\n",
        "z.ts": "import './w';\n",
        "alone.ts": "export const alone = 1;\n",
    },
}

# modules, edges, classified barrels, imported barrels, dead exports, of which with low confidence
COUNTS = {
    "plain": (3, 2, 0, 0, 3, 0),
    "pure": (7, 6, 1, 1, 5, 0),
    "nested": (7, 6, 3, 1, 3, 2),
    "renames": (4, 3, 2, 1, 1, 0),
    "effects": (4, 3, 1, 1, 2, 0),
    "bare": (5, 5, 1, 1, 4, 3),
    "types": (3, 3, 0, 0, 2, 0),
    "clash": (5, 4, 0, 0, 5, 3),
    "lost": (2, 1, 0, 0, 1, 0),
    "loops": (7, 7, 0, 0, 1, 0),
}


@pytest.fixture(scope="module")
def tree(spark):
    files = {"package.json": "{}", **{f"{name}/{path}": text for name, some in TREES.items() for path, text in some.items()}}
    return Analysis.from_workspace(Workspace.from_files(spark, files, Config()))


@pytest.fixture(scope="module")
def report(tree):
    return tree.report()


@pytest.mark.parametrize("name", sorted(COUNTS))
def test_counts(report, name):
    own = lambda rows, key: [r for r in rows if r[key].startswith(f"{name}/")]
    path = {m["id"]: m["path"] for m in report["modules"]}
    modules, dead = own(report["modules"], "path"), own(report["deadExports"], "module")
    edges = [e for e in report["edges"] if path[e["src"]].startswith(f"{name}/")]
    classified = sum(m["barrel"] is not None for m in modules)
    got = (len(modules), len(edges), classified, len(own(report["barrels"], "barrel")), len(dead), sum(d["lowConfidence"] for d in dead))
    assert got == COUNTS[name]


def test_sites(report):
    site = lambda s: (s["actualCost"], s["minimalCost"], s["excess"], s["amplification"], s["rewritable"], s["skipped"])
    of = lambda name: [site(s) for s in report["sites"] if s["module"].startswith(f"{name}/")]
    assert of("pure") == [(6, 1, 5, 6.0, 1, 0)]
    assert of("nested") == [(6, 1, 5, 6.0, 1, 0)]
    assert of("renames") == [(3, 1, 2, 3.0, 1, 0)]
    assert of("effects") == [(3, 1, 2, 3.0, 0, 1)]
    assert of("bare") == [(4, 4, 0, 1.0, 0, 0)] * 2
    assert {"reason": "barrelHasSideEffects", "n": 1} in report["skipCounts"]
    excess = [s["excess"] for s in report["sites"]]
    assert excess == sorted(excess, reverse=True) and all(s["amplification"] >= 1 for s in report["sites"])


def test_the_rest_of_the_report(report):
    assert [(c["size"], c["path"]) for c in report["cycles"]] == [(4, ["loops/w.ts", "loops/x.ts", "loops/z.ts", "loops/w.ts"]), (2, ["loops/a.ts", "loops/b.ts", "loops/a.ts"])]
    assert [(u["importer"], u["specifier"]) for u in report["unresolved"]] == [("lost/start.ts", "./nowhere"), ("lost/start.ts", "not-there")]
    assert [f["path"] for f in report["failures"]] == ["broken/bad.ts"] and report["failures"][0]["errors"][0] == report["failures"][0]["message"]
    assert {p["root"]: p["name"] for p in report["workspace"]["packages"]} == {"": None, "plain": "plain"} and report["workspace"]["kind"] == "single"
    assert [m["id"] for m in report["modules"]] == [f"m{i}" for i in range(len(report["modules"]))]
    edges = [(e["src"], e["dst"]) for e in report["edges"]]
    assert edges == sorted(edges)
    low = {(d["module"], d["name"]) for d in report["deadExports"] if d["lowConfidence"] and d["module"].startswith("clash/")}
    assert low == {("clash/west.ts", "both"), ("clash/east.ts", "both"), ("clash/east.ts", "east")}
    s = report["summary"]
    assert (s["filesAnalyzed"], s["packages"], s["unresolvedSpecifiers"], s["parseFailures"], s["cycles"]) == (sum(p.endswith(".ts") for t in TREES.values() for p in t), 2, 2, 1, 2)
    assert (s["classifiedBarrels"], s["importedBarrels"]) == (sum(c[2] for c in COUNTS.values()) + 1, sum(c[3] for c in COUNTS.values()) + 1)  # and that of "typed"
    assert s["deadExports"] == len(report["deadExports"]) and s["edges"] == len(report["edges"])


def test_projections_and_fan(tree, spark):
    before = {r.entrypoint: (r.before, r.after, r.removed) for r in tree.projection(["pure/start.ts", "nested/start.ts", "typed/start.ts", "gone.ts"]).collect()}
    assert before == {"pure/start.ts": (7, 2, 5), "nested/start.ts": (7, 2, 5), "typed/start.ts": (4, 3, 1)}
    typed = Analysis(spark, tree.modules, tree.imports, tree.bindings, tree.exports, tree.config, True, tree.locals, tree.workspace)
    assert [(r.before, r.after) for r in typed.projection(["typed/start.ts"]).collect()] == [(6, 4)]
    fan = {r.path: (r.direct, r.transitive) for r in tree.fan("in").collect()}
    assert fan["pure/zoo/ant.ts"] == (1, 2) and "typed/api/models/Shape.ts" not in fan
    assert typed.fan("in").where("path = 'typed/api/models/Shape.ts'").first().direct == 2


def test_renderers_tell_the_same(report, tree):
    from modweave.functions import render

    text = render.to_terminal(report)
    for title in ("Summary", "Unresolved", "Failures", "Barrels", "Worst imports", "Skipped symbols", "Cycles", "Dead exports", "Fan-in", "Fan-out"):
        assert f"{title}\n" in text
    assert "Entrypoints" not in text and "more" in text
    nodes, edges = tree.nodes(12)
    assert len(nodes) <= 12 and {n["id"][0] for n in nodes} == {"d"} and not edges  # the trees do not refer to each other
    assert [r.barrel for r in tree.warnings().collect()] == ["nested/x/index.ts", "pure/zoo/index.ts"]


def generated(spark, total=6000):
    """An application of many modules behind one barrel, as tables: clients that use two utilities each, hooks and components that import through the barrel, one entrypoint."""
    clients, utils, hooks = total * 8 // 100, total // 10, total * 7 // 100
    parts = total - clients - utils - hooks
    imports, exports = [], []

    def module(path, name, *wanted):
        exports.append((path, 0, "local", name, name, None, None, False))
        imports.extend((path, k, target, "named", False, what) for k, (target, what) in enumerate(wanted))

    for i in range(utils):
        module(f"utils/util{i}", f"util{i}")
    for i in range(clients):
        module(f"clients/client{i}", f"Client{i}", *[(f"utils/util{u}", f"util{u}") for u in (i % utils, (i * 7 + 3) % utils)])
        exports.append(("clients/index", i, "named", f"Client{i}", None, f"Client{i}", f"clients/client{i}", False))
    through = lambda i: ("clients/index", f"Client{i % clients}")
    for i in range(hooks):
        module(f"hooks/use{i}", f"use{i}", through(i))
    for i in range(parts):
        module(f"features/f{i % 40}/Part{i}", f"Part{i}", through(i), (f"hooks/use{i % hooks}", f"use{i % hooks}"))
    imports += [("main", i, f"features/f{i}/Part{i}", "named", False, f"Part{i}") for i in range(40)]
    paths = [e[0] for e in exports if e[0] != "clients/index"] + ["clients/index", "main"]
    return Analysis(
        spark,
        spark.createDataFrame([(p, False, int(p not in ("clients/index", "main"))) for p in paths], "path string, has_side_effects boolean, own_decls int"),
        spark.createDataFrame([i[:5] for i in imports], "module string, ord long, target string, kind string, type_only boolean"),
        spark.createDataFrame([(i[0], i[1], 0, i[5]) for i in imports], "module string, ord long, bord long, imported string"),
        spark.createDataFrame(exports, "module string, ord long, kind string, name string, local string, imported string, src string, type_only boolean"),
        Config(entrypoints=["main"]),
    )


def test_a_generated_application(spark):
    a = generated(spark)
    barrel = a.barrel_amplification().collect()
    assert [(b.barrel, b.site_count, b.actual_cost, b.total_excess, b.max_excess, b.max_amplification) for b in barrel] == [("clients/index", 4920, 1047, 5136480, 1044, 349.0)]
    assert [tuple(r) for r in a.projection().select("before", "after", "removed").collect()] == [(1128, 195, 933)]
    assert a.cycles().count() == 0 and a.modules.count() == 6002
