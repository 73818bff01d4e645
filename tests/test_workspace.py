import json

from pyspark.sql import functions as F

from modweave.api import Analysis
from modweave.cli import main
from modweave.sources.config import Config, Resolve
from modweave.sources.workspace import Workspace

PURE = {
    "src/main.ts": "import { alpha } from './lib';\nconsole.log(alpha);\n",
    "src/lib/index.ts": "export { alpha } from './alpha';\nexport { beta } from './beta';\nexport { gamma } from './gamma';\nexport { delta } from './delta';\nexport { epsilon } from './epsilon';\n",
    **{f"src/lib/{n}.ts": f"export const {n} = 1;\n" for n in ("alpha", "beta", "gamma", "delta", "epsilon")},
    "package.json": '{"name": "pure"}',
}


def test_pure_barrel(spark):
    a = Analysis.from_workspace(Workspace.from_files(spark, PURE, Config(entrypoints=["src/main.ts"])))
    site = a.costs.first()
    assert (site.actual_cost, site.minimal_cost, site.excess, site.amplification, site.fully_rewritable) == (6, 1, 5, 6.0, True)
    assert a.edges.count() == 6 and a.barrels.first().kind == "pure"
    p = a.projection().first()
    assert (p.before, p.after) == (7, 2)
    assert a.dead_exports().count() == 4
    assert a.fan("in").where("path = 'src/lib/alpha.ts'").first()[1:] == (1, 2)
    r = a.report()
    assert r["summary"]["modules"] == 7 and r["sites"][0]["actualCost"] == 6
    for f in ("json", "dot", "mermaid", "html", "terminal"):
        assert a.render(f)


def test_html_draws_few_nodes_but_tells_all(spark):
    more = {p.replace("src/", "more/"): t for p, t in PURE.items() if p.startswith("src/")}
    a = Analysis.from_workspace(Workspace.from_files(spark, PURE | more, Config(entrypoints=["src/main.ts", "more/main.ts"])))
    data = json.loads(a.render("html", most=2).split('id="data">')[1].split("</script>")[0])
    assert [n["label"] for n in data["nodes"]] == ["more", "src"]
    assert {b["barrel"] for b in data["barrels"]} == {"src/lib/index.ts", "more/lib/index.ts"}
    assert data["summary"]["deadExports"] == a.dead_exports().count() == 8


def test_plan_is_applied_and_stable(spark, tmp_path):
    for p, t in PURE.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    assert main(["--root", str(tmp_path), "fix", "--check"], spark) == 1
    assert main(["--root", str(tmp_path), "fix", "--write"], spark) == 0
    assert (tmp_path / "src/main.ts").read_text() == "import { alpha } from './lib/alpha';\nconsole.log(alpha);\n"
    assert main(["--root", str(tmp_path), "fix", "--check"], spark) == 0


def test_resolution_kinds(spark):
    w = Workspace.from_files(
        spark,
        {
            "src/a.ts": "import fs from 'fs'; import 'node:x'; import b from './b.js'; import c from '@/c'; import l from 'lodash/x'; import no from './gone'; import z from 'zed';",
            "src/b.ts": "export default 1",
            "src/lib/c/index.tsx": "export default 1",
            "node_modules/lodash/package.json": "{}",
            "tsconfig.json": '{ /* c */ "compilerOptions": { "baseUrl": ".", "paths": { "@/*": ["src/lib/*"], }, } }',
        },
    )
    found = {r.specifier: (r.kind, r.path or r.package) for r in w.resolutions.collect()}
    assert found == {
        "fs": ("builtin", None),
        "node:x": ("builtin", None),
        "./b.js": ("internal", "src/b.ts"),
        "@/c": ("internal", "src/lib/c/index.tsx"),
        "lodash/x": ("external", "lodash"),
        "./gone": ("unresolved", None),
        "zed": ("unresolved", None),
    }
    assert [r.specifier for r in w.unresolved.collect()] == ["./gone", "zed"]


def test_alias_with_several_targets(spark):
    w = Workspace.from_files(
        spark,
        {
            "a.ts": "import x from '@/x'; import y from '@/y'; import z from '@/z';",
            "gen/x.ts": "export default 1",
            "src/x.ts": "export default 1",
            "src/y.ts": "export default 1",
            "old/z.ts": "export default 1",
            "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["gen/*", "src/*", "old/*"]}}}',
        },
    )
    assert {r.specifier: (r.kind, r.path) for r in w.resolutions.collect()} == {"@/x": ("internal", "gen/x.ts"), "@/y": ("internal", "src/y.ts"), "@/z": ("internal", "old/z.ts")}
    assert sorted((r.nth, r.target) for r in w.aliases.collect()) == [(0, "gen/*"), (1, "src/*"), (2, "old/*")]


def test_alias_rules_hold_for_their_own_package(spark):
    one = lambda p: {f"{p}/package.json": "{}", f"{p}/a.ts": "import x from '@/x'; import o from '@/only';", f"{p}/src/x.ts": "export default 1", f"{p}/tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}'}
    w = Workspace.from_files(spark, {"package.json": "{}", **one("p"), **one("q"), "q/src/only.ts": "export default 1"})
    found = {(r.importer, r.specifier): (r.kind, r.path) for r in w.resolutions.collect()}
    assert found == {
        ("p/a.ts", "@/x"): ("internal", "p/src/x.ts"),
        ("p/a.ts", "@/only"): ("unresolved", None),
        ("q/a.ts", "@/x"): ("internal", "q/src/x.ts"),
        ("q/a.ts", "@/only"): ("internal", "q/src/only.ts"),
    }


def resolved(w):
    return {(r.importer, r.specifier): (r.kind, r.path or r.package) for r in w.resolutions.collect()}


CONDITIONED = {
    "package.json": "{}",
    "packages/app/src/main.ts": "import { a } from '@fixture/lib'; import { h } from '@fixture/lib/helper'; import no from '@fixture/lib/hidden';",
    "packages/app/package.json": '{"name": "app"}',
    "packages/lib/package.json": '{"name": "@fixture/lib", "exports": {".": {"@fixture/source": "./src/index.ts", "import": "./dist/index.js", "default": "./dist/index.js"}, "./*": {"node": "./gone/*.ts", "default": "./src/*.ts"}, "./hidden": null}}',
    "packages/lib/src/index.ts": "export const a = 1",
    "packages/lib/src/helper.ts": "export const h = 1",
    "packages/lib/src/hidden.ts": "export default 1",
}


def test_export_conditions(spark):
    main = "packages/app/src/main.ts"
    for conditions, kind in (([], ("unresolved", None)), (["@fixture/source"], ("internal", "packages/lib/src/index.ts")), (["some-other"], ("unresolved", None))):
        found = resolved(Workspace.from_files(spark, CONDITIONED, Config(resolve=Resolve(conditions=conditions))))
        assert found[main, "@fixture/lib"] == kind
        assert found[main, "@fixture/lib/helper"] == ("internal", "packages/lib/src/helper.ts")


def test_packages_by_main_fields_and_below(spark):
    w = Workspace.from_files(
        spark,
        {
            "package.json": "{}",
            "app/a.ts": "import x from 'one'; import y from 'one/lib/deep'; import z from 'two'; import i from 'three'; import e from 'held/x'; import o from 'one/none';",
            "one/package.json": '{"name": "one", "main": "./main.js", "module": "./esm"}',
            "one/main.ts": "export default 1",
            "one/esm/index.ts": "export default 1",
            "one/lib/deep.ts": "export default 1",
            "two/package.json": '{"name": "two", "exports": "./src/two.js"}',
            "two/src/two.ts": "export default 1",
            "three/package.json": '{"name": "three"}',
            "three/index.tsx": "export default 1",
            "app/node_modules/held/package.json": '{"name": "held", "exports": {"./x": "./x.js"}}',
            "app/node_modules/held/x.js": "",
            "held/package.json": '{"name": "held"}',
        },
    )
    found = {s: v for (_, s), v in resolved(w).items()}
    assert found == {
        "one": ("internal", "one/esm/index.ts"),
        "one/lib/deep": ("internal", "one/lib/deep.ts"),
        "one/none": ("unresolved", None),
        "two": ("internal", "two/src/two.ts"),
        "three": ("internal", "three/index.tsx"),
        "held/x": ("external", "held"),
    }


def test_inherited_and_referenced_tsconfig(spark):
    w = Workspace.from_files(
        spark,
        {
            "package.json": "{}",
            "tsconfig.json": '{"extends": ["./base/first", "./base/second.json"], "compilerOptions": {}, "references": [{"path": "./tsconfig.app.json"}]}',
            "tsconfig.app.json": '{"compilerOptions": {"paths": {"#app/*": ["app/*"], "#one": ["app/never"]}}, "extends": "./tsconfig.json"}',
            "base/first.json": '{"compilerOptions": {"paths": {"@/*": ["wrong/*"]}, "baseUrl": "../shared"}}',
            "base/second.json": '{"extends": "@cfg/strict", "compilerOptions": {"paths": {"@/*": ["x/*"], "#one": ["one"]}}}',
            "node_modules/@cfg/strict/tsconfig.json": '{"compilerOptions": {"baseUrl": "."}}',
            "lib/package.json": "{}",
            "lib/l.ts": "import a from '@/a'; import b from '#app/b'; import c from '#one'",
            "node_modules/@cfg/strict/x/a.ts": "",
            "shared/x/a.ts": "export default 1",
            "app/b.ts": "export default 1",
            "shared/one.ts": "export default 1",
            "node_modules/@cfg/strict/one.ts": "",
        },
    )
    # the later of two extended ones wins with all that it extends, so its baseUrl is the package's
    assert resolved(w) == {("lib/l.ts", "@/a"): ("external", "node_modules/@cfg/strict/x/a.ts"), ("lib/l.ts", "#app/b"): ("internal", "app/b.ts"), ("lib/l.ts", "#one"): ("external", "node_modules/@cfg/strict/one.ts")}


def test_nested_ignore_files_and_negation(spark):
    w = Workspace.from_files(
        spark,
        {
            ".gitignore": "gen/*\n!gen/keep.ts\n*.tmp.ts\n/only.ts\n\n# no rule\nbuilt/\n",
            "gen/a.ts": "",
            "gen/keep.ts": "",
            "gen/deep/keep.ts": "",
            "src/x.tmp.ts": "",
            "src/important.tmp.ts": "",
            "only.ts": "",
            "src/only.ts": "",
            "src/.gitignore": "!important.tmp.ts\nlocal\n/here.ts",
            "src/local/a.ts": "",
            "src/deep/local": "",
            "src/here.ts": "",
            "src/deep/here.ts": "",
            "other/local/a.ts": "",
            "built.ts": "",
            "x/built/a.ts": "",
            "x/built.ts/b.ts": "",
        },
    )
    assert sorted(r.path for r in w.sources.select("path").collect()) == ["built.ts", "gen/keep.ts", "other/local/a.ts", "src/deep/here.ts", "src/important.tmp.ts", "src/only.ts", "x/built.ts/b.ts"]


def test_packages_and_kind(spark):
    w = Workspace.from_files(
        spark,
        {
            "package.json": '{"workspaces": ["p/*"]}',
            "p/ui/package.json": '{"name": "@x/ui", "sideEffects": false, "exports": {".": {"import": "./src/index.js"}, "./d/*": "./src/d/*"}}',
            "p/ui/src/index.ts": "export const a = 1",
            "p/ui/src/d/e.ts": "export const b = 1",
            "p/bad/package.json": "{ nonsense",
            ".gitignore": "ignored/\n",
            "ignored/x.ts": "",
            "dist/y.ts": "",
        },
    )
    rows = {r.root: r for r in w.packages.collect()}
    assert set(rows) == {"", "p/ui", "p/bad"} and rows["p/ui"].side_effects_false and not rows["p/bad"].side_effects_false
    assert rows["p/ui"].public_entrypoints == ["p/ui/src/d/e.ts", "p/ui/src/index.ts"]
    assert w.kind == "npmWorkspaces"
    assert sorted(r.path for r in w.sources.select("path").collect()) == ["p/ui/src/d/e.ts", "p/ui/src/index.ts"]
    assert w.fingerprint == w.fingerprint


def test_cycles_shortest_path(spark):
    w = Workspace.from_files(spark, {"a.ts": "import './b'", "b.ts": "import './a'", "w.ts": "import './x'", "x.ts": "import './y'; import './z'", "y.ts": "import './z'", "z.ts": "import './w'", "s.ts": "import './s'"})
    rows = [(r["size"], r.path) for r in Analysis.from_workspace(w).cycles().collect()]
    assert rows == [(4, ["w.ts", "x.ts", "z.ts", "w.ts"]), (2, ["a.ts", "b.ts", "a.ts"]), (1, ["s.ts", "s.ts"])]


def test_star_collision_and_namespaces(spark):
    w = Workspace.from_files(
        spark,
        {
            "l.ts": "export const shared = 1, onlyLeft = 2",
            "r.ts": "export const shared = 1, onlyRight = 2",
            "i.ts": "export * from './l'; export * from './r'; export { missing } from './nowhere'",
            "alias.ts": "import { onlyLeft } from './i'; export { onlyLeft as renamed }",
            "m.ts": "import { shared, onlyLeft } from './i'; import * as ns from './i'; import { renamed } from './alias'",
        },
    )
    v = {(r.module, r.name): (r.verdict, r.def_module, r.def_name) for r in Analysis.from_workspace(w).verdicts.collect()}
    assert v["i.ts", "shared"][0] == "ambiguous"
    assert v["i.ts", "onlyLeft"] == ("definition", "l.ts", "onlyLeft")
    assert v["alias.ts", "renamed"] == ("definition", "l.ts", "onlyLeft")
    assert v["i.ts", "missing"][0] == "notFound"


def test_empty_workspace(spark):
    a = Analysis.from_workspace(Workspace.from_files(spark, {"README.md": "x"}))
    assert a.report()["summary"]["modules"] == 0


def test_byte_spans(spark):
    w = Workspace.from_files(spark, {"a.ts": "/* é */ import { b } from './b'"})
    row = w.import_facts.first()
    assert (row.start, row.end) == (9, 32)
    assert w.import_facts.where(F.col("type_only")).count() == 0
