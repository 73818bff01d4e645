import pytest

from modweave.plans.codemod import apply_edits, render_import, rewritten
from modweave.sources.scan import scan

SOURCE = """#!/usr/bin/env node
'use client'
import React, { useState as us, type FC } from "react";
import * as ns from './ns'
import './side'
import type { T } from "./t"
import {} from './empty';
export * from './a'; export * as b from "./b"
export { x as y, type Z } from './c'
export { us as renamed }
export const { p, q: [r, ...s2], d = {a: 1} } = foo(), w = () => { return /a"b/g }
export default function () { return `t${ {a:`n${1}`} }x` }
type A<B> =
  | { k: "a" }
  | B
export interface I extends A<string> { a(): void }
async function f(a: {x: 1}): Promise<{y: 2}> { const m = await import("./dyn"); }
const el = <div>don't</div>
@dec({a: 1}) class K extends B { m() {} }
enum E { A }
"""


def test_everything_at_once():
    f = scan(SOURCE)
    assert [(i["specifier"], i["kind"], i["type_only"]) for i in f.imports] == [
        ("react", "default", False), ("./ns", "namespace", False), ("./side", "sideEffect", False), ("./t", "named", True), ("./empty", "named", False), ("./dyn", "dynamic", False),
    ]
    assert [(e["kind"], e["name"]) for e in f.exports] == [
        ("star", None), ("namespaceStar", "b"), ("named", "y"), ("named", "Z"), ("local", "renamed"), ("local", "p"), ("local", "r"), ("local", "s2"), ("local", "d"), ("local", "w"), ("default", "default"), ("local", "I"),
    ]
    assert (f.own_decls, f.has_side_effects, f.errors) == (12, False, [])


@pytest.mark.parametrize("source", ["foo()", "if (a) { }", "let a = 1\nfoo()", "a = 2"])
def test_side_effects(source):
    assert scan(source).has_side_effects


@pytest.mark.parametrize("source", ["", "'use strict'", "import a from 'b'", "export type X = { a: 1 }\nexport {}", "function f() { g() }", "const a = b\n  .c()\n  .d"])
def test_no_side_effects(source):
    assert not scan(source).has_side_effects


def test_broken_source_keeps_what_it_has():
    f = scan("import a from './a'\nexport const = ;{")
    assert f.imports and f.errors


def test_commented_and_quoted_imports_are_none():
    assert not scan("// import a from 'a'\n/* import b from 'b' */\nconst s = \"import c from 'c'\", t = `import d from 'd'`").imports


def test_render():
    assert render_import([("default", "D", False), ("a", "a", False), ("b", "c", False), ("T", "T", True)], "./x") == "import D, { a, b as c } from './x';\nimport type { T } from './x';"
    assert render_import([("default", "D", True), ("T", "T", True)], "./x", False) == "import type D from './x'\nimport type { T } from './x'"


def test_edits_are_bytes():
    assert apply_edits("é ab".encode(), [(3, 4, b"X"), (4, 5, b"Y")]) == "é XY".encode()


def test_merge_into_existing_import():
    content = b"import { a } from './lib';\nimport { b } from './lib/b';\n"
    plan = [{"start": 0, "end": 26, "bord": 0, "specifier": "./lib/b", "def_module": "lib/b.ts", "def_name": "a", "local": "a", "type_only": False, "anchor": ["./lib/b"]}]
    assert rewritten(content, plan) == b"import { b, a } from './lib/b';\n"
