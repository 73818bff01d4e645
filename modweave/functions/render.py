"""Report renderers: JSON, DOT, Mermaid, HTML, terminal. They take plain dictionaries."""

from __future__ import annotations

import json
import re

# How edges of each kind are drawn.
DOT_STYLE = {"static": "solid", "dynamic": "dashed", "typeOnly": "dotted", "reExport": "bold", "sideEffectOnly": "solid"}
MERMAID_ARROW = {"reExport": "==>", "dynamic": "-.->", "typeOnly": "-.->", "static": "-->", "sideEffectOnly": "-->"}


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False) + "\n"


def _groups(nodes: list[dict]) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for n in nodes:
        out.setdefault(n["label"].rpartition("/")[0] or ".", []).append(n)
    return dict(sorted(out.items()))


def to_dot(nodes: list[dict], edges: list[dict]) -> str:
    """Nodes (id, label, is_barrel, in_cycle) in clusters by directory; edges (src, dst, kind)."""
    q = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines = ["digraph modules {", "  rankdir=LR;"]
    for k, (directory, members) in enumerate(_groups(nodes).items()):
        lines += [f"  subgraph cluster_{k} {{", f"    label={q(directory)};"]
        for n in members:
            colour = "#d33" if n["in_cycle"] else "#c80" if n["is_barrel"] else "#468"
            lines.append(f"    {q(n['id'])} [label={q(n['label'].rpartition('/')[2])}, shape={'box' if n['is_barrel'] else 'ellipse'}, color={q(colour)}];")
        lines.append("  }")
    lines += [f"  {q(e['src'])} -> {q(e['dst'])} [style={DOT_STYLE[e['kind']]}];" for e in edges]
    return "\n".join([*lines, "}"]) + "\n"


def to_mermaid(nodes: list[dict], edges: list[dict]) -> str:
    q = lambda s: '"' + s.replace('"', "&quot;") + '"'
    lines = ["flowchart LR"]
    for k, (directory, members) in enumerate(_groups(nodes).items()):
        lines.append(f"  subgraph g{k}[{q(directory)}]")
        lines += [f"    {n['id']}[{q(n['label'].rpartition('/')[2])}]" for n in members]
        lines.append("  end")
    lines += [f"  {e['src']} {MERMAID_ARROW[e['kind']]} {e['dst']}" for e in edges]
    lines += ["  classDef barrel stroke:#c80", "  classDef cycle stroke:#d33"]
    for name, flag in (("barrel", "is_barrel"), ("cycle", "in_cycle")):
        some = [n["id"] for n in nodes if n[flag] and not (name == "barrel" and n["in_cycle"])]
        if some:
            lines.append(f"  class {','.join(some)} {name}")
    typed = [str(i) for i, e in enumerate(edges) if e["kind"] == "typeOnly"]
    if typed:
        lines.append(f"  linkStyle {','.join(typed)} stroke-dasharray:2")
    return "\n".join(lines) + "\n"


def script_safe(value) -> str:
    """JSON that may stand inside a script element."""
    text = json.dumps(value, ensure_ascii=False)
    return re.sub("[<>&  ]", lambda m: f"\\u{ord(m[0]):04x}", text)


def to_html(report: dict, nodes: list[dict], edges: list[dict]) -> str:
    """One page without any outside resource; it carries only what it draws."""
    data = script_safe({"nodes": nodes, "edges": edges, "summary": report["summary"], "barrels": report["barrels"]})
    return f"""<!doctype html>
<html lang="en"><meta charset="utf-8"><title>Module graph</title>
<style>body{{font:14px sans-serif;margin:2em}}table{{border-collapse:collapse}}td,th{{padding:2px 8px;border-bottom:1px solid #ccc;text-align:left}}svg{{border:1px solid #ccc}}</style>
<h1>Module graph</h1><div id="summary"></div><svg id="graph" width="960" height="640"></svg><h2>Barrels</h2><table id="barrels"></table>
<script type="application/json" id="data">{data}</script>
<script>
const d = JSON.parse(document.getElementById("data").textContent), svg = document.getElementById("graph"), ns = "http://www.w3.org/2000/svg";
document.getElementById("summary").textContent = Object.entries(d.summary).map(([k, v]) => k + ": " + v).join(", ");
const at = {{}}, n = d.nodes.length;
d.nodes.forEach((x, i) => at[x.id] = [480 + 300 * Math.cos(6.2832 * i / n), 320 + 290 * Math.sin(6.2832 * i / n)]);
const add = (name, attributes) => {{ const e = document.createElementNS(ns, name); for (const k in attributes) e.setAttribute(k, attributes[k]); svg.append(e); return e; }};
d.edges.forEach(e => add("line", {{x1: at[e.src][0], y1: at[e.src][1], x2: at[e.dst][0], y2: at[e.dst][1], stroke: "#bbb"}}));
d.nodes.forEach(x => {{ const c = add("circle", {{cx: at[x.id][0], cy: at[x.id][1], r: 4, fill: x.in_cycle ? "#d33" : x.is_barrel ? "#c80" : "#468"}}); const t = document.createElementNS(ns, "title"); t.textContent = x.label; c.append(t); }});
const table = document.getElementById("barrels");
d.barrels.forEach(b => {{ const r = table.insertRow(); Object.values(b).forEach(v => r.insertCell().textContent = v); }});
</script></html>
"""


def table(title: str, head: list[str], rows: list[list], most: int = 20) -> str:
    """A text table of at most ``most`` rows; the rest is counted."""
    shown = [[f"{v:.1f}×" if isinstance(v, float) else str(v) for v in r] for r in rows[:most]]
    widths = [max(len(x) for x in column) for column in zip(head, *shown)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths)).rstrip()
    out = [title, line(head), line(["-" * w for w in widths]), *map(line, shown)]
    if len(rows) > most:
        out.append(f"+{len(rows) - most} more")
    return "\n".join(out) + "\n"


def percent(part: int, whole: int) -> str:
    return f"{100 * part / whole if whole else 0:.0f}%"


# What a reader sees of the summary, in order.
SUMMARY = {
    "filesAnalyzed": "files analyzed", "packages": "packages", "modules": "modules", "edges": "edges", "externalPackages": "external packages",
    "unresolvedSpecifiers": "unresolved specifiers", "cycles": "cycles", "deadExports": "dead exports",
}


def to_terminal(report: dict) -> str:
    """Tables of the report, those with rows; each is cut at its first rows and tells how many more there are."""
    worst = [s for s in report["sites"] if s["excess"] > 0]
    fan = lambda rows: [[f["path"], f["direct"], f["transitive"]] for f in rows]
    sections = [
        ("Summary", ["metric", "value"], [[label, report["summary"][key]] for key, label in SUMMARY.items()]),
        ("Unresolved", ["specifier", "imported from"], [[u["specifier"], u["importer"]] for u in report["unresolved"]]),
        ("Failures", ["file", "error"], [[f["path"], e] for f in report["failures"] for e in f["errors"]]),
        ("Barrels", ["barrel", "sites", "cost", "excess", "worst"], [[b["barrel"], b["siteCount"], b["actualCost"], b["totalExcess"], b["maxAmplification"]] for b in report["barrels"]]),
        ("Worst imports", ["importer", "barrel", "cost", "minimal"], [[s["module"], s["target"], s["actualCost"], s["minimalCost"]] for s in worst]),
        ("Skipped symbols", ["reason", "symbols"], [[s["reason"], s["n"]] for s in report["skipCounts"]]),
        ("Entrypoints", ["entrypoint", "before", "after", "removed"], [[e["entrypoint"], e["before"], e["after"], f"{e['removed']} ({percent(e['removed'], e['before'])})"] for e in report["entrypoints"]]),
        ("Cycles", ["size", "shortest"], [[c["size"], " -> ".join(c["path"])] for c in report["cycles"]]),
        ("Dead exports", ["module", "name", "confidence"], [[d["module"], d["name"], "low" if d["lowConfidence"] else "high"] for d in report["deadExports"]]),
        ("Fan-in", ["module", "direct", "transitive"], fan(report["fanIn"])),
        ("Fan-out", ["module", "direct", "transitive"], fan(report["fanOut"])),
    ]
    return "\n".join(table(*section) for section in sections if section[2])
