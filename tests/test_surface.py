"""Configuration, renderers, streaming."""

import json

import pytest

from modweave.functions import render
from modweave.sources.config import ConfigError, load
from modweave.streaming.watch import watch

NODES = [{"id": "m0", "label": 'a/"x".ts', "is_barrel": True, "in_cycle": True}, {"id": "m1", "label": "y.ts", "is_barrel": False, "in_cycle": False}]
EDGES = [{"src": "m0", "dst": "m1", "kind": "reExport"}, {"src": "m1", "dst": "m0", "kind": "typeOnly"}]


def test_config(tmp_path):
    file = tmp_path / "c.toml"
    file.write_text('entrypoints = ["a.ts"]\n[barrel]\nreexport_ratio = 0.5\n')
    c = load(str(file))
    assert c.entrypoints == ["a.ts"] and c.barrel.reexport_ratio == 0.5 and c.barrel.max_own_decls == 2
    assert load(None, str(tmp_path / "none.toml")).thresholds.max_cycles == 0
    for text in ("unknown = 1", "[barrel]\nx = 1", "= broken"):
        file.write_text(text)
        with pytest.raises(ConfigError):
            load(str(file))
    with pytest.raises(ConfigError):
        load(str(tmp_path / "none.toml"))


def test_dot_and_mermaid():
    dot, mermaid = render.to_dot(NODES, EDGES), render.to_mermaid(NODES, EDGES)
    assert 'label="\\"x\\".ts", shape=box, color="#d33"' in dot and '"m0" -> "m1" [style=bold]' in dot and "cluster_1" in dot
    assert "m0 ==> m1" in mermaid and "m1 -.-> m0" in mermaid and "class m0 cycle" in mermaid and "linkStyle 1" in mermaid


def test_html_is_safe():
    page = render.to_html({"summary": {"modules": 1}, "barrels": [{"barrel": "</script><b>\u2028"}]}, NODES, EDGES)
    assert "</script><b>" not in page and "\u2028" not in page
    data = page.split('id="data">')[1].split("</script>")[0]
    assert json.loads(data)["barrels"][0]["barrel"] == "</script><b>\u2028"


def test_table_counts_the_rest():
    text = render.table("T", ["a", "b"], [[i, 1.25] for i in range(25)])
    assert "+5 more" in text and "1.2×" in text and len(text.splitlines()) == 24
    assert render.percent(1, 3) == "33%" and render.percent(1, 0) == "0%"


def test_watch_recomputes_per_change(spark, tmp_path):
    calls = []
    folder, schema = str(tmp_path / "in"), "path string, hash long"
    for k in range(2):
        spark.createDataFrame([(f"a{k}", k)], schema).write.mode("append").parquet(folder)
        watch(spark, folder, schema, lambda s: calls.append(1), str(tmp_path / "state"), once=True).awaitTermination(120)
    assert len(calls) == 2
