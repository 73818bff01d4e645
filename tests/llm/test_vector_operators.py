"""Operators on vectors and chats against brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from modweave.llm import permutation_index, runtime
from modweave.llm.chat import Template, escape, format_chats, read_back, unescape
from modweave.llm.components import components
from modweave.llm.permutation_index import nearest
from modweave.llm.pstable import Projections, near_vectors, shape
from modweave.llm.tokens import NAME, vocabulary_path

SCHEMA = "vec_id long, embedding array<float>, label int, key long, rep string"


def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 32))
    near = base[:40] + rng.normal(scale=0.02, size=(40, 32))
    near[20:] *= 7  # length does not matter for the cosine
    crowd = base[0] + rng.normal(scale=0.03, size=(60, 32))
    rows = [(i, [float(np.float32(x)) for x in v], 0, 1, "r") for i, v in enumerate([*base, *near, *crowd, *base[:3]])]
    n = len(rows)
    odd = [None, [], [0.0] * 32, [math.nan] * 32, [math.inf] * 32, [None] * 32, [1.0, 2.0], [1e38] * 32, [1e-40] * 32]
    return rows + [(n + i, v, None, None, None) for i, v in enumerate(odd)] + [rows[7]]


@pytest.fixture(scope="module")
def rows():
    return vectors()


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(np.float32(x) for x in v)


@pytest.mark.parametrize("frequent", [1 << 18, 2])
def test_near_vectors(spark, table, rows, frequent, monkeypatch):
    monkeypatch.setattr(runtime, "FREQUENT", frequent)
    good = [i for i, r in enumerate(rows) if usable(r[1])]
    unit = {i: np.array(rows[i][1], np.float32).astype(float) for i in good}
    unit = {i: v / np.abs(v).max() for i, v in unit.items()}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = {i: {j for j in good if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9} for i in good}
    root = {i: rows[i][0] for i in range(len(rows))}
    for _ in range(10):
        for i in good:
            root[i] = min([root[i], *(root[j] for j in links[i])])
    expected = sorted((r[0], len(links.get(i, ())), root[i], r[0] == root[i]) for i, r in enumerate(rows))
    assert sorted(map(tuple, near_vectors(table).collect())) == expected
    assert near_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize("n", [500, 50_000, 1_000_000, 10_000_000])
def test_recall_at_the_threshold_is_held_at_every_size(n):
    """Pairs at cosine 0.9 against the projections and tables of a table of n vectors."""
    projections, tables = shape(n, 0.9, 0.99, 128)
    assert projections == max(8, math.ceil(math.log(n / 0.06) / -math.log(0.566))) and tables >= 128
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 1000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + math.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    p, met = Projections(64, tables, projections, 17), np.zeros(1000, bool)
    for first in range(0, tables, 64):
        met |= (p.keys(a, first, first + 64) == p.keys(b, first, first + 64)).any(axis=1)
    assert met.mean() >= 0.98


@pytest.mark.parametrize("indexed", [16, 0])
def test_nearest(spark, table, rows, indexed, monkeypatch):
    """Against brute force, for every length of vectors, with and without an index; other columns of the table clash with the operator's."""
    monkeypatch.setattr(permutation_index, "_INDEXED", indexed)
    more = [(1000 + i, [float(i % 3), 1.0 + i], 0, 1, "r") for i in range(12)] + [(2000, [5.0], 0, 1, "r")]
    more = table.union(spark.createDataFrame(more, table.schema)).withColumn("score", F.lit("x")).withColumn("dim", F.lit(1)).withColumn("near", F.lit(None).cast("string"))
    got = {}
    for r in nearest(more, every=10, k=5, share=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {r.vec_id: np.array(r.embedding, np.float32).astype(float) for r in more.collect() if usable(r.embedding)}
    assert set(got) == {i for i in good if i % 10 == 0 and i != 2000}
    for q, found in got.items():
        score = sorted(((-float(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:5]
        assert [i for _, i, _ in sorted(found)] == [i for _, i in score]
        assert [s for _, _, s in sorted(found)] == pytest.approx([-s for s, _ in score])
    assert nearest(table.limit(0)).count() == 0


def test_the_inverted_files_add_up_to_the_footrule():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, 16)), rng.normal(size=(7, 16))
    index = permutation_index.Permutations(permutation_index._apart(x, 20), float(np.sqrt((x * x).sum(axis=1).max())), 8)
    near, asked = index.nearest(x), index.nearest(y, query=True)
    files = permutation_index.Files(near, 20)
    place = lambda row, p: row.tolist().index(p) if p in row else len(row)
    foot = [[sum(abs(place(a, p) - place(b, p)) for p in range(20)) for b in near] for a in asked]
    for a, expected in zip(asked, foot):
        assert (8 * 9 - 2 * files.saved(a) == expected).all()
        assert sorted(np.array(expected)[files.candidates(a, 30)]) == sorted(expected)[:30]
    pivot = index.pivots
    for a, v in zip(near, x):  # nearest pivots by distance, in the space where all norms are equal
        extra = lambda z: np.sqrt(max(index.largest**2 - z @ z, 0))
        away = [(p @ p) + extra(p) ** 2 - 2 * (v @ p + extra(v) * extra(p)) for p in pivot]
        assert [away[k] for k in a] == pytest.approx(sorted(away)[:8])


def test_recall_with_its_own_parameters(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(9000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in nearest(table, every=100).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for q, ids in found.items():
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -9
        recall.append(len(ids & set(np.argsort(-s)[:20].tolist())) / 20)
    assert len(recall) == 90 and np.mean(recall) >= 0.9


def recall(spark, x, **given):
    """(query, share of its 20 nearest by score that nearest finds with its own parameters) of the rows of x."""
    x = x.astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in nearest(table, every=100, **given).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    out = []
    for q, ids in sorted(found.items()):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        least = np.partition(s, -20)[-20]
        assert len(set(ids)) == len(ids) == 20 and q not in ids
        out.append((q, (s[ids] >= least - 1e-9 * abs(least)).mean()))
    assert len(out) == -(-len(x) // 100)
    return np.array(out)


def test_recall_over_several_blocks_and_rows_of_one_id(spark):
    x = np.random.default_rng(5).normal(size=(30000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(spark, x)[:, 1].mean() >= 0.9


@pytest.mark.parametrize("noise", [0, 0.03])
def test_recall_where_a_third_are_copies_or_a_cluster(spark, noise):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(8100, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:2700] = x[0] + noise * rng.normal(size=(2700, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    query, found = recall(spark, x).T
    assert found.mean() >= 0.9 and found[query >= 2700].mean() >= 0.9


def test_recall_beside_a_vector_of_huge_norm(spark):
    x = np.random.default_rng(9).normal(size=(8100, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[5] *= 1e30
    assert recall(spark, x)[:, 1].mean() >= 0.9


@pytest.mark.parametrize("n, frequent", [(2, 1 << 18), (40, 1 << 18), (40, 5)])
def test_components_of_chains_and_stars(spark, n, frequent, monkeypatch):
    monkeypatch.setattr(runtime, "FREQUENT", frequent)
    links = [(i, i + 1) for i in range(n - 1)] + [(1000, 1000 + i) for i in range(1, 30)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(n)} | {1000 + i: 1000 for i in range(30)}


def test_escape_is_reversible():
    for text in ("", "\\", "\\\\<turn>", "<turn", "a<|endoftext|>b</turn>", "### Assistant: \\### User:", "\\### Assistant: </turn> ok", "\n\\n"):
        assert unescape(escape(text)) == text
    assert escape("</turn>") != "</turn>"


def test_chats(spark):
    long = "word " * 5000
    rows = [(1, 0, "user", "hi </turn>", 5), (1, 1, "assistant", "é日本\\ ### User: <|endoftext|>", 5), (1, 2, "assistant", None, 5), (2, 1, "assistant", "b", 5), (2, 0, None, "a", 5), (3, 0, "user", "", 5), (None, 0, "assistant", "x", 5), (4, None, "assistant", long, 5), (5, 0, "user", "same", 5), (5, 0, "user", "same", 5)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, nth long")
    got = {r.conv_id: r for r in read_back(format_chats(chats)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:4] for r in rows if r[0] == conv), key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
        learnt = "".join(t or "" for _, r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert read_back(format_chats(chats.limit(0))).count() == 0


def test_a_long_conversation_is_dealt_over_tasks_and_read_from_storage(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(c, int(t), ("user", "assistant")[int(t) % 2], f"{rng.integers(0, 99)} said " * int(rng.integers(0, 30))) for c, n in ((1, 3), (2, 900), (3, 2), (None, 400)) for t in rng.integers(0, n, n)]
    formatted = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    formatted.repartition(7).write.parquet(str(tmp_path / "chats"))  # rows in any order
    stored = spark.read.parquet(str(tmp_path / "chats"))
    by_conv = {}
    for r in stored.collect():
        by_conv.setdefault(r.conv_id, []).append(r)
    got = {r.conv_id: r for r in read_back(stored).collect()}
    assert set(got) == set(by_conv) == {1, 2, 3, None}
    t = Template(vocabulary_path(NAME, ".json"))
    for conv, found in by_conv.items():
        found.sort(key=lambda r: r.nth)
        said = sorted((r[1:] for r in rows if r[0] == conv))
        assert [r.nth for r in found] == list(range(len(said)))
        assert [r.token_offset for r in found] == np.cumsum([0, *(len(r.ids) for r in found)])[:-1].tolist()
        assert [t.render(np.array(r.ids)) for r in found] == [r.formatted for r in found]
        learnt = "".join(x for _, role, x in said if role == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in said).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_turns_are_ids_and_masks():
    t = Template(vocabulary_path(NAME, ".json"))
    ids, mask, bounds = t.turns(["user", "assistant"], ["<turn>", "ok <|endoftext|>"])
    turns = [(ids[a:b], mask[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    assert t.parse(turns) == [("user", "<turn>", ""), ("assistant", "ok <|endoftext|>", "ok <|endoftext|>")] and (ids >= t.base).sum() == 6
    assert t.render(ids) == "<turn>user<text>\\<turn></turn><turn>assistant<text>ok \\<|endoftext|></turn>"
