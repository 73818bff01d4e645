"""Operators on texts against brute force, on a fixture with nulls, empty, blank, very long and repeated texts and clashing columns."""

import math
import re
import tracemalloc
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from modweave.llm import language as language_module
from modweave.llm import mixing, packing, runtime
from modweave.llm import quality as quality_module
from modweave.llm import substring_dedup as substring
from modweave.llm.jaccard_join import Bands, near_duplicates
from modweave.llm.language import UNKNOWN, codewords, languages
from modweave.llm.mixing import mix, targets
from modweave.llm.packing import pack, plan
from modweave.llm.quality import quality
from modweave.llm.runtime import text_bytes
from modweave.llm.substring_dedup import repeated_windows, substring_dedup
from modweave.llm.tokens import NAME, Encoder, library, pieces, token_counts, vocabulary_path
from modweave.llm.words import Words, window_hashes

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, bucket string, __x int"


def some_texts():
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [" ".join(rng.choice(vocabulary, 120)) for _ in range(12)]
    near = [" ".join(w if k % 60 else "changed" for k, w in enumerate(b.split())) for b in base[:4]]
    passage = " ".join(rng.choice(vocabulary, 60))
    shared = [f"{' '.join(rng.choice(vocabulary, 40))} {passage} {' '.join(rng.choice(vocabulary, 40))}" for _ in range(4)]
    small = ["", "   \t\n ", "one", "one", "One", "a b c d", "a b c d e", "a b c d e f", "ünï côdé  x", "x" * 3000, "\x0bv\x0cf"]
    long = " ".join(rng.choice(vocabulary, 30000))
    loop = "again and " * 40
    return [*base, *near, *shared, *small, long, long + " end", loop, base[0], base[0].upper(), None, None]


@pytest.fixture(scope="module")
def rows():
    texts = some_texts()
    out = [(i, t, ("en", "de", None)[i % 3], ("b", "a", None, "ä")[i % 4], 0, 1, "q", 2) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, texts[1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


@pytest.mark.parametrize("frequent", [1 << 18, 2])
def test_near_duplicates(docs, none, rows, frequent, monkeypatch):
    monkeypatch.setattr(runtime, "FREQUENT", frequent)
    sets = []
    for r in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    ids = [r[0] for r in rows]
    least = {k: min((ids[i] for i in range(len(rows)) if root[i] == k and ids[i] is not None), default=None) for k in set(root)}
    key = lambda r: tuple((x is None, x or 0) for x in r)
    expected = sorted(((r[0], len(s), least[root[i]] if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=key)
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=key) == expected
    assert near_duplicates(none).count() == 0


def test_bands_cover_all_pairs():
    bands = Bands(80, 100, 3000)
    for a in range(1, 1500):
        for b in {a, a + 1, a * 5 // 4}:
            if a <= b and 100 * a >= 80 * b:  # the smaller inside the larger is as alike as sizes allow
                common = set(bands.of(a)) & set(bands.of(b))
                assert a == b and not bands.of(a) or any((a + b) * 20 // 180 <= bands.d[i] < bands.k[i] for i in common) or (a + b) * 20 // 180 == 0


def removed(rows):
    order = sorted({(r[0] if r[0] is not None else -1, r[1] or "") for r in rows})
    first, out = {}, {}
    for i, t in order:
        w = words(t)
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (i, k))
    for i, t in order:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] != (i, k):
                gone[k : k + 20] = [True] * 20
        out[i, t] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("base, frequent", [(10, 1 << 14), (5, 1 << 14), (5, 2)])
def test_substrings(docs, none, rows, base, frequent, monkeypatch):
    monkeypatch.setattr(substring, "_FREQUENT", frequent)
    expected = removed(rows)
    got = substring_dedup(docs.withColumn("copy", F.col("text")), base=base).select("doc_id", "copy", "n_words", "n_removed", "kept_text", "bucket", "__x").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_text) == expected[r.doc_id if r.doc_id is not None else -1, r.copy or ""]
    assert substring_dedup(none).count() == 0


@pytest.mark.parametrize("frequent", [1 << 14, 3])
def test_a_passage_in_many_texts(spark, frequent, monkeypatch):
    """Twelve words that all texts share, within different words, in longer passages that some share."""
    monkeypatch.setattr(substring, "_FREQUENT", frequent)
    rng = np.random.default_rng(7)
    some = lambda n: " ".join(f"v{w}" for w in rng.integers(0, 9000, n))
    line, longer = some(12), some(7)
    rows = [(i, f"{some(30)} {longer if i % 5 == 0 else some(7)} {line} {some(int(rng.integers(0, 30)))}") for i in range(120)]
    rows += [(200 + i, line + " " + longer) for i in range(3)] + [(300, " ".join([line] * 9))]
    expected = removed(rows)
    for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("copy", F.col("text")).repartition(5)).collect():
        assert (r.n_words, r.n_removed, r.kept_text) == expected[r.doc_id, r.copy]


def test_the_search_ends_where_nothing_survives(spark):
    docs = spark.createDataFrame([(i, " ".join(f"x{i}y{k}" for k in range(50))) for i in range(20)], "doc_id long, text string")
    assert repeated_windows(docs).count() == 0 and substring_dedup(docs).where("n_removed = 0 and n_words = 50").count() == 20


def test_token_counts(docs, none, rows):
    encoder = library(vocabulary_path(NAME, ".json"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs).collect())
    counts = [(r[0], len((r[1] or "").encode()), len(encoder.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows]
    assert got == sorted((i is None, i or 0, b, n, n > 512) for i, b, n in counts)
    assert token_counts(none).count() == 0


def split(encoder, texts):
    """Each text's pieces, and its ids put together from them."""
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    begin = pieces(data, offsets, encoder.special)
    ids, bounds = encoder.ids(data, offsets)
    assert encoder.counts(data, offsets).tolist() == np.diff(bounds).tolist()
    cuts = np.searchsorted(begin, offsets)
    parts = [[data[s:e].tobytes().decode() for s, e in zip(begin[a:b], [*begin[a + 1 : b], end])] for a, b, end in zip(cuts[:-1], cuts[1:], offsets[1:])]
    return parts, [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


def test_pieces_encode_as_their_text_does():
    encoder = Encoder(vocabulary_path(NAME, ".json"))
    rng = np.random.default_rng(3)
    every = [chr(c) for c in range(1, 0x3100)] + ["\U0001f600", "\ufeff"]
    texts = [f"a{c}b {c} {c}{c}1{c}\n{c}  {c}'s,{c} é{c}" for c in every]
    letters = [*"aZé9.,'\"×÷ \n\t\r\u00a0\u2003\u3000\u0085ß日—", "<|endoftext|>", "'s", "'ll", "<|", "|>", " 'd"]
    texts += ["".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(6000)]
    texts += ["", "x <|endoftext|> y", "<|endoftext|>", "word  two\n\n three,four 'll don't 12 34\t" * 60, "x" * 3000]
    parts, ids = split(encoder, texts)
    assert ["".join(p) for p in parts] == texts
    assert ids == [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert split(encoder, ["one, two 34x"])[0] == [["one", ",", " two", " 34", "x"]]


def test_ids_take_little_memory():
    texts = [" ".join(f"w{i * j % 9973:x}" for j in range(500)) for i in range(400)]
    data, offsets = text_bytes(pa.array(texts))
    encoder = Encoder(vocabulary_path(NAME, ".json"))
    tracemalloc.start()
    ids, bounds = encoder.ids(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 14 * len(data)
    whole = library(vocabulary_path(NAME, ".json")).encode_batch_fast(texts[::50], add_special_tokens=False)
    assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(0, 400, 50)] == [e.ids for e in whole]


def test_packing(docs, none, rows):
    encoder = library(vocabulary_path(NAME, ".json"))
    got = pack(docs).collect()
    expected = []
    for r in rows:
        ids = [*encoder.encode(r[1] or "", add_special_tokens=False).ids, 0]
        at, piece = 0, 0
        while at < len(ids):
            n = (len(ids) - at) % 2048 or 2048
            expected.append((r[0] is None, r[0] or 0, piece, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at, piece = at + n, piece + 1
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        ends = np.cumsum([n for _, n in sorted(found)])
        assert [o for o, _ in sorted(found)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(places) <= -(-sum(e[4] for e in expected) // 2048) + 2
    assert pack(none).count() == 0


def test_plan_is_tight():
    rng = np.random.default_rng(4)
    for lengths in (rng.integers(1, 2049, 5000), rng.geometric(0.002, 5000).clip(1, 2048), np.full(1000, 1025), np.full(999, 512)):
        h = np.bincount(lengths, minlength=2049)
        runs, n = plan(h, 2048)
        bound = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
        assert n <= bound * 1.02 + 2
        assert sum(len(r) > 0 for r in runs) == (h > 0).sum()


def test_mixing(spark, docs, none, rows):
    got = mix(docs).collect()
    size = lambda t: len(words(t))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((r[0] is None, r[0] or 0, size(r[1])) for r in rows)
    by_source = {}
    for r in got:
        by_source.setdefault(r.source, []).append(r)
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    assert sum(v[0].target for v in by_source.values()) == pytest.approx(sum(r.size for r in got))
    assert sorted(map(tuple, mix(docs.repartition(5)).select("doc_id", "tag", "copies").na.fill(-1, ["doc_id"]).collect())) == sorted((r.doc_id if r.doc_id is not None else -1, r.tag, r.copies) for r in got)
    assert mix(none).count() == 0


def test_patterns_do_most_of_the_packing(monkeypatch):
    """Of 4,000 pieces most go to sequences that a pattern fills; the plan without them needs as many sequences or more."""
    lengths = np.random.default_rng(6).geometric(0.002, 4000).clip(1, 2047)
    h = np.bincount(lengths, minlength=2049)
    runs, n = plan(h, 2048)
    end = np.zeros(n, np.int64)
    members = [[] for _ in range(n)]
    for length, r in enumerate(runs):
        for k, (rank, first, _, _) in enumerate(r):
            for i in range((r[k + 1, 0] if k + 1 < len(r) else h[length]) - rank):
                members[first + i].append(length)
                end[first + i] += length
    assert end.sum() == lengths.sum() and end.max() <= 2048
    assert sum(len(m) for m, e in zip(members, end) if e == 2048 and len(m) <= 3) > 0.4 * len(lengths)
    monkeypatch.setattr(packing, "patterns", lambda *_: np.zeros((0, 3), np.int64))
    assert n <= plan(h, 2048)[1]


@pytest.mark.parametrize("near", [128, 10, 1])
def test_copies_are_the_integers_that_prefix_sums_cross(spark, monkeypatch, near):
    """Against exact fractions, document by document in the order of size, after those that are a good part of their target."""
    monkeypatch.setattr(mixing, "NEAR", near)
    rng = np.random.default_rng(4)
    rows = [(int(i), " ".join(["w"] * int(n)), (None, "a", "b", "ä")[i % 4]) for i, n in enumerate(rng.pareto(1.2, 300) * 9)]
    rows += rows[:7] + [(None, "x y", "a"), (None, None, None), (5, None, "only empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).withColumn("key", F.xxhash64("doc_id", "tag", F.lit(7))).withColumn("begin", F.pmod(F.xxhash64(F.coalesce("source", F.lit("")), F.lit(7)), F.lit(1024))).collect()
    taken, sampled = [], 0
    for source in {r.source for r in got}:
        order = sorted((r for r in got if r.source == source), key=lambda r: (r.size, r.key))
        target, size = order[0].target, order[0].source_size
        large = [r for r in order if r.size * near > target][::-1]
        owed, rate = 0.0, target / size if size else 0.0
        for r in large:
            best = min({math.floor(rate), math.ceil(rate)}, key=lambda c: (abs(owed + rate * r.size - c * r.size), c))
            owed += rate * r.size - best * r.size
            taken.append((r, best * r.size))
        rest = size - sum(r.size for r in large)
        rate = min(max((target - sum(t for r, t in taken if r.source == source)) / rest, 0.0), 3.0) if rest else 0.0
        total = Fraction(2 * order[0].begin + 1, 2048)
        for r in order[: len(order) - len(large)]:
            after = total + Fraction(rate)
            taken.append((r, (math.floor(after) - math.floor(total)) * r.size))
            total, sampled = after, sampled + 1
    assert len(taken) == len(got) == len(rows) and sampled > (50 if near < 128 else 0)
    at = lambda r: (r.source is not None, r.source or "", r.doc_id is None, r.doc_id or 0, r.size)
    assert sorted((at(r), r.taken) for r in got) == sorted((at(r), t) for r, t in taken)


def shared_out(sizes):
    """Targets by resharing the excess until none is above three times its size."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, list(names), float(sum(sizes.values()))
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > 3 * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in over]
    return out


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 100, "c": 3, None: 50}, {"a": 10}, {"a": 0, "b": 0}, {"z": 1, "ä": 1, "Z": 90, "x": 2, "y": 0}, {f"s{i}": (i * 37) % 11 + 1 for i in range(30)}])
def test_targets(spark, sizes):
    got = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    expected = shared_out(sizes)
    assert {r.source: r.target for r in got} == pytest.approx(expected)


def test_mix_comes_near_its_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(n)), f"s{i % 5}") for i, n in enumerate(rng.pareto(1.5, 3000) * 20 + 1)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    for r in got:
        assert r.t == pytest.approx(r.target, rel=0.03)


def labelled(n, seed):
    rng = np.random.default_rng(seed)
    good = [f"{a}{b}" for a in ("ka", "lo", "mi") for b in ("ren", "dan", "sol", "tir")]
    bad = ["!!!", "BUY", "$$$", "CLICK", "%%%"]
    out = []
    for i in range(n):
        label = int(rng.random() < 0.7)
        out.append((i, " ".join(rng.choice(good if label else [*good, *bad, *bad], int(rng.integers(5, 60)))), label))
    return out


def test_quality(spark, docs, none):
    rows = labelled(600, 3)
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality(table, labels).collect()}
    held = [(got[i].score, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert np.mean([(s >= 0.7) == bool(q) for s, q in held]) > 0.9
    edge = quality(docs, labels.limit(50)).collect()
    assert len(edge) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in edge)
    assert quality(none, labels).count() == 0 and {r.score for r in quality(docs, labels.limit(0)).collect()} == {0.5}


def plain_grams(text, n, bits):
    """Buckets of the n-grams of a text, one by one."""
    return [int(quality_module.grams(np.array([ord(c) for c in text[i : i + n]], "<u4"), n, bits)[0]) for i in range(len(text) - n + 1)]


def test_scores_are_the_softmax_of_averaged_vectors(spark):
    """The lookup of one number per feature against averaging the learned vectors of a text's words, pairs and n-grams."""
    rows = labelled(120, 5)
    model = quality_module.train([t for _, t, _ in rows], np.array([q for *_, q in rows]), bits=9, epochs=2)
    assert model.vectors.any() and model.vectors.shape == (5 << 9, 8)
    table, bias = model.lookup()
    shared = type("Shared", (), {"value": (table, bias, 9)})
    texts = [t for _, t, _ in rows[:30]] + ["", "one", "a a a b", "é日 x  y\n", "\U0001f600 !!! BUY BUY", "x" * 5000]
    data, offsets = text_bytes(pa.array(texts))
    found = quality_module._scores(shared)(data, offsets)
    for text, logit in zip(texts, found):
        said = words(text)
        hashes = [Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())])).hash for w in said]
        ids = [int(h[0] >> np.uint64(64 - 9)) for h in hashes]
        pairs = [0 if a == b else int(window_hashes(np.concatenate([hashes[i], hashes[i + 1]]), 2)[0] >> np.uint64(64 - 9)) for i, (a, b) in enumerate(zip(said, said[1:]))]
        ids += [p + (1 << 9) for p in pairs]
        for kind, n in enumerate((1, 2, 3), 2):
            ids += [g + (kind << 9) for g in plain_grams(text, n, 9)]
        hidden = np.mean([model.vectors[i] for i in ids], axis=0) if ids else np.zeros(8)
        e = np.exp(hidden @ model.weights + model.bias)
        assert 1 / (1 + np.exp(-logit)) == pytest.approx(e[1] / e.sum(), abs=1e-5)


def test_decoding_is_the_least_weighted_loss():
    """Against plain loops over languages and bits, on the margins of whole texts."""
    rng = np.random.default_rng(3)
    names = [f"l{i}" for i in range(7)]
    texts = [" ".join("".join(rng.choice(list("abcdefg" + "hijklmn"[i % 7] * 9), 4)) for _ in range(12)) for i in range(140)]
    model = language_module.train(texts, [names[i % 7] for i in range(140)], bits=10, epochs=2)
    assert model.code.shape[0] == 7 and set(np.unique(model.code)) == {-1.0, 1.0}
    margins = []
    for text in texts[:40]:
        ids = [g + (kind << 10) for kind, n in enumerate((1, 2, 3)) for g in plain_grams(text.lower(), n, 10)]
        margins.append(np.mean([model.table[i].astype(float) for i in ids], axis=0) + model.bias)
    data, offsets = text_bytes(pa.array(texts[:40]))
    total, count = 0, 0
    for h, begin, n in language_module._features(data, offsets, 10):
        total, count = total + language_module.sums(model.table[h], begin, n), count + n
    assert np.allclose(total / count[:, None] + model.bias, margins, atol=1e-5)
    best, p, ahead = model.decode(np.array(margins))
    for i, m in enumerate(margins):
        loss = [sum(w * math.log1p(math.exp(-c * x)) for c, x, w in zip(code, m, model.trust)) for code in model.code]
        order = sorted(range(7), key=lambda k: loss[k])
        share = [math.exp(min(loss) - x) for x in loss]
        assert best[i] == order[0] and p[i] == pytest.approx(share[order[0]] / sum(share)) and ahead[i] == pytest.approx((share[order[0]] - share[order[1]]) / sum(share))


def test_columns_named_like_results_are_replaced(docs):
    clash = docs.select("doc_id", "text", *[F.lit("old").alias(c) for c in ("score", "held_out", "predicted", "lang_pred", "ambiguous", "n_bytes", "n_tokens", "over_limit", "n_words", "n_removed", "kept_text", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "size", "copies", "taken", "n_shingles", "component_id")], F.lit("s").alias("source"), F.lit("en").alias("lang"))
    labels = docs.sparkSession.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    n = docs.count()
    for found, columns in (
        (quality(clash, labels), {"score": "double", "held_out": "boolean", "predicted": "int"}),
        (languages(clash), {"lang_pred": "string", "score": "double", "ambiguous": "boolean"}),
        (token_counts(clash), {"n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}),
        (substring_dedup(clash), {"n_words": "bigint", "n_removed": "bigint", "kept_text": "string"}),
        (mix(clash), {"size": "bigint", "copies": "bigint", "taken": "bigint"}),
        (near_duplicates(clash), {"n_shingles": "bigint", "component_id": "bigint"}),
    ):
        assert {c: t for c, t in found.dtypes if c in columns} == columns and found.count() == n
    assert dict(pack(clash).dtypes)["length"] == "bigint" and pack(clash).select("doc_id", "piece").distinct().count() >= docs.select("doc_id").distinct().count()


def test_languages(spark, docs, none):
    rng = np.random.default_rng(6)
    parts_ = {"aa": ["ka", "ko", "ki"], "bb": ["ze", "zu", "zo"], "cc": ["thri", "thro"], "dd": ["mué", "muà"], "ee": ["px", "pq"], "ff": ["yo", "ya"]}
    names = list(parts_)
    rows = [(i, " ".join("".join(rng.choice(parts_[names[i % 6]], 3)) for _ in range(rng.integers(3, 30))), names[i % 6]) for i in range(600)]
    got = {r.doc_id: r for r in languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [got[i].lang_pred == x for i, _, x in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean(held) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    edge = languages(docs).collect()
    assert len(edge) == docs.count()
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").where("doc_id is not null").collect()}
    assert all((r.lang_pred == UNKNOWN) == (not re.search(r"[^\W\d_]", texts[r.doc_id] or "")) for r in edge if r.doc_id is not None)
    assert languages(none).count() == 0


@pytest.mark.parametrize("k", [1, 2, 4, 5, 9])
def test_codewords_differ(k):
    code = codewords(k)
    assert len(code) == k and len({tuple(c) for c in code}) == k
    assert k < 3 or min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 2


