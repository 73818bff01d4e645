"""The pipeline's stages on a small corpus."""

import numpy as np
import pyarrow as pa

import corpus_pipeline as pipeline
from modweave.llm.runtime import BATCH_BYTES


def corpus(spark):
    rng = np.random.default_rng(8)
    words = {"en": [f"the{i}" for i in range(600)], "de": [f"ßü{i}" for i in range(600)]}
    texts = [(" ".join(rng.choice(words[("en", "de")[i % 2]], 80)), ("en", "de")[i % 2]) for i in range(40)]
    passage = " ".join(rng.choice(words["en"], 50))
    texts += [(f"{t} {passage}", "en") for t, _ in texts[:3]]
    texts += [texts[0], texts[1], ("12 34 !!", "en"), (None, None), ("", "en")]
    rows = [(i, t, lang, f"s{i % 3}", len(t or "")) for i, (t, lang) in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, lang string, source string, n_chars long"), rows


def test_stages(spark):
    docs, rows = corpus(spark)
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, "").persist()
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    by_id = {r[0]: r for r in rows}
    assert {r.doc_id for r in seen["language_id"]} == {i for i, r in by_id.items() if any(c.isalpha() for c in r[1] or "")}
    kept = sorted(r.doc_id for r in seen["near_duplicates"])
    assert kept == [i for i in range(43)]  # exact copies go; those with a passage are alike to less than 0.8
    cleaned = {r.doc_id: r for r in seen["substring_dedup"]}
    assert cleaned[0].text == by_id[0][1]
    for i in (41, 42):
        assert len((cleaned[i].text if i in cleaned else "").split()) == 0  # all of it was said before
    assert len(cleaned[40].text.split()) in (50, 69)
    mixed = [r.doc_id for r in seen["mixing"]]
    assert set(mixed) <= set(cleaned) and max(map(mixed.count, mixed)) <= 3
    assert {r.doc_id for r in seen["packing"]} == set(mixed)


def test_empty_corpus(spark):
    docs = corpus(spark)[0].limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_rows_are_judged_by_their_texts(spark):
    """Against brute force: repeated and null ids, with alike, near and different texts, null and empty ones."""
    rng = np.random.default_rng(2)
    base = [" ".join(f"w{w}" for w in rng.integers(0, 5000, 60)) for _ in range(6)]
    near = f"{base[0]} end"
    rows = [(1, base[0], "en"), (1, base[1], "en"), (1, base[0], "de"), (1, base[0], "en"), (2, near, "en"), (2, base[2], "en"), (None, base[3], "en"), (None, base[3], "en"), (3, base[3], None), (None, base[4], "en"), (None, base[5], "en"), (4, "", "en"), (4, None, "en"), (5, "", "en"), (0, near, "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = pipeline.near_duplicate_stage(spark, docs, "").collect()
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    names = sorted({(i is None, i or 0, t or "") for i, t, _ in rows})
    expected = []
    for k, (none, i, t) in enumerate(names):
        alike = [m for m in names[:k] if grams(t) and 10 * len(grams(t) & grams(m[2])) >= 8 * len(grams(t) | grams(m[2])) and (m[:2] < (none, i) or m[2] == t)]
        expected += [] if alike else [(none, i, t)]
    # an empty text is like nothing, a null one has a row of its own
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == sorted([*expected, (False, 4, "")])


def test_arrow_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs, before = corpus(spark)[0], spark.conf.get(name)
    wide = spark.range(0, 12_000, 1, 1).selectExpr("id", "repeat('x', 2000) as text")
    for stage, f in pipeline.STAGES:
        if stage != "mixing":  # it moves sizes only
            spark.conf.set(name, before)
            f(spark, docs, "")
            found = [r.n for r in wide.mapInArrow(sizes, "n long").collect()]
            assert len(found) > 1 and max(found) < 1.1 * BATCH_BYTES, stage
    spark.conf.set(name, str(1 << 20))
    pipeline.packing_stage(spark, docs, "")
    assert spark.conf.get(name) == str(1 << 20)  # a smaller bound stays
    spark.conf.set(name, before)
