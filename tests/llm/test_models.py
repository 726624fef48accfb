"""Language ID and the quality classifier: their algorithms by brute force, and held-out accuracy."""

import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import langid, quality
from kerbline.llm.queries import QUERIES


def held(i, m=4):
    return zlib.crc32(("" if i is None else str(i)).encode()) % m == 2


def segmentations(unit):
    for cuts in itertools.product((0, 1), repeat=len(unit) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(unit)]
        yield [unit[a:b] for a, b in zip(at, at[1:], strict=False)]


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(4)
    vocabulary = ["▁", "▁t", "th", "t", "h", "e", "he", "the", "▁the", "r"]
    pieces = langid.Pieces(vocabulary)
    probs = rng.random((len(vocabulary) + 1, 3)) / 5
    texts = ["▁the", "▁there", "▁xthe", "the", "▁", "h", "▁tththe"]
    at = {p: i for i, p in enumerate(vocabulary)}
    want = np.zeros((len(texts), 3))
    counts = np.zeros(len(vocabulary) + 1)
    weights = np.arange(1, len(texts) + 1, dtype=float)
    for k, u in enumerate(texts):
        shares = []
        for seg in segmentations(u):
            ids = [at.get(s, len(vocabulary) if len(s) == 1 else None) for s in seg]
            if None not in ids:
                want[k] += np.prod(probs[ids], axis=0)
                shares.append((ids, np.prod(probs[ids, 0])))
        for ids, p in shares:
            np.add.at(counts, ids, weights[k] * p / want[k][0])
    assert langid.likelihoods(pieces, probs, texts) == pytest.approx(np.log(want))
    got, reached = langid.expected_counts(pieces, np.ascontiguousarray(probs[:, 0]), texts, weights)
    assert got == pytest.approx(counts) and reached == pytest.approx(np.log(want[:, 0]) @ weights)


def test_units_cover_whole_texts():
    found = langid.runs("Ab, c1d\nÉ_" + "x" * 60)
    assert [u for r in found for u in langid.units(r)] == ["▁ab", "▁c", "▁d", "▁é", "▁" + "x" * 23, "x" * 24, "x" * 13]
    assert langid.runs(None) == [] and langid.runs("12 .,") == []


def test_language_held_out_accuracy(spark, sf):
    rows = QUERIES["op9_langid"](spark, sf).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(lang) and all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    mine = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(mine) / len(mine) >= 0.97


def test_language_odd_rows(spark, docs_of, odd):
    rows = [*odd, (30, "12345 !!"), (31, "deutsch ich und nicht", "de"), (32, "der die das und", "de"), (33, "no language", None)]
    docs = docs_of(rows)
    model = langid.fit(docs, held_out=None)
    assert model[0] == ["de", "en"]
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows)
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (1, 2, 3, 30)} == {("und", 0.0)}
    kept = langid.keep_confident(docs, model)
    assert kept.columns == docs.columns and {1, 2, 3, 30}.isdisjoint({r["doc_id"] for r in kept.collect()})
    none = langid.fit(docs.where("lang is null"))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.where(F.lit(False)), model).collect() == []


def test_dual_descent_meets_the_optimum():
    """The duality gap of the hinge-loss machine closes."""
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(60, 8, replace=False)) for _ in range(80)]
    labels = np.array([int((r < 30).sum() + rng.integers(0, 3) > 4) for r in rows])
    scale = rng.normal(size=1 << quality.BITS)
    w, b = quality.dual_descent(rows, labels, scale, epochs=600)
    share = np.array([(labels == k).mean() for k in (0, 1)])
    upper = 0.5 / share[labels]
    hinge = np.maximum(0, 1 - np.where(labels == 1, 1, -1) * quality.margins(rows, scale, w, b))
    primal = 0.5 * (w @ w + b * b) + (upper * hinge).sum()
    for _ in range(200):  # no direction leads down
        dw, db = np.zeros_like(w), rng.normal() * 0.01
        dw[:60] = rng.normal(size=60) * 0.01
        near = np.maximum(0, 1 - np.where(labels == 1, 1, -1) * quality.margins(rows, scale, w + dw, b + db))
        assert 0.5 * ((w + dw) @ (w + dw) + (b + db) ** 2) + (upper * near).sum() >= primal - 1e-3 * primal


def test_quality_held_out_accuracy(spark, sf):
    rows = {r["doc_id"]: r for r in QUERIES["op8_quality"](spark, sf).collect()}
    truth = [(rows[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in rows and held(r["doc_id"])]
    assert all(r["held_out"] for r, _ in truth)
    assert sum((r["score"] >= 0.7) == (r["predicted"] == 1) for r, _ in truth) == len(truth)
    assert sum(r["predicted"] == q for r, q in truth) / len(truth) >= 0.95


def test_quality_odd_rows(spark, docs_of, odd):
    docs = docs_of(odd)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 1, 1), (6, 0, 0), (None, 1, 0), (7, None, 0), (99, 1, 1), (2, 7, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("quality = 1"), labels.where(F.lit(False))):
        got = quality.predict(docs, quality.fit(docs, known, held_out=None)).collect()
        assert len(got) == len(odd) and all(0 < r["score"] < 1 and not math.isnan(r["score"]) for r in got)
    model = quality.fit(docs, labels, held_out=None)
    kept = quality.keep_good(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(odd)
    assert quality.predict(docs.where(F.lit(False)), model).collect() == []


def slow_columns(text):
    """The indicators, named by what they stand for, put in columns by the same hash."""
    raw = b"\x02" + (text or "").encode() + b"\x03"
    codes = {(n << 56) | int.from_bytes(raw[i : i + n], "big") for n in (1, 2, 3) for i in range(len(raw) - n + 1)}
    words = (text or "").split()
    for n in range(2, 7):
        for i in range(len(words) - n + 1):
            gram = words[i : i + n]
            places = [gram.index(w) + 1 if gram.index(w) < j else 0 for j, w in enumerate(gram)]
            codes.add(((100 + n) << 56) | sum(p * 8 ** (n - 1 - j) for j, p in enumerate(places)))
    return {(c * 0x9E3779B97F4A7C15 % 2**64) >> (64 - quality.BITS) for c in codes}


def test_columns_are_the_ngrams_of_the_whole_text(spark, sf):
    grams = quality.Grams()
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120").collect()]
    for t in [*texts, None, "", " ", "a", "a a", "a b a b a b", "x y z x x", "ü\U0001f600"]:
        got = grams.columns(t).tolist()
        assert len(got) == len(set(got)) and set(got) == slow_columns(t)


def test_every_score_of_the_table_by_its_definition(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = quality.fit(docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in quality.predict(docs, m).collect()[::3]:
        at = sorted(slow_columns(text[r["doc_id"]]))
        norm = math.sqrt(sum(m["scale"][i] ** 2 for i in at)) + 1e-12
        margin = m["bias"] + sum(m["scale"][i] * m["weights"][i] for i in at) / norm
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, m["slope"] * margin + m["offset"])))), rel=1e-9)


def test_the_sample_is_bounded_by_features_too(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    few = quality.fit(docs, labels, most_cells=60_000)
    assert 0 < np.count_nonzero(few["weights"]) <= 60_000


def test_score_is_the_margin_of_the_whole_text():
    rows = ["good text here", "bad!!! text###", "more good words", "###!!!"]
    grams = quality.Grams()
    cols = [grams.columns(t) for t in rows]
    model = quality.train(cols, np.array([1, 0, 1, 0]))
    scorer = quality.Scorer(model)
    m = quality.margins(cols, model["scale"], model["weights"], model["bias"])
    for t, x in zip(rows, m, strict=True):
        assert scorer.score(t) == pytest.approx(1 / (1 + math.exp(-(model["slope"] * x + model["offset"]))))
    assert len(set(grams.columns("abcabc").tolist())) == grams.columns("abcabc").size


def slow_forward(unit, ids, probs, unknown):
    """Log of the sum over all segmentations, by the recurrence on plain floats."""
    total = [1.0] + [0.0] * len(unit)
    for j in range(1, len(unit) + 1):
        for i in range(max(0, j - 20), j):
            k = ids.get(unit[i:j], unknown if j - i == 1 else None)
            if k is not None:
                total[j] += total[i] * probs[k]
    return math.log(total[-1])


@pytest.fixture(scope="module")
def languages(spark, sf):
    return langid.fit(spark.read.parquet(f"{sf}/documents.parquet"))


def test_every_language_score_of_the_table_by_its_definition(spark, sf, languages):
    docs, model = spark.read.parquet(f"{sf}/documents.parquet"), languages
    ids = {p: i for i, p in enumerate(model.pieces.pieces)}
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    known = {}
    for r in sorted(langid.predict(docs, model).collect(), key=lambda r: r["doc_id"])[::25]:
        words = [w for w in "".join(c if c.isalpha() else " " for c in (text[r["doc_id"]] or "").lower()).split() if len(w) < 60]
        total = np.zeros(len(model.langs))
        for w in words:
            if w not in known:
                known[w] = np.array([slow_forward("▁" + w, ids, model.probs[:, k], len(ids)) for k in range(len(model.langs))])
            total += known[w]
        if words:
            odds = np.exp(total - total.max())
            assert r["lang_pred"] == model.langs[int(odds.argmax())] and r["score"] == pytest.approx(1 / odds.sum(), rel=1e-6)


def test_letters_of_no_learned_language_are_rejected(spark, sf, languages):
    docs, model = spark.read.parquet(f"{sf}/documents.parquet"), languages
    kept = langid.keep_confident(docs, model).count()
    assert kept >= 0.999 * docs.where("text is not null").count()
    junk = [(1, "xkcd qzrtv wqxz jjkpl vbnmq zzxqw qwrtp " * 20), (2, "слова на другом языке, которого модель не знает " * 10), (3, "日本語の文章です。" * 30)]
    assert langid.keep_confident(spark.createDataFrame(junk, "doc_id long, text string"), model).count() == 0
