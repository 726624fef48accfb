from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kerbline.llm import mixing


def filled(sizes, weights=(5, 2, 1), cap=3):
    """Shares with a cap, the excess handed round until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def rows():
    out = [(i, "w " * (1 + i * 7919 % 40), "en", f"s{i % 4}") for i in range(1200)]
    out += [(2000 + i, "word " * 30, "en", "hot") for i in range(1500)] + [(5000 + i, "a b c", "en", None) for i in range(40)]
    return out + [(9001, "x y", "en", "tiny"), (9002, None, "en", "empty"), (9003, "", "en", "s1"), (None, "no id", "en", "s1"), (7, "again and again", "en", "s2"), (7, "again and again", "en", "s2")]


def test_targets_and_taken(spark, docs_of):
    data = rows()
    got = mixing.mix(mixing.sized(docs_of(data))).collect()
    assert len(got) == len(data)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, _, source in data:
        sizes[source] += len((text or "").split())
        largest[source] = max(largest[source], len((text or "").split()))
    want = filled(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and len(r["positions"]) == r["copies"]
        taken[r["source"]] += r["taken"]
        if r["size"]:
            assert all(0 <= p <= 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])
    for s, target in want.items():
        assert abs(taken[s] - target) <= largest[s] / 2 + 1e-6
    again = mixing.mix(mixing.sized(docs_of(data).repartition(7))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_positions_invert_the_schedule(spark, docs_of):
    """The share of a source's words placed before u is the integral of its weights up to u."""
    data = [(i, "w " * 10, "en", "a") for i in range(4000)]
    sizes = mixing.sized(docs_of(data))
    knots = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in ((0.0, 0.0), (0.25, 4.0), (0.5, 0.0), (0.75, 0.0), (1.0, 2.0))])
    per = mixing.targets(sizes).withColumn("knots", knots)
    order = [r["position"] for r in mixing.training_order(mixing.mix(sizes, per)).collect()]
    assert order == sorted(order) and len(order) == 4000
    share = lambda u: sum(p <= u for p in order) / len(order)
    area = 0.5 + 0.5 + 0 + 0.25
    for u, integral in ((0.25, 0.5), (0.5, 1.0), (0.74, 1.0), (0.875, 1.0625), (1.0, 1.25)):
        assert share(u) == pytest.approx(integral / area, abs=0.002)


def test_mixed_documents_and_empty_table(spark, docs_of):
    data = [*rows(), *[(None, "the same words without an id", "en", "s3")] * 200, *[(None, f"other words {i}", "en", "s3") for i in range(200)]]
    docs = docs_of(data).withColumn("_size", F.lit(1)).withColumn("_id", F.lit(2)).withColumn("_src", F.lit(3)).withColumn("_one", F.lit(4)).withColumn("rows", F.lit(5))
    mixed = mixing.mix(mixing.sized(docs)).collect()
    out = mixing.mixed_documents(docs)
    assert out.columns == [*docs.columns, "copies_", "position"]
    kept = out.collect()
    assert [r["position"] for r in kept] == sorted(r["position"] for r in kept)
    # every row's own copies, whatever ids and texts it shares
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["copies_"] if "copies_" in r.__fields__ else r["copies"])
    assert sorted(map(key, kept)) == sorted(key(r) for r in mixed if r["copies"])
    size = {}
    for r in kept:
        size[r["source"]] = size.get(r["source"], 0) + r["copies_"] * len(r["text"].split())
    for r in mixed:
        assert r["size"] == 0 or abs(size[r["source"]] - r["target"]) <= 20
    empty = docs.where(F.lit(False))
    assert mixing.mix(mixing.sized(empty)).collect() == [] and mixing.mixed_documents(empty).collect() == []
    assert mixing.mixed_documents(docs.drop("copies")).columns[-2:] == ["copies", "position"]
