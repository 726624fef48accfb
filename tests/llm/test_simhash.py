import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from kerbline.llm import simhash
from kerbline.llm.components import connected_components
from kerbline.llm.queries import QUERIES


def slow_fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    if not shingles:
        return 0
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps, distance):
    u = np.array(fps, np.uint64)
    parent = list(range(len(u)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i] ^ u[i + 1 :]) <= distance).tolist():
            parent[find(i + 1 + j)] = find(i)
    return [find(i) for i in range(len(u))]


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op6_simhash"](spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs[::9]:
        assert got[r["doc_id"]]["fingerprint"] == f"{slow_fingerprint(r['text']):016x}"
    ids = [r["doc_id"] for r in docs]
    roots = brute_classes([int(got[i]["fingerprint"], 16) for i in ids], 4)
    least = {}
    for i, root in zip(ids, roots, strict=True):
        least[root] = min(i, least.get(root, i))
    assert all(got[i]["component_id"] == least[root] for i, root in zip(ids, roots, strict=True))


def test_dense_balls_lose_no_link(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(120):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))))
    fps |= {0, 2**64 - 1, 1 << 63, 15}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["fp"]: r["root"] for r in simhash.classes(df, 4).collect()}
    want = brute_classes([x & (2**64 - 1) for x in signed], 4)
    groups = lambda labels: sorted(sorted(x for x, v in zip(signed, labels, strict=True) if v == k) for k in set(labels))
    assert groups([got[x] for x in signed]) == groups(want)


def test_plan_meets_the_pigeonhole_sum():
    together = np.full((64, 64), 25.0)
    np.fill_diagonal(together, 50.0)
    for n in (0, 1, 100, 10**6, 10**10):
        for distance in (0, 2, 4, 7):
            scale = n / 100
            parts = simhash.plan(n, together * scale, distance)
            dealt = sorted(b for bits, _ in parts for b in bits)
            assert len(dealt) == len(set(dealt))
            # parts that are not used have threshold -1: sum(t + 1) over all parts is distance + 1
            assert sum(t + 1 for _, t in parts) == distance + 1


def test_components_on_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(400, 500)] + [(7, 7), (900, 901), (901, 900), (900, 901)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, **{i: 400 for i in range(401, 501)}, 901: 900}


def test_odd_rows(docs_of, odd):
    rows = simhash.near_duplicates(docs_of(odd)).collect()
    assert len(rows) == len(odd)
    assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3, 6)} == {1: 1, 2: 1, 3: 1, 6: 6}
    kept = simhash.drop_near_duplicates(docs_of(odd))
    assert kept.columns == docs_of(odd).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7] and ids.count(None) == 1
    assert simhash.near_duplicates(docs_of(odd).where(F.lit(False))).collect() == []


def test_the_bits_dealt_do_not_tell_apart_the_plans_of_a_step(spark):
    """A text has a row for each part, and a probe for each value within its threshold, under one name whatever the masks."""
    fps = spark.createDataFrame([(i, i, [i * 7919 - 50, -i]) for i in range(20)], "id long, root long, fps array<long>")
    low, high = list(range(32)), list(range(32, 64))
    generators = []
    for first, second in ((low, high), (high, low)):
        parts = simhash.Parts([[(first, 1), (second, 0)]] * 2)
        index, probes = parts.index(fps), parts.probes(fps)
        assert index.count() == 20 * 4 and index.distinct().count() == 80
        plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (index, probes)]
        generators.append([re.sub(r"#\d+L?|\d+", "", line).strip() for x in plans for line in x.splitlines() if "Generate" in line])
    assert len(generators[0]) == 2 and generators[0] == generators[1]
