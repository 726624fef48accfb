"""The pipeline's near-duplicate stage against Jaccard similarity by brute force."""

import random

from pyspark.sql import functions as F

from kerbline.llm import jaccard, simhash


def slow_shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_kept(rows, least=0.8):
    """Least doc_id of each class of (doc_id, text)."""
    sets = {i: slow_shingles(x) for i, x in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) < least * max(len(a), len(b)):
                continue
            shared = len(a & b)
            if not (a or b) or shared >= least * (len(a) + len(b) - shared):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {find(i) for i in ids}


def kept(docs):
    return {r["doc_id"] for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()}


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert kept(docs) == brute_kept(rows)


def test_near_copies_about_the_threshold(spark, docs_of):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    line = " ".join(rng.choices(vocabulary, k=30))
    rows = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice((8, 12, 40, 160)))
        for changes in range(6):
            words = list(base)
            for _ in range(changes):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words) + (" " + line if changes % 2 else "")))
    rows += [(len(rows) + k, line + " " + " ".join(rng.choices(vocabulary, k=k))) for k in range(12)]  # mostly the common line
    want = brute_kept(rows)
    assert 60 < len(want) < len(rows) - 10
    assert kept(docs_of(rows)) == want


def test_chains_through_a_group_are_followed(spark, docs_of):
    """Neighbours of a sliding window of words are similar, its ends are not."""
    words = [f"w{i}" for i in range(200)]
    rows = [(50 - i, " ".join(words[3 * i : 3 * i + 60])) for i in range(40)] + [(100, " ".join(words[7:20]))]
    assert kept(docs_of(rows)) == brute_kept(rows) == {11, 100}


def test_keys_are_equal_as_the_plain_texts_are(spark):
    texts = ["A b\tc", " a  B c\n", "a b c d", "Ä b", "ä b", "", None, " \x0b\x0c\r"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    got = [r["k"] for r in df.orderBy("i").select(jaccard.text_key(F.col("text")).alias("k")).collect()]
    plain = [b" ".join((x or "").encode().lower().split()) for x in texts]
    assert all((got[i] == got[j]) == (plain[i] == plain[j]) for i in range(8) for j in range(8))


def test_one_row_of_each_class_stays_whatever_its_id(spark, docs_of):
    long = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    near = [x + " more" for x in long]
    rows = [(1, long[0]), (1, long[1]), (1, long[1]), (2, near[1]), (None, near[0]), (None, long[2]), (None, near[2]), (3, near[2]), (None, long[3]), (None, near[3]), (None, near[3])]
    got = [(r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(docs_of(rows).repartition(5)).collect()]
    again = [(r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(docs_of(rows[::-1]).withColumns({c: F.lit(1) for c in ("_one", "_id", "_key", "key", "a")}).repartition(3)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(again, key=key)
    assert sorted((i, x[0]) for i, x in got if i is not None) == [(1, "a"), (1, "b"), (3, "c")]
    assert [x[0] for i, x in got if i is None] == ["d"]


def test_other_columns_do_not_choose_the_text_that_stays(spark, docs_of):
    texts = [" ".join(f"{c}{i}" for i in range(40)) + end for c in "efghij" for end in ("", " more", " again")]
    docs = docs_of([(None, x) for x in texts])
    kept_texts = lambda df: sorted(r["text"] for r in simhash.drop_near_duplicates(df).collect())
    got = kept_texts(docs)
    assert [x[0] for x in got] == list("efghij")
    assert got == kept_texts(docs.withColumn("lang", F.lit("de")).withColumn("another", F.lit(1)))


def test_chance_met_covers_the_threshold():
    assert simhash.chance_met(0.8, 9, 5) > 0.96 and simhash.chance_met(0.85, 9, 5) > 0.996 and simhash.chance_met(0.4, 9, 5) < 0.03


def test_the_parity_filter_loses_no_pair(spark):
    """Pairs that the filter rejects are below the threshold, whatever the sizes."""
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((6, 30, 120, 900)))]
        texts.append(" ".join(base))
        for share in (0.005, 0.02, 0.05):
            texts.append(" ".join(w if rng.random() > share else f"v{rng.randrange(999)}" for w in base))
    rows = spark.createDataFrame(list(enumerate(texts)), "_key long, text string")
    got = simhash.several_fingerprints(rows, 5, 2)
    side = lambda x: got.select(F.col("_key").alias(x), F.col("size").alias(f"size_{x}"), F.col("odd").alias(f"odd_{x}"))
    pairs = side("a").join(side("b"), F.floor(F.col("a") / 4) == F.floor(F.col("b") / 4)).where("a < b").select("a", "b", simhash.may_reach(0.8).alias("can"))
    sets = [slow_shingles(x) for x in texts]
    seen = set()
    for r in pairs.collect():
        x, y = sets[r["a"]], sets[r["b"]]
        alike = len(x & y) >= 0.8 * len(x | y)
        assert r["can"] or not alike
        seen.add((r["can"], alike))
    assert {(True, True), (False, False)} <= seen
