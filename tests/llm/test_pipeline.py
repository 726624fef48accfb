import sys

from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 3)[0])

import corpus_pipeline as P  # noqa: E402

from test_jaccard import brute_kept  # noqa: E402

from kerbline.llm import decontam, langid, mixing, quality  # noqa: E402


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for k, (_, function) in enumerate(P.STAGES):
        out = P.stage(function(spark, docs, sf), f"test-{k}")
        if k < 4:
            assert out.columns == docs.columns
        kept.append((docs, out))
        docs = out
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    told, good, unique, clean, mixed = ((ids(a), ids(b), a) for a, b in kept)
    assert told[1] == {r["doc_id"] for r in langid.keep_confident(told[2], langid.fit(told[2]), P.LEAST_LANGUAGE).collect()}
    assert told[0] - told[1] <= {r["doc_id"] for r in told[2].where("n_chars < 200").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert good[1] == {r["doc_id"] for r in quality.predict(good[2], quality.fit(good[2], labels)).where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"]) for r in unique[2].select("doc_id", "text").collect()]
    assert unique[1] == brute_kept(rows) and len(unique[1]) < len(unique[0])
    hits = decontam.scan(clean[2], spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()
    assert hits and clean[1] == clean[0] - {r["doc_id"] for r in hits}
    assert mixed[1] == {r["doc_id"] for r in mixing.mix(mixing.sized(mixed[2])).where("copies > 0").collect()}
    # clean prose stays: of documents labelled good, the first two stages lose almost none
    fine = {r["doc_id"] for r in labels.where("quality = 1").collect()} & told[0]
    assert len(fine & good[1]) / len(fine) > 0.97


def test_odd_rows_go_through(spark, sf, tmp_path, odd):
    """Null, empty, blank, long and repeated rows, rows without an id, clashing names; and empty tables."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(300)
    extra = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in odd] + [(None, None, None, None, None)] * 3, docs.schema)
    table = docs.unionByName(extra).withColumns({c: F.lit("own") for c in ("copies", "position", "_id", "_key", "score", "root", "_one", "_hit", "_size")})
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    for name, rows in (("full", table), ("empty", table.where(F.lit(False)))):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        (labels if name == "full" else labels.where(F.lit(False))).write.parquet(f"{folder}/labels.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        out = P.run(spark, folder)
        assert out.columns == [*table.columns, "copies_", "position_"]
        got = out.collect()
        assert all(r["copies"] == "own" and r["copies_"] > 0 and r["text"] for r in got)
        assert bool(got) == (name == "full") and len({r["text"] for r in got}) == len(got)
