import hashlib
import re

from pyspark.sql import functions as F

from kerbline.llm import decontam
from kerbline.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        k = min(width, len(w))
        for i in range(len(w) - k + 1) if k else ():
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    for doc, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if x := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= x
        yield (doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


def test_whole_table_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op10_decontam"](spark, sf).collect()]
    assert sorted(got, key=key) == sorted(brute(docs, items), key=key)
    assert any(r[5] for r in got)


def test_odd_rows_blocks_and_short_items(spark, docs_of, odd):
    long_item = " ".join(f"w{i}" for i in range(25))
    rows = [*odd, (20, f"Before. {long_item.upper()}, after it"), (21, "say Hello-World twice: hello world"), (22, "x " + " ".join(f"w{i}" for i in range(3, 14)) + " y")]
    items = [(1, long_item), (2, "hello world"), (3, None), (4, "..."), (None, "one"), (1, "no id at")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    want = sorted(brute([r[:2] for r in rows], [("" if i is None else i, t) for i, t in items]), key=key)
    for block in (200_000, 3):
        got = decontam.scan(docs_of(rows), bench, block_words=block).collect()
        assert sorted(map(tuple, got), key=key) == want
    kept = decontam.remove_documents(docs_of(rows), bench)
    assert kept.columns == docs_of(rows).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(r[0] or 0 for r in want if not r[5])
    cut = {r["doc_id"]: r["text"] for r in decontam.remove_spans(docs_of(rows), bench).collect()}
    assert cut[20] == "Before. , after it" and cut[21] == "say  twice: " and cut[22] == "x  y" and cut[1] is None
    empty = docs_of(rows).where(F.lit(False))
    assert decontam.scan(empty, bench).collect() == []
    assert not any(r["contaminated"] for r in decontam.scan(docs_of(rows), bench.where(F.lit(False))).collect())


def test_spans_do_not_depend_on_blocks(spark, docs_of):
    """Items that overlap in a text, and one window that very many items have."""
    rows = [(1, "a b c d"), (2, "x a b c d e y"), (3, None), (4, "the same ten words are in all items of it twice the same ten words are in all items of it")]
    for items in ([(1, "b c"), (2, "a d")], [(1, "a b c"), (2, "c d e")], [(i, "the same ten words are in all items of it") for i in range(3000)]):
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = [{r["doc_id"]: r["text"] for r in decontam.remove_spans(docs_of(rows).withColumn("_hit", F.lit(1)), bench, block_words=k).collect()} for k in ((2, 3, 100) if len(items) < 9 else (20_000, 10**6))]
        assert all(x == got[0] for x in got)
        text = got[0][2 if items[0][1] == "a b c" else 1]
        assert text == {"b c": "a  d", "a b c": "x  y"}.get(items[0][1], "a b c d")
    found = decontam.scan(docs_of(rows), bench).where("doc_id = 4").first()
    assert found["n_items"] == 3000 and found["n_hit"] == 20
