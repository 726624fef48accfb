import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import ppm


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w] + [None]


class Trie:
    """Prediction by partial matching straight from its definition."""

    def __init__(self, order):
        self.order, self.after = order, defaultdict(Counter)

    def symbols(self, text):
        flat = [256] * self.order + list(lower(text).encode()) + [256]
        for i in range(self.order, len(flat)):
            yield flat[i - self.order : i], flat[i]

    def learn(self, text):
        for ctx, s in self.symbols(text):
            for k in range(self.order, -1, -1):
                after = self.after[tuple(ctx[self.order - k :])]
                after[s] += 1
                if after[s] > 1:
                    break

    def log10(self, text):
        out = 0.0
        for ctx, s in self.symbols(text):
            gone = set()
            for k in range(self.order, -1, -1):
                after = self.after.get(tuple(ctx[self.order - k :]))
                if not after:
                    continue
                total, kinds = sum(n for x, n in after.items() if x not in gone), len(after.keys() - gone)
                if s in after:
                    out += math.log10((2 * after[s] - 1) / (2 * total))
                    break
                if kinds:
                    out += math.log10(kinds / (2 * total))
                gone |= after.keys()
            else:
                out -= math.log10(257 - len(gone))
        return out


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def check(rows, got, order):
    learn = [t for i, t in rows if not held(i)]
    counts = Counter(w for t in learn for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    trie = Trie(order)
    for t in learn:
        trie.learn(t)
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, t in rows:
        r = by[i][0] if len(by[i]) == 1 else next(x for x in by[i] if x["n_tokens"] == len(tokens(t)))
        w = tokens(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r["score"] == pytest.approx(trie.log10(t), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize(("order", "block"), [(5, 1 << 25), (2, 2000)])
def test_against_the_definition(spark, docs_of, odd, sf, order, block):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text")).where("doc_id < 60").collect()]
    rows = [(i, t[:3000]) for i, t in rows] + [(1000 + (i or 0) * 3, t) for i, t in odd[:7]] + [(None, "no id"), (9, "Zq\x00\x01 ünï \U0001f600")]
    rows = [r for k, r in enumerate(rows) if r[0] != 9 or k >= 60]
    got = ppm.pretrained(docs_of(rows), order=order, block_bytes=block).collect()
    check(rows, got, order)


def test_empty_table_and_no_training_rows(spark, docs_of):
    assert ppm.pretrained(docs_of([(1, "x")]).where(F.lit(False))).collect() == []
    alone = next(i for i in range(100) if held(i))
    check([(alone, "only held out")], ppm.pretrained(docs_of([(alone, "only held out")])).collect(), ppm.ORDER)


@pytest.fixture(scope="module")
def whole(spark, sf):
    """The texts of the whole table, and the query's rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return [tuple(r) for r in docs.select("doc_id", "text").collect()], {r["doc_id"]: r for r in ppm.pretrained(docs).collect()}


def test_learns_the_corpus(whole):
    rows, got = whole
    size = {i: len((t or "").encode()) + 1 for i, t in rows}
    out = [r for r in got.values() if r["held_out"]]
    assert -sum(r["score"] for r in out) / sum(size[r["doc_id"]] for r in out) * math.log2(10) < 2.4  # bits a byte; 8 without a model


def test_adaptive_is_the_definition_learned_on_the_go():
    text = "abracadabra Abracadabra"
    trie, bits = Trie(3), 0.0
    for ctx, s in list(trie.symbols(text)):
        one = Trie(3)
        one.after, one.symbols = trie.after, lambda _, at=(ctx, s): [at]
        bits -= one.log10("") * math.log2(10)
        one.learn("")
    assert ppm.adaptive_bits(text, 3) == pytest.approx(bits)
    assert ppm.adaptive_bits(None) == pytest.approx(math.log2(257))


def test_key_table_finds_all_and_only_its_keys():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(-(2**62), 2**62, 5000))
    table = ppm.KeyTable(keys[::2], np.arange(keys[::2].size, dtype=float))
    assert (table[keys[::2]] == np.arange(keys[::2].size)).all() and np.isnan(table[keys[1::2]]).all()
    assert np.isnan(ppm.KeyTable(keys[:0], np.zeros(0))[keys[:3]]).all()


def test_word_columns_of_the_whole_table(whole):
    rows, got = whole
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for i, t in rows:
        w = tokens(t)
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (held(i), len(w), sum(counts[x] > 0 for x in w), n)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)


def test_words_made_to_collide_under_polynomial_hashes():
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    words = [thue, thue.translate(str.maketrans("ab", "ba")), thue[:64], thue[:64].translate(str.maketrans("ab", "ba")), thue[:16], "b" + thue[1:16], "a", "b", "a\x00", "ab", "x" * 65, "x" * 64]
    keys, sizes = ppm.word_keys([ppm._lowered(" ".join(words)), ppm._lowered("ab"), ppm._lowered("")])
    assert sizes.tolist() == [13, 2, 1] and len(set(keys[:12].tolist())) == 12
    assert keys[13] == keys[9] and keys[12] == keys[14] == keys[15]


def test_repeats_of_a_row_are_one_text(spark, docs_of):
    first = next(i for i in range(100) if not held(i))
    rows = [(first, "the same row again and again")] * 3000 + [(1000 + i, f"row {i} of the others") for i in range(30)]
    got = ppm.pretrained(docs_of(rows), block_bytes=500).collect()
    learn = [t for i, t in rows if not held(i)]
    trie = Trie(ppm.ORDER)
    for t in learn:
        trie.learn(t)
    assert len(got) == len(rows) and all(r["train_tokens"] == sum(len(tokens(t)) for t in learn) for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    for i, t in rows[2999:]:
        assert by[i] == pytest.approx(trie.log10(t), rel=1e-9)
