"""LM scoring: prediction by partial matching over bytes.

The model is a byte-context trie, kept as tables of counts by depth: n(c, s) of symbol s
after context c, for contexts of ``ORDER`` symbols down to none. A text is its lowered
bytes and an end mark; before its start stand boundary marks. The longest contexts count
occurrences; a shorter one counts the distinct contexts, longer by one, in which the
symbol was seen (update exclusion). Every symbol seen after a context was seen after its
suffixes too. That makes symbol exclusion exact with one number for each context:

    T(c), q(c)   sum of the counts after c, distinct symbols after it
    X(c)         sum of the counts, after c's suffix, of those symbols that follow c

Escape estimation is method D: a symbol of count n has (2n - 1) / 2T, an escape q / 2T. After
an escape from c, its suffix c' is used with T(c') - X(c) and q(c') - q(c), i.e. without the
symbols that c would have coded. Contexts never seen cost nothing; below the empty context
the symbols not seen at all are equally likely. The score of a text is the sum of log10
probabilities (``pretrained``), or of those under a model that starts empty and learns from
the text itself (``adaptive_bits``).

Scale. Different texts, with the number of training rows that have them, are dealt into blocks of about
``BLOCK_BYTES`` by their digest, so repeats of a row neither fill a block nor are scored twice. Each block gives its
distinct (context, symbol) keys and words once, with their training counts, as 64-bit keys: rows grow with
the corpus, far slower than its positions. Counts are summed by key, log probabilities are
joined to the keys that each block needs, and a block is scored from its own keys alone.
So no worker holds the model, and no table is broadcast. The blocks are scored in
``WAVES``, so that only a part of what is shuffled lies on disk at once.

Words are keyed by 63-bit hashes (``common.word_hashes``); those of up to eight bytes and equal length never
collide but for the lost bit, others of k distinct words with a chance of about k^2 / 2^64.

Defined results: null text is empty, i.e. one end token; a null doc_id hashes as the empty
text; repeated rows count as often as they occur; without training rows all symbols are
equally likely; one text, of any length that fits in a row, is scored in one piece; an empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import LOWER, NOT_SPACE, id_remainder, mix64, release, stage, word_hashes, word_spans

ORDER = 5
BLOCK_BYTES = 16 << 20
BATCH_BYTES = 1 << 20
#: Scoring goes in so many waves of blocks, so that no more than a part of the shuffled rows is on disk at once.
WAVES = 4
#: Symbols take 9 bits: bytes and the boundary mark, which is also the end of a text.
WIDTH, EDGE, SYMBOLS = 9, 256, 257
#: Words have the sign bit set; the end token has no other.
WORD = np.uint64(1 << 63)


def _lowered(text: str | None) -> np.ndarray:
    return LOWER[np.frombuffer((text or "").encode(), np.uint8)]


def gram_keys(texts: list[np.ndarray], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all (context, symbol) of lowered texts, one text after another, and how many each has."""
    sizes = np.array([t.size + 1 for t in texts], np.int64)
    flat = np.full(int(sizes.sum()) + order * len(texts), EDGE, np.uint64)
    at = order
    for t in texts:
        flat[at : at + t.size] = t
        at += t.size + 1 + order
    n = flat.size - order
    keys = np.zeros(n, np.uint64)
    for j in range(order + 1):
        keys <<= np.uint64(WIDTH)
        keys |= flat[j : j + n]
    if len(texts) > 1:  # drop the positions inside the marks between texts
        begin = np.concatenate([[0], np.cumsum(sizes + order)[:-1]])
        keep = np.zeros(n, bool)
        edge = np.zeros(n + 1, np.int64)
        edge[begin] += 1
        edge[begin + sizes] -= 1
        keep = np.cumsum(edge[:-1]) > 0
        keys = keys[keep]
    return keys.view(np.int64), sizes


def word_keys(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words of lowered texts, the end token last in each, and how many each has."""
    flat = np.concatenate([np.append(t, np.uint8(32)) for t in texts]) if texts else np.zeros(0, np.uint8)
    starts, ends = word_spans(NOT_SPACE[flat])
    keys = word_hashes(flat, starts, ends)
    keys |= WORD
    keys[keys == WORD] = WORD | np.uint64(1)
    stops = np.cumsum([t.size + 1 for t in texts])
    upto = np.searchsorted(starts, stops)
    counts = np.diff(np.concatenate([[0], upto]))
    return np.insert(keys, upto, WORD).view(np.int64), counts + 1


class KeyTable:
    """Open-addressing lookup of int64 keys, built and probed on whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(8, int(max(keys.size, 1)).bit_length() + 1)
        self.keys, self.values = np.append(keys, 0), np.append(values, np.nan)
        self.slots = np.full(1 << self.bits, keys.size, np.int32)
        left, at = np.arange(keys.size, dtype=np.int32), self._slot(keys)
        while left.size:
            free = self.slots[at] == keys.size
            self.slots[at[free]] = left[free]
            done = self.slots[at] == left
            left, at = left[~done], (at[~done] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values; nan for keys that aren't there."""
        keys = np.ascontiguousarray(keys)
        at = self._slot(keys)
        found = self.slots[at]
        left = np.flatnonzero((self.keys[found] != keys) & (found != self.keys.size - 1))
        while left.size:
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found[left] = self.slots[at[left]]
            left = left[(self.keys[found[left]] != keys[left]) & (found[left] != self.keys.size - 1)]
        return self.values[found]


def _batches(texts: pa.Array, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of the places ``at`` whose texts have a bounded size together (one may exceed it)."""
    first, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_numpy()[at].tolist()):
        size += n + 1
        if size >= BATCH_BYTES or i + 1 == at.size:
            yield first, i + 1
            first, size = i + 1, 0


def _tallied(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every, n = every[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if every.size else np.zeros(0, np.int64)
    return every[first], np.add.reduceat(n, first) if first.size else np.zeros(0, np.int64)


def _unique(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts, times n (training rows of the texts)."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if keys.size else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, keys.size)) * n


def _count(order: int):
    """(block, key, n): the distinct keys of the block's texts in a task, n from their training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for block, lists in held.items():
                k, n = _tallied(*lists)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k.size, block, np.int64)), pa.array(k), pa.array(n)], names=["block", "key", "n"])

        for b in batches:
            blocks, learn, texts = b.column("block").to_numpy(), b.column("learn").to_numpy(), b.column("text")
            for block in np.unique(blocks).tolist():
                lists = held.setdefault(block, ([], []))
                for use in np.unique(learn[blocks == block]).tolist():
                    at = np.flatnonzero((blocks == block) & (learn == use))
                    for i, j in _batches(texts, at):
                        low = [_lowered(t) for t in texts.take(pa.array(at[i:j])).to_pylist()]
                        for keys in (gram_keys(low, order)[0], word_keys(low)[0]):
                            k, n = _unique(keys, use)
                            lists[0].append(k)
                            lists[1].append(n)
                        if len(lists[0]) >= 16:
                            k, n = _tallied(*lists)
                            lists[0][:], lists[1][:] = [k], [n]
            if sum(k.size for lists in held.values() for k in lists[0]) > 3_000_000:
                yield from out()
                held.clear()
        yield from out()

    return run


# ---- the model, as tables ----------------------------------------------------


def _low(key: Column, symbols: int) -> Column:
    return key.bitwiseAND(F.lit((1 << (WIDTH * symbols)) - 1))


def log_probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """key, lp (log10) for every (context, symbol) key in ``counts`` (key, n), of which n > 0 were learned.

    Keys with n > 0 need their own context only. The others walk down the orders.
    """
    grams = counts.where("n > 0").select(F.col("key").alias("gram"), "n")
    levels = {order: grams}
    for k in range(order - 1, -1, -1):
        levels[k] = stage(levels[k + 1].groupBy(_low(F.col("gram"), k + 1).alias("gram")).agg(F.count("*").alias("n")), f"ppm-{k}")
    contexts = {}
    for k in range(order, -1, -1):
        rows = levels[k].withColumn("ctx", F.shiftright("gram", WIDTH))
        if k:
            shorter = levels[k - 1].select(F.col("gram").alias("_g"), F.col("n").alias("_n"))
            rows = rows.join(shorter, _low(F.col("gram"), k) == F.col("_g"))
        else:
            rows = rows.withColumn("_n", F.lit(0).cast("long"))
        sums = rows.groupBy("ctx").agg(F.sum("n").alias("t"), F.count("*").alias("q"), F.sum("_n").alias("x"))
        contexts[k] = stage(sums, f"ppm-contexts-{k}")
    top = contexts[order].select(F.col("ctx").alias("_c"), "t", "q")
    known = grams.join(top, F.shiftright("gram", WIDTH) == F.col("_c"))
    known = known.select(F.col("gram").alias("key"), F.log10((2 * F.col("n") - 1) / (2 * F.col("t"))).alias("lp"))
    # the rest: escape, order by order
    left = counts.where("n = 0").select("key", F.lit(0.0).alias("lp"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("ex"), F.lit(0).cast("long").alias("eq"))
    for k in range(order, -1, -1):
        c = contexts[k].select(F.col("ctx").alias("_c"), F.col("t").alias("_t"), F.col("q").alias("_q"), F.col("x").alias("_x"))
        g = levels[k].select(F.col("gram").alias("_g"), F.col("n").alias("_n"))
        left = left.join(c, F.shiftright(_low(F.col("key"), k + 1), WIDTH) == F.col("_c"), "left").join(g, _low(F.col("key"), k + 1) == F.col("_g"), "left")
        t, q = F.col("_t") - F.col("ex"), F.col("_q") - F.col("eq")
        gain = F.when(F.col("done") | F.col("_c").isNull(), 0.0).when(F.col("_g").isNotNull(), F.log10((2 * F.col("_n") - 1) / (2 * t))).when(q > 0, F.log10(q / (2 * t))).otherwise(0.0)
        seen = F.coalesce("_x", F.lit(0).cast("long")), F.coalesce("_q", F.lit(0).cast("long"))
        left = left.select("key", (F.col("lp") + gain).alias("lp"), (F.col("done") | F.col("_g").isNotNull()).alias("done"), seen[0].alias("ex"), seen[1].alias("eq"))
    # no order has the symbol: all that the empty context hasn't seen are alike
    left = left.select("key", F.when(F.col("done"), F.col("lp")).otherwise(F.col("lp") - F.log10(F.greatest(F.lit(SYMBOLS) - F.col("eq"), F.lit(1)).cast("double"))).alias("lp"))
    return known.unionByName(left)


# ---- scoring -----------------------------------------------------------------

_SCORES = "n_tokens long, n_known long, base_score double, score double"


def _score(order: int, tokens: int, distinct: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key, value = right.column("key").to_numpy(), right.column("value").to_numpy()
        grams = KeyTable(key[key >= 0], value[key >= 0])
        words = KeyTable(key[key < 0], value[key < 0])
        del key, value
        texts = left.column("text").combine_chunks()
        cols: list[list[np.ndarray]] = [[], [], [], []]
        floor = math.log10(1 / (tokens + distinct + 1))
        for i, j in _batches(texts, np.arange(len(texts))):
            low = [_lowered(t) for t in texts.slice(i, j - i).to_pylist()]
            keys, sizes = gram_keys(low, order)
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            cols[3].append(np.add.reduceat(grams[keys], begin))
            keys, sizes = word_keys(low)
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            count = words[keys]
            cols[0].append(sizes)
            cols[1].append(np.add.reduceat((count > 0).astype(np.int64), begin))
            cols[2].append(np.add.reduceat(np.log10(count + 1) + floor, begin))
        flat = [np.concatenate(c) if c else np.zeros(0) for c in cols]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([left.column("digest"), *(pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(flat, kinds, strict=True))], names=["digest", "n_tokens", "n_known", "base_score", "score"])

    return run


def pretrained(docs: DataFrame, held_out: tuple[int, int] = (7, 2), order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learned from the rows whose crc32(doc_id) has another remainder than held_out's.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (id_remainder(F.col("doc_id"), held_out[0]) == held_out[1]).alias("held_out"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = int(max(1, -(-size // block_bytes)))
    distinct_texts = rows.groupBy("digest").agg(F.first("text").alias("text"), F.sum(F.when(F.col("held_out"), 0).otherwise(1)).alias("learn"))
    dealt = stage(distinct_texts.select(F.pmod(F.xxhash64("digest"), F.lit(blocks)).alias("block"), "digest", "learn", "text"), "ppm-texts")
    release(spark)
    keyed = dealt.select("block", "learn", "text").repartition(blocks, "block").mapInArrow(_count(order), "block long, key long, n long")
    keyed = stage(keyed, "ppm-keys")
    release(spark)
    totals = stage(keyed.groupBy("key").agg(F.sum("n").alias("n")), "ppm-totals")
    release(spark)
    words = totals.where("key < 0")
    sums = words.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    tokens, distinct = int(sums["n"] or 0), int(sums["v"] or 0)
    values = log_probabilities(totals.where("key >= 0"), order).select(F.col("key").alias("_key"), F.col("lp").alias("value"))
    values = stage(values.unionByName(words.select(F.col("key").alias("_key"), F.col("n").cast("double").alias("value"))), "ppm-values")
    release(spark)
    scored = None
    for wave in range(WAVES):
        turn = F.col("block") % WAVES == wave
        needed = keyed.where(turn).select("block", "key").join(values, F.col("key") == F.col("_key")).select("block", "key", "value")
        texts = dealt.where(turn).select("block", "digest", "text")
        part = stage(texts.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(_score(order, tokens, distinct), f"digest binary, {_SCORES}"), "ppm-scores")
        scored = part if scored is None else scored.unionByName(part)
        release(spark)
    scored = scored.withColumnRenamed("digest", "_digest")
    out = rows.select("doc_id", "held_out", "digest").join(scored, F.col("digest") == F.col("_digest"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def adaptive_bits(text: str | None, order: int = ORDER) -> float:
    """Code length in bits of one text under a trie that starts empty and learns as it goes."""
    trie: dict[tuple[int, ...], dict[int, int]] = {}
    past, bits = [EDGE] * order, 0.0
    for s in [*_lowered(text).tolist(), EDGE]:
        gone: set[int] = set()
        for k in range(order, -1, -1):
            after = trie.get(tuple(past[order - k :]))
            if not after:
                continue
            total = sum(n for x, n in after.items() if x not in gone)
            kinds = len(after.keys() - gone)
            if s in after:
                bits -= math.log2((2 * after[s] - 1) / (2 * total))
                break
            if kinds:
                bits -= math.log2(kinds / (2 * total))
            gone |= after.keys()
        else:
            bits += math.log2(SYMBOLS - len(gone))
        for k in range(order, -1, -1):  # update exclusion: up to the first context that knew the symbol
            after = trie.setdefault(tuple(past[order - k :]), {})
            after[s] = after.get(s, 0) + 1
            if after[s] > 1:
                break
        past = [*past[1:], s]
    return bits


def adaptive(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, bits of every row, each coded on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([adaptive_bits(t, order) for t in b.column("text").to_pylist()], pa.float64())], names=["doc_id", "bits"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, bits double")
