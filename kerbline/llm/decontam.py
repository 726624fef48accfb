r"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Texts are lowered (A-Z) and cut into words of digits, a-z and anything outside ASCII. A
benchmark item's windows are its runs of ``width`` words; an item of fewer words, but not
none, is one window. A document's windows are keyed by a rolling hash over its bytes, all
at once; keys that may be in the set are verified by the windows' bytes. A word inside
any occurrence is hit.

The set is broadcast in blocks of at most ``block_words`` benchmark words (one item may
exceed this, as it is not cut), about 60 bytes a word: the documents pass once for each block, and the hits
are kept with the row. So what a worker holds doesn't grow with the benchmark, and the
result doesn't depend on the blocks.

Defined results: null or wordless texts have no words, no windows and no hits; repeated
rows and ids count each; a null item_id is listed as an empty string; an empty benchmark
hits nothing; an empty table gives no rows. Other columns are ignored by ``scan`` and kept
as they are by ``remove_documents`` and ``remove_spans``, whatever their names. Texts are scanned whole, of
any length that fits in a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import free_name, span_keys, stage, word_spans

#: Byte table: A-Z lowered; what is neither digit, letter nor part of a longer character is a space.
TABLE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def normalised(text: str | None) -> bytes:
    return b" ".join((text or "").encode().translate(TABLE).split())


def _bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(data == 32)
    return data, np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [data.size]])


class WindowSet:
    """The different windows of a block of items: sorted keys, the bytes they stand for, the items that have them.

    A bitmap over the keys comes before the exact lookup.
    """

    def __init__(self, items: list[tuple[str, str | None]], width: int = 10) -> None:
        self.names = [item for item, _ in items]
        texts, keys, spans, of = [], [], [], []
        self.lengths: set[int] = set()
        at = 0
        for i, (_, text) in enumerate(items):
            joined = normalised(text)
            if not joined:
                continue
            data, starts, ends = _bounds(joined)
            k = min(width, starts.size)
            self.lengths.add(k)
            a, b = starts[: starts.size - k + 1], ends[k - 1 :]
            keys.append(span_keys(data, a, b))
            spans.append(np.stack([a + at, b + at], axis=1))
            of.append(np.full(a.size, i, np.int32))
            texts.append(joined)
            at += len(joined)
        self.bytes = b"".join(texts)
        every = np.concatenate([np.zeros(0, np.uint64), *keys])
        order = np.argsort(every, kind="stable")
        self.keys, self.spans, self.of = every[order], np.concatenate([np.zeros((0, 2), np.int64), *spans])[order], np.concatenate([np.zeros(0, np.int32), *of])[order]
        self.bits = max(16, int(max(every.size, 1)).bit_length() + 5)
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[self.keys >> np.uint64(64 - self.bits)] = True

    def _window(self, i: int) -> bytes:
        a, b = self.spans[i].tolist()
        return self.bytes[a:b]

    def hits(self, joined: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged word ranges that are hit, and the items found."""
        if not joined:
            return 0, [], set()
        data, starts, ends = _bounds(joined)
        n, spans, found, known = starts.size, [], set(), {}
        for k in self.lengths:
            if k > n:
                continue
            a, b = starts[: n - k + 1], ends[k - 1 :]
            keys = span_keys(data, a, b)
            for i in np.flatnonzero(self.bitmap[keys >> np.uint64(64 - self.bits)]).tolist():
                window = joined[a[i] : b[i]]
                if window not in known:  # once a document, however often it occurs
                    first, last = np.searchsorted(self.keys, keys[i]), np.searchsorted(self.keys, keys[i], "right")
                    same = [j for j in range(first, last) if self._window(j) == window]
                    known[window] = bool(same)
                    found.update(self.names[x] for x in set(self.of[same].tolist()))
                if known[window]:
                    spans.append((i, i + k))
        return n, merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def window_sets(benchmark: DataFrame, width: int = 10, block_words: int = 2_000_000) -> Iterator:
    """Broadcast window sets, one bounded block of the benchmark after another; at least one."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").toLocalIterator()
    block, size = [], 0
    for item, text in rows:
        words = normalised(text).count(b" ") + 1
        if block and size + words > block_words:
            yield spark.sparkContext.broadcast(WindowSet(block, width))
            block, size = [], 0
        block.append((item, text))
        size += words
    yield spark.sparkContext.broadcast(WindowSet(block, width))


def _by_blocks(docs: DataFrame, sets: Iterator, step) -> DataFrame:
    """``step`` for one set after another; what an earlier set found is stored before the next."""
    out = None
    for windows in sets:
        out = step(docs if out is None else stage(out, "decontam-block"), windows)
    return out


_FOUND = "n_words long, spans array<struct<a:int,b:int>>, items array<string>"
_SPAN = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """doc_id, text, n_words, spans (word ranges that are hit), items (sorted) of every row."""
    docs = docs.select("doc_id", "text")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text string, {_FOUND}"
    return _by_blocks(docs, window_sets(benchmark, width, block_words), lambda d, windows: d.mapInArrow(_scan(windows), schema))


def _scan(windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = windows.value.hits
        for b in batches:
            names = b.schema.names
            spans0 = b.column("spans").to_pylist() if "spans" in names else None
            items0 = b.column("items").to_pylist() if "items" in names else None
            counts, spans, items = [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                n, hit, found = find(normalised(text))
                if spans0 is not None:
                    hit, found = merged(hit + [(x["a"], x["b"]) for x in spans0[i]]), found | set(items0[i])
                counts.append(n)
                spans.append([{"a": x, "b": y} for x, y in hit])
                items.append(sorted(found))
            cols = [b.column("doc_id"), b.column("text"), pa.array(counts, pa.int64()), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "n_words", "spans", "items"])

    return run


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    found = find_hits(docs, benchmark, width, block_words).drop("text")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the hit words and what stands between them."""
    raw = text.encode()
    starts, ends = word_spans(np.frombuffer(raw.translate(TABLE), np.uint8) != 32)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode()


def remove_documents(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """The rows without a hit, all columns as they were."""

    def step(docs: DataFrame, windows) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = windows.value.hits
            for b in batches:
                yield b.filter(pa.array([not find(normalised(x))[1] for x in b.column(b.schema.names.index("text")).to_pylist()], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    return _by_blocks(docs, window_sets(benchmark, width, block_words), step)


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """All rows, hit words cut from the texts: those that any block hits in the text as it came, cut at once after the last."""
    hit = free_name(docs, "_hit")

    def step(docs: DataFrame, windows) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = windows.value.hits
            for b in batches:
                texts, before = b.column(b.schema.names.index("text")).to_pylist(), b.column(b.num_columns - 1).to_pylist()
                spans = [merged(find(normalised(x))[1] + [(s["a"], s["b"]) for s in old]) for x, old in zip(texts, before, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([[{"a": x, "b": y} for x, y in s] for s in spans], _SPAN)], names=b.schema.names)

        return docs.mapInArrow(run, docs.schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index("text")
            pairs = zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)
            new = pa.array([without_spans(x, [(s["a"], s["b"]) for s in spans]) if spans else x for x, spans in pairs], b.schema.types[at])
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns[:-1])], schema=pa.schema(list(b.schema)[:-1]))

    marked = docs.withColumn(hit, F.array().cast("array<struct<a:int,b:int>>"))
    return _by_blocks(marked, window_sets(benchmark, width, block_words), step).mapInArrow(cut, docs.schema)
