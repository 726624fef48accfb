"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: a bit is 1 if it is set in over half of the XXH64 values (seed 42) of a
document's word shingles. Documents link at ``distance`` or fewer differing bits; a
class is what links reach.

Links are searched among distinct fingerprints, so copies cost nothing. The 64 bits are
dealt into parts, correlated bits together, and each part i gets a threshold t_i of its
own (-1: not used) with sum(t_i) = distance - parts + 1; two fingerprints within
``distance`` then differ in at most t_i bits of some part. Number of parts and
thresholds come from a dynamic program over estimated candidate counts, from the
frequencies of the bits over all fingerprints. Of two fingerprints whose parts differ in
the bits D, the one with a 0 in D's lowest bit probes the other's part, so each pair is met
once a part; an equi-join's condition verifies the whole distance.

Dense groups would pair up by the square. So fingerprints are first linked to the least one
of some group (those that agree outside a run of bits, or in a part), by a grouped minimum;
what is in one class is not paired again, as the probing join only yields pairs of
different classes. No link between classes is lost.

``drop_near_duplicates`` decides by Jaccard similarity of the shingles. One fingerprint's
distance tells little about that, so a text has ``prints`` independent ones (the XXH64 values
mixed anew for each), a pair within ``distance`` in any of them is a candidate, and candidates are
verified on their shingles. A pair of similarity s is met with the chance 1 - (1 - p)^prints, p the
chance that a binomial of 64 and acos(2s / (1 + s)) / pi is at most ``distance``: 0.96 for the defaults
at the threshold of 0.8 itself, 0.997 at 0.85 (``chance_met``). Pairs below the threshold are never linked.

Defined results: null or empty text has fingerprint 0 and links like any other; a null
doc_id has a class, of which it is never the smallest id unless all are null; repeated
rows give repeated results; texts are taken whole, of any length that fits in a row; an empty
table gives no rows. Extra columns are ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import discard, free_name, mix64, release, row_hash, stage
from kerbline.llm.components import connected_components
from kerbline.llm.jaccard import shingle_sets, similar, text_key

_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, words: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; of fewer words than one the whole sequence."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=False)]), ">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits set in over half of each row's values; 0 if a row is empty. Eight bits a pass are counted in the bytes of one word."""
    if not hashes.shape[1]:
        return np.zeros(hashes.shape[0], np.uint64)
    votes = np.zeros((hashes.shape[0], 8, 8), np.int64)
    starts = np.arange(0, hashes.shape[1], 255)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, starts, axis=1)
        votes[:, :, k] = lanes.astype("<u8").view(np.uint8).reshape(hashes.shape[0], -1, 8).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * votes > hashes.shape[1], axis=2, bitorder="little").reshape(-1, 8).view("<u8")[:, 0]


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    return int(majority(shingle_hashes(text, words, seed)[None])[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, words, seed) for x in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def several_fingerprints(rows: DataFrame, words: int, prints: int, seed: int = 42, remembered: int = 10_000) -> DataFrame:
    """The columns of ``rows`` but ``text``, and ``fps``, as many independent fingerprints, ``size``, the number of
    different shingles, and ``odd``, for each of 256 ranges of their values whether it has an odd number of them.
    rows: ``_key`` of the text, ``text``."""
    names = [c for c in rows.columns if c != "text"]
    salts = mix64(np.arange(1, prints, dtype=np.uint64))[:, None]  # the first fingerprint is the plain one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, int, np.ndarray]] = {}  # of repeated texts
        for b in batches:
            out = []
            for key, text in zip(b.column("_key").to_pylist(), b.column("text").to_pylist(), strict=True):
                if key not in known:
                    if len(known) >= remembered:
                        known.clear()
                    hashes = shingle_hashes(text, words, seed)
                    fps = majority(np.concatenate([hashes[None], mix64(hashes ^ salts)]))
                    different = np.unique(hashes)
                    odd = np.bincount((different >> np.uint64(56)).astype(np.int64), minlength=256) & 1
                    known[key] = fps, different.size, np.packbits(odd.astype(np.uint8)).view(np.int64)
                out.append(known[key])
            fps, odd = (_lists([x[i].view(np.int64) for x in out], n) for i, n in ((0, prints), (2, 4)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), fps, pa.array([x[1] for x in out], pa.int32()), odd], names=[*names, "fps", "size", "odd"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", fps array<long>, size int, odd array<long>")


def _lists(rows: list[np.ndarray], n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * n), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def may_reach(least: float) -> Column:
    """Whether texts a and b can have this similarity: sets that do differ in few shingles, and so in few ranges' parities."""
    apart = sum((F.bit_count(F.element_at("odd_a", k).bitwiseXOR(F.element_at("odd_b", k))) for k in range(1, 5)), F.lit(0))
    sizes = F.least("size_a", "size_b") >= F.lit(least) * F.greatest("size_a", "size_b")
    return sizes & (apart <= (F.col("size_a") + F.col("size_b")) * ((1 - least) / (1 + least)) + 1e-6)


def chance_met(similarity: float, distance: int, prints: int) -> float:
    """The chance that a pair of this Jaccard similarity is within ``distance`` in one of the fingerprints at least."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    near = sum(_choose(64, k) * p**k * (1 - p) ** (64 - k) for k in range(distance + 1))
    return 1 - (1 - near) ** prints


# ---- parts and thresholds ----------------------------------------------------


def bit_statistics(fps: DataFrame, prints: int = 1) -> tuple[int, list[np.ndarray]]:
    """Number of rows, and for each of the fingerprints in ``fps`` how often each pair of bits is set together (64 x 64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((prints, 64, 64))
        for b in batches:
            flat = b.column("fps").flatten().to_numpy(zero_copy_only=False).reshape(-1, prints)
            for k in range(prints):
                bits = np.unpackbits(np.ascontiguousarray(flat[:, k]).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
                total[k] += bits.T @ bits
        at = np.arange(prints * 64, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[:, :, j].reshape(-1)) for j in range(64))], names=["i", *(f"c{j}" for j in range(64))])

    sums = fps.select("fps").mapInArrow(run, "i int, " + ", ".join(f"c{j} double" for j in range(64)))
    rows = sums.groupBy("i").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(64)]).collect()  # 64 rows for each fingerprint whatever the input
    together = np.zeros((prints * 64, 64))
    for r in rows:
        together[r["i"]] = r[1:]
    return fps.count(), list(together.reshape(prints, 64, 64))


def deal_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of even size; a part starts with the free bit of the strongest tie and takes on what correlates with it."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    free, out = list(range(64)), []
    for k in range(parts):
        size = (64 - sum(map(len, out)) + (parts - k) - 1) // (parts - k)
        part = [max(free, key=lambda i: (tie[i, free].max(), -i))]
        free.remove(part[0])
        while len(part) < size:
            part.append(max(free, key=lambda i: (tie[i, part].sum(), -i)))
            free.remove(part[-1])
        out.append(sorted(part))
    return out


def plan(n: int, together: np.ndarray, distance: int, most_parts: int = 6, probe_cost: float = 1.0, pair_cost: float = 0.1) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part, of the least estimated cost.

    A part's cost at threshold t: n probes for every value within t, and n * n times
    the chance that two fingerprints differ in at most t of its bits.
    """
    p = np.diag(together) / max(n, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for parts in range(1, min(most_parts, distance + 1) + 1):
        dealt = deal_bits(n, together, parts)
        costs = []
        for bits in dealt:
            chance = np.zeros(distance + 1)
            chance[0] = 1
            for i in bits:
                chance = chance * (1 - differ[i]) + np.concatenate([[0], chance[:-1]]) * differ[i]
            ball = [sum(_choose(len(bits), k) for k in range(t + 1)) for t in range(distance + 1)]
            costs.append([0.0, *(n * ball[t] * probe_cost + float(n) * n * chance[: t + 1].sum() * pair_cost for t in range(distance + 1))])
        # dynamic program over parts; spent: sum of (threshold + 1)
        spend = distance + 1
        table: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * spend
        for cost in costs:
            table = [min(((table[s - c][0] + cost[c], [*table[s - c][1], c - 1]) for c in range(min(s, distance + 1) + 1)), key=lambda x: x[0]) for s in range(spend + 1)]
        if table[spend][0] < best[0]:
            best = (table[spend][0], [(bits, t) for bits, t in zip(dealt, table[spend][1], strict=True) if t >= 0])
    return best[1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(bits: list[int] | tuple[int, ...]) -> int:
    return _signed(sum(1 << b for b in bits))


# ---- links and classes -------------------------------------------------------


def sure_links(fps: DataFrame, distance: int) -> DataFrame:
    """(a, b): each fingerprint and the least one that agrees with it outside a run of ``distance`` bits."""
    runs = [_signed(~sum(1 << b for b in range(k, min(k + distance, 64))) & (2**64 - 1)) for k in range(0, 64, distance)]
    keys = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in runs])).alias("run", "key"))
    least = keys.groupBy("run", "key").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("top <> b").select(F.col("run").alias("_run"), F.col("key").alias("_key"), "b")
    return keys.join(stage(least, "simhash-runs"), (F.col("run") == F.col("_run")) & (F.col("key") == F.col("_key"))).where("fp <> b").select(F.col("fp").alias("a"), "b")


class Parts:
    """The parts of the fingerprints; the expressions that key and probe them. Other columns named in ``more`` travel along."""

    def __init__(self, plans: list[list[tuple[list[int], int]]], more: tuple[str, ...] = ()) -> None:
        self.parts = [(which, bits, t) for which, parts in enumerate(plans) for bits, t in parts]
        self.more = more

    def of(self, which: int) -> Parts:
        """The parts of one of the fingerprints alone."""
        out = Parts([], self.more)
        out.parts = [p for p in self.parts if p[0] == which]
        return out

    def index(self, fps: DataFrame) -> DataFrame:
        """k (key of a part), b, root_b, fp_b... of every part; fps: id, root, fps, and those of ``more``."""
        x = _for_each(fps, [f"named_struct('which', {w}, 'first', {bits[0]}, 'mask', {_mask(bits)}L)" for w, bits, _ in self.parts])
        x = x.withColumn("fp", F.element_at("fps", F.col("x.which") + 1))
        key = F.xxhash64("x.which", "x.first", F.col("fp").bitwiseAND(F.col("x.mask")))
        return x.select(key.alias("k"), F.col("id").alias("b"), F.col("root").alias("root_b"), F.col("fp").alias("fp_b"), *[F.col(c).alias(f"{c}_b") for c in self.more])

    def probes(self, fps: DataFrame) -> DataFrame:
        """k, a, root_a, fp_a..., part, flipped: the keys within each part's threshold that a row has to look up."""
        flips = [f"named_struct('part', {k}, 'which', {w}, 'first', {bits[0]}, 'mask', {_mask(bits)}L, 'flip', {_mask(c)}L, 'low', {_mask(c[:1])}L)" for k, (w, bits, t) in enumerate(self.parts) for size in range(t + 1) for c in combinations(bits, size)]
        x = _for_each(fps, flips).withColumn("fp", F.element_at("fps", F.col("x.which") + 1))
        x = x.where(F.col("fp").bitwiseAND(F.col("x.low")) == 0)
        key = F.xxhash64("x.which", "x.first", F.col("fp").bitwiseAND(F.col("x.mask")).bitwiseXOR(F.col("x.flip")))
        return x.select(key.alias("k"), *[F.col(c).alias(f"{'a' if c == 'id' else c + '_a'}") for c in ("id", "root", "fp", *self.more)], "x.part", (F.col("x.flip") != 0).alias("flipped"))

    def met_before(self) -> Column:
        """Whether an earlier part of the same fingerprint already brings a and b together."""
        apart = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
        met = F.lit(False)
        for k, (w, bits, t) in enumerate(self.parts):
            later = [i for i, p in enumerate(self.parts) if i > k and p[0] == w]
            if later:
                met = met | (F.col("part").between(later[0], later[-1]) & (F.bit_count(apart.bitwiseAND(F.lit(_mask(bits)))) <= t))
        return met


def _for_each(fps: DataFrame, structs: list[str]) -> DataFrame:
    """Every row with each of the structs, as ``x``. What is exploded are their numbers alone: which bits are dealt
    depends on the data, and must not tell apart the plans of one step over different inputs."""
    x = fps.withColumn("x", F.explode(F.array(*[F.lit(k + 1) for k in range(len(structs))])))
    return x.withColumn("x", F.element_at(F.expr(f"array({', '.join(structs)})"), F.col("x")))


def _near(distance: int) -> Column:
    return F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= distance


def probe_links(fps: DataFrame, parts: Parts, distance: int, also: Column | None = None) -> DataFrame:
    """(a, b) of rows of different classes with a fingerprint within ``distance``, once for each; fps: id, root, fps."""
    index = parts.index(fps).withColumnRenamed("k", "key")
    on = (F.col("k") == F.col("key")) & (F.col("flipped") | (F.col("a") < F.col("b"))) & (F.col("root_a") != F.col("root_b")) & _near(distance) & ~parts.met_before()
    return parts.probes(fps).join(index, on if also is None else on & also).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def star_links(fps: DataFrame, parts: Parts, distance: int, also: Column) -> DataFrame:
    """(a, b): each row and the least that agrees with it in a part, if within ``distance``: as many as rows at most, a part."""
    index = parts.index(fps).drop("root_b")
    least = index.groupBy(F.col("k").alias("key")).agg(F.min(F.struct(*index.columns[1:])).alias("to"), F.max("b").alias("top")).where("to.b <> top")
    least = least.select("key", *[F.col(f"to.{c}").alias(f"{c[:-2]}_a" if c != "b" else "a") for c in index.columns[1:]])
    return index.join(least, (F.col("k") == F.col("key")) & (F.col("a") < F.col("b")) & _near(distance) & also).select(F.col("b").alias("a"), F.col("a").alias("b"))


def classes(fps: DataFrame, distance: int = 4, stride: int = 2) -> DataFrame:
    """fps: distinct ``fp``. Returns (fp, root): the least fingerprint of its class, signed order.

    Larger distances are reached in steps from 4: what a step links, the next doesn't pair again.
    """
    fps = stage(fps.select("fp"), "simhash-fps")
    listed = fps.select(F.col("fp").alias("id"), F.array("fp").alias("fps"))
    n, (together,) = bit_statistics(listed)
    radii = [*range(min(4, distance), distance, stride), distance]
    labels = connected_components(sure_links(fps, radii[0])) if radii[0] else None
    for radius in radii if n else ():
        rooted = _rooted(listed, labels)
        links = probe_links(rooted, Parts([plan(n, together, radius)]), radius)
        if labels is not None:
            links = links.unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b")))
        labels = connected_components(links)
    return _rooted(listed, labels).select(F.col("id").alias("fp"), "root")


def _rooted(fps: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return fps.withColumn("root", F.col("id"))
    return stage(fps.join(labels, F.col("id") == F.col("node"), "left").select(*fps.columns, F.coalesce("root", "id").alias("root")), "simhash-rooted")


def similar_classes(texts: DataFrame, docs: DataFrame, words: int = 5, least: float = 0.8, distance: int = 9, prints: int = 5) -> DataFrame:
    """(node, root) of every text that is not the least of its class; texts: different ``id``, ``fps``, ``size``, ``odd``; docs: ``_key``, ``text``.

    The fingerprints are probed one after another, so that only what one of them shuffles lies on disk at once.
    """
    spark = texts.sparkSession
    n, together = bit_statistics(texts, prints)
    if not n:
        return spark.createDataFrame([], "node long, root long")
    parts = Parts([plan(n, t, distance) for t in together], ("size", "odd"))
    can = may_reach(least)
    met = stage(star_links(_rooted(texts, None), parts, distance, can).distinct(), "near-stars")
    sets = shingle_sets(docs, met, words)
    links = stage(similar(met, sets, least), "near-links")
    labels = connected_components(links)
    rooted = _rooted(texts, labels)
    found, most = [], prints if n <= 10_000 else 1  # only the disk at once depends on it
    for first in range(0, prints, most):
        near = [probe_links(rooted, parts.of(k), distance, can) for k in range(first, min(prints, first + most))]
        found.append(stage(reduce(DataFrame.unionByName, near), "near-pairs"))
        if most < prints:
            release(spark)
    pairs = stage(reduce(DataFrame.unionByName, found).distinct().join(met, ["a", "b"], "left_anti"), "near-new")
    for old in (sets, links, rooted, met, *found):
        discard(old)
    sets = shingle_sets(docs, pairs, words)
    more = similar(pairs, sets, least).unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b")))
    merged = connected_components(more)
    for old in (pairs, sets, labels):
        discard(old)
    return merged


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    prints = stage(fingerprints(docs, words), "simhash-docs")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-least")
    rooted = classes(distinct, distance)
    named = distinct.join(rooted.withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp")).select("fp", "root", "least")
    ids = stage(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-ids").withColumnRenamed("root", "_root")
    of = stage(named.join(ids, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id"), "simhash-of")
    return prints.join(of, F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8, distance: int = 9, prints: int = 5) -> DataFrame:
    """Of each class one row, all columns kept: that of the smallest doc_id, a null one last.

    Classes are what links of a Jaccard similarity of ``least`` or more between the word shingles reach, whatever the
    ids are; candidates are those within ``distance`` in one of ``prints`` fingerprints. Of rows that
    share the id, the least by a hash of the text, then of all columns, stays; of equal rows one.
    """
    one, two = row_hash(docs, 1), row_hash(docs, 2)
    keyed = docs.select(F.col("doc_id"), text_key(F.col("text")).alias("_key"), F.xxhash64("text").alias("_plain"), one.alias("_one"), two.alias("_two"), "text")
    rows = stage(several_fingerprints(keyed, words, prints), "near-rows")
    texts = stage(rows.groupBy(F.col("_key").alias("id")).agg(*[F.min(c).alias(c) for c in ("fps", "size", "odd")]), "near-texts")
    labels = similar_classes(texts, keyed.select("_key", "text"), words, least, distance, prints)
    named = rows.select("doc_id", "_key", "_plain", "_one", "_two").join(labels, F.col("_key") == F.col("node"), "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_plain", "_one", "_two"))
    keep = stage(named.groupBy(F.coalesce("root", "_key").alias("root")).agg(first.alias("x")).select("x._one", "x._two"), "near-kept")
    for old in (rows, texts, labels):
        discard(old)
    mark = [free_name(docs, "_mark1"), free_name(docs, "_mark2")]
    one_, two_ = free_name(docs, "_one"), free_name(docs, "_two")
    keep = keep.select(F.col("_one").alias(one_), F.col("_two").alias(two_))
    marked = docs.withColumn(mark[0], one).withColumn(mark[1], two)
    return marked.join(keep, (F.col(mark[0]) == F.col(one_)) & (F.col(mark[1]) == F.col(two_)), "left_semi").dropDuplicates(mark).drop(*mark)
