"""Quality classifier: a linear support vector machine over naive Bayes features.

Features are indicators of a text's n-grams, hashed into 2^``BITS`` columns and scaled by the columns'
log-count ratios between the classes: byte n-grams of 1 to ``GRAMS`` bytes (case kept, the text between marks for
its start and end), and word n-grams of 2 to ``WORDS`` words up to renaming, i.e. which of the words are equal ("a b a").
The weights minimise the L2-regularised hinge loss by dual coordinate descent, and a logistic link fitted to
out-of-fold margins turns a margin into a score.

The fit takes a bounded sample: at most ``most`` labelled ids, the first by hash, and of these the first
that have ``most_cells`` features together (a text has at most 2^``BITS``, typically 1,000). The ids are
broadcast to the documents, so no text is shuffled; the sampled features are gathered on the driver, 4 bytes each, and
8 more while it fits. Scoring covers every row.

Defined results: null and empty texts score by the marks alone; labels that are null or not 0 or 1
are ignored, of several labels for an id the lowest counts; if there is no label of one class
every text scores the share of class 1 (0.5 without labels); repeated rows get equal scores; texts are
taken whole, of any length that fits in a row; an empty table gives no rows. ``labels``, ``lang``, ``source`` and
``doc_id`` never enter a score. Other columns are ignored by ``predict`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import id_remainder, stage

GRAMS = 3
WORDS = 6
BITS = 17
_START, _END = b"\x02", b"\x03"
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """Distinct feature columns of texts; owns the scratch memory for that."""

    def __init__(self) -> None:
        self.stamp = np.zeros(1 << BITS, np.int32)

    @staticmethod
    def _patterns(text: str) -> list[np.ndarray]:
        """Codes of the word n-grams up to renaming: for each word after the first the place of the first word equal to it, or 0."""
        ids: dict[str, int] = {}
        words = np.array([ids.setdefault(x, len(ids)) for x in text.split()], np.int32)
        same = [np.concatenate([np.zeros(min(k, words.size), bool), words[k:] == words[:-k]]) for k in range(1, WORDS)]  # as the word k before
        out = []
        for n in range(2, min(WORDS, words.size) + 1):
            m = words.size - n + 1
            code = np.zeros(m, np.uint64)
            for j in range(1, n):
                first = np.zeros(m, np.uint64)
                for k in range(1, j + 1):  # the earliest is set last
                    first[same[k - 1][j : j + m]] = j - k + 1
                code = code * np.uint64(8) + first
            out.append(np.unique(code) | np.uint64((100 + n) << 56))
        return out

    def columns(self, text: str | None) -> np.ndarray:
        data = np.frombuffer(_START + (text or "").encode() + _END, np.uint8).astype(np.uint64)
        codes, code = [], np.zeros(data.size, np.uint64)
        for n in range(GRAMS):
            code = (code[: data.size - n] << np.uint64(8)) | data[n:] if n else data
            codes.append(code | np.uint64((n + 1) << 56))
            if data.size <= n + 1:
                break
        codes += self._patterns(text or "")
        with np.errstate(over="ignore"):
            at = ((np.concatenate(codes) * _ODD) >> np.uint64(64 - BITS)).astype(np.int64)
        order = np.arange(at.size, dtype=np.int32)
        self.stamp[at] = order
        return at[self.stamp[at] == order]


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = [alpha + np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == k]), minlength=1 << BITS) for k in (0, 1)]
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights (before scaling) and bias of the hinge-loss machine, rows scaled to unit length.

    Each class has the same total cost, so the rare one isn't drowned.
    """
    sign = np.where(labels == 1, 1.0, -1.0)
    # all values in one array that is given back at once; rows see their parts of it
    ends = np.cumsum([r.size for r in rows])
    flat = scale[np.concatenate(rows)]
    values = [flat[e - r.size : e] for r, e in zip(rows, ends.tolist(), strict=True)]
    for v in values:
        v /= np.sqrt(v @ v) + 1e-12
    share = np.array([max((labels == k).mean(), 1e-9) for k in (0, 1)])
    upper = cost * 0.5 / share[labels]
    dual, weights, bias = np.zeros(len(rows)), np.zeros(1 << BITS), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            r, v, y = rows[i], values[i], sign[i]
            slack = y * (weights[r] @ v + bias) - 1
            new = min(max(dual[i] - slack / 2.0, 0.0), upper[i])  # the row and its constant feature have length 1 each
            if new != dual[i]:
                step = (new - dual[i]) * y
                weights[r] += step * v
                bias += step
                dual[i] = new
    return weights, bias


def margins(rows: list[np.ndarray], scale: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(rows), bias)
    for i, r in enumerate(rows):
        v = scale[r]
        out[i] += weights[r] @ v / (np.sqrt(v @ v) + 1e-12)
    return out


def logistic_link(margin: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton's method, with targets drawn in as Platt does."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    aim = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (aim - p) - 1e-6 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def train(rows: list[np.ndarray], labels: np.ndarray, folds: int = 3) -> dict:
    """The model as {scale, weights, bias, slope, offset}."""
    if len(rows) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(rows) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return {"scale": np.zeros(1 << BITS), "weights": np.zeros(1 << BITS), "bias": 0.0, "slope": 0.0, "offset": float(np.log(share / (1 - share)))}

    def one(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        own, y = [rows[i] for i in at.tolist()], labels[at]
        scale = log_count_ratios(own, y)
        return scale, *dual_descent(own, y, scale)

    fold = np.arange(len(rows)) % folds
    outside = np.zeros(len(rows))
    usable = np.zeros(len(rows), bool)
    for k in range(folds):
        at, rest = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if rest.size and at.size and labels[at].min() != labels[at].max():
            outside[rest] = margins([rows[i] for i in rest.tolist()], *one(at))
            usable[rest] = True
    scale, weights, bias = one(np.arange(len(rows)))
    if not usable.any():
        outside, usable = margins(rows, scale, weights, bias), ~usable
    slope, offset = logistic_link(outside[usable], labels[usable])
    return {"scale": scale, "weights": weights, "bias": bias, "slope": slope, "offset": offset}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 8000, held_out: tuple[int, int] | None = (4, 2), most_cells: int = 40_000_000) -> dict:
    """A model of ``labels.quality``, from a bounded sample of the labelled rows outside the held-out remainder."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if held_out:
        known = known.where(id_remainder(F.col("doc_id"), held_out[0]) != held_out[1])
    known = known.groupBy("doc_id").agg(F.min(label).alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    picked = F.broadcast(known.withColumnRenamed("doc_id", "_id"))  # ``most`` rows of two numbers
    texts = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("_id")).select("doc_id", "text", F.col("_y").cast("int").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            cols = [grams.columns(x).astype(np.int32).tobytes() for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), b.column("y").cast(pa.int32()), pa.array(cols, pa.binary())], names=["id", "y", "cols"])

    sample = stage(texts.mapInArrow(run, "id string, y int, cols binary").groupBy("id").agg(F.first("y").alias("y"), F.min("cols").alias("cols")), "quality-sample")
    upto = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)  # of ``most`` rows
    fits = sample.select("id", F.sum(F.length("cols") / 4).over(upto).alias("cells")).where(F.col("cells") <= most_cells).select(F.col("id").alias("_id"))
    got = sample.join(F.broadcast(fits), F.col("id") == F.col("_id")).select("id", "y", "cols").toArrow().sort_by("id")
    rows = [np.frombuffer(x, np.int32) for x in got["cols"].to_pylist()]
    return train(rows, np.array(got["y"].to_pylist(), np.int64))


class Scorer:
    def __init__(self, model: dict) -> None:
        self.grams = Grams()
        self.square = model["scale"] ** 2
        self.effective = model["scale"] * model["weights"]
        self.model = model

    def score(self, text: str | None) -> float:
        at = self.grams.columns(text)
        m = self.model
        margin = m["bias"] + self.effective[at].sum() / (np.sqrt(self.square[at].sum()) + 1e-12)
        return float(1 / (1 + np.exp(-np.clip(m["slope"] * margin + m["offset"], -30, 30))))


def predict(docs: DataFrame, model: dict, held_out: tuple[int, int] = (4, 2), least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            got = np.array([scorer.score(x) for x in b.column("text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(got), pa.array((got >= least).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (id_remainder(F.col("doc_id"), held_out[0]) == held_out[1]).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """The rows that score ``least`` or more, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array([scorer.score(x) >= least for x in b.column(b.schema.names.index("text")).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
