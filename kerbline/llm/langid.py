"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A text is
lowered and cut into units: runs of letters, marked at their start as the vocabulary
marks words, of any length. A unit's likelihood is summed over all its
segmentations into pieces by the forward algorithm; a text's is the product over its
units. The piece probabilities are fitted by expectation maximisation over the
distinct units of each language, starting from equal ones, until a round raises the likelihood by
less than ``tolerance`` of itself; a character that is no piece counts as the unknown piece.

The fit learns from at most ``most`` different labelled texts, the first by hash (and counts how
often each occurs); every text is scored. The vocabulary is a SentencePiece model of 32,000 pieces, described
in the README beside it; its path is a parameter, and only its pieces are used.

``keep_confident`` also rejects a text whose likelihood for each character, under its own language, lies far below
that of the learned texts (``floor``: their median less twice the distance to their lowest thousandth), i.e. letters that
no learned language explains.

Units are scored in numpy, all of one length at once; a worker keeps the likelihoods of
a bounded number of units and recomputes the others. What reaches the driver is one
number for each piece and language, and one for each learned text.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every
text if nothing was learned; ties go to the first language in sort order; repeated
rows count as often as they occur; texts are taken whole, of any length that fits in a row; an empty table gives no rows. ``lang``, ``source`` and
``doc_id`` never enter a score. Other columns are ignored by ``predict`` and kept by
``keep_confident``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import id_remainder, stage

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Units up to this length are summed as they are; in longer ones the sums are scaled, so that none vanishes.
UNIT = 24
CACHE_RUNS = 150_000
_LETTERS = re.compile(r"[^\W\d_]+")
_MARK = "▁"


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """The lower-case letter pieces of a SentencePiece vocabulary, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in pieces if p == p.lower() and (x := p.removeprefix(_MARK)) and (x.isalpha() or not x) or p == _MARK)


def runs(text: str | None) -> list[str]:
    """Letter runs of a lowered text."""
    return _LETTERS.findall((text or "").lower())


def units(run: str) -> list[str]:
    """A marked run cut every ``UNIT`` letters. Scores don't use the cut, they sum over the whole run."""
    run = _MARK + run
    return [run] if len(run) <= UNIT else [run[i : i + UNIT] for i in range(0, len(run), UNIT)]


class Pieces:
    """A trie over the pieces, as tables; the last id is the unknown piece.

    ``step[node, letter]`` is the next node or 0; letters are numbered as far as they stand in
    pieces of two or more characters, others have number 0 and lead nowhere.
    """

    def __init__(self, pieces: list[str]) -> None:
        self.pieces, self.unknown = pieces, len(pieces)
        self.longest = max(map(len, pieces), default=1)
        letters = sorted({c for p in pieces if len(p) > 1 for c in p})
        self.letter = np.zeros(0x110000, np.uint16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.single = np.full(0x110000, self.unknown, np.int32)
        for i, p in enumerate(pieces):
            if len(p) == 1:
                self.single[ord(p)] = i
        nodes: dict[str, int] = {"": 1}
        for p in pieces:
            if len(p) > 1:
                for k in range(1, len(p) + 1):
                    nodes.setdefault(p[:k], len(nodes) + 1)
        self.step = np.zeros((len(nodes) + 1, len(letters) + 1), np.int32)
        self.piece = np.full(len(nodes) + 1, -1, np.int32)
        for prefix, node in nodes.items():
            if prefix:
                self.step[nodes[prefix[:-1]], self.letter[ord(prefix[-1])]] = node
        for i, p in enumerate(pieces):
            if len(p) > 1:
                self.piece[nodes[p]] = i

    def __reduce__(self):
        return Pieces, (self.pieces,)


def _lattice(pieces: Pieces, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, rows, ids) of every piece in units of one length, by end."""
    n, size = len(texts), len(texts[0])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(n, size).T
    letters = pieces.letter[codes]
    found: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(size + 1)]
    for i in range(size):
        found[i + 1].append((i, np.arange(n), pieces.single[codes[i]]))  # what is no piece is unknown
        node, rows = pieces.step[1, letters[i]], None
        for j in range(i + 1, min(size, i + pieces.longest)):
            on = np.flatnonzero(node)
            if not on.size:
                break
            rows = on if rows is None else rows[on]
            node = pieces.step[node[on], letters[j][rows]]
            ids = pieces.piece[node]
            hit = np.flatnonzero((ids >= 0) & (node > 0))
            if hit.size:
                found[j + 1].append((i, rows[hit], ids[hit]))
        for start, at, ids in found[i + 1]:  # no later start ends here
            yield start, i + 1, at, ids
        found[i + 1] = []


def _forward_logs(pieces: Pieces, probs: np.ndarray, arcs: Iterable[tuple[int, int, np.ndarray, np.ndarray]], size: int, n: int) -> np.ndarray:
    """Logs of the forward sums at each place, (size + 1, n, languages), of arcs by end."""
    alpha, logs = np.zeros((2, size + 1, n, probs.shape[1]))
    alpha[0] = 1
    scale = np.zeros(alpha.shape[1:])
    for j, into in groupby(arcs, key=lambda a: a[1]):
        for i, _, rows, ids in into:
            alpha[j, rows] += alpha[i, rows] * probs[ids]
        logs[j] = np.log(alpha[j]) + scale
        low = alpha[j] < 1e-50
        if low.any():  # only the places that a piece can still start from need the new scale
            lift = np.where(low, 1e50, 1.0)
            alpha[max(0, j - pieces.longest + 1) : j + 1] *= lift
            scale -= np.log(lift)
    return logs


def by_length(texts: list[str], most: int = 8_000) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Indices and texts in groups of one length, of bounded size."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        step = most if size <= UNIT else max(1, most * UNIT // size)
        for k in range(0, at.size, step):
            part = at[k : k + step]
            yield part, [texts[i] for i in part.tolist()]


def likelihoods(pieces: Pieces, probs: np.ndarray, texts: list[str]) -> np.ndarray:
    """Log likelihood of each unit (rows) under each language (columns)."""
    out = np.zeros((len(texts), probs.shape[1]))
    for at, group in by_length(texts):
        if len(group[0]) > UNIT:
            out[at] = _forward_logs(pieces, probs, _lattice(pieces, group), len(group[0]), len(group))[-1]
            continue
        alpha = np.zeros((len(group[0]) + 1, len(group), probs.shape[1]))
        alpha[0] = 1
        for i, j, rows, ids in _lattice(pieces, group):
            if rows.size == len(group):
                alpha[j] += alpha[i] * probs[ids]
            else:
                alpha[j, rows] += alpha[i, rows] * probs[ids]
        out[at] = np.log(alpha[-1])
    return out


def run_likelihoods(pieces: Pieces, probs: np.ndarray, found: list[str]) -> np.ndarray:
    """Log likelihood of each letter run: the sum over all its segmentations."""
    return likelihoods(pieces, probs, [_MARK + r for r in found])


def expected_counts(pieces: Pieces, probs: np.ndarray, texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Expected number of each piece over all segmentations of weighted units (forward-backward), and their log likelihood."""
    total, reached = np.zeros(probs.size), 0.0
    for at, group in by_length(texts):
        size = len(group[0])
        arcs = list(_lattice(pieces, group))
        if size > UNIT:
            fore = _forward_logs(pieces, probs[:, None], arcs, size, len(group))[:, :, 0]
            mirrored = sorted(((size - j, size - i, rows, ids) for i, j, rows, ids in arcs), key=lambda a: a[1])
            back = _forward_logs(pieces, probs[:, None], mirrored, size, len(group))[:, :, 0]
            for i, j, rows, ids in arcs:
                share = np.exp(fore[i, rows] + np.log(probs[ids]) + back[size - j, rows] - fore[size, rows])
                total += np.bincount(ids, share * weights[at][rows], probs.size)
            reached += float(fore[size] @ weights[at])
            continue
        alpha, beta = np.zeros((size + 1, len(group))), np.zeros((size + 1, len(group)))
        alpha[0] = beta[size] = 1
        for i, j, rows, ids in arcs:
            alpha[j, rows] += alpha[i, rows] * probs[ids]
        for i, j, rows, ids in sorted(arcs, key=lambda a: -a[0]):
            beta[i, rows] += beta[j, rows] * probs[ids]
        scale = weights[at] / alpha[size]
        reached += float(np.log(alpha[size]) @ weights[at])
        for i, j, rows, ids in arcs:
            total += np.bincount(ids, alpha[i, rows] * probs[ids] * beta[j, rows] * scale[rows], probs.size)
    return total, reached


def _smoothed(counts: np.ndarray) -> np.ndarray:
    """Probabilities of the pieces and, last, of one unknown character among 100,000."""
    p = (counts + 0.05) / (counts + 0.05).sum()
    p[-1] /= 1e5
    return np.maximum(p, 1e-10)


def _sample(docs: DataFrame, held_out: tuple[int, int] | None, most: int) -> DataFrame:
    """lang, text, n of the first ``most`` different labelled texts by hash."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if held_out:
        rows = rows.where(id_remainder(F.col("doc_id"), held_out[0]) != held_out[1])
    rows = rows.select(F.xxhash64("lang", "text").alias("_h"), "lang", "text")
    last = rows.select("_h").distinct().orderBy("_h").limit(most).agg(F.max("_h")).first()[0]
    rows = rows.where(F.col("_h") <= F.lit(-(2**63) if last is None else last))
    return stage(rows.groupBy("_h").agg(F.first("lang").alias("lang"), F.first("text").alias("text"), F.count("*").alias("n")).drop("_h"), "langid-sample")


def fit(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = 12, held_out: tuple[int, int] | None = (4, 2), most: int = 20_000, tolerance: float = 1e-3) -> Model:
    """The model from ``text`` and non-null ``lang``.

    held_out: (modulus, remainder) of crc32(doc_id) that are not learned from.
    """
    spark = docs.sparkSession
    pieces = Pieces(load_pieces(vocabulary))
    sample = _sample(docs, held_out, most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            flat = [(lang, r, n) for lang, c in tally.items() for r, n in c.items()]
            tally.clear()
            cols = list(zip(*flat, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "run", "n"])

        for b in batches:
            for lang, text, n in zip(*(b.column(c).to_pylist() for c in ("lang", "text", "n")), strict=True):
                of = tally.setdefault(lang, Counter())
                for run, k in Counter(runs(text)).items():
                    of[run] += k * n
                if sum(map(len, tally.values())) > CACHE_RUNS:
                    yield flush()
        yield flush()

    counted = sample.mapInArrow(count, "lang string, run string, n long")
    counted = stage(counted.groupBy("lang", "run").agg(F.sum("n").alias("n")), "langid-runs")
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    size = len(pieces.pieces) + 1
    probs = np.full((size, len(langs)), 1.0 / size)
    before = -np.inf
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast((langs, pieces, probs))
        sums = counted.mapInArrow(_expect(shared), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        shared.destroy()
        lang, piece, n = (sums[c].to_numpy() for c in ("lang", "piece", "n"))
        counts = np.zeros_like(probs)
        counts[piece[piece >= 0], lang[piece >= 0]] = n[piece >= 0]
        probs = np.stack([_smoothed(counts[:, k]) for k in range(len(langs))], axis=1)
        reached = float(n[piece < 0].sum())  # the log likelihood under the probabilities of the round before
        if reached - before <= tolerance * abs(reached):
            break
        before = reached
    model = Model(langs, pieces, probs)
    if langs:
        shared = spark.sparkContext.broadcast(model)

        def typical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(*shared.value[:3])
            for b in batches:
                got = [x for lang, _, x in scorer.judge(b.column("text").to_pylist()) if lang != "und"]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.float64())], names=["x"])

        found = sample.mapInArrow(typical, "x double").toArrow()["x"].to_numpy()  # of ``most`` texts
        shared.destroy()
        if found.size:
            middle, low = np.median(found), np.quantile(found, 0.001)
            model = model._replace(floor=float(middle - 2 * (middle - low)))
    return model


def _expect(shared):
    """(lang, piece, n): expected counts, and as piece -1 the log likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, pieces, probs = shared.value
        at = {x: k for k, x in enumerate(langs)}
        total, reached = np.zeros(probs.T.shape), np.zeros(len(langs))
        for b in batches:
            of = np.array([at[x] for x in b.column("lang").to_pylist()], np.int64)
            marked, n = [_MARK + r for r in b.column("run").to_pylist()], b.column("n").to_numpy().astype(float)
            for k in np.unique(of).tolist():
                rows = np.flatnonzero(of == k)
                counts, logs = expected_counts(pieces, np.ascontiguousarray(probs[:, k]), [marked[i] for i in rows.tolist()], n[rows])
                total[k] += counts
                reached[k] += logs
        lang, piece = np.nonzero(total)
        lang, piece, n = np.concatenate([lang, np.arange(len(langs))]), np.concatenate([piece, np.full(len(langs), -1)]), np.concatenate([total[lang, piece], reached])
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(n)], names=["lang", "piece", "n"])

    return run


class Model(NamedTuple):
    """Languages, pieces, probs[piece, language], and the least log likelihood a character of a text in a learned language."""

    langs: list[str]
    pieces: Pieces
    probs: np.ndarray
    floor: float = -np.inf


class Scorer:
    """Predictions for texts; remembers the likelihoods of recent letter runs."""

    def __init__(self, langs: list[str], pieces: Pieces, probs: np.ndarray) -> None:
        self.langs, self.pieces, self.probs = langs, pieces, probs
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((CACHE_RUNS + 1, len(self.langs)))

    def _rows(self, flat: list[str]) -> np.ndarray:
        fresh = list(set(flat).difference(self.known))
        if fresh and len(self.known) + len(fresh) > CACHE_RUNS:
            self._forget()
            fresh = list(set(flat))
        if fresh:
            first = len(self.known)
            if first + len(fresh) > len(self.table):  # a batch of more runs than are kept
                self.table = np.zeros((first + len(fresh), len(self.langs)))
            self.table[first : first + len(fresh)] = run_likelihoods(self.pieces, self.probs, fresh)
            self.known.update(zip(fresh, range(first, first + len(fresh)), strict=True))
        return np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, score, and the log likelihood a character (word marks included) of each text."""
        out: list[tuple[str, float, float]] = []
        for k in range(0, len(texts), 1024):
            docs = [runs(x) for x in texts[k : k + 1024]]
            flat = [r for doc in docs for r in doc]
            rows = self._rows(flat) if self.langs else np.zeros(0, np.int64)
            at = 0
            for doc in docs:
                if not self.langs or not any(c.isalpha() for r in doc for c in r):
                    out.append(("und", 0.0, -np.inf))
                else:
                    total = self.table[rows[at : at + len(doc)]].sum(axis=0)
                    best = int(total.argmax())
                    out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum()), float(total[best] / (len(doc) + sum(map(len, doc))))))
                at += len(doc)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        return [x[:2] for x in self.judge(texts)]


def predict(docs: DataFrame, model: Model, held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value[:3])
        for b in batches:
            got = scorer.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", (id_remainder(F.col("doc_id"), held_out[0]) == held_out[1]).alias("held_out")).select("doc_id", "held_out", "text")
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def keep_confident(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows whose language is told with a score of ``least`` or more and explains their letters, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, floor = Scorer(*shared.value[:3]), shared.value.floor
        for b in batches:
            yield b.filter(pa.array([s >= least and x >= floor for _, s, x in scorer.judge(b.column(b.schema.names.index("text")).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
