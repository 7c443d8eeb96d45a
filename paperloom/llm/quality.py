"""Quality classifier: naive Bayes support vectors.

Features are indicators of three kinds of n-grams: of words (one and two, A-Z
lower-cased), of bytes (four), and of word shapes (one to four). A shape keeps
what a word looks like (case, digits, punctuation runs) and whether it repeats the
word before it, so tables, shouting, symbol junk and repetition are seen whatever
the vocabulary. Each kind has a range of hashed numbers of its own. Indicators are
scaled by the log ratio of their smoothed class counts; a linear model with hinge
loss is then fitted by dual coordinate descent, and a logistic curve on held-back
training rows turns its margins into scores.

Only the fit uses a bounded sample: ``TRAIN_ROWS`` labelled rows with the
smallest id hashes. Scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import id_bucket, ids_and_texts, pieces, smallest_hashes

TRAIN_ROWS = 8000
#: Feature numbers: half of them for words, a quarter each for bytes and shapes.
BITS = 18
#: Length of the n-grams of words, bytes and shapes.
WORDS, BYTES, ORDER = 2, 4, 4
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
SHAPES_HELD = 100_000

_KINDS = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"([aA0])\1+|([^aA0])\2\2+")


class _Shapes(dict):
    """word -> its number (high bits) and its shape's number (low 32 bits); a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= SHAPES_HELD:
            self.clear()
        shape = _RUN.sub(lambda m: m[1] or m[2] * 2, word.translate(_KINDS))
        value = self[word] = _number(word.lower()) << 32 | _number(shape)
        return value


def _number(data: bytes) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(data)


_shapes = _Shapes()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _grams(symbols: np.ndarray, order: int, bits: int) -> Iterator[np.ndarray]:
    """Hashed numbers of the runs of one to ``order`` symbols, one array per length."""
    run = np.zeros(len(symbols), np.uint64)
    for n in range(min(order, len(symbols))):
        run = run[: len(symbols) - n] * _ODD + symbols[n:] + np.uint64(n + 1)
        run ^= run >> np.uint64(31)
        yield ((run * _ODD) >> np.uint64(64 - bits)).astype(np.int64)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct feature numbers of a whole text, ascending; a text without words has none."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return np.empty(0, np.int32)
    both = np.fromiter(map(_shapes.__getitem__, words), np.uint64, len(words))
    shape = (both & np.uint64(0xFFFFFFFF)) * np.uint64(2)
    shape[1:] += both[1:] == both[:-1]
    mark = np.zeros(1 << bits, bool)
    for found in _grams(both >> np.uint64(32), WORDS, bits - 1):
        mark[found] = True
    half, quarter = 1 << bits - 1, 1 << bits - 2
    cells = np.frombuffer(data.lower(), np.uint8).astype(np.uint32)
    run = cells[: max(len(cells) - BYTES + 1, 0)].copy()
    for n in range(1, BYTES):
        run |= cells[n : len(cells) - BYTES + 1 + n] << np.uint32(8 * n)
    mark[half + ((run * np.uint32(2654435761)) >> np.uint32(34 - bits))] = True
    for found in _grams(shape, ORDER, bits - 2):
        mark[half + quarter + found] = True
    return np.flatnonzero(mark).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray  # one per feature, log-count ratio included
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum()) + self.bias

    def score(self, found: np.ndarray) -> float:
        z = self.slope * self.margin(found) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, penalty: float = 1.0, smoothing: float = 1.0, sweeps: int = 20, seed: int = 7) -> Model:
    """Fit on feature lists and 0/1 labels; with one class only, the score is that class' share."""
    labels = np.asarray(labels)
    size = 1 << bits
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.5
        return Model(np.zeros(size), 0.0, 0.0, float(np.log(share / (1 - share))))
    order = np.random.default_rng(seed).permutation(len(rows))
    # A fifth of the rows is held back, for the curve only.
    cut = max(1, len(rows) // 5)
    back, used = order[:cut], order[cut:]
    if labels[used].min() == labels[used].max() or labels[back].min() == labels[back].max():
        back = used = order
    ratio = _log_ratio([rows[i] for i in used], labels[used], size, smoothing)
    weights, bias = _descend([rows[i] for i in used], labels[used], ratio, penalty, sweeps, seed)
    model = Model(weights * ratio, bias, 1.0, 0.0)
    model.slope, model.shift = _curve(np.array([model.margin(rows[i]) for i in back]), labels[back])
    return model


def _log_ratio(rows: list[np.ndarray], labels: np.ndarray, size: int, smoothing: float) -> np.ndarray:
    counts = [np.full(size, smoothing), np.full(size, smoothing)]
    for found, label in zip(rows, labels, strict=True):
        counts[int(label)][found] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def _descend(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, penalty: float, sweeps: int, seed: int, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; each class weighs the same."""
    rng = np.random.default_rng(seed)
    sign = np.where(labels > 0, 1.0, -1.0)
    share = np.array([np.mean(sign < 0), np.mean(sign > 0)])
    top = penalty / (2 * share[(sign > 0).astype(int)])
    # The scaled rows are made again at each visit: held, they would be the largest thing on the driver.
    square = np.array([float(ratio[r] @ ratio[r]) + 1.0 for r in rows])
    alpha, w, b = np.zeros(len(rows)), np.zeros(len(ratio)), 0.0
    for _ in range(sweeps):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            scaled = ratio[rows[i]]
            gradient = sign[i] * (float(w[rows[i]] @ scaled) + b) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), top[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[rows[i]] += step * scaled
                b += step
                moved = max(moved, abs(step) / top[i])
                alpha[i] = new
        if moved < tolerance:
            break
    return w, b


def _curve(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt's logistic curve with his smoothed targets, by Newton's method."""
    up, down = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -500, 500)))
        g = np.array([((p - target) * margin).sum() + 1e-6 * a, (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margin * margin).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum()]])
        step = np.linalg.lstsq(h, g, rcond=None)[0]
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-6), float(c)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, bits: int = BITS) -> Model:
    """Fit on the labelled rows outside the held-out fold, ``rows`` of them at most.

    Rows without a label are not used; an id labelled more than once has its
    smallest label. Features are made on the executors; the driver gets at most
    ``rows`` lists of numbers.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    own = own.where(id_bucket("doc_id", FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = smallest_hashes(own, "doc_id", rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [features(t.as_py(), bits) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "quality", "found"])

    # ``chosen`` has at most ``rows`` short rows, a proven bound.
    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, found array<int>").toArrow().sort_by("doc_id")
    found = [x.values.to_numpy() for x in sample.column("found")]
    return fit(found, sample.column("quality").to_numpy(), bits)


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text; higher means that quality 1 is likelier.

    Returns doc_id, held_out, score, predicted for every row. Null texts count as
    empty; an empty text has no features and the score of the bias alone. A null
    id is not held out and takes no part in training. Repeated rows are scored
    alike. Without labels every score is one half. An empty table gives no rows.
    """
    docs = ids_and_texts(df, id_col, text_col)
    scored = score_column(docs, train(docs, labels, rows))
    held = F.coalesce(id_bucket("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def score_column(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> (doc_id, score) by a broadcast model of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bits = int(np.log2(len(model.weights)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(features(t.as_py(), bits)) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def without_rejects(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, all columns unchanged, whose predicted quality is 1.

    Null and empty texts have the bias alone; repeated rows stay or go together;
    without labels all rows stay. An empty table gives no rows.
    """
    model = train(ids_and_texts(df, id_col, text_col), labels, rows)
    shared = df.sparkSession.sparkContext.broadcast(model)
    names, at = df.columns, df.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        bits = int(np.log2(len(own.weights)))
        for batch in pieces(batches):
            yield batch.filter(pa.array([own.score(features(t.as_py(), bits)) >= threshold for t in batch.column(at)], pa.bool_()))

    return df.select(*(F.col(c) for c in names)).mapInArrow(run, df.schema)
