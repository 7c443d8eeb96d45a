"""Language identification by averaged hashed subword embeddings.

A text is lower-cased, its ASCII characters that are no letters become blanks,
and every run of two to four bytes is hashed to a row of an embedding table. The
average of those rows goes into a linear softmax. Table and softmax are trained
together by stochastic gradient descent in numpy, on a bounded sample of the
learning rows. A temperature fitted on held-back rows calibrates the scores, and
a rejection level is the lowest score above which held-back predictions reach
the wanted precision.

For scoring, table times softmax weights is one row of logits for each bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import id_bucket, smallest_hashes

TRAIN_ROWS = 3000
BITS = 14
DIMENSIONS = 16
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
PRECISION = 0.99

_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_BLANKS = re.compile(rb"  +")
_ASCII = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII.search(text)) or any(c.isalpha() for c in text)


def subwords(text: str, bits: int = BITS) -> np.ndarray:
    """Buckets of all byte runs of two to four, with repeats."""
    data = b" " + _BLANKS.sub(b" ", text.encode("utf-8", "surrogatepass").translate(_CLEAN)).strip(b" ") + b" "
    cells = np.frombuffer(data, np.uint8).astype(np.uint32)
    out, run = [], cells
    for n in (2, 3, 4):
        if len(data) < n:
            break
        run = run[: len(data) - n + 1] | cells[n - 1 :] << np.uint32(8 * (n - 1))
        out.append(((run + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def counts(text: str, bits: int = BITS) -> np.ndarray:
    return np.bincount(subwords(text, bits), minlength=1 << bits)


@dataclass
class Model:
    names: list[str]
    logits: np.ndarray  # buckets x languages: embedding table times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, found: np.ndarray) -> np.ndarray:
        z = (found @ self.logits / max(found.sum(), 1) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected); no text or no letter: (UNKNOWN, 0, rejected)."""
        if not self.names or text is None or not has_letter(text):
            return UNKNOWN, 0.0, True
        p = self.probabilities(counts(text, int(np.log2(len(self.logits)))))
        k = int(p.argmax())
        return self.names[k], float(p[k]), bool(p[k] < self.reject_below)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], bits: int = BITS, dimensions: int = DIMENSIONS, epochs: int = 8, rate: float = 0.5, seed: int = 5) -> Model:
    """Train on (buckets, counts) rows. With one language only, it is always predicted."""
    names = sorted(set(labels))
    size = 1 << bits
    if len(names) < 2:
        return Model(names, np.zeros((size, len(names)), np.float32), np.zeros(len(names)), 1.0, 0.0)
    target = np.array([names.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    cut = max(1, len(rows) // 5)
    back, used = order[:cut], order[cut:] if len(rows) > 5 else order
    table = rng.uniform(-1 / dimensions, 1 / dimensions, (size, dimensions)).astype(np.float64)
    weights, bias = np.zeros((dimensions, len(names))), np.zeros(len(names))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(used):
            at, n = rows[i]
            if not len(at):
                continue
            share = n / n.sum()
            hidden = share @ table[at]
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            down = weights @ p
            weights -= step * np.outer(hidden, p)
            bias -= step * p
            # Each row of the table moves by its share; the factor keeps rare buckets from standing still.
            table[at] -= (step * 20) * np.outer(share, down)
    model = Model(names, (table @ weights).astype(np.float32), bias, 1.0, 0.0)
    dense = np.zeros((len(back), size), np.float32)
    for k, i in enumerate(back):
        dense[k, rows[i][0]] = rows[i][1]
    z = dense @ model.logits / np.maximum(dense.sum(axis=1, keepdims=True), 1) + bias
    model.temperature = _temperature(z, target[back])
    p = _softmax(z / model.temperature)
    model.reject_below = _reject_level(p.max(axis=1), p.argmax(axis=1) == target[back])
    return model


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _temperature(z: np.ndarray, target: np.ndarray) -> float:
    """Temperature with the least log loss, on a fixed grid."""
    grid = np.exp(np.linspace(np.log(0.005), np.log(20), 90))
    loss = [-np.log(_softmax(z / t)[np.arange(len(target)), target] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _reject_level(score: np.ndarray, right: np.ndarray, precision: float = PRECISION) -> float:
    """Lowest score from which on held-back predictions are right often enough; 0 if all are."""
    order = np.argsort(-score)
    good = np.cumsum(right[order]) / np.arange(1, len(score) + 1) >= precision
    if good.all():
        return 0.0
    held = np.flatnonzero(good)
    return float(score[order[held[-1]]]) if len(held) else 1.0


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, bits: int = BITS) -> Model:
    """Fit on learning rows with a language and a letter: at most ``rows``, those with the smallest id hashes.

    The ids are chosen first, from ids and languages alone, so that no texts are
    sorted. Executors count the subwords; the driver gets at most ``rows`` sparse
    lists. Of rows repeated with one id all are learned.
    """
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = own.where("doc_id IS NOT NULL AND lang IS NOT NULL").where(id_bucket("doc_id", FOLDS) != HELD_OUT)
    chosen = smallest_hashes(own.select("doc_id"), "doc_id", rows).distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, at, n = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text is not None and has_letter(text):
                    found = counts(text, bits)
                    where = np.flatnonzero(found)
                    keep.append(k)
                    at.append(where.astype(np.int32))
                    n.append(found[where].astype(np.int32))
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], ["doc_id", "lang", "at", "n"])

    # ``chosen`` has at most ``rows`` ids, a proven bound.
    sample = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, at array<int>, n array<int>").toArrow().sort_by("doc_id")
    found = [(a.values.to_numpy(), n.values.to_numpy().astype(np.float64)) for a, n in zip(sample.column("at"), sample.column("n"), strict=True)]
    return fit(found, sample.column("lang").to_pylist(), bits)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> DataFrame:
    """Predict the language of every whole text.

    Returns doc_id, held_out, lang_pred, score, rejected for every row. Null
    texts and texts without a letter get ``und``, score 0 and are rejected; so
    does every text if nothing can be learned. A prediction whose score is below
    the rejection level is still named, with rejected set. A null id is not held
    out and is not learned from. An empty table gives no rows.
    """
    model = train(df, id_col, text_col, lang_col, rows)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            got = [own.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    scored = docs.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    held = F.coalesce(id_bucket("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
