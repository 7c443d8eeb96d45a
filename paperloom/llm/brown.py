"""Language-model scoring by Brown class-based bigrams.

``log P(text) = sum over tokens of log P(class | class before) + log P(word | class)``.

1. The frequent words of the training texts are found in one pass. The first ones
   that make up ``COVERAGE`` of the tokens are clustered: exchange clustering moves
   each to the class that raises the likelihood of the class bigrams most, sweep
   after sweep.
2. Every other word goes to the class under which its own neighbours, in all its
   occurrences, are likeliest. Its neighbours are gathered per task; before they are
   shuffled, those of a word that came often become counts by their classes, which
   are some hundred numbers however often it came. They are summed word by word in
   one sorted stream, so no word's occurrences are ever held.
3. With all words in classes, the texts become class lines; class bigrams are
   counted on those of the training texts, and all are scored.

Words and classes are looked up in two ways: the ``HEAD`` most frequent words in a
broadcast table of proven size, all others by a shuffled join of (row, word) pairs
with the whole table. Nothing is left out at any size. A word that was never seen
counts for the class that has the most words seen once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import cut, cut_at, id_bucket, ids_and_texts, remove
from paperloom.llm.words import Lookup, word_hashes, words_of

FOLDS, HELD_OUT = 7, 2
#: Share of the training tokens whose words are clustered by exchange, as far as words with ``SHARE`` make it up; the
#: result says what share it was. Pairs of these words are kept where they occur, not as a square table.
COVERAGE = 0.5
#: Classes of words, 250 at most; the end of a text is a class of its own.
CLASSES = 64
#: Words that make up this share of some task's tokens are candidates; a word with this share of all tokens always is one.
SHARE = 1e-5
HEAD = 200_000
SWEEPS = 4
#: Added to each class bigram.
SMOOTHING = 0.1
#: Distinct words, and occurrences, that a counting task holds before it sends what it has.
HELD_WORDS, HELD_TOKENS = 250_000, 3_000_000
#: Distinct pairs of symbols that it holds.
HELD_PAIRS = 2_000_000
#: Bytes of texts whose words are looked up at once.
GROUP_BYTES = 1 << 20


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, without the end token."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[range, list[bytes], pa.RecordBatch]]:
    """(positions in a batch, their texts with A-Z lower-cased, the batch), some ``GROUP_BYTES`` at a time; the text is the last column."""
    for batch in batches:
        texts, size, low = [], 0, 0
        for k, text in enumerate(batch.column(batch.num_columns - 1)):
            texts.append(text.as_buffer().to_pybytes().lower() if text.is_valid else b"")
            size += len(texts[-1])
            if size >= GROUP_BYTES:
                yield range(low, k + 1), texts, batch
                texts, size, low = [], 0, k + 1
        if texts:
            yield range(low, batch.num_rows), texts, batch


class _Gathered(dict):
    """Numbers of words by hash, and the words in that order."""

    def __init__(self) -> None:
        super().__init__()
        self.words: list[bytes] = []

    def numbers(self, data: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each of the given words, new ones at the end; a word's bytes are taken once."""
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        own, words = [], self.words
        for h, a, b in zip(unique.tolist(), starts[first].tolist(), ends[first].tolist(), strict=True):
            k = self.get(h)
            if k is None:
                k = self[h] = len(words)
                words.append(data[a:b])
            own.append(k)
        return np.array(own, np.int64)[back]


def frequent_words(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """(word binary, n long) of words that are frequent in some task, and all tokens under a null word.

    The counts serve to choose the clustered words; those of the model are exact
    and come from ``neighbours``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, total = _Gathered(), np.zeros(0, np.int64), 0
        # A word is counted from when its cell has half of the share; so much at most is missing.
        cells = np.zeros(1 << 20, np.int64)
        for _, texts, _ in _groups(batches):
            starts, ends, hashes, _ = words_of(texts)
            total += len(hashes)
            cell = (hashes >> np.uint64(44)).astype(np.int64)
            cells += np.bincount(cell, minlength=len(cells))
            some = np.flatnonzero(cells[cell] >= share * total / 2)
            own = held.numbers(b" ".join(texts), starts[some], ends[some], hashes[some])
            counts = np.concatenate([counts, np.zeros(len(held) - len(counts), np.int64)]) + np.bincount(own, minlength=len(held))
            if len(held) >= HELD_WORDS:
                # What came so rarely in so many words has less than the share so far.
                stay = np.flatnonzero(counts > max(1, share * total / 2))
                hashes, words = list(held), held.words
                held, counts = _Gathered(), counts[stay]
                held.update((hashes[k], j) for j, k in enumerate(stay.tolist()))
                held.words = [words[k] for k in stay.tolist()]
        often = np.flatnonzero(counts >= share * total / 2)
        yield pa.RecordBatch.from_arrays([pa.array([None, *(held.words[k] for k in often.tolist())], pa.binary()), pa.array([total, *counts[often].tolist()], pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame, most: int) -> dict[bytes, int]:
    """Counts of the most frequent words, ``most`` of them or fewer.

    A histogram of counts in eighths of a power of two (some hundred rows at any
    size) gives the lowest count at which the bound still holds; words are then
    filtered by it, without a global sort or a task that sees them all.
    """
    step = F.floor(F.log2("n") * 8)
    sizes = dict(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect())
    low, total = None, 0
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > most:
            break
        low = at
    if low is None:
        return {}
    top = counts.where(step >= low).select("word", "n").toArrow()
    return dict(zip((w.as_py() for w in top.column("word")), top.column("n").to_pylist(), strict=True))


def clustered_words(held: dict[bytes, int], total: int, coverage: float) -> list[bytes]:
    """The most frequent words that make up ``coverage`` of ``total`` tokens, or all there are."""
    ranked = sorted(held, key=lambda w: (-held[w], w))
    upto = np.cumsum([held[w] for w in ranked])
    return ranked[: int(np.searchsorted(upto, coverage * total)) + 1]


class _Pairs:
    """Counts by number, summed in sorted arrays; what comes in waits until there is enough to merge."""

    def __init__(self) -> None:
        self.keys, self.counts, self.waiting, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size >= max(1 << 18, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.size = [], 0
        if len(keys):
            self.keys, back = np.unique(keys, return_inverse=True)
            # Exact, as counts are far below 2 ** 53.
            self.counts = np.bincount(back, counts, len(self.keys)).astype(np.int64)


def neighbours(docs: DataFrame, ranked: list[bytes]) -> DataFrame:
    """(cell, n, word, codes): counts of symbol pairs, and the neighbours of each word outside ``ranked``.

    A symbol is a word's rank, len(ranked) for any other word, or one more for the
    end, which stands before and after each text. codes are the symbols before
    and, plus their number, after each occurrence, as little-endian integers.
    """
    size = len(ranked) + 2
    kind = code_type(size)
    shared = docs.sparkSession.sparkContext.broadcast(ranked)
    names = ["cell", "n", "word", "codes"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lookup(hashes_of(shared.value))
        total, end = _Pairs(), size - 1
        others = _Gathered()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for _, texts, _ in _groups(batches):
            starts, ends, hashes, sizes = words_of(texts)
            symbol = known(hashes).astype(np.int64)
            rest = np.flatnonzero(symbol < 0)
            symbol[rest] = size - 2
            # Each text's words with the end before, between and after the texts.
            place = np.arange(len(symbol)) + np.repeat(np.arange(len(texts)), sizes) + 1
            row = np.full(len(symbol) + len(texts) + 1, end)
            row[place] = symbol
            cell, n = np.unique(row[:-1] * size + row[1:], return_counts=True)
            total.add(cell, n)
            if len(total.keys) >= HELD_PAIRS:
                yield pairs(total)
                total = _Pairs()
            own = others.numbers(b" ".join(texts), starts[rest], ends[rest], hashes[rest])
            found.append((own.astype(np.int32), row[place[rest] - 1].astype(kind), (row[place[rest] + 1] + size).astype(kind)))
            held += len(rest)
            if held >= HELD_TOKENS or len(others) >= HELD_WORDS:
                yield contexts(others.words, found)
                others, found, held = _Gathered(), [], 0
        yield contexts(others.words, found)
        yield pairs(total)

    def pairs(total: _Pairs) -> pa.RecordBatch:
        total.merge()
        none = pa.nulls(len(total.keys), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(total.keys), pa.array(total.counts), none, none], names)

    def contexts(others: list[bytes], found: list[tuple]) -> pa.RecordBatch:
        if not others:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2 + [pa.array([], pa.binary())] * 2, names)
        own, before, after = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(own, kind="stable")
        codes = np.stack([before[order], after[order]], axis=1).astype(kind)
        stops = np.cumsum(np.bincount(own, minlength=len(others))) * 2 * codes.itemsize
        offsets = np.concatenate([[0], stops]).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(others), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(codes.tobytes())])
        none = pa.nulls(len(others), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(others, pa.binary()), data], names)

    return docs.select("text").mapInArrow(run, "cell long, n long, word binary, codes binary")


def hashes_of(words: Iterable[bytes]) -> np.ndarray:
    """The hash of each word, in order."""
    return word_hashes(b" ".join(words))[2]


def code_type(size: int) -> str:
    return "<u2" if 2 * size <= 1 << 16 else "<u4"


def kind_type(width: int) -> str:
    return "<u1" if width <= 256 else "<u2"


def counted_kinds(found: DataFrame, kinds_of: np.ndarray, width: int) -> DataFrame:
    """(word, codes) -> (word, kinds, counts): the kind of each neighbour, without counts, or where
    that is shorter each kind once with its count."""
    code, kind = code_type(len(kinds_of) // 2), kind_type(width)
    shared = found.sparkSession.sparkContext.broadcast(kinds_of.astype(kind))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds_of = shared.value
        for batch in batches:
            kinds, counts = [], []
            for data in batch.column(1):
                own = kinds_of[np.frombuffer(data.as_buffer(), code)]
                times = np.bincount(own, minlength=width) if len(own) > 5 * width else None
                at = None if times is None else np.flatnonzero(times)
                kinds.append(own.tobytes() if at is None else at.astype(kind).tobytes())
                counts.append(None if at is None else times[at].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.binary()), pa.array(counts, pa.binary())], ["word", "kinds", "counts"])

    return found.select("word", "codes").mapInArrow(run, "word binary, kinds binary, counts binary")


def assigned_words(found: DataFrame, kinds_of: np.ndarray, gains: np.ndarray) -> DataFrame:
    """(word, codes) -> (word, n, class): each word once, in the class whose gains over all its codes add up to the most.

    ``kinds_of`` is the kind of neighbour of each code, ``gains`` has a row for each
    kind and a column per class. Each word's pieces follow each other in a
    partition; their kinds are counted as they pass.
    """
    kind = kind_type(len(gains))
    shared = found.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(shared.value)
        last, held = None, np.zeros(width, np.int64)
        for batch in batches:
            for piece in (batch.slice(k, 4096) for k in range(0, batch.num_rows, 4096)):
                words, data, times = (piece.column(k).to_pylist() for k in range(3))
                sizes = np.array([len(d) for d in data]) // np.dtype(kind).itemsize
                place = np.cumsum(np.array([w != v for w, v in zip(words, [last, *words[:-1]], strict=True)]))
                # Row 0 is the word that the piece before ended with.
                cells = np.repeat(place * width, sizes) + np.frombuffer(b"".join(data), kind)
                weights = np.ones(len(cells))
                ends = np.cumsum(sizes)
                for k in (k for k, t in enumerate(times) if t is not None):
                    weights[ends[k] - sizes[k] : ends[k]] = np.frombuffer(times[k], "<u4")
                # Exact, as counts are far below 2 ** 53.
                table = np.bincount(cells, weights, (int(place[-1]) + 1) * width).astype(np.int64).reshape(-1, width)
                table[0] += held
                first = np.flatnonzero(np.diff(place, prepend=0))
                names = [last, *(words[k] for k in first.tolist())]
                if len(names) > 1:
                    skip = int(last is None)
                    yield out(names[skip:-1], table[skip:-1])
                last, held = names[-1], table[-1].copy()
        if last is not None:
            yield out([last], held[None])

    def out(words: list[bytes], table: np.ndarray) -> pa.RecordBatch:
        sums = table @ shared.value
        # Each occurrence has two neighbours. Rounded, so that equal classes stay equal.
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(table.sum(axis=1) // 2), pa.array(np.round(sums, 6).argmax(axis=1).astype(np.int32))], ["word", "n", "class"])

    return counted_kinds(found, kinds_of, len(gains)).repartition("word").sortWithinPartitions("word").mapInArrow(run, "word binary, n long, class int")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


@dataclass
class Bigrams:
    """Counts of symbol pairs that occur, sorted by the first and the second symbol."""

    symbols: int
    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray

    @classmethod
    def of_cells(cls, symbols: int, cells: np.ndarray, counts: np.ndarray) -> Bigrams:
        order = np.argsort(cells)
        return cls(symbols, cells[order] // symbols, cells[order] % symbols, counts[order])

    def turned(self) -> Bigrams:
        return Bigrams.of_cells(self.symbols, self.second * self.symbols + self.first, self.counts)

    def edges(self) -> np.ndarray:
        """Where the pairs of each first symbol begin."""
        return np.searchsorted(self.first, np.arange(self.symbols + 1))

    def by_class(self, assigned: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(assigned[self.first] * n + assigned[self.second], self.counts, n * n).reshape(n, n)


def exchange(bigrams: Bigrams, words: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each symbol. The first ``words`` symbols move among ``classes``; each other one is its own."""
    classes = max(1, min(classes, words))
    rest = bigrams.symbols - words
    n = classes + rest
    assigned = np.concatenate([np.arange(words) % classes, classes + np.arange(rest)])
    table = bigrams.by_class(assigned, n)
    turned = bigrams.turned()
    after, before = bigrams.edges(), turned.edges()
    same = bigrams.first == bigrams.second
    twice = dict(zip(bigrams.first[same].tolist(), bigrams.counts[same].tolist(), strict=True))
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            a = assigned[w]
            a1, b1, a2, b2 = after[w], after[w + 1], before[w], before[w + 1]
            right = np.bincount(assigned[bigrams.second[a1:b1]], bigrams.counts[a1:b1], n)
            left = np.bincount(assigned[turned.second[a2:b2]], turned.counts[a2:b2], n)
            own = float(twice.get(w, 0))
            right[a] -= own
            left[a] -= own
            table[a, :] -= right
            table[:, a] -= left
            table[a, a] -= own
            # Gain of putting w into each class: its row, its column, its own cell, its margins.
            near = table[:classes]
            gain = (_xlogx(near + right) - _xlogx(near)).sum(axis=1)
            gain += (_xlogx(table[:, :classes].T + left) - _xlogx(table[:, :classes].T)).sum(axis=1)
            k = np.arange(classes)
            cell = table[k, k]
            gain -= _xlogx(cell + right[:classes]) + _xlogx(cell + left[:classes]) - 2 * _xlogx(cell)
            gain += _xlogx(cell + right[:classes] + left[:classes] + own) - _xlogx(cell)
            rows, columns = table.sum(axis=1)[:classes], table.sum(axis=0)[:classes]
            gain -= _xlogx(rows + right.sum() + own) - _xlogx(rows) + _xlogx(columns + left.sum() + own) - _xlogx(columns)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            table[b, :] += right
            table[:, b] += left
            table[b, b] += own
            moved += b != a
            assigned[w] = b
        if not moved:
            break
    return assigned


def class_gains(bigrams: Bigrams, assigned: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each code, and log-likelihood that a neighbour of each kind adds to a word in each class.

    What a word's occurrence adds is log P(class | class before) + log P(class after
    | class) + log P(word | class); of the last only the class' size depends on the
    class, and half of it is put on each of the occurrence's two neighbours.
    """
    n = int(assigned.max()) + 1
    table = bigrams.by_class(assigned, n)
    smooth = table + SMOOTHING
    chance = np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True))
    share = 0.5 * np.log(table.sum(axis=0)[:classes] + 1)
    return np.concatenate([assigned, assigned + n]), np.concatenate([chance[:, :classes] - share, chance[:classes].T - share])


@dataclass
class Vocabulary:
    """What the driver knows of the words, and the table of the words outside of ``head``."""

    head: dict[bytes, tuple[int, int]]  # count, class
    classes: int
    unseen: int  # class of words that were never seen
    mass: np.ndarray  # tokens of each class
    kinds: np.ndarray  # distinct words of each class
    ends: int
    clustered: int  # training tokens whose words were clustered by exchange

    @property
    def train_tokens(self) -> int:
        return int(self.mass.sum()) + self.ends

    @property
    def distinct(self) -> int:
        return int(self.kinds.sum()) + (self.ends > 0)

    def sizes(self) -> np.ndarray:
        """log10 of each class' emission denominator, the end's last; one class keeps a place for a word never seen."""
        out = self.mass + self.kinds
        out[self.unseen] += 1
        return np.log10(np.concatenate([np.maximum(out, 1), [self.ends + 1]]))


def learn(docs: DataFrame, ends: int, coverage: float = COVERAGE, classes: int = CLASSES, head: int = HEAD) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of the training texts, ``ends`` in number, and (word, n, class) of all words outside the clustered ones."""
    spark = docs.sparkSession
    counts = cut(frequent_words(docs), "frequent-words")
    total = counts.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
    ranked = clustered_words(head_words(counts.where("word IS NOT NULL"), HEAD), total, coverage)
    size = len(ranked) + 2
    found, found_path = cut_at(neighbours(docs, ranked), "word-neighbours")
    # Pairs of clustered words that occur: at most the square of their number.
    pairs = found.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    bigrams = Bigrams.of_cells(size, pairs.column("cell").to_numpy(), pairs.column("n").to_numpy())
    classes = max(1, min(classes, len(ranked)))
    assigned = exchange(bigrams, len(ranked), classes) if ranked else np.array([1, 2])
    others = cut(assigned_words(found.where("word IS NOT NULL"), *class_gains(bigrams, assigned, classes)), "word-classes")
    remove(spark, found_path)
    mass, kinds, once = np.zeros(classes), np.zeros(classes), np.zeros(classes)
    for r in others.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect():
        mass[r["class"]], kinds[r["class"]], once[r["class"]] = r.n, r.kinds, r.once
    own = np.bincount(bigrams.first, bigrams.counts, size).astype(np.int64)
    table = {w: (int(n), int(c)) for w, n, c in zip(ranked, own, assigned, strict=False)}
    clustered = sum(n for n, _ in table.values())
    for n, c in table.values():
        mass[c] += n
        kinds[c] += 1
        once[c] += n == 1
    least = min(head_words(others, head - len(ranked)).values(), default=None) if head > len(ranked) else None
    if least is not None:
        for part in others.where(F.col("n") >= least).toArrow().to_batches():
            table.update(zip(part.column(0).to_pylist(), zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True), strict=True))
    return Vocabulary(table, classes, int(once.argmax()), mass, kinds, ends, clustered), others


def class_lines(docs: DataFrame, words: Vocabulary, others: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, known, counted, line): log10 counts + 1 summed, and each token's class as a byte.

    Words outside of the head are looked up by a join of (row, word) pairs; a text
    gets back one entry for each of its distinct words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        number = TaskContext.get().partitionId() << 33
        place = Lookup(hashes_of(own.head))
        counts, classes = (np.array(c) for c in zip(*own.head.values(), (0, 0), strict=True))
        logs = np.log10(counts + 1.0)
        end_count = float(np.log10(own.ends + 1))
        for positions, texts, batch in _groups(batches):
            data = b" ".join(texts)
            starts, ends, hashes, sizes = words_of(texts)
            at = place(hashes).astype(np.int64)
            stops = np.cumsum(sizes)
            # Words to look up, each once in a text and numbered there.
            rest = np.flatnonzero(at < 0)
            names, back = np.unique(hashes[rest], return_inverse=True)
            owner = np.repeat(np.arange(len(texts)), sizes)[rest]
            pairs, first, back = np.unique(owner * (len(names) + 1) + back, return_index=True, return_inverse=True)
            low = np.searchsorted(pairs, np.arange(len(texts) + 1) * (len(names) + 1))
            line = classes[at].astype(np.int32)
            line[rest] = 256 + back - low[owner]
            values = np.where(at < 0, 0.0, logs[at])
            missing = np.concatenate([[0], np.cumsum(at < 0)])
            words = [data[a:b] for a, b in zip(starts[rest[first]].tolist(), ends[rest[first]].tolist(), strict=True)]
            rows = []
            for k, (a, b) in enumerate(zip((stops - sizes).tolist(), stops.tolist(), strict=True)):
                rare = words[low[k] : low[k + 1]]
                # Bytes alone where all words are known.
                rows.append((b - a + 1, b - a - int(missing[b] - missing[a]) + (own.ends > 0), float(values[a:b].sum()) + end_count, (line[a:b] if rare else line[a:b].astype(np.uint8)).tobytes(), rare))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            numbers = pa.array(range(number, number + len(rows)), pa.int64())
            number += len(rows)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary()))
            doc_ids = batch.column(0).slice(positions[0], len(positions))
            yield pa.RecordBatch.from_arrays([numbers, doc_ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["row", "doc_id", "n_tokens", "known", "counted", "line", "rare"])

    # Written once: the row numbers must be the same on both sides of the join.
    parts, path = cut_at(docs.mapInArrow(run, "row long, doc_id long, n_tokens long, known long, counted double, line binary, rare array<binary>"), "lm-parts")
    pairs = parts.where(F.size("rare") > 0).select("row", F.posexplode("rare").alias("k", "word"))
    looked = pairs.join(others, "word").groupBy("row").agg(F.collect_list(F.struct("k", "n", "class")).alias("seen"))
    rare = parts.where(F.size("rare") > 0).join(looked, "row", "left").select("doc_id", "n_tokens", "known", "counted", "line", F.size("rare").alias("kinds"), "seen")

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            known, counted, lines = [], [], []
            for k, (n, so_far, line, kinds, seen) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("known", "counted", "line", "kinds")), batch.column("seen"), strict=True)):
                codes = np.frombuffer(line, np.int32)
                classes, logs, have = np.full(256 + kinds, own.unseen, np.int64), np.zeros(256 + kinds), np.zeros(256 + kinds, bool)
                classes[:256] = np.arange(256)
                if seen.is_valid and len(seen.values):
                    at = seen.values.field("k").to_numpy() + 256
                    classes[at], logs[at], have[at] = seen.values.field("class").to_numpy(), np.log10(seen.values.field("n").to_numpy() + 1.0), True
                times = np.bincount(codes, minlength=len(have))
                known.append(n + int(times[have].sum()))
                counted.append(so_far + float((times * logs).sum()))
                lines.append(classes[codes].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(known, pa.int64()), pa.array(counted, pa.float64()), pa.array(lines, pa.binary())], ["doc_id", "n_tokens", "known", "counted", "line"])

    schema = "doc_id long, n_tokens long, known long, counted double, line binary"
    plain = parts.where(F.size("rare") == 0).select("doc_id", "n_tokens", "known", "counted", "line")
    out = cut(plain.unionByName(rare.mapInArrow(fill, schema)), "lm-lines")
    remove(docs.sparkSession, path)
    return out


def transitions(lines: DataFrame, classes: int) -> np.ndarray:
    """log10 P(class | class before) from class lines; the end, the last class, stands around each text."""
    size = classes + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for line in batch.column(0):
                row = _ended(line.as_py(), classes)
                total += np.bincount(row[:-1] * size + row[1:], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["cell", "n"])

    # At most size * size rows.
    found = lines.select("line").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size * size)
    table[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    smooth = table.reshape(size, size) + SMOOTHING
    return np.log10(smooth) - np.log10(smooth.sum(axis=1, keepdims=True))


def _ended(line: bytes, classes: int) -> np.ndarray:
    """A line's classes with the end before and after it."""
    out = np.full(len(line) + 2, classes, np.int64)
    out[1:-1] = np.frombuffer(line, np.uint8)
    return out


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE, classes: int = CLASSES, head: int = HEAD) -> DataFrame:
    """Score every whole text, learning from the texts outside the held-out fold.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    perplexity and clustered_share (of the training tokens, those whose words the
    exchange clustered) for every row. Null texts count as empty: one end token. A null id
    is not held out and is not learned from. Repeated rows are counted as often
    as they stand and scored alike. If nothing can be learned, all counts are 0.
    An empty table gives no rows.
    """
    docs = ids_and_texts(df, id_col, text_col)
    bucket = id_bucket("doc_id", FOLDS)
    learned = docs.where(bucket != HELD_OUT)
    words, others = learn(learned, learned.select("doc_id").count(), coverage, classes, head)
    lines = class_lines(docs, words, others)
    chance, sizes = transitions(lines.where(bucket != HELD_OUT), words.classes), words.sizes()
    shared = docs.sparkSession.sparkContext.broadcast((chance, sizes))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance, sizes = shared.value
        for batch in batches:
            scores = []
            for counted, line in zip(batch.column(3).to_pylist(), batch.column(4), strict=True):
                row = _ended(line.as_py(), len(sizes) - 1)
                scores.append(counted + float(chance[row[:-1], row[1:]].sum() - sizes[row[1:]].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(scores, pa.float64())], ["doc_id", "n_tokens", "known", "counted", "score"])

    scored = lines.select("doc_id", "n_tokens", "known", "counted", "line").mapInArrow(run, "doc_id long, n_tokens long, known long, counted double, score double")
    return scored.select(
        "doc_id",
        F.coalesce(bucket == HELD_OUT, F.lit(False)).alias("held_out"),
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(words.train_tokens).cast("long").alias("train_tokens"),
        (F.col("counted") - F.col("n_tokens") * F.lit(float(np.log10(words.train_tokens + words.distinct + 1)))).alias("base_score"),
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
        F.lit(words.clustered / max(words.train_tokens, 1)).alias("clustered_share"),
    )
