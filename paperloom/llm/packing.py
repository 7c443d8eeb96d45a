"""Vector bin packing of examples into training sequences.

Each sequence has three limits: tokens, segments and loss-bearing tokens. A bin
is filled by the dot-product heuristic: of the waiting items that fit, take the
one whose demand vector has the largest dot product with what the bin has left,
each dimension scaled by its limit. Where cutting is allowed, a bin that no
whole item fills is topped up with the head of the longest one, unless that head
were shorter than ``HEAD`` tokens.

Partitions pack by themselves, so nothing is shuffled and the only padding is
in the last sequences of a partition, or where segments or loss run out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import bpe
from paperloom.llm.common import ids_and_texts


@dataclass(frozen=True)
class Limits:
    """Of one sequence; the queries take these. Loss may be as much as all tokens: a lower
    limit would leave every sequence inside a long document padded, as its loss is its length."""

    tokens: int = 1024
    segments: int = 16
    loss: int = 1024


#: Tokens of the shortest head that is cut off to top a sequence up.
HEAD = 8
#: Waiting items from which bins are filled; bounds a worker's memory and each choice's cost.
POOL = 1024


class Packer:
    """Places (key, start, length, loss) items; ``place`` gets them with sequence and offset.

    loss(start, length) counts the loss-bearing tokens of a piece; with ``cut``
    items may be split, else an item must fit an empty bin.
    """

    def __init__(self, limits: Limits, place, loss_of, cut: bool, pool: int = POOL):
        self.limits, self.place, self.loss_of, self.cut, self.pool = limits, place, loss_of, cut, pool
        self.items: list[tuple] = []
        self.sequence = 0

    def fill(self, key, start: int, stop: int) -> int:
        """Give sequences of their own to pieces that fill one; returns where the rest starts."""
        top = self.limits.tokens
        while stop - start >= top:
            take = self._head(key, start, top, self.limits.loss)
            if not take:
                raise ValueError("the limit of loss tokens lets no piece through")
            self.place(key, start, take, self.sequence, 0)
            self.sequence += 1
            start += take
        return start

    def add(self, key, start: int, length: int) -> None:
        """Let an item wait for its place; shorter than a sequence if it may be cut."""
        top = self.limits.tokens
        if not length:
            return
        if not self.cut and (length > top or self.loss_of(key, start, length) > self.limits.loss):
            raise ValueError(f"an example of {length} tokens doesn't fit an empty sequence")
        self.items.append((key, start, length))
        if len(self.items) >= 2 * self.pool:
            self._fill(self.pool)

    def close(self) -> None:
        self._fill(0)

    def _fill(self, keep: int) -> None:
        """Fill bins until at most ``keep`` items wait."""
        limits = self.limits
        key_of = [k for k, _, _ in self.items]
        start = np.array([s for _, s, _ in self.items], np.int64)
        length = np.array([n for _, _, n in self.items], np.int64)
        loss = np.array([self.loss_of(*x) for x in self.items], np.int64)
        waiting = np.ones(len(self.items), bool)
        left = len(self.items)
        scale = np.array([1 / limits.tokens**2, 1 / limits.segments**2, 1 / max(limits.loss, 1) ** 2])
        while left > keep:
            tokens, segments, spare = limits.tokens, limits.segments, limits.loss
            while tokens and segments and left:
                fits = waiting & (length <= tokens) & (loss <= spare)
                score = np.where(fits, length * (tokens * scale[0]) + loss * (spare * scale[2]) + segments * scale[1], -1.0)
                k = int(score.argmax())
                if score[k] >= 0:
                    take, used, waiting[k] = int(length[k]), int(loss[k]), False
                    left -= 1
                elif self.cut:
                    k = int(np.where(waiting, length, -1).argmax())
                    take = self._head(key_of[k], int(start[k]), int(min(length[k], tokens)), spare)
                    if take < min(HEAD, limits.tokens) and tokens < limits.tokens:
                        break
                    used = self.loss_of(key_of[k], int(start[k]), take)
                else:
                    break
                self.place(key_of[k], int(start[k]), take, self.sequence, limits.tokens - tokens)
                tokens, segments, spare = tokens - take, segments - 1, spare - used
                if waiting[k]:
                    start[k] += take
                    length[k] -= take
                    loss[k] = self.loss_of(key_of[k], int(start[k]), int(length[k]))
            self.sequence += 1
        at = np.flatnonzero(waiting)
        self.items = [(key_of[i], int(start[i]), int(length[i])) for i in at]

    def _head(self, key, start: int, most: int, spare: int) -> int:
        """The longest head of at most ``most`` tokens that bears at most ``spare`` loss tokens."""
        low, high = 0, most
        while low < high:
            mid = (low + high + 1) // 2
            if self.loss_of(key, start, mid) <= spare:
                low = mid
            else:
                high = mid - 1
        return low


def pack_documents(df: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits(), end_id: int = 0, pool: int = POOL) -> DataFrame:
    """Encode every text, append the end id and pack all ids; documents may be cut.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. A document's first line is taken for its prompt, which bears no
    loss, and the lines after it for the answer; one line alone is all answer. A piece's
    first token bears none either, as nothing in its sequence predicts it. Null and empty
    texts have only the end id. Rows with the
    same id, and null ids, are documents of their own; of pieces that fit alike the
    one that came first is taken. An empty table gives no pieces. Sequence ids are
    unique; their high bits are the partition.
    """
    path = vocabulary or bpe.default_vocabulary()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        encoder, rows = bpe.encoder(path), []
        encode = encoder.encode

        def place(doc, start, length, sequence, offset):
            doc_id, tokens, held, base, _ = doc
            crc = zlib.crc32(memoryview(held)[4 * (start - base) : 4 * (start - base + length)])
            rows.append((doc_id, start, length, crc, tokens, first + sequence, offset))

        packer = Packer(limits, place, lambda doc, start, length: max(start + length - max(start + 1, doc[4]), 0), cut=True, pool=pool)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist(), end), strict=True):
                n, prompt = len(ids) // 4, prompt_tokens(ids, encoder.breaks)
                # Pieces that fill a sequence leave at once; only the remainder's bytes wait in the pool.
                at = packer.fill((doc_id, n, ids, 0, prompt), 0, n)
                if n > at:
                    packer.add((doc_id, n, ids[4 * at :], at, prompt), at, n - at)
            if len(rows) >= 10_000:
                yield _pieces(rows)
                rows.clear()
        packer.close()
        yield _pieces(rows)

    return ids_and_texts(df, id_col, text_col).mapInArrow(run, ", ".join(f"{c} long" for c in PIECES))


def prompt_tokens(ids: bytes, breaks: np.ndarray) -> int:
    """How many ids a text's first line has, its line feed included; 0 if it is the only line."""
    values = np.frombuffer(ids, "<u4")[:-1]
    found = np.flatnonzero(breaks[values])
    return int(found[0]) + 1 if len(found) and found[0] + 1 < len(values) else 0


PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(PIECES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], PIECES)


def pack_examples(df: DataFrame, id_col: str, tokens_col: str, loss_col: str, limits: Limits = Limits(), pool: int = POOL) -> DataFrame:
    """Pack whole instruction examples, given their token and loss-token counts.

    Returns example_id, tokens, loss, sequence_id, offset. Null counts are 0 and
    an example without tokens takes no place: its sequence_id and offset are
    null. An example over a limit of an empty sequence also gets nulls, so no row
    is lost and the caller decides what to do with it. Of examples that fit alike
    the one that came first is taken; repeated rows are examples of their own. An
    empty table gives no rows.
    """
    items = df.select(
        F.col(id_col).cast("long").alias("example_id"),
        F.greatest(F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)), F.lit(0)).alias("tokens"),
        F.greatest(F.coalesce(F.col(loss_col).cast("long"), F.lit(0)), F.lit(0)).alias("loss"),
    )
    names = ["example_id", "tokens", "loss", "sequence_id", "offset"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, rows = TaskContext.get().partitionId() << 32, []
        packer = Packer(limits, lambda x, s, n, seq, off: rows.append((*x, first + seq, off)), lambda x, s, n: x[2], cut=False, pool=pool)
        for batch in batches:
            for item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if 0 < item[1] <= limits.tokens and item[2] <= limits.loss:
                    packer.add(item, 0, item[1])
                else:
                    rows.append((*item, None, None))
            yield out(rows)
            rows.clear()
        packer.close()
        yield out(rows)

    def out(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return items.mapInArrow(run, ", ".join(f"{c} long" for c in names))
