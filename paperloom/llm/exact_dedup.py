"""Exact deduplication by composable polynomial fingerprints.

A text is lower-cased (A-Z only) and read as UTF-8 bytes. Its fingerprint is the
value of the polynomial with those bytes as coefficients at one base, modulo
four primes below 2**31. Chunks are evaluated apart from each other, as rows of
one matrix product, and combined by length-shifted arithmetic:
``H(a + b) = H(a) * base**len(b) + H(b)``. So a huge text costs no more memory
than its bytes and one block of chunks.

Equal fingerprints and lengths are only a claim. Every member of such a group is
then compared with the row that stays, chunk after chunk, up to the first
difference. Members that differ (a collision) are regrouped by their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import LOWER, UPPER, cut, cut_at, ids_and_texts, remove, without_rows

#: Primes below 2**31; bytes times residues summed over a chunk stay below 2**53.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASE = 1000003
CHUNK = 4096
BLOCK = 256
COMPARED = 65536
#: Bits of the filter that keeps unique texts out of the comparison's shuffle.
FILTER_BITS = 1 << 24


@lru_cache(maxsize=8)
def _powers(primes: tuple[int, ...], base: int, chunk: int) -> np.ndarray:
    """base**(chunk - 1 - i) modulo each prime, as float64 columns."""
    out = np.empty((chunk, len(primes)))
    for k, p in enumerate(primes):
        x = 1
        for i in range(chunk - 1, -1, -1):
            out[i, k] = x
            x = x * base % p
    return out


def combine(left: tuple[int, ...], right: tuple[int, ...], right_len: int, primes=PRIMES, base: int = BASE) -> tuple[int, ...]:
    """The fingerprint of a + b from those of a and b and b's length."""
    return tuple((a * pow(base, right_len, p) + b) % p for a, b, p in zip(left, right, primes, strict=True))


def fingerprint(data: bytes, primes=PRIMES, base: int = BASE, chunk: int = CHUNK) -> tuple[int, ...]:
    """Polynomial fingerprint of ``data``; empty data gives zeros."""
    powers = _powers(tuple(primes), base, chunk)
    total = (0,) * len(primes)
    n = len(data)
    head = n % chunk
    if head:
        part = np.frombuffer(data, np.uint8, head).astype(np.float64)
        total = tuple(int(v) % p for v, p in zip(part @ powers[chunk - head :], primes, strict=True))
    shift = [pow(base, chunk, p) for p in primes]
    for start in range(head, n, chunk * BLOCK):
        rows = min(BLOCK, (n - start) // chunk)
        block = np.frombuffer(data, np.uint8, rows * chunk, start).reshape(rows, chunk).astype(np.float64) @ powers
        for row in block:
            total = tuple((t * s + int(v)) % p for t, s, v, p in zip(total, shift, row, primes, strict=True))
    return total


def normalised(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def _key(values: tuple[int, ...], length: int) -> bytes:
    return b"".join(int(v).to_bytes(4, "big") for v in values) + length.to_bytes(8, "big")


def _slots(key: bytes, bits: int) -> tuple[int, int, int]:
    word = hashlib.blake2b(key, digest_size=24).digest()
    return tuple(int.from_bytes(word[8 * i : 8 * i + 8], "big") % bits for i in range(3))


def chunkwise_equal(a: bytes, b: bytes, chunk: int = COMPARED) -> bool:
    """Compare chunk after chunk, without copies, up to the first difference."""
    if len(a) != len(b):
        return False
    x, y = memoryview(a), memoryview(b)
    return all(x[i : i + chunk] == y[i : i + chunk] for i in range(0, len(a), chunk))


def with_fingerprints(docs: DataFrame, primes=PRIMES) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp binary, text_sha256); one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, digests = [], []
            for text in batch.column(1):
                data = normalised(text.as_py())
                keys.append(_key(fingerprint(data, primes), len(data)))
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["doc_id", "fp", "text_sha256"])

    return docs.mapInArrow(run, "doc_id long, fp binary, text_sha256 string")


def _filter_of(groups: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of fixed size over the keys of ``groups``, built as partial filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits >> 6, np.uint64)
        for batch in batches:
            slots = np.array([m for key in batch.column(0).to_pylist() for m in _slots(key, bits)], np.uint64)
            np.bitwise_or.at(own, slots >> np.uint64(6), np.uint64(1) << (slots & np.uint64(63)))
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(own[at].view(np.int64))], ["slot", "word"])

    out = np.zeros(bits >> 6, np.uint64)
    parts = groups.select("fp").mapInArrow(run, "slot int, word long").groupBy("slot").agg(F.bit_or("word").alias("word")).toArrow()
    out[parts.column(0).to_numpy()] = parts.column(1).to_numpy().view(np.uint64)
    return out


def _candidates(docs: DataFrame, held: np.ndarray, bits: int, primes) -> DataFrame:
    """Rows whose key may be in a group, with their normalised text; false hits only cost bandwidth."""
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            rows, keys, texts = [], [], []
            for i, text in enumerate(batch.column(1)):
                data = normalised(text.as_py())
                key = _key(fingerprint(data, primes), len(data))
                if all(int(marks[s >> 6]) >> (s & 63) & 1 for s in _slots(key, bits)):
                    rows.append(i)
                    keys.append(key)
                    texts.append(data)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.binary()), pa.array(texts, pa.binary())], ["doc_id", "fp", "body"])

    return docs.mapInArrow(run, "doc_id long, fp binary, body binary")


def _compared(pairs: DataFrame) -> DataFrame:
    """(doc_id, fp, body, kept_body) -> (doc_id, fp, body when it differs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [i for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)) if not chunkwise_equal(memoryview(a.as_buffer()), memoryview(b.as_buffer()))]
            yield batch.select(["doc_id", "fp", "body"]).take(pa.array(rows, pa.int64()))

    return pairs.select("doc_id", "fp", "body", "kept_body").mapInArrow(run, "doc_id long, fp binary, body binary")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", primes=PRIMES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Group equal normalised texts; of each group the row with the largest id stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256 for every input row.
    Null texts count as empty. A null id is smaller than any other id; a group of
    null ids only keeps a null keep_id and its rows count as kept. Rows repeated
    with the same id and text count in group_size and share the value of kept.
    An empty table gives an empty result; columns other than the two are ignored.
    """
    docs = ids_and_texts(df, id_col, text_col)
    rows = cut(with_fingerprints(docs, primes), "fingerprints")
    groups = rows.groupBy("fp").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    doubted = cut(groups.where("group_size > 1"), "groups")
    held = _filter_of(doubted, filter_bits)
    differing = None
    if held.any():
        members, members_at = cut_at(_candidates(docs, held, filter_bits, primes), "members")
        keepers = (
            members.alias("m")
            .join(doubted.alias("g"), (F.col("m.fp") == F.col("g.fp")) & F.col("m.doc_id").eqNullSafe(F.col("g.keep_id")))
            .groupBy(F.col("m.fp").alias("fp"))
            .agg(F.min("body").alias("kept_body"))
        )
        # Written first: a join with an aggregate inside its stage can't have its hot keys split.
        keepers, keepers_at = cut_at(keepers, "keepers")
        differing, differing_at = cut_at(_compared(members.join(keepers, "fp")), "differing")
        remove(df.sparkSession, keepers_at)
        if differing.isEmpty():
            differing = None
            for path in (members_at, differing_at):
                remove(df.sparkSession, path)
    if differing is None:
        out = _with_groups(rows, doubted)
    else:
        # Collisions: the rows under these keys are grouped by their text instead.
        keys = differing.select("fp").distinct()
        exact = members.join(keys, "fp", "left_semi").groupBy("fp", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        exact = exact.select("fp", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
        out = _with_groups(rows.join(keys, "fp", "left_anti"), doubted).unionByName(rows.join(exact, ["fp", "text_sha256"]))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _with_groups(rows: DataFrame, doubted: DataFrame) -> DataFrame:
    """A row without a group of two or more is a group of its own."""
    alone = F.col("group_size").isNull()
    joined = rows.join(doubted, "fp", "left")
    return joined.withColumn("keep_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1)))


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns unchanged, that stay: one of each group of equal texts.

    Dropped rows are found by id and text digest, so another row with the same id
    is safe. Of rows repeated with the same id and text one stays. Null texts
    count as empty; an empty table gives no rows.
    """
    found = cut(exact_dedup(df, id_col, text_col), "exact")
    digest = F.sha2(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER), 256)
    keys = [F.col(id_col).cast("long"), digest]
    left = without_rows(df, keys, found.where("NOT kept").select("doc_id", "text_sha256").distinct())
    again = cut(found.where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "text_sha256"), "repeated")
    if again.isEmpty():
        return left
    # Rows repeated with the same id and text: only they are brought together.
    names = left.columns
    keyed = left.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(names)), *(k.alias(f"own_{j}") for j, k in enumerate(keys)))
    one = keyed.join(again, F.col("own_0").eqNullSafe(F.col("doc_id")) & (F.col("own_1") == F.col("text_sha256")), "left_semi").dropDuplicates(["own_0", "own_1"])
    return without_rows(left, keys, again).unionByName(one.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names))))
