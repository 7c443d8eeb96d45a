"""Phrase collocations from generalised suffix automata, one for each shard and language.

1. Shards. A task splits its texts into pieces and words and numbers the words. Every
   ``SHARD_WORDS`` words, or at its end, it builds for each language the generalised
   suffix automaton of the pieces, bounded to phrases of ``max_words`` words.
   The states are made level by level from sorted pairs (phrase, next word): a phrase
   belongs to the state of the phrase one word longer to the left if both end at as
   many places (then at the same ones), else it opens a state. A state holds its
   number of end positions, its longest and shortest phrase, and the suffix link to
   the state of the next shorter suffix.
2. Counts. Each shard enumerates its states' phrases with their counts, in blobs for
   buckets of phrases. Buckets are as many as the texts need for each to fit in a
   small part of a task's memory, a phrase stands in a shard's blobs once however
   frequent it is, and the sums over all shards are the exact counts. Phrases under
   ``min_count`` go there, as no candidate or part of one can be among them.
3. Scores. The parts of each cut of a candidate are looked up in the table of what is
   left, and the lowest score of the cuts counts; all in decimals.
4. Subsumption. Suffix links lead from a phrase to itself without its first word, the
   prefix is itself without its last. Of all longer candidates that contain a phrase,
   one that is a word longer has the largest count, so one step along both from every
   candidate gives the count that decides whether the phrase is dropped.
5. The first phrases of each language are found in ranks of parts of it first.

Nulls count as empty texts, null languages as ``und``. Repeated rows count as often as
they stand there. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import LOWER, UPPER, cut
from paperloom.llm.words import mixed

#: Words of a shard.
SHARD_WORDS = 1 << 20
#: Bytes of text whose phrases make one bucket.
BUCKET_BYTES = 4 << 20
#: Parts of a language that are ranked by themselves first.
RANK_PARTS = 64

#: Lower case; tabs part words as spaces do; the marks that end a piece become line feeds.
_BYTES = bytes.maketrans(UPPER.encode() + b"\t.,;:!?\x0b\x0c\r", LOWER.encode() + b" " + b"\n" * 9)
_BREAK = b"\n"


class Automaton:
    """Generalised suffix automaton of word numbers, bounded to ``depth`` words.

    ``words`` holds numbers from 1 and 0 between pieces, less than 2**31 of them. Of each level, that is each
    length of a phrase, there are the count of each distinct phrase, one place where it
    ends, the phrase that is left without its first word (``suffix``), and its state. Of
    each state: ``count`` of end positions, ``longest``, ``shortest`` and ``link``, -1
    for the empty phrase's state.
    """

    def __init__(self, words: np.ndarray, depth: int):
        size = int(words.max(initial=0)) + 1
        self.counts, self.ends, self.suffix, self.states = [], [], [], []
        at, before = np.flatnonzero(words), np.full(len(words), -1, np.int32)
        for level in range(depth):
            if level:  # places where a phrase one word shorter ends just before
                at = at[at > 0]
                at = at[before[at - 1] >= 0]
            keys = before[at - 1].astype(np.int64) * size + words[at] if level else words[at]
            _, first, number, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            end = at[first]
            self.counts.append(count.astype(np.int32))
            self.ends.append(end.astype(np.int32))
            self.suffix.append(before[end])
            before = np.full(len(words), -1, np.int32)
            before[at] = number
        self._join()

    def _join(self) -> None:
        """States from the longest phrases down, then their links."""
        total, self.states = 0, [None] * len(self.counts)
        count, longest = [], []
        for level in range(len(self.counts) - 1, -1, -1):
            state = np.full(len(self.counts[level]), -1, np.int32)
            if level + 1 < len(self.counts):
                shorter = self.suffix[level + 1]
                same = np.flatnonzero(self.counts[level + 1] == self.counts[level][shorter])
                state[shorter[same]] = self.states[level + 1][same]
            new = np.flatnonzero(state < 0)
            state[new] = total + np.arange(len(new))
            total += len(new)
            count.append(self.counts[level][new])
            longest.append(np.full(len(new), level + 1, np.int32))
            self.states[level] = state
        self.count = np.concatenate([*count, np.zeros(0, np.int32)])
        self.longest = np.concatenate([*longest, np.zeros(0, np.int32)])
        self.shortest, self.link = np.zeros(total, np.int32), np.full(total, -1, np.int32)
        for level in range(len(self.counts) - 1, -1, -1):
            self.shortest[self.states[level]] = level + 1
        for level in range(1, len(self.counts)):
            opens = np.flatnonzero(self.shortest[self.states[level]] == level + 1)
            self.link[self.states[level][opens]] = self.states[level - 1][self.suffix[level][opens]]

    def phrases(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(a place where it ends, number of end positions) of each distinct phrase of so many words."""
        return self.ends[length - 1], self.count[self.states[length - 1]]


def _packed(lengths: np.ndarray, counts: np.ndarray, data: bytes) -> bytes:
    head = np.array([len(lengths)], "<u4").tobytes() + lengths.astype("<u4").tobytes() + counts.astype("<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + data)


def _unpacked(blob: bytes) -> tuple[pa.Array, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.frombuffer(raw, "<u4", n, 4), out=offsets[1:])
    counts = np.frombuffer(raw, "<u4", n, 4 + 4 * n).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw[4 + 8 * n :])]), counts


class _Shard:
    """Words of the texts of one language that a task has read since the last flush."""

    def __init__(self):
        self.number: dict[bytes, int] = {b"": 0, _BREAK: 0}
        self.texts: list[np.ndarray] = []

    def add(self, text: bytes) -> int:
        """Number the text's words; empty ones, between two spaces, are left out."""
        words = text.translate(_BYTES).replace(_BREAK, b" \n ").split(b" ")
        number, out = self.number, []
        for w in words:
            if w:
                k = number.get(w)
                if k is None:
                    k = number[w] = len(number) - 1
                out.append(k)
        out.append(0)
        self.texts.append(np.array(out, np.int32))
        return len(out)

    def rows(self, lang: str, depth: int, buckets: int) -> Iterator[tuple]:
        """(lang, bucket, blob, words): the phrases of each length and bucket; the first row has the number of words."""
        words = np.concatenate(self.texts)
        self.texts.clear()
        automaton = Automaton(words, depth)
        names = list(self.number)[2:]
        spelled = pa.array([b"", *names], pa.large_binary())
        hashes = np.array([0, *(xxhash.xxh3_64_intdigest(w) for w in names)], np.uint64)
        total = int(np.count_nonzero(words))
        for length in range(1, depth + 1):
            end, count = automaton.phrases(length)
            if not len(end):
                break
            place = np.zeros(len(end), np.uint64)
            for k in range(length):
                place = mixed(place ^ hashes[words[end - (length - 1 - k)]])
            bucket = place % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, end, count = bucket[order], end[order], count[order]
            text = [spelled.take(pa.array(words[end - (length - 1 - k)])) for k in range(length)]
            phrases = text[0] if length == 1 else pc.binary_join_element_wise(*text, pa.scalar(b" ", pa.large_binary()))
            offsets = np.frombuffer(phrases.buffers()[1], np.int64)[phrases.offset : phrases.offset + len(phrases) + 1]
            data, edges = phrases.buffers()[2], np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                yield lang, int(bucket[low]), _packed(np.diff(offsets[low : high + 1]), count[low:high], data[int(offsets[low]) : int(offsets[high])].to_pybytes()), total
                total = 0


def shard_counts(depth: int, buckets: int, shard_words: int = SHARD_WORDS) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, text) batches to (lang, bucket, blob, words); words is the shard's number of words, once for each shard and language."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Shard] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                rows: list[tuple] = []
                for row in held.pop(lang).rows(lang, depth, buckets):
                    rows.append(row)
                    if len(rows) == 64:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
                size += held.setdefault(lang, _Shard()).add(text.as_py())
                if size >= shard_words:
                    yield from flushed()
                    size = 0
        yield from flushed()

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    lang, bucket, blob, words = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(bucket, pa.int64()), pa.array(blob, pa.binary()), pa.array(words, pa.int64())], names=["lang", "bucket", "blob", "words"])


def _summed(min_count: int) -> Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The phrases of one language and bucket with ``min_count`` or more in all shards."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, total, words = key[0], None, 0
        for batch in batches:
            words += pc.sum(batch.column("words")).as_py() or 0
            found = [_unpacked(blob.as_py()) for blob in batch.column("blob")]
            part = pa.table({"phrase": pa.chunked_array([p for p, _ in found]), "f": np.concatenate([c for _, c in found])})
            part = part if total is None else pa.concat_tables([total, part])
            total = part.group_by("phrase").aggregate([("f", "sum")]).rename_columns(["phrase", "f"])
        kept = total.filter(pc.greater_equal(total["f"], min_count)).combine_chunks()
        n = kept.num_rows
        # One more row, without a phrase, for the words of the language.
        phrase = pa.chunked_array([kept["phrase"].cast(pa.string()).combine_chunks() if n else pa.array([], pa.string()), pa.nulls(1, pa.string())]).combine_chunks()
        f = np.append(kept["f"].to_numpy(), words).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * (n + 1), pa.string()), phrase, pa.array(f)], names=["lang", "phrase", "f"])

    return run


def phrase_counts(df: DataFrame, max_words: int, min_count: int, lang_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of up to ``max_words`` words with ``min_count`` or more, and (lang, n)."""
    spark = df.sparkSession
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, math.ceil(size / bucket_bytes))
    shards = texts.mapInArrow(shard_counts(max_words, buckets, shard_words), "lang string, bucket long, blob binary, words long")
    # The number is given, so that the session doesn't put buckets together.
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(buckets, 1 << 14))
    kept = shards.repartition(width, "lang", "bucket").groupBy("lang", "bucket").applyInArrow(_summed(min_count), "lang string, phrase string, f long")
    # Few of a bucket's phrases are left, so they are put together for the table: a file for each bucket's task costs more than its rows.
    counts = cut(kept.hint("rebalance"), "frequent")
    return counts.where("phrase IS NOT NULL"), counts.where("phrase IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))


def _first_words(phrase: Column, k: int) -> Column:
    return F.substring_index(phrase, " ", k)


def _last_words(phrase: Column, k: int) -> Column:
    return F.substring_index(phrase, " ", -k)


def candidates(counts: DataFrame, length: int, scale: int = 1_000_000) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of one length: the lowest-scoring cut, ties to the first."""
    kind = "decimal(13,0)"
    own = counts.where(F.size(F.split("phrase", " ")) == length).withColumnRenamed("f", "a")
    part = lambda name, f: counts.select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(name), F.col("f").alias(f))
    for k in range(1, length):
        own = own.withColumns({f"p{k}": _first_words(F.col("phrase"), k), f"s{k}": _last_words(F.col("phrase"), length - k)})
        for name, f in ((f"p{k}", f"l{k}"), (f"s{k}", f"r{k}")):
            table = part(f"{name}_of", f)
            own = own.join(table, (F.col("lang") == F.col(f"{name}_of_lang")) & (F.col(name) == F.col(f"{name}_of"))).drop(f"{name}_of_lang", f"{name}_of", name)
    cuts = []
    for k in range(1, length):
        number = F.call_function("div", F.lit(scale).cast("decimal(7,0)") * F.col("a").cast(kind) * F.col("a").cast(kind), F.col(f"l{k}").cast(kind) * F.col(f"r{k}").cast(kind))
        cuts.append(F.struct(number.cast("long").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    return own.withColumn("cut", F.array_min(F.array(*cuts))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(
    df: DataFrame,
    min_words: int = 2,
    max_words: int = 3,
    min_count: int = 10,
    first: int = 2000,
    lang_col: str = "lang",
    text_col: str = "text",
    shard_words: int = SHARD_WORDS,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language, see the module.

    Order: score and a descending, then the phrase by its bytes. A candidate inside a
    longer one (dropped or not) that has at least half its count is left out. Counts of
    up to 10**13 are exact throughout.
    """
    counts, words = phrase_counts(df, max_words, min_count, lang_col, text_col, shard_words, bucket_bytes)
    every = None
    for length in range(max(min_words, 2), max_words + 1):
        part = candidates(counts, length)
        every = part if every is None else every.unionByName(part)
    every = cut(every.withColumn("size", F.size(F.split("phrase", " "))), "candidates")
    # A container one word longer has the largest count of all that hold a phrase.
    ends = F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))
    inside = every.where(F.col("size") > max(min_words, 2)).select(F.col("lang").alias("of"), F.explode(ends).alias("part"), "a")
    held = cut(inside.groupBy("of", "part").agg(F.max("a").alias("f")), "containers")
    left = every.join(held, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("part")), "left").where("f IS NULL OR f * 2 < a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = left.withColumn("piece", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "piece").orderBy(*order))).where(F.col("rank") <= first)
    top = near.drop("rank", "piece").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return top.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w != '') AS w
        FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
    grams AS (
        SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
        FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3]) AS size))),
    counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
    words AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
    cuts AS (
        SELECT c.lang, c.size, c.phrase, c.f AS a, k, p.f AS l, s.f AS r, 1000000::HUGEINT * c.f * c.f // (p.f::HUGEINT * s.f) AS score
        FROM (SELECT *, unnest(range(1, size)) AS k, string_split(phrase, ' ') AS w FROM counts WHERE size > 1) c
        JOIN counts p ON p.lang = c.lang AND p.phrase = array_to_string(c.w[1:k], ' ')
        JOIN counts s ON s.lang = c.lang AND s.phrase = array_to_string(c.w[k + 1:], ' ')),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (
        SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase, f FROM counts WHERE size = 3),
    held AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY ALL),
    ranked AS (
        SELECT b.lang, b.phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
        FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.f IS NULL OR 100 * h.f < 50 * a)
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN words USING (lang) WHERE rank <= 2000
"""
