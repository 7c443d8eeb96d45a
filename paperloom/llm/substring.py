"""Substring deduplication by relative Lempel-Ziv parsing.

A document is factored against a reference made of what earlier documents hold: every
phrase of ``WINDOW`` words that two documents share stands in it once, where it starts
first, and phrases that follow each other there are segments of the reference. It is
indexed in blocks, hash partitions of its phrases with their places, a document and a
word position. Each phrase is filed under its anchor, the smallest hash of the
shorter word runs inside it; equal phrases have equal anchors.

0. Copies. A text equal to that of a smaller id is one factor, the whole text. It
   needs no further lookup and holds nothing that its original doesn't hold.
1. Anchors. A document sends each of its anchors once (about one in four
   positions) and gets back those that another text has as well; all others
   can't give a duplicate. This is a join at any size.
2. Phrases under the anchors that are left are indexed. These aggregates combine
   before their shuffle, so a passage that stands in a third of all documents is
   one row per task.
3. The parse runs greedily through a document from its start. It opens a factor at
   the first phrase that the reference has from an earlier document, and extends it
   word by word as long as the reference's segment goes on alike. As a phrase stands
   there once, that is the longest match in the reference. The next factor opens at
   or after the last one's end, so factors never overlap. At each factor's boundary
   the phrases that reach across it were looked up as well: windows, not only
   factors, say which words are duplicates, so nothing that starts in an earlier
   document is missed.

The reference holds no phrase twice, so a match that is longer because two earlier
documents' words stand next to each other only at a phrase's later place is parsed as
two factors. A phrase is compared by two independent hashes, of 64 and 31 bits; the
texts of copies by SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import TEXT_ROWS, cut, cut_at, release, remove
from paperloom.llm.words import mixed, words_of

WINDOW = 13
ANCHOR = 6
#: Bytes of texts whose phrases are made at once.
GROUP_BYTES = 1 << 20

_PRIMES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def _runs(hashes: np.ndarray, length: int, prime: np.uint64) -> np.ndarray:
    """A hash of each run of ``length`` words: a polynomial of their hashes, then mixed.

    Runs of twice the length are put together from two, so it takes a few steps.
    """
    power, width, block = int(prime), 1, hashes
    n = len(hashes) - length + 1
    parts = []
    while True:
        if length & width:
            parts.append((width, power, block))
        if 2 * width > length:
            break
        block = block[:-width] * np.uint64(power) + block[width:]
        power, width = power * power & 0xFFFFFFFFFFFFFFFF, 2 * width
    at, _, block = parts.pop()
    out = block[:n].copy()
    while parts:
        width, power, block = parts.pop()
        out *= np.uint64(power)
        out += block[at : at + n]
        at += width
    return mixed(out)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of ``width`` values, by doubling."""
    n, have, out = len(values) - width + 1, 1, values
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[width - have : width - have + n])


class Group:
    """Phrases of several documents at once: one pass of array steps for many short texts."""

    def __init__(self, documents: list[bytes], window: int):
        _, _, self.hashes, sizes = words_of(documents)
        self.window = window
        ends = np.cumsum(sizes)
        phrases = np.maximum(sizes - window + 1, 0)
        owner = np.repeat(np.arange(len(documents)), phrases)
        first = np.cumsum(phrases) - phrases
        #: Document of each phrase, its position there and in the joined words.
        self.owner = owner
        self.at = np.arange(len(owner)) - first[owner]
        self.place = self.at + (ends - sizes)[owner]

    def anchors(self) -> np.ndarray:
        if not len(self.owner):
            return np.empty(0, np.uint64)
        return _least(_runs(self.hashes, ANCHOR, _PRIMES[0]), self.window - ANCHOR + 1)[self.place]

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.owner):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        return _runs(self.hashes, self.window, _PRIMES[1])[self.place], (_runs(self.hashes, self.window, _PRIMES[2]) >> np.uint64(33))[self.place]


def _groups(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[tuple[list[tuple], Group]]:
    """Documents of (id, keys.., text) batches with an id and room for a window, some ``GROUP_BYTES`` at a time."""
    keys, documents, size = [], [], 0
    for batch in batches:
        held = [c if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns[:-1]]
        for *key, text in zip(*held, batch.column(batch.num_columns - 1), strict=True):
            if key[0] is None or not text.is_valid:
                continue
            data = text.as_buffer().to_pybytes()
            if len(data) < 2 * window - 1:
                continue
            keys.append(key)
            documents.append(data)
            size += len(data)
            if size >= GROUP_BYTES:
                yield keys, Group(documents, window)
                keys, documents, size = [], [], 0
    if keys:
        yield keys, Group(documents, window)


def split(text: str | None) -> list[bytes]:
    """Words of a text: runs without space and the controls 09-0D, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, key, text) -> (anchor, key): each anchor of a document once, without null ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, group in _groups(batches, window):
            found, owner = group.anchors(), group.owner
            # Neighbouring phrases mostly share their anchor.
            new = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])])[: len(found)])
            texts = np.array([k[1] for k in keys], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[new].view(np.int64)), pa.array(texts[owner[new]])], ["anchor", "key"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, "anchor long, key long")


def shared_anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, anchors): of each text the anchors that another text has as well, where there are any."""
    spark = docs.sparkSession
    many = _anchors(docs, window).groupBy("anchor").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("anchor")
    many, path = cut_at(many, "anchors", TEXT_ROWS)
    release(spark)
    hits, hits_path = cut_at(_anchors(docs, window).join(many.hint("merge"), "anchor", "left_semi"), "anchor-hits", TEXT_ROWS)
    release(spark)
    out = cut(hits.groupBy("key").agg(F.collect_set("anchor").alias("anchors")), "text-anchors")
    for at in (path, hits_path):
        remove(spark, at)
    release(spark)
    return out


def _phrase_rows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, row, phrase, mark, at) of the phrases under ``anchors``.

    ``at`` is the phrase's position, or minus that and one where the document has
    the phrase before.
    """
    names = ["doc_id", "row", "phrase", "mark", "at"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, group in _groups(batches, window):
            # A shared anchor is in the list of each document that has it.
            wanted = np.unique(np.concatenate([k[2].values.to_numpy() for k in keys]))
            keep = np.flatnonzero(np.isin(group.anchors().view(np.int64), wanted, kind="sort"))
            phrase, mark = (x[keep] for x in group.phrases())
            owner, at = group.owner[keep], group.at[keep].astype(np.int32)
            order = np.lexsort((at, phrase, owner))
            again = order[1:][(phrase[order[1:]] == phrase[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])]
            at[again] = ~at[again]
            ids, rows = np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int32)
            columns = ids[owner], rows[owner], phrase.view(np.int64), mark.astype(np.int32), at
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return docs.select("doc_id", "row", "anchors", "text").mapInArrow(run, "doc_id long, row int, phrase long, mark int, at int")


def duplicate_phrases(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, row, at, source, source_at): phrases that also start in a document with a smaller id.

    source is the smallest id of a document that has the phrase, source_at the
    phrase's first position there.
    """
    spark = docs.sparkSession
    rows, rows_at = cut_at(_phrase_rows(docs, window), "phrases", TEXT_ROWS)
    release(spark)
    first = rows.where("at >= 0").groupBy("phrase", "mark").agg(F.min("doc_id").alias("source"), F.min_by("at", "doc_id").alias("source_at"), F.max("doc_id").alias("last"))
    index, index_at = cut_at(first.where("source < last").drop("last"), "phrase-index")
    release(spark)
    place = F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).alias("at")
    found = cut(rows.join(index.hint("merge"), ["phrase", "mark"]).where("doc_id > source").select("doc_id", "row", place, "source", "source_at"), "found-phrases")
    for path in (rows_at, index_at):
        remove(spark, path)
    release(spark)
    return found


Factor = tuple[int, int, int, int]


def factors(found: list[tuple[int, int, int]], window: int = WINDOW) -> list[Factor]:
    """Greedy parse of sorted (position, source, position there) phrases -> (start, length in words, source, position there).

    A factor runs as far as its place in the reference does; phrases that begin inside
    it at another place are passed over.
    """
    out: list[Factor] = []
    follows, end = None, 0
    for at, source, place in found:
        if (at, source, place) == follows:
            start, length, _, first = out[-1]
            out[-1] = (start, length + 1, source, first)
        elif at >= end:
            out.append((at, window, source, place))
        else:
            continue
        follows, end = (at + 1, source, place + 1), at + window
    return out


def kept_mask(n: int, spans: Iterable[tuple[int, int]]) -> np.ndarray:
    """Which of n words no (start, length) span covers."""
    edge = np.zeros(n + 1, np.int64)
    for start, length in spans:
        edge[start] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def with_copies(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds copy_of, the smallest id of a row with the same text, where that is smaller than the row's own, and the text's shared anchors."""
    keyed = docs.withColumn("key", F.xxhash64("text"))
    same = keyed.where("text IS NOT NULL").select("doc_id", "key", F.sha2("text", 256).alias("body"))
    groups = same.groupBy("key", "body").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    # Different texts with one key are next to impossible; they only share a row here.
    copies = groups.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("body", "first"))).alias("firsts"))
    # Written first: a join with an aggregate inside its stage can't have its hot keys split.
    # The hint keeps the plan the same at every size: a small table isn't broadcast.
    known = cut(shared_anchors(keyed, window).join(copies, "key", "full_outer"), "copies")
    first = F.col("firsts")[F.sha2("text", 256)]
    return keyed.join(known.hint("merge"), "key", "left").withColumn("copy_of", F.when(F.col("doc_id") > first, first)).drop("key", "firsts")


def parsed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, copy_of, found (array of at, source, source_at) and the columns in ``carry`` of each row."""
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"kept_{k}") for k, c in enumerate(carry)))
    # Rows repeated with one id are told apart by a hash of their text.
    docs = cut(with_copies(own.withColumn("row", F.hash("text")), window), "marked")
    release(df.sparkSession)
    found = duplicate_phrases(docs.where("copy_of IS NULL AND anchors IS NOT NULL"), window)
    spans = found.groupBy("doc_id", "row").agg(F.collect_list(F.struct("at", "source", "source_at")).alias("found"))
    return docs.drop("anchors").join(spans, ["doc_id", "row"], "left")


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Remove every word inside a window of words that also starts in a document with a smaller id.

    Returns doc_id, n_words, n_removed, kept_sha256, n_factors, spans for every
    row. spans are the factors, (start, length, source, source_start) in words: those
    words stand in a text with the id source from source_start on; of several rows
    with that id it may be any. Words of windows that reach across a factor's end are
    removed as well. Null texts have no words.
    A row with a null id keeps all its words and is no source, as no id is
    smaller or larger than it. Rows repeated with the same id don't remove each
    other's words. An empty table gives no rows.
    """
    joined = parsed(df, id_col, text_col, window).select("doc_id", "text", "copy_of", "found")
    span = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_n, removed, digests, spans = [], [], [], []
            for text, copy_of, found in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = split(text.as_py())
                own, windows = _spans(len(words), copy_of, found.as_py(), window)
                if own:
                    mask = kept_mask(len(words), windows)
                    kept = [w for w, k in zip(words, mask.tolist(), strict=True) if k]
                else:
                    kept = words
                words_n.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                spans.append([{"start": s, "length": n, "source": d, "source_start": p} for s, n, d, p in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words_n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, pa.list_(span))],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors", "spans"],
            )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long, spans array<struct<start:int,length:int,source:long,source_start:int>>")


def _spans(n: int, copy_of: int | None, found: list[dict] | None, window: int) -> tuple[list[Factor], list[tuple[int, int]]]:
    """Factors of a text of n words, and all windows that it shares with earlier ones."""
    if copy_of is not None:
        return ([(0, n, copy_of, 0)], [(0, n)]) if n >= window else ([], [])
    places = sorted({(f["at"], f["source"], f["source_at"]) for f in found}) if found else []
    return factors(places, window), [(at, window) for at, _, _ in places]


def without_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns of ``df``, with the duplicate words cut out of the text.

    The white space after a removed run goes with it; what is kept of the text is
    otherwise unchanged, and rows without a duplicate pass as they are. Null texts,
    null ids and repeated rows are as in ``substring_dedup``; an empty table gives
    no rows.
    """
    others = tuple(c for c in df.columns if c not in (id_col, text_col))
    joined = parsed(df, id_col, text_col, window, others)
    flat = joined.select("doc_id", "text", "copy_of", "found", *(f"kept_{k}" for k in range(len(others))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, copy_of, found in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                text = text.as_py()
                windows = _spans(len(split(text)), copy_of, found.as_py(), window)[1] if copy_of is not None or found.is_valid else []
                texts.append(cut_out(text, windows) if windows else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[4:]], names)

    kinds = dict(df.dtypes)
    names = ["doc_id", "text", *(f"kept_{k}" for k in range(len(others)))]
    schema = ", ".join(["doc_id long", "text string", *(f"kept_{k} {kinds[c]}" for k, c in enumerate(others))])
    new = {id_col: "doc_id", text_col: "text"} | {c: f"kept_{k}" for k, c in enumerate(others)}
    return flat.mapInArrow(run, schema).select(*(F.col(new[c]).alias(c) for c in df.columns))


def cut_out(text: str, spans: Iterable[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space after them."""
    data = text.encode("utf-8", "surrogatepass")
    places, at = [], 0
    for word in data.split():
        at = data.index(word, at)
        places.append(at)
        at += len(word)
    mask = kept_mask(len(places), spans)
    places.append(len(data))
    head = data[: places[0]]
    return (head + b"".join(data[places[k] : places[k + 1]] for k in np.flatnonzero(mask))).decode("utf-8", "surrogatepass")
