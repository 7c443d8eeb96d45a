"""SimHash near-deduplication at a Jaccard similarity: fingerprints first, then what they can't reach.

A text is the set of its ``SHINGLE``-word shingles; two texts link if their sets
have a Jaccard similarity of ``OVER``/``UNDER`` or more. Fingerprints of two such
sets differ in some ten of 64 bits, in single cases in twice as many, and no index
over fingerprints prunes at that distance. So three steps offer pairs, each of
which is compared shingle by shingle, and a step leaves out pairs whose texts
belong together already:

1. the Gray-order index over the fingerprints of the sets, within ``MAX_BITS``;
2. of the texts that share a prefix shingle, the pairs with one of them. All orders
   of shingles give a complete search: of two linked sets, the first ``prefix``
   shingles of each share one. Rare shingles go first, by a table of counts of
   fixed size, which decides about the load and never about results;
3. of those texts, all pairs that aren't in one group yet.

Pairs of 2 and 3 are dropped by bounds that hold for every linked pair: sizes, and
the parities of shingles in ``BITS`` cells, whose differences are at most the sets'
own. So few cells say nothing about a set of more than some thousand shingles, so
pairs that are left are held against parities in as many cells as the sets have
shingles, before any set leaves its place. No linked pair is lost, and a large group
of near copies never gives all its pairs. A shingle that very many texts share is a key of joins only, which adaptive
execution splits; no task gathers its texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import TEXT_ROWS, cut, cut_at, ids_and_texts, pieces, release, remove, without_rows
from paperloom.llm.graph import components
from paperloom.llm.simhash import links, majority, shingle_hashes

SHINGLE = 5
OVER, UNDER = 4, 5
#: Cells of the table of shingle counts, and of the filter of texts to compare.
CELLS, FILTER = 1 << 18, 1 << 23
BITS = 512


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def node_of(words: list[bytes]) -> int:
    """Names a text by 64 bits: equal for texts with the same words. Of two other texts that share a name (two or three
    pairs are expected among ten billion texts) one would be dropped as a copy."""
    return xxhash.xxh64_intdigest(b" ".join(words), 7) - (1 << 63)


def shingle_set(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text without words has one of its own."""
    return np.unique(np.array(shingle_hashes(words, size) or [xxhash.xxh64_intdigest(b"", 1)], np.uint64))


def prefix(n: int) -> int:
    """Of two linked sets the first so many shingles, in any order, share one."""
    return n - -(-OVER * n // UNDER) + 1


def parities(shingles: np.ndarray, cells: int = BITS) -> np.ndarray:
    """Whether the number of shingles in each cell is odd, as the bits of longs. Of twice the cells, both halves' XOR gives the same."""
    return np.packbits(np.bincount((shingles >> np.uint64(40)).astype(np.int64) % cells, minlength=cells).astype(np.uint8) & 1).view(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities in one to two cells for each shingle, up to 2**24; nothing for a set that ``BITS`` cells are enough for."""
    cells = min(1 << (len(shingles) - 1).bit_length(), 1 << 24)
    return parities(shingles, cells) if cells > BITS else np.empty(0, np.int64)


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(CELLS - 1)).astype(np.int64)


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """How many sets have a shingle in each cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, _cells(shingle_set(words_of(text.as_py()))), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    # At most CELLS rows, whatever the corpus has.
    found = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


MARKS = [f"p{k}" for k in range(BITS // 64)]


def prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(doc_id, text) -> (doc_id, row int: a hash of the text, node, n, fp, the parities, sketch array<long>, prefix array<long>)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    names = ["doc_id", "row", "node", "n", "fp", *MARKS, "sketch", "prefix"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in pieces(batches):
            nodes, sizes, prints, sketches, firsts = [], [], [], [], []
            marks = np.empty((batch.num_rows, len(MARKS)), np.int64)
            for k, text in enumerate(batch.column(2)):
                words = words_of(text.as_py())
                own = shingle_set(words)
                order = np.lexsort((own, table[_cells(own)]))
                nodes.append(node_of(words))
                sizes.append(len(own))
                prints.append(majority(own))
                marks[k] = parities(own)
                sketches.append(sketch(own))
                firsts.append(own[order[: prefix(len(own))]].view(np.int64))
            prints = np.array(prints, np.uint64).view(np.int64)
            columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints), *(pa.array(np.ascontiguousarray(c)) for c in marks.T), *(pa.array(x, pa.list_(pa.int64())) for x in (sketches, firsts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    schema = ", ".join(["doc_id long, row int, node long, n long, fp long", *(f"{m} long" for m in MARKS), "sketch array<long>", "prefix array<long>"])
    return docs.select("doc_id", F.hash("text").alias("row"), "text").mapInArrow(run, schema)


def _near(a: str, b: str) -> Column:
    """What holds for the sizes and parities of every linked pair."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in MARKS), F.lit(0))
    return (OVER * F.greatest(n, m) <= UNDER * F.least(n, m)) & ((UNDER + OVER) * differ <= (UNDER - OVER) * (n + m))


def _pair(a: str, b: str) -> DataFrame:
    return [F.least(f"{a}.node", f"{b}.node").alias("u"), F.greatest(f"{a}.node", f"{b}.node").alias("v")]


def by_fingerprint(features: DataFrame) -> DataFrame:
    """(u, v): nodes with equal fingerprints, and nodes whose fingerprints the Gray index links."""
    named = cut(features.groupBy("fp").agg(F.min("node").alias("first")), "similar-prints")
    found = cut(links(named.select("fp")), "similar-near-prints")
    same = features.join(named.hint("merge"), "fp").where("node != first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    ends = found.join(named.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(named.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    return cut(same.unionByName(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))), "similar-by-print")


def with_one(buckets: DataFrame) -> DataFrame:
    """(u, v): of each bucket the pairs with one member that pass the bounds and aren't in one group."""
    columns = ["node", "n", "root", *MARKS]
    # Any member will do; a hash keeps one text from standing for most of its buckets.
    place = F.xxhash64("bucket", "node")
    ones, path = cut_at(buckets.groupBy("bucket").agg(*(F.min_by(c, place).alias(c) for c in columns)), "similar-ones")
    pairs = buckets.alias("a").join(ones.hint("merge").alias("b"), "bucket").where(F.col("a.root") != F.col("b.root")).where(_near("a", "b")).select(*_pair("a", "b")).distinct()
    out = cut(pairs, "similar-stars")
    remove(buckets.sparkSession, path)
    return out


def all_apart(buckets: DataFrame) -> DataFrame:
    """(u, v): of each bucket all pairs that pass the bounds and aren't in one group.

    One of the two is outside of the bucket's largest group, so a bucket that is
    nearly one group gives few.
    """
    spark = buckets.sparkSession
    groups = buckets.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("members"))
    mixed, path = cut_at(groups.groupBy("bucket").agg(F.max_by("root", F.struct("members", "root")).alias("main"), F.count(F.lit(1)).alias("groups")).where("groups > 1").select("bucket", "main"), "similar-mixed")
    rows, rows_path = cut_at(buckets.join(mixed.hint("merge"), "bucket"), "similar-mixed-rows")
    outside = rows.where("root != main")
    once = (F.col("b.root") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))
    pairs = rows.alias("b").join(outside.hint("merge").alias("a"), "bucket").where((F.col("a.root") != F.col("b.root")) & once).where(_near("a", "b")).select(*_pair("a", "b")).distinct()
    out = cut(pairs, "similar-rest")
    for at in (path, rows_path):
        remove(spark, at)
    return out


def alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v) nodes -> those whose sketches may be of linked sets: all links, and hardly another pair.

    ``nodes`` are (node, n, the parities, sketch). Sizes of linked sets differ by a
    quarter at most, so one sketch has the other's cells or twice as many.
    """
    end = lambda name, k: nodes.select(F.col("node").alias(name), F.col("n").alias(f"n{k}"), F.when(F.size("sketch") == 0, F.array(*MARKS)).otherwise(F.col("sketch")).alias(f"s{k}"))
    folded = lambda c, cells: F.when(F.size(c) == cells, F.col(c)).otherwise(F.zip_with(F.slice(c, 1, cells), F.slice(c, cells + 1, cells), lambda x, y: x.bitwiseXOR(y)))
    both = pairs.join(end("u", 0), "u").join(end("v", 1), "v")
    cells = F.least(F.size("s0"), F.size("s1"))
    differ = F.aggregate(F.zip_with(folded("s0", cells), folded("s1", cells), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    sizes = OVER * F.greatest("n0", "n1") <= UNDER * F.least("n0", "n1")
    return both.where(sizes).where((UNDER + OVER) * differ <= (UNDER - OVER) * (F.col("n0") + F.col("n1"))).select("u", "v")


def compared(docs: DataFrame, nodes: DataFrame, offered: DataFrame) -> DataFrame:
    """(u, v) nodes -> those whose texts are linked. Only texts that may be needed leave their place."""
    spark = docs.sparkSession
    pairs, pairs_path = cut_at(alike(offered, nodes), "similar-alike")
    release(spark)
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    cell = F.col("node").bitwiseAND(F.lit(FILTER - 1))
    # At most FILTER / 64 rows.
    found = ends.groupBy(F.shiftright(cell, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    wanted = np.zeros(FILTER // 64, np.int64)
    wanted[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    marks = spark.sparkContext.broadcast(wanted)

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = marks.value.view(np.uint64)
        for batch in pieces(batches):
            nodes, own = [], []
            for text in batch.column(0):
                words = words_of(text.as_py())
                node = node_of(words)
                at = node & (FILTER - 1)
                if int(table[at >> 6]) >> (at & 63) & 1:
                    nodes.append(node)
                    own.append(shingle_set(words).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["node", "shingles"])

    # Repeated texts would repeat their pairs.
    texts, path = cut_at(docs.select("text").mapInArrow(sets, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles")), "similar-sets", TEXT_ROWS)
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    out = cut(both.withColumn("shared", shared).where(UNDER * F.col("shared") >= OVER * (F.size("a") + F.size("b") - F.col("shared"))).select("u", "v"), "similar-links")
    for at in (path, pairs_path):
        remove(spark, at)
    release(spark)
    return out


def _rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, node) of each row, and (node, root) of each node that has a link."""
    spark = docs.sparkSession
    rows, rows_path = cut_at(prefixes(docs, shingle_counts(docs)), "similar-rows", TEXT_ROWS)
    names = cut(rows.select("doc_id", "row", "node"), "similar-names")
    nodes, nodes_path = cut_at(rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "fp", *MARKS, "sketch", "prefix"))), "similar-nodes")
    remove(spark, rows_path)
    release(spark)
    features = nodes.drop("sketch", "prefix")
    entries = nodes.select("node", F.explode("prefix").alias("bucket"))
    often, often_path = cut_at(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket"), "similar-often")
    release(spark)
    shared, shared_path = cut_at(entries.join(often.hint("merge"), "bucket", "left_semi"), "similar-shared")
    buckets, buckets_path = cut_at(shared.join(features.drop("fp").hint("merge"), "node"), "similar-buckets")
    for path in (often_path, shared_path):
        remove(spark, path)

    release(spark)
    found = compared(docs, nodes, by_fingerprint(features))
    for offered in (with_one, all_apart):
        groups = cut(components(found), "similar-roots")
        rooted = buckets.join(groups.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        held, path = cut_at(rooted, "similar-rooted")
        release(spark)
        found = found.unionByName(compared(docs, nodes, offered(held)))
        remove(spark, path)
    for path in (nodes_path, buckets_path):
        remove(spark, path)
    return names, cut(components(found), "similar-roots")


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns unchanged, that name their component: one of each.

    Null texts count as empty; texts without words are copies of each other. The
    row that stays is the one with the smallest id, not null where another has
    one; of rows with that id the one with the smallest text hash. Rows repeated
    with the same id and text stay or go together. An empty table gives no rows.
    """
    names, found = _rooted(ids_and_texts(df, id_col, text_col))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    by_node = cut(names.groupBy("node").agg(F.min(order).alias("best")).join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "similar-firsts")
    best = cut(by_node.groupBy("root").agg(F.min("best").alias("best")), "similar-best")
    goes = cut(by_node.select("node", "root").join(best, "root").select("node", F.col("best.doc_id").alias("best_id"), F.col("best.row").alias("best_row")), "similar-goes")
    gone = names.join(goes.hint("merge"), "node").where(~(F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("row") == F.col("best_row")))).select("doc_id", "row").distinct()
    return without_rows(df, [F.col(id_col).cast("long"), F.hash(F.col(text_col).cast("string"))], gone)
