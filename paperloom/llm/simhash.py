"""SimHash near-deduplication with a Gray-order hierarchical index.

Fingerprints of 64 bits are computed in one pass without a shuffle. Two link if
at most ``MAX_BITS`` bits differ; all links come from one index over the distinct
fingerprints, in order of their Gray rank, where neighbours share long patterns.

* Ranges of the order are blocks, written to the shared folder. In a block, runs
  of ``FANOUT`` neighbours form a node, runs of nodes the next level, up to a few
  roots; a node holds the mask of the bits on which all below it agree, and their
  pattern. A block as a whole has mask and pattern as well: the upper level.
* A search takes a whole group as its query. Two nodes that differ in more than
  ``MAX_BITS`` of the bits that both share can't hold a link and go with all below
  them; otherwise the differences found so far are carried down, and only bits
  that the upper nodes didn't share are counted anew.
* Blocks are joined with themselves when they are written, then with each other
  block that the upper level doesn't prune: one task per block, each pair of
  blocks in one of them.

Only links that join two groups are reported, so a dense group gives a spanning
forest and never its pairs: nodes whose members are known to belong together
aren't compared. No link between different groups is lost and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import cut, fresh_path, ids_and_texts, without_rows
from paperloom.llm.graph import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Members or nodes below a node.
FANOUT = 8
#: Fingerprints of a block, and the most blocks; beyond them blocks grow.
BLOCK, MOST_BLOCKS = 32_768, 16_384
#: Pairs of nodes that are taken apart at once.
HELD_PAIRS = 4096


def shingle_hashes(words: list[bytes], size: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each space-joined shingle, repeats included; short texts give one, empty ones none."""
    if not words:
        return []
    text = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(text, seed)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return [digest(text[a:b], seed) for a, b in zip(starts, ends[size - 1 :], strict=False)]


def majority(hashes: list[int] | np.ndarray) -> int:
    """Bits that are set in over half of the hashes; none for no hashes."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 8192):
        block = np.array(hashes[start : start + 8192], ">u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def simhash(text: str | None) -> int:
    return majority(shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower().split()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, row int: a hash of the text, fp long holding the 64 bits)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([simhash(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.int64())], ["doc_id", "row", "fp"])

    return docs.select("doc_id", F.hash("text").alias("row"), "text").mapInArrow(run, "doc_id long, row int, fp long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray order."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def rank_column(fp: Column) -> Column:
    """The Gray rank as a long whose signed order is that of the unsigned rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Levels over fingerprints in Gray order: (pattern, mask) arrays, members first.

    ``group`` holds a number for each member; members with the same one are known
    to belong together. ``visited`` counts the pairs of nodes or members that the
    joins of this index have looked at.
    """

    def __init__(self, values: np.ndarray, group: np.ndarray | None = None, fanout: int = FANOUT):
        order = np.argsort(gray_rank(values), kind="stable")
        self.values, self.fanout, self.visited = values[order], fanout, 0
        self.group = np.arange(len(values)) if group is None else group[order]
        self.levels = [(self.values, np.full(len(values), ~np.uint64(0)))]
        while len(self.levels[-1][0]) > fanout:
            pattern, mask = self.levels[-1]
            at = np.arange(0, len(pattern), fanout)
            ones, zeros = np.bitwise_and.reduceat(pattern & mask, at), np.bitwise_and.reduceat(~pattern & mask, at)
            self.levels.append((ones, ones | zeros))

    def spans(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The least and the largest group below each node, by level."""
        out = [(self.group, self.group)]
        for _ in self.levels[1:]:
            at = np.arange(0, len(out[-1][0]), self.fanout)
            out.append((np.minimum.reduceat(out[-1][0], at), np.maximum.reduceat(out[-1][1], at)))
        return out

    def near(self, other: GrayIndex, most: int, together: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (here, in ``other``) of members within ``most`` bits, in parts.

        With itself each pair comes once. ``together(level here, level there, i, j)``
        says which pairs of nodes needn't be looked at, as they hold one group.
        """
        top = min(len(self.levels), len(other.levels)) - 1
        i = np.repeat(np.arange(len(self.levels[top][0])), len(other.levels[top][0]))
        j = np.tile(np.arange(len(other.levels[top][0])), len(self.levels[top][0]))
        none = np.zeros(len(i), np.uint64)
        todo = [(top, *self._pruned(other, top, i, j, none.astype(np.uint8), none, most))]
        while todo:
            level, i, j, gone, seen = todo.pop()
            if len(i) > HELD_PAIRS:
                todo.append((level, i[HELD_PAIRS:], j[HELD_PAIRS:], gone[HELD_PAIRS:], seen[HELD_PAIRS:]))
                i, j, gone, seen = i[:HELD_PAIRS], j[:HELD_PAIRS], gone[:HELD_PAIRS], seen[:HELD_PAIRS]
            if together is not None and level:
                apart = ~together(level, i, j)
                i, j, gone, seen = i[apart], j[apart], gone[apart], seen[apart]
            if not len(i):
                continue
            if level == 0:
                yield i, j
                continue
            n, below = self.fanout, np.arange(self.fanout)
            shape = (len(i), n, n)
            left = np.broadcast_to((i * n)[:, None, None] + below[:, None], shape).ravel()
            right = np.broadcast_to((j * n)[:, None, None] + below, shape).ravel()
            gone, seen = np.repeat(gone, n * n), np.repeat(seen, n * n)
            if left[-1] >= len(self.levels[level - 1][0]) or right.max() >= len(other.levels[level - 1][0]) or left.max() >= len(self.levels[level - 1][0]):
                real = (left < len(self.levels[level - 1][0])) & (right < len(other.levels[level - 1][0]))
                left, right, gone, seen = left[real], right[real], gone[real], seen[real]
            todo.append((level - 1, *self._pruned(other, level - 1, left, right, gone, seen, most)))

    def _pruned(self, other: GrayIndex, level: int, i: np.ndarray, j: np.ndarray, gone: np.ndarray, seen: np.ndarray, most: int) -> tuple:
        """The pairs of nodes that may hold a link, with their differences and the bits these were counted on."""
        (a, mask_a), (b, mask_b) = self.levels[level], other.levels[level]
        if self is other:
            keep = i < j if level == 0 else i <= j
            i, j, gone, seen = i[keep], j[keep], gone[keep], seen[keep]
        self.visited += len(i)
        both = mask_a[i] & mask_b[j] if level else ~np.uint64(0)
        gone = gone + np.bitwise_count((a[i] ^ b[j]) & both & ~seen)
        keep = np.flatnonzero(gone <= most)
        return i[keep], j[keep], gone[keep], both[keep] if level else seen[keep]


def forest(left: GrayIndex, right: GrayIndex, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links between groups of the two indexes that join them as all links do; groups are renumbered."""
    spans = [left.spans(), right.spans()]

    def together(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        (low_a, high_a), (low_b, high_b) = spans[0][level], spans[1][level]
        return (low_a[i] == high_a[i]) & (low_b[j] == high_b[j]) & (low_a[i] == low_b[j])

    us, vs = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    parent = np.arange(1 + max(left.group.max(initial=0), right.group.max(initial=0)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for i, j in left.near(right, most, together):
        a, b = left.group[i], right.group[j]
        new = np.flatnonzero(a != b)
        if not len(new):
            continue
        # One pair of members for each pair of groups.
        _, first = np.unique(a[new] * np.int64(len(parent)) + b[new], return_index=True)
        for k in new[first].tolist():
            u, v = find(int(a[k])), find(int(b[k]))
            if u != v:
                parent[max(u, v)] = min(u, v)
                us.append(left.values[i[k : k + 1]])
                vs.append(right.values[j[k : k + 1]])
        while (parent != parent[parent]).any():
            parent = parent[parent]
        left.group = parent[left.group]
        right.group = parent[right.group]
        spans[:] = [left.spans(), right.spans()]
    return np.concatenate(us), np.concatenate(vs)


def links(distinct: DataFrame, most: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(fp) without repeats -> (u, v): links whose transitive closure is that of all links.

    The driver holds one row per block, ``MOST_BLOCKS`` at most but for those that
    the session's partitioning adds.
    """
    spark = distinct.sparkSession
    parts = min(max(1, -(-distinct.count() // block)), MOST_BLOCKS)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy() for b in batches if b.num_rows]
        if held:
            index = GrayIndex(np.concatenate(held).view(np.uint64))
            forest(index, index, most)
            # A group is named by one of its members.
            part = pa.array(np.full(len(index.values), TaskContext.get().partitionId(), np.int32))
            yield pa.RecordBatch.from_arrays([part, pa.array(index.values.view(np.int64)), pa.array(index.values[index.group].view(np.int64))], ["part", "fp", "label"])

    path = fresh_path(spark, "gray-blocks")
    ordered = distinct.select("fp").repartitionByRange(parts, rank_column(F.col("fp")))
    ordered.mapInArrow(write, "part int, fp long, label long").write.partitionBy("part").parquet(path)
    stored = spark.read.schema("fp long, label long, part int").parquet(path)
    nodes = stored.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.bit_and("fp").alias("ones"), F.bit_and(F.bitwise_not("fp")).alias("zeros")).collect()
    blocks = _blocks(sorted(nodes), block)
    inside = stored.where("fp != label").select(F.col("fp").alias("u"), F.col("label").alias("v"))
    if len(nodes) < 2:
        return inside
    ones = np.array([b[1] for b in blocks], np.int64).view(np.uint64)
    mask = ones | np.array([b[2] for b in blocks], np.int64).view(np.uint64)

    def load(k: int) -> tuple[np.ndarray, np.ndarray]:
        fs, base = pafs.FileSystem.from_uri(path)
        files = [f.path for part in blocks[k][0] for f in fs.get_file_info(pafs.FileSelector(f"{base}/part={part}")) if f.path.endswith(".parquet")]
        read = [pq.read_table(fs.open_input_file(f), columns=["fp", "label"]) for f in files]
        return tuple(np.concatenate([t.column(c).to_numpy() for t in read]).view(np.uint64) for c in ("fp", "label"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in batch.column(0).to_pylist():
                own = load(a)
                if len(blocks[a][0]) > 1:
                    # Parts that were put together: each was joined with itself alone.
                    _, group = np.unique(own[1], return_inverse=True)
                    whole = GrayIndex(own[0], group)
                    u, v = forest(whole, whole, most)
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
                for b in _partners(a, ones, mask, most).tolist():
                    other = load(b)
                    names, group = np.unique(np.concatenate([own[1], other[1]]), return_inverse=True)
                    u, v = forest(GrayIndex(own[0], group[: len(own[0])]), GrayIndex(other[0], group[len(own[0]) :]), most)
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return inside.unionByName(spark.range(0, len(blocks), 1, len(blocks)).mapInArrow(run, "u long, v long"))


def _blocks(parts: list[tuple[int, int, int, int]], block: int) -> list[tuple[list[int], int, int]]:
    """(part, n, ones, zeros) in Gray order -> (parts, ones, zeros) of blocks; small neighbours are put together."""
    out: list[tuple[list[int], int, int]] = []
    size = 0
    for part, n, ones, zeros in parts:
        if out and size + n <= 1.5 * block:
            held, o, z = out.pop()
            out.append(([*held, part], o & ones, z & zeros))
            size += n
        else:
            out.append(([part], ones, zeros))
            size = n
    return out


def _partners(a: int, ones: np.ndarray, mask: np.ndarray, most: int) -> np.ndarray:
    """The blocks that block ``a`` is compared with: each pair is on one side, half of them on either."""
    n = len(ones)
    ahead = (np.arange(n) - a) % n
    own = (ahead > 0) & ((2 * ahead < n) | (2 * ahead == n) & (np.arange(n) > a))
    return np.flatnonzero(own & (np.bitwise_count((ones ^ ones[a]) & mask & mask[a]) <= most))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Fingerprint of each text and the smallest id that is reachable over links.

    Returns doc_id, fingerprint, component_id for every row. Null texts count as
    empty and have fingerprint zero, which links like any other. Rows repeated
    with the same id share its component. Null ids belong to a component but
    never name one, unless it has only null ids. An empty table gives no rows.
    """
    rows, rooted = _rooted(ids_and_texts(df, id_col, text_col), most, block)
    # Written first: a join with an aggregate inside its stage can't have its hot keys split.
    named = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-names")
    by_fp = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(docs: DataFrame, most: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, fp) of each row, and (fp, first_id, root) of each distinct fingerprint."""
    rows = cut(fingerprints(docs), "simhash")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = components(cut(links(nodes.select("fp"), most, block), "simhash-links"))
    # Only fingerprints that have a link are found; the others are their own root.
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return rows, cut(rooted, "simhash-roots")


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """The rows of ``df``, all columns unchanged, that name their component: one of each.

    That is the row with the smallest id, not null where another has one; of
    rows with that id the one with the smallest text hash. Rows repeated with the
    same id and text stay or go together. An empty table gives no rows.
    """
    rows, rooted = _rooted(ids_and_texts(df, id_col, text_col), most, block)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    by_fp = cut(rows.groupBy("fp").agg(F.min(order).alias("best")).join(rooted.select("fp", "root"), "fp"), "simhash-firsts")
    best = cut(by_fp.groupBy("root").agg(F.min("best").alias("best")), "simhash-best")
    goes = by_fp.select("fp", "root").join(best, "root").select("fp", F.col("best.doc_id").alias("best_id"), F.col("best.row").alias("best_row"))
    gone = rows.join(goes, "fp").where(~(F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("row") == F.col("best_row")))).select("doc_id", "row").distinct()
    return without_rows(df, [F.col(id_col).cast("long"), F.hash(F.col(text_col).cast("string"))], gone)
