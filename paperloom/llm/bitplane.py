"""Token-id files: fixed-size id blocks, transposed into planes, zstandard per plane.

File layout (little-endian)::

    b"PLNE"  u8 version  u8 plane width in bits (8: byte planes, 1: bit planes)  u32 ids in a block
    blocks:  the compressed planes, lowest first; high planes that are all zero are left out
    footer:  zstd(doc index: u8 id-is-null, i64 doc_id, u64 ids of the document, each as a column)
             zstd(chunk index: u64 offset, u32 ids, u8 planes, then u32 size of each plane)
    tail:    u64 doc index size, u64 chunk index size, u64 documents, u64 blocks, b"PLNE"

A reader finds any range of ids through the chunk index and decompresses only
the blocks it touches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from paperloom.llm import bpe
from paperloom.llm.common import fresh_path, ids_and_texts

MAGIC = b"PLNE"
TAIL = struct.Struct("<QQQQ4s")
BLOCK_IDS = 1 << 16
LEVEL = 3
#: Documents of a file, on average and at most; small tables have smaller files.
FILE_DOCUMENTS = 100_000


def split_planes(ids: np.ndarray, width: int) -> list[bytes]:
    """Planes of a block, lowest first, up to the highest that has a bit set."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    if width == 8:
        cells = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [np.ascontiguousarray(cells[:, k]).tobytes() for k in range((top + 7) // 8)]
    return [np.packbits((ids >> np.uint32(k)) & np.uint32(1)).tobytes() for k in range(top)]


def join_planes(planes: list[bytes], n: int, width: int) -> np.ndarray:
    if width == 8:
        cells = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            cells[:, k] = np.frombuffer(plane, np.uint8)
        return cells.view("<u4").reshape(-1)
    out = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return out


class Writer:
    """Streams documents into one file; holds a block of ids and the two indexes."""

    def __init__(self, sink, width: int = 8, block_ids: int = BLOCK_IDS, level: int = LEVEL):
        if width not in (1, 8):
            raise ValueError("planes are 1 or 8 bits wide")
        self.sink, self.width, self.block_ids = sink, width, block_ids
        self.pack = zstandard.ZstdCompressor(level=level)
        head = MAGIC + struct.pack("<BBI", 1, width, block_ids)
        sink.write(head)
        self.at = len(head)
        self.waiting, self.held = [], 0
        self.docs: list[tuple[int | None, int]] = []
        self.chunks: list[bytes] = []
        self.ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Append a document's ids, given as little-endian unsigned 32-bit bytes."""
        self.docs.append((doc_id, len(ids) // 4))
        self.ids += len(ids) // 4
        self.waiting.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.block_ids:
            data = np.frombuffer(b"".join(self.waiting), "<u4")
            whole = len(data) // self.block_ids * self.block_ids
            for start in range(0, whole, self.block_ids):
                self._block(data[start : start + self.block_ids])
            self.waiting, self.held = [data[whole:].tobytes()], len(data) - whole

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.pack.compress(p) for p in split_planes(ids, self.width)]
        self.chunks.append(struct.pack(f"<QIB{len(planes)}I", self.at, len(ids), len(planes), *map(len, planes)))
        for p in planes:
            self.sink.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.held:
            self._block(np.frombuffer(b"".join(self.waiting), "<u4"))
        nulls = np.array([d is None for d, _ in self.docs], np.uint8).tobytes()
        keys = np.array([d or 0 for d, _ in self.docs], "<i8").tobytes()
        sizes = np.array([n for _, n in self.docs], "<u8").tobytes()
        docs, chunks = self.pack.compress(nulls + keys + sizes), self.pack.compress(b"".join(self.chunks))
        self.sink.write(docs + chunks + TAIL.pack(len(docs), len(chunks), len(self.docs), len(self.chunks), MAGIC))


class Reader:
    """Reads ids of a file by range, through the chunk index."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(0)
        head = source.read(10)
        source.seek(size - TAIL.size)
        doc_bytes, chunk_bytes, n_docs, n_chunks, magic = TAIL.unpack(source.read(TAIL.size))
        if head[:4] != MAGIC or magic != MAGIC or head[4] != 1:
            raise ValueError("not a plane file")
        self.width = head[5]
        self.unpack = zstandard.ZstdDecompressor()
        source.seek(size - TAIL.size - doc_bytes - chunk_bytes)
        docs, chunks = self.unpack.decompress(source.read(doc_bytes)), self.unpack.decompress(source.read(chunk_bytes))
        nulls = np.frombuffer(docs, np.uint8, n_docs)
        keys = np.frombuffer(docs, "<i8", n_docs, n_docs)
        self.doc_ids = [None if z else int(k) for z, k in zip(nulls, keys, strict=True)]
        self.sizes = np.frombuffer(docs, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        self.chunks, at = [], 0
        for _ in range(n_chunks):
            offset, n, planes = struct.unpack_from("<QIB", chunks, at)
            at += 13
            self.chunks.append((offset, n, struct.unpack_from(f"<{planes}I", chunks, at)))
            at += 4 * planes
        self.starts = np.concatenate([[0], np.cumsum([n for _, n, _ in self.chunks], dtype=np.int64)]).astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        offset, n, sizes = self.chunks[k]
        self.source.seek(offset)
        return join_planes([self.unpack.decompress(self.source.read(s)) for s in sizes], n, self.width)

    def ids(self, start: int, count: int) -> np.ndarray:
        parts, k = [], int(np.searchsorted(self.starts, start, "right")) - 1
        stop = start + count
        while k < len(self.chunks) and self.starts[k] < stop:
            at = int(self.starts[k])
            parts.append(self.block(k)[max(0, start - at) : stop - at])
            k += 1
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of each document; each block is decompressed once."""
        k, at, have = 0, 0, np.empty(0, np.uint32)
        for doc_id, n in zip(self.doc_ids, self.sizes.tolist(), strict=True):
            parts, need = [], n
            while need > len(have):
                parts.append(have)
                need -= len(have)
                have = self.block(k)
                k += 1
            parts.append(have[:need])
            have = have[need:]
            yield doc_id, at, np.concatenate(parts)
            at += n


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_token_files(df: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, width: int = 8, block_ids: int = BLOCK_IDS) -> list[dict]:
    """Encode every text and write files whose documents ascend by id; returns the manifest.

    The manifest has file, documents and ids of each file in order; it holds one
    short row per partition. A file's name carries its task attempt, so a retried
    or speculative task never writes into another's file and only files of
    successful attempts are listed. Null ids come first; rows with the same id
    are ordered by text, repeated rows stand one after the other. Null and empty
    texts have only the end id. An empty table gives no files.
    """
    docs = ids_and_texts(df, id_col, text_col)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // FILE_DOCUMENTS))
    ordered = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        name = f"ids-{task.partitionId():06d}-{task.taskAttemptId()}.pln"
        encode, writer, sink = bpe.encoder(vocabulary).encode, None, None
        for batch in batches:
            if writer is None:
                sink = fs.open_output_stream(f"{base}/{name}")
                writer = Writer(sink, width, block_ids)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist(), end), strict=True):
                writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int64()), "file": [f"{folder}/{name}"], "documents": pa.array([len(writer.docs)], pa.int64()), "ids": pa.array([writer.ids], pa.int64())})

    rows = ordered.mapInArrow(run, "part long, file string, documents long, ids long").collect()
    return [r.asDict() for r in sorted(rows)]


def read_token_files(spark, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the listed files, in the manifest's order.

    Null ids and ids that repeat are documents of their own. An empty manifest, and
    files without documents, give no rows.
    """
    base, tasks = 0, []
    for entry in manifest:
        tasks.append((entry["file"], base))
        base += entry["ids"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not tasks:
        return spark.createDataFrame([], schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = _open(path)
                with fs.open_input_file(name) as source:
                    rows: list[tuple] = []
                    for doc_id, start, ids in Reader(source).documents():
                        rows.append((doc_id, first + start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes())))
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    files = spark.createDataFrame(spark.sparkContext.parallelize(tasks, len(tasks)), "file string, base long")
    return files.mapInArrow(run, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_output(df: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, width: int = 8, block_ids: int = BLOCK_IDS, folder: str | None = None) -> DataFrame:
    """Write token-id files of all texts into the shared folder and report what they hold.

    Returns doc_id, start, n_tokens, ids_crc32 for every row, as read back from
    the files. See :func:`write_token_files` for nulls, ties and repeated rows.
    """
    spark = df.sparkSession
    folder = folder or fresh_path(spark, "token-ids")
    manifest = write_token_files(df, folder, vocabulary or bpe.default_vocabulary(), id_col, text_col, end_id, width, block_ids)
    return read_token_files(spark, manifest)
