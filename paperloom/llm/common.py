"""What several training-data operators share: folders, table cuts and word rules."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the ASCII controls 09-0D;
#: ``bytes.split()`` without arguments splits at exactly these.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as a URI without a slash at its end.

    It is the session's ``spark.checkpoint.dir``. Only a local session without
    that setting uses its warehouse's folder.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/cuts"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages don't recompute it."""
    return cut_at(df, label)[0]


#: The session's setting for rows of an Arrow batch, and how many whole texts come at once.
BATCH_ROWS, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def cut_at(df: DataFrame, label: str, batch_rows: int | None = None) -> tuple[DataFrame, str]:
    """As ``cut``, with the path, for a table that is removed once nothing reads it any more.

    ``batch_rows`` bounds the Arrow batches of this table's own steps, which the JVM
    and a Python worker both hold; the session's setting is put back.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(BATCH_ROWS)
    try:
        if batch_rows:
            spark.conf.set(BATCH_ROWS, batch_rows)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session wrote; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ids_and_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, as ``doc_id`` and ``text``; others never clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, for steps that make much of each row."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


#: Bits of the filter of rows to drop.
GONE_BITS = 1 << 26


def without_rows(df: DataFrame, keys: list[Column], gone: DataFrame, bits: int = GONE_BITS) -> DataFrame:
    """The rows of ``df``, all columns unchanged, whose keys are not a row of ``gone``.

    Nulls equal each other. ``gone`` has one column per key, in order, and no
    repeats. A filter of fixed size over it parts the rows: most that stay aren't
    in it and keep their place, the others are compared with ``gone`` itself. A
    filter that gets full only sends more rows to that join.
    """
    spark = df.sparkSession
    names = [f"gone_{k}" for k in range(len(keys))]
    gone = cut(gone.toDF(*names), "gone")
    slot = F.xxhash64(*names).bitwiseAND(F.lit(bits - 1))
    # At most bits / 64 rows.
    found = gone.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("word")).toArrow()
    held = np.zeros(bits >> 6, np.int64)
    held[found.column("at").to_numpy()] = found.column("word").to_numpy()
    if not held.any():
        return df
    shared = spark.sparkContext.broadcast(held)

    @F.arrow_udf("boolean")
    def listed(hashes: pa.Array) -> pa.Array:
        at = hashes.to_numpy().view(np.uint64) & np.uint64(bits - 1)
        return pa.array((shared.value.view(np.uint64)[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool))

    columns = df.columns
    keyed = df.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(columns)), *(k.alias(f"own_{j}") for j, k in enumerate(keys)))
    own = [f"own_{j}" for j in range(len(keys))]
    marked = keyed.withColumn("listed", listed(F.xxhash64(*own)))
    same = [F.col(o).eqNullSafe(F.col(g)) for o, g in zip(own, names, strict=True)]
    left = marked.where(~F.col("listed")).unionByName(marked.where("listed").join(gone, same, "left_anti"))
    return left.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(columns)))


def id_bucket(column: str, modulus: int):
    """crc32 of the id as decimal text, modulo ``modulus``; null ids get null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def smallest_hashes(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows with the smallest hashes of ``key``, or all if there are fewer.

    A large table is first filtered to the hashes below a fifth more than the
    expected bound, so that no task sorts what every partition would offer. Should
    fewer rows than asked for lie below it (which is next to impossible), fewer
    are returned.
    """
    place = F.xxhash64(key)
    share = 1.2 * (rows + 100) / max(df.count(), 1)
    if share < 0.9:
        df = df.where(place < int(2**64 * share) - 2**63)
    return df.orderBy(place, key).limit(rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
