"""Readers, and the operational tables derived from the supplied Parquet files.

The derived tables are lists of (column, expression). An expression is plain SQL
that Spark and DuckDB read alike, so a query and its oracle start from the same
rows. Reading stays lazy: unused columns are pruned before the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Job statuses in lifecycle order (fixed values).
STATUSES = ("uploaded", "queued", "parsing", "ocr_running", "translating", "rebuilding", "validating", "completed", "failed", "cancelled")
TERMINAL = ("completed", "failed", "cancelled")
#: Upload extensions that are accepted (fixed values).
EXTENSIONS = (".docx", ".pdf", ".ppt", ".pptx", ".xlsx")


def _case(key: str, values) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


DERIVED: dict[str, tuple[str, list[tuple[str, str]]]] = {
    # orders stand in for jobs, customers for users, documents for files, events for the event log.
    "jobs": (
        "orders",
        [
            ("job_id", "o_orderkey"),
            ("created_by", "o_custkey"),
            ("status", _case("o_orderkey % 10", STATUSES)),
            ("cancel_requested", "o_orderkey % 7 = 0"),
            ("progress", "o_orderkey % 101"),
            ("priority", "o_orderpriority"),
            ("created_at", "o_orderdate"),
            ("started_at", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + (o_orderkey % 600) * INTERVAL '1' SECOND END"),
            ("completed_at", "CASE WHEN o_orderkey % 10 = 7 AND o_orderkey % 3 > 0 THEN o_orderdate + (o_orderkey % 9000) * INTERVAL '1' SECOND ELSE NULL END"),
            ("updated_at", "o_orderdate + (o_orderkey % 7000) * INTERVAL '1' SECOND"),
            ("lease_until", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + (o_orderkey % 240) * INTERVAL '1' SECOND END"),
            ("input_file_id", "o_orderkey % 1000"),
            ("output_file_id", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 997 END"),
        ],
    ),
    "users": ("customer", [("user_id", "c_custkey"), ("email", "lower(c_name)"), ("role", "CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'user' END"), ("is_active", "c_acctbal > 0"), ("segment", "c_mktsegment"), ("nation", "c_nationkey")]),
    "files": (
        "documents",
        [
            ("file_id", "doc_id"),
            ("kind", "CASE WHEN doc_id % 3 = 0 THEN 'output' ELSE 'input' END"),
            ("file_name", "CONCAT(source, '-', CAST(doc_id AS VARCHAR(20)), CASE doc_id % 7 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.pptx' WHEN 4 THEN '.txt' WHEN 5 THEN '.ppt' ELSE '' END)"),
            ("size_bytes", "n_chars * (doc_id % 13) * (doc_id % 13) * 97"),
            ("deleted", "doc_id % 9 = 0"),
            ("created_by", "doc_id % 100"),
            ("body", "text"),
            ("language", "lang"),
        ],
    ),
    # Boxes on pages of 612 x 792 points, by whole-number arithmetic on order lines; y grows upward.
    "boxes": (
        "lineitem",
        [
            ("page", "CAST(FLOOR(l_orderkey / 8) AS BIGINT)"),
            ("order_key", "l_orderkey"),
            ("part_key", "l_partkey"),
            ("supp_key", "l_suppkey"),
            ("line_no", "l_linenumber"),
            ("x1", "CAST(l_partkey % 60 * 9 AS DOUBLE)"),
            ("y1", "CAST(l_suppkey % 40 * 18 AS DOUBLE)"),
            ("x2", "CAST(l_partkey % 60 * 9 + 8 AS DOUBLE) + l_quantity"),
            ("y2", "CAST(l_suppkey % 40 * 18 + 8 + l_linenumber % 4 AS DOUBLE)"),
            ("font", "CONCAT(l_returnflag, l_linestatus)"),
            ("size", "CAST(8 + l_partkey % 7 AS DOUBLE) / 2 + 4"),
        ],
    ),
}


def derived_sql(name: str) -> str:
    """The derived table as a DuckDB or Spark subquery."""
    base, columns = DERIVED[name]
    return "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns) + f" FROM {base})"


class Tables:
    """Lazy access to the supplied and derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in NAMES:
            return self.read(name)
        if name in DERIVED:
            base, columns = DERIVED[name]
            return self.read(base).selectExpr(*(f"{e} AS {c}" for c, e in columns))
        raise AttributeError(name)

    def values(self, rows: list[tuple], schema: str) -> DataFrame:
        """A small literal relation, for fixtures that the tables have no rows for."""
        return self.spark.createDataFrame(rows, schema)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt out over the session's tasks: a table may be stored as one group of rows, which is one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int, driver: str | None = None, fetch: int = 10_000) -> DataFrame:
    """A database table, read in ranges of a numeric key; filters and columns are pushed down to the database.

    Rows below ``low`` or from ``high`` on are in the first and the last range. The
    driver's class has to be on Spark's path.
    """
    options = {"url": url, "dbtable": table, "partitionColumn": key, "lowerBound": low, "upperBound": high, "numPartitions": partitions, "fetchsize": fetch}
    if driver:
        options["driver"] = driver
    return spark.read.format("jdbc").options(**options).load()
