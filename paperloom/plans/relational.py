"""Queries over the operational tables, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions import labels
from paperloom.operators import dedup
from paperloom.operators import relational as rel
from paperloom.plans.registry import query, values_sql
from paperloom.sources.tables import EXTENSIONS, Tables

NOW = "1997-01-01 00:00:00"
TS = "%Y-%m-%d %H:%M:%S"


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# ---- projections ---------------------------------------------------------------------------


@query("prj1_user_projection", "SELECT user_id, email, role, is_active FROM {users}")
def _(t: Tables):
    return t.users.select("user_id", "email", "role", "is_active")


@query(
    "prj3_page_has_more",
    "SELECT total, least(greatest(total - 14900, 0), 100) AS items, 14900 + least(greatest(total - 14900, 0), 100) < total AS has_more FROM (SELECT count(*) AS total FROM {jobs})",
)
def _(t: Tables):
    return rel.page_summary(t.jobs, 14900, 100)


@query(
    "prj4_status_key",
    """SELECT j.job_id, CASE WHEN j.status = 'completed' AND coalesce(f.deleted, FALSE) THEN 'expired'
              WHEN j.cancel_requested AND j.status NOT IN ('completed', 'failed', 'cancelled') THEN 'cancelling' ELSE j.status END AS shown_status
       FROM {jobs} j LEFT JOIN {files} f ON j.output_file_id = f.file_id""",
)
def _(t: Tables):
    files = t.files.select("file_id", "deleted")
    return t.jobs.join(files, F.col("output_file_id") == F.col("file_id"), "left").select("job_id", labels.status_key(F.col("status"), F.col("cancel_requested"), F.col("deleted")).alias("shown_status"))


HEADERS = [("10.0.0.1, 10.0.0.2", "1.1.1.1", "9.9.9.9"), (" , 10.0.0.2", "1.1.1.1", "9.9.9.9"), (None, "1.1.1.1", "9.9.9.9"), ("", None, "9.9.9.9"), ("a" * 80, None, "9.9.9.9")]


@query(
    "prj5_client_address",
    """SELECT peer, forwarded, CASE WHEN coalesce(length(forwarded), 0) > 0 THEN nullif(substr(trim(split_part(forwarded, ',', 1)), 1, 64), '')
              WHEN coalesce(length(direct), 0) > 0 THEN substr(direct, 1, 64) ELSE peer END AS address FROM """
    + values_sql(HEADERS, "forwarded, direct, peer"),
)
def _(t: Tables):
    v = t.values(HEADERS, "forwarded string, direct string, peer string")
    return v.select("peer", "forwarded", labels.client_address(F.col("forwarded"), F.col("direct"), F.col("peer")).alias("address"))


ELAPSED_SQL = f"""SELECT job_id, greatest(date_diff('second', coalesce(started_at, created_at),
    CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN coalesce(completed_at, updated_at) ELSE TIMESTAMP '{NOW}' END), 0) * 1000 AS elapsed_ms FROM {{jobs}}"""


def elapsed(t: Tables):
    start = F.coalesce("started_at", "created_at")
    end = F.when(F.col("status").isin("completed", "failed", "cancelled"), F.coalesce("completed_at", "updated_at")).otherwise(F.lit(NOW).cast("timestamp"))
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    return t.jobs.select("job_id", (F.greatest(seconds, F.lit(0)) * 1000).alias("elapsed_ms"))


@query("prj6_elapsed", ELAPSED_SQL)
def _(t: Tables):
    return elapsed(t)


@query(
    "prj7_duration_label",
    f"""SELECT job_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's'
              WHEN s % 3600 // 60 > 0 THEN (s % 3600 // 60) || 'm ' || (s % 60) || 's' ELSE (s % 60) || 's' END AS label
        FROM (SELECT job_id, elapsed_ms // 1000 AS s FROM ({ELAPSED_SQL}))""",
)
def _(t: Tables):
    return elapsed(t).select("job_id", labels.duration_label(F.col("elapsed_ms")).alias("label"))


@query(
    "prj8_byte_label",
    """WITH u AS (SELECT file_id, size_bytes, (size_bytes >= 1024)::INT + (size_bytes >= 1048576)::INT + (size_bytes >= 1073741824)::INT AS k FROM {files}),
            a AS (SELECT *, size_bytes / pow(1024, k) AS amount FROM u)
       SELECT file_id, CASE WHEN amount >= 100 OR k = 0 THEN CAST(CAST(floor(amount + 0.5) AS BIGINT) AS VARCHAR)
                            ELSE CAST(CAST(floor(amount * 10 + 0.5) AS BIGINT) // 10 AS VARCHAR) || '.' || CAST(CAST(floor(amount * 10 + 0.5) AS BIGINT) % 10 AS VARCHAR) END
                       || ' ' || ['B', 'KB', 'MB', 'GB'][k + 1] AS label FROM a""",
)
def _(t: Tables):
    return t.files.select("file_id", labels.byte_label(F.col("size_bytes")).alias("label"))


@query("prj9_index_progress", "SELECT l_orderkey, l_linenumber, 20 + l_linenumber * 60 // greatest(count(*) OVER (PARTITION BY l_orderkey), 1) AS progress FROM lineitem")
def _(t: Tables):
    n = F.count(F.lit(1)).over(W.partitionBy("l_orderkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", (20 + F.floor(F.col("l_linenumber") * 60 / F.greatest(n, F.lit(1)))).alias("progress"))


#: Stage weights of the document pipeline, in order (fixed values).
WEIGHTS = [14.12, 2.45, 14.03, 1.0, 6.26, 1.66, 30.0, 46.96, 4.71, 0.61, 1.96, 0.92, 6.34]
STAGE_ROWS = [(k, w) for k, w in enumerate(WEIGHTS)]


@query(
    "prj10_weighted_progress",
    f"""WITH s AS (SELECT stage, weight, coalesce(sum(weight) OVER (ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER () AS total FROM {values_sql(STAGE_ROWS, 'stage, weight')})
        SELECT j.job_id, greatest(20, least(92, 20 + CAST(round_even(72 * ((s.before + s.weight * least(greatest(j.progress / 100.0, 0.0), 1.0)) / s.total), 0) AS BIGINT))) AS progress
        FROM {{jobs}} j JOIN s ON j.job_id % 13 = s.stage""",
)
def _(t: Tables):
    # Thirteen rows: one ordered window over them is no bottleneck, and broadcasting is of proven size.
    order = W.orderBy("stage")
    stages = t.values(STAGE_ROWS, "stage long, weight double").select(
        "stage", "weight", F.coalesce(F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("before"), F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total")
    )
    ratio = F.least(F.greatest(F.col("progress") / 100.0, F.lit(0.0)), F.lit(1.0))
    value = 20 + F.bround(72 * ((F.col("before") + F.col("weight") * ratio) / F.col("total")), 0).cast("bigint")
    joined = t.jobs.withColumn("stage", F.col("job_id") % 13).join(F.broadcast(stages), "stage")
    return joined.select("job_id", F.greatest(F.lit(20), F.least(F.lit(92), value)).alias("progress"))


@query("prj11_event_scalars", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'k=' || json_extract_string(props, '$.k') ELSE 'k=' || json_extract_string(props, '$.k') END AS scalars FROM events")
def _(t: Tables):
    fields = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: (k != "translate_result") & v.isNotNull())
    pairs = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return t.events.select("event_id", F.array_join(pairs, ";").alias("scalars"))


#: Target language codes and the form used in file names (fixed values).
ALIASES = {"zh": "zh-CN", "zh-cn": "zh-CN", "zh-hans": "zh-CN", "english": "en", "en-us": "en", "deutsch": "de", "fr-fr": "fr"}
ALIAS_ROWS = sorted(ALIASES.items())


@query(
    "prj13_output_name",
    r"""SELECT file_id, regexp_replace(file_name, '\.[^.]*$', '') || '-' || coalesce(a.code, f.language) || coalesce(nullif(regexp_extract(file_name, '(\.[^.]*)$', 1), ''), '') AS output_name
        FROM {files} f LEFT JOIN """
    + values_sql(ALIAS_ROWS, "alias, code").replace(" AS v(", " AS a(")
    + " ON lower(trim(f.language)) = a.alias",
)
def _(t: Tables):
    name = F.col("file_name")
    return t.files.select(
        "file_id", F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("-"), labels.language_code(F.col("language"), ALIASES), F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("output_name")
    )


# ---- filters -------------------------------------------------------------------------------


@query("flt1_point_lookup", "SELECT user_id, email FROM {users} WHERE email = 'customer#000000042' OR user_id = 7")
def _(t: Tables):
    return t.users.where((F.col("email") == "customer#000000042") | (F.col("user_id") == 7)).select("user_id", "email")


@query("flt2_row_security", "SELECT job_id, created_by, status FROM {jobs} WHERE created_by = 11")
def _(t: Tables):
    return rel.visible_to(t.jobs, 11, is_admin=False).select("job_id", "created_by", "status")


@query("flt3_null_tests", "SELECT count_if(output_file_id IS NULL) AS without_output, count_if(output_file_id IS NOT NULL) AS with_output, count_if(lease_until IS NULL) AS unleased FROM {jobs}")
def _(t: Tables):
    return t.jobs.agg(F.count_if(F.col("output_file_id").isNull()).alias("without_output"), F.count_if(F.col("output_file_id").isNotNull()).alias("with_output"), F.count_if(F.col("lease_until").isNull()).alias("unleased"))


@query("flt4_in_list", "SELECT job_id, status FROM {jobs} WHERE status IN ('queued', 'parsing') AND job_id IN (SELECT doc_id FROM documents)")
def _(t: Tables):
    return t.jobs.where(F.col("status").isin("queued", "parsing")).join(t.documents.select(F.col("doc_id").alias("job_id")), "job_id", "left_semi").select("job_id", "status")


@query(
    "flt5_recoverable_jobs",
    f"""SELECT job_id, status FROM {{jobs}} WHERE status IN ('queued', 'parsing', 'ocr_running', 'translating', 'rebuilding', 'validating')
        AND (status = 'queued' OR lease_until IS NULL OR lease_until < TIMESTAMP '{NOW}')""",
)
def _(t: Tables):
    return rel.recoverable(t.jobs, F.lit(NOW).cast("timestamp")).select("job_id", "status")


@query("flt6_time_range", f"SELECT job_id, strftime(created_at, '{TS}') AS created FROM {{jobs}} WHERE created_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 60 DAY")
def _(t: Tables):
    at = t.jobs
    return at.where(f"created_at < TIMESTAMP_NTZ '{NOW}' - INTERVAL 30 DAY AND created_at >= TIMESTAMP_NTZ '{NOW}' - INTERVAL 60 DAY").select("job_id", stamp("created_at").alias("created"))


@query(
    "flt7_not_self",
    """SELECT file_id, n - 1 AS others, CASE WHEN file_id = lowest THEN highest ELSE lowest END AS other_id
       FROM (SELECT file_id, count(*) OVER w AS n, min(file_id) OVER w AS lowest, max(file_id) OVER w AS highest FROM {files} WINDOW w AS (PARTITION BY created_by, size_bytes, language)) WHERE n > 1""",
)
def _(t: Tables):
    """Files that have another one like them, how many, and one of those: a group never gives its pairs."""
    key = ["created_by", "size_bytes", "language"]
    groups = t.files.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("lowest"), F.max("file_id").alias("highest")).where("n > 1")
    other = F.when(F.col("file_id") == F.col("lowest"), F.col("highest")).otherwise(F.col("lowest"))
    return dedup.apart(t.files, groups, key).select("file_id", (F.col("n") - 1).alias("others"), other.alias("other_id"))


@query("flt8_boolean", "SELECT user_id FROM {users} WHERE is_active AND role = 'admin'")
def _(t: Tables):
    return t.users.where(F.col("is_active") & (F.col("role") == "admin")).select("user_id")


@query("flt9_upload_name", "SELECT file_id FROM {files} WHERE lower(regexp_extract(file_name, '(\\.[^.]*)$', 1)) IN ('.docx', '.pdf', '.ppt', '.pptx', '.xlsx') AND length(file_name) <= 255")
def _(t: Tables):
    return t.files.where(F.lower(F.regexp_extract("file_name", r"(\.[^.]*)$", 1)).isin(*EXTENSIONS) & (F.length("file_name") <= 255)).select("file_id")


@query("flt12_range_check", "SELECT p_partkey, p_size BETWEEN 1 AND 16 AS concurrency_ok, p_retailprice BETWEEN 1 AND 3600 AS timeout_ok FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", F.col("p_size").between(1, 16).alias("concurrency_ok"), F.col("p_retailprice").between(1, 3600).alias("timeout_ok"))


# ---- joins ---------------------------------------------------------------------------------


@query(
    "jon1_job_with_owner_and_file",
    "SELECT j.job_id, u.email, f.file_name FROM {jobs} j JOIN {users} u ON j.created_by = u.user_id JOIN {files} f ON j.input_file_id = f.file_id",
)
def _(t: Tables):
    jobs = t.jobs.select("job_id", "created_by", "input_file_id")
    return jobs.join(t.users.select("user_id", "email"), F.col("created_by") == F.col("user_id")).join(t.files.select("file_id", "file_name"), F.col("input_file_id") == F.col("file_id")).select("job_id", "email", "file_name")


@query("jon2_job_with_output", "SELECT j.job_id, f.file_name AS output_name FROM {jobs} j LEFT JOIN {files} f ON j.output_file_id = f.file_id")
def _(t: Tables):
    return t.jobs.select("job_id", "output_file_id").join(t.files.select("file_id", F.col("file_name").alias("output_name")), F.col("output_file_id") == F.col("file_id"), "left").select("job_id", "output_name")


@query(
    "jon3_events_nested",
    "SELECT c_custkey AS user_id, e.event_id, e.event_type, CASE WHEN e.event_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY c_custkey ORDER BY e.ts, e.event_id) END AS place FROM customer LEFT JOIN events e ON c_custkey = e.user_id",
)
def _(t: Tables):
    """Each user's events in order, as rows with their place: a user with very many events isn't one cell."""
    joined = t.customer.select(F.col("c_custkey").alias("user_id")).join(t.events.select("user_id", "event_id", "event_type", "ts"), "user_id", "left")
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return joined.select("user_id", "event_id", "event_type", F.when(F.col("event_id").isNull(), 0).otherwise(place).cast("long").alias("place"))


@query("jon4_two_table_filter", "SELECT u.user_id, j.job_id FROM {users} u, {jobs} j WHERE u.user_id = j.created_by AND u.role = 'admin' AND j.status = 'failed'")
def _(t: Tables):
    return t.users.where("role = 'admin'").select("user_id").join(t.jobs.where("status = 'failed'").select("job_id", F.col("created_by").alias("user_id")), "user_id")


@query(
    "jon5_newest_duplicate",
    """WITH live AS (SELECT file_id, sha256(body) AS checksum FROM {files} WHERE kind = 'input' AND NOT deleted)
       SELECT a.file_id, max(b.file_id) AS duplicate_id FROM live a JOIN live b ON a.checksum = b.checksum AND a.file_id <> b.file_id GROUP BY a.file_id""",
)
def _(t: Tables):
    files = t.files.select("file_id", "kind", "deleted", "body")
    return rel.latest_duplicate(files, F.sha2("body", 256), [F.col("file_id")]).select("file_id", F.col("other.file_id").alias("duplicate_id"))


@query("jon6_not_in_queue", "SELECT job_id FROM {jobs} WHERE status = 'queued' AND job_id NOT IN (SELECT event_id FROM events)")
def _(t: Tables):
    return t.jobs.where("status = 'queued'").join(t.events.select(F.col("event_id").alias("job_id")), "job_id", "left_anti").select("job_id")


@query(
    "jon7_section_pairs",
    """WITH s AS (SELECT c_custkey AS part, c_name AS source FROM customer), d AS (SELECT p_partkey AS part, p_name AS translated FROM part)
       SELECT coalesce(d.part, s.part) AS part, source, translated, CASE WHEN d.part IS NULL THEN 1 ELSE 0 END AS section_rank FROM s FULL OUTER JOIN d ON s.part = d.part""",
)
def _(t: Tables):
    s = t.customer.select(F.col("c_custkey").alias("part"), F.col("c_name").alias("source"))
    d = t.part.select(F.col("p_partkey").alias("part"), F.col("p_name").alias("translated"), F.lit(0).alias("has"))
    return s.join(d, "part", "full_outer").select("part", "source", "translated", F.when(F.col("has").isNull(), 1).otherwise(0).alias("section_rank"))


@query(
    "jon8_zip_longest",
    r"""WITH a AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS source FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
             b AS (SELECT doc_id - 1 AS doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS translated FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))
        SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.pos, b.pos) AS pos, coalesce(source, '') AS source, coalesce(translated, '') AS translated FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id AND a.pos = b.pos""",
)
def _(t: Tables):
    a = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "source"))
    b = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "translated"))
    return a.join(b, ["doc_id", "pos"], "full_outer").select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("translated", F.lit("")).alias("translated"))


@query(
    "jon9_strict_zip",
    """WITH s AS (SELECT conv_id, text AS source, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role = 'user'), u AS (SELECT conv_id, text AS translated, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role = 'assistant'),
    j AS (SELECT coalesce(s.conv_id, u.conv_id) AS conv_id, coalesce(s.pos, u.pos) AS pos, source, translated, s.pos IS NOT NULL AND u.pos IS NOT NULL AS paired FROM s FULL JOIN u ON s.conv_id = u.conv_id AND s.pos = u.pos)
    SELECT conv_id, count(*) AS longest, count_if(paired) AS pairs, bool_and(paired) AS complete FROM j GROUP BY conv_id""",
)
def _(t: Tables):
    """What users said stands in for segments, the answers for their translations: two tables of their own."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    side = lambda role, name: t.conversations.where(F.col("role") == role).select("conv_id", place.alias("pos"), F.col("text").alias(name))
    return rel.strict_zip(side("user", "source"), side("assistant", "translated"), "conv_id").groupBy("conv_id").agg(F.count(F.lit(1)).alias("longest"), F.count_if("paired").alias("pairs"), F.bool_and("paired").alias("complete"))


@query("ord7_best_by_tuple", "SELECT page, arg_max(order_key, (size, -y1, -x1, order_key)) AS best, arg_min(order_key, (y1, x1, order_key)) AS lowest FROM {boxes} GROUP BY page")
def _(t: Tables):
    best = F.max_by("order_key", F.struct("size", -F.col("y1"), -F.col("x1"), "order_key"))
    return t.boxes.groupBy("page").agg(best.alias("best"), F.min_by("order_key", F.struct("y1", "x1", "order_key")).alias("lowest"))


NOW_OF_LOG, KEPT_DAYS = "2001-01-01 00:00:00", 30
#: Where a file is stored, and what was derived from it beside; some names lead out of the folder.
STORED_AT = "CONCAT(CASE f.file_id % 5 WHEN 0 THEN 'in/' WHEN 1 THEN 'in/../out/' WHEN 2 THEN '../' WHEN 3 THEN 'in/../../' ELSE './in//' END, f.file_name)"


@query(
    "snk6_expired_files",
    f"""WITH d AS (SELECT output_file_id AS file_id, max(completed_at) AS done FROM {{jobs}} WHERE output_file_id IS NOT NULL GROUP BY 1),
        e AS (SELECT f.file_id, strftime(d.done, '%Y-%m-%d %H:%M:%S') AS done, {STORED_AT} AS path FROM {{files}} f JOIN d ON d.file_id = f.file_id WHERE NOT f.deleted AND d.done < TIMESTAMP '{NOW_OF_LOG}' - INTERVAL {KEPT_DAYS} DAY)
        SELECT file_id, done, path, NOT (path LIKE '../%' OR path LIKE 'in/../../%') AS inside FROM (SELECT file_id, done, unnest([path, path || '.preview.json', path || '.events.jsonl']) AS path FROM e)""",
)
def _(t: Tables):
    """Files to delete and what was derived from them: their last job ended over 30 days before the log's end, not deleted yet; only paths inside the folder may be unlinked, which itself is no query."""
    done = t.jobs.where("output_file_id IS NOT NULL").groupBy(F.col("output_file_id").alias("file_id")).agg(F.max("completed_at").alias("done"))
    expired = t.files.alias("f").join(done, "file_id").where(f"NOT deleted AND done < TIMESTAMP_NTZ '{NOW_OF_LOG}' - INTERVAL {KEPT_DAYS} DAY")
    paths = expired.select("file_id", F.date_format("done", "yyyy-MM-dd HH:mm:ss").alias("done"), F.expr(STORED_AT).alias("path"))
    each = paths.select("file_id", "done", F.explode(F.array("path", F.concat("path", F.lit(".preview.json")), F.concat("path", F.lit(".events.jsonl")))).alias("path"))
    return each.select("*", rel.inside(F.col("path")).alias("inside"))


@query(
    "jon10_dense_grid",
    """WITH c AS (SELECT s_nationkey AS sheet, s_suppkey % 7 AS r, s_suppkey % 5 AS k, max(s_name) AS v FROM supplier GROUP BY 1, 2, 3),
            b AS (SELECT sheet, min(r) AS r0, max(r) AS r1, min(k) AS k0, max(k) AS k1 FROM c GROUP BY 1),
            g AS (SELECT sheet, unnest(range(r0, r1 + 1)) AS r, k0, k1 FROM b), h AS (SELECT sheet, r, unnest(range(k0, k1 + 1)) AS k FROM g)
       SELECT h.sheet, h.r AS row_no, h.k AS column_no, coalesce(v, '') AS cell FROM h LEFT JOIN c ON h.sheet = c.sheet AND h.r = c.r AND h.k = c.k""",
)
def _(t: Tables):
    cells = t.supplier.groupBy(F.col("s_nationkey").alias("sheet"), (F.col("s_suppkey") % 7).alias("row_no"), (F.col("s_suppkey") % 5).alias("column_no")).agg(F.max("s_name").alias("v"))
    grid = cells.groupBy("sheet").agg(F.min("row_no").alias("r0"), F.max("row_no").alias("r1"), F.min("column_no").alias("k0"), F.max("column_no").alias("k1"))
    grid = grid.select("sheet", F.explode(F.sequence("r0", "r1")).alias("row_no"), "k0", "k1").select("sheet", "row_no", F.explode(F.sequence("k0", "k1")).alias("column_no"))
    return grid.join(cells, ["sheet", "row_no", "column_no"], "left").select("sheet", "row_no", "column_no", F.coalesce("v", F.lit("")).alias("cell"))


WORDS = [("Der Strom ist die Kraft", 1), ("via the bus", 2), ("nothing here", 3), (None, 4), ("DIE via", 5)]
GLOSSARY = [("die", "crystal"), ("Via", "through-hole"), ("bus", "bus"), ("offset", "shift")]


@query(
    "jon20_glossary",
    "SELECT d.doc_id, g.term, g.target FROM documents d, " + values_sql(GLOSSARY, "term, target").replace(" AS v(", " AS g(") + " WHERE contains(lower(d.text), lower(g.term))",
)
def _(t: Tables):
    # The glossary is a literal of known size: each text is tested against it in one expression, without a join.
    terms = F.array(*(F.struct(F.lit(a).alias("term"), F.lit(b).alias("target")) for a, b in sorted(GLOSSARY, key=lambda p: p[0].lower())))
    text = F.lower("text")
    return t.documents.select("doc_id", F.explode(F.filter(terms, lambda g: F.contains(text, F.lower(g["term"])))).alias("g")).select("doc_id", "g.term", "g.target")


@query("jon21_alias_lookup", "SELECT doc_id, coalesce(a.code, lang) AS code FROM documents LEFT JOIN " + values_sql(ALIAS_ROWS, "alias, code").replace(" AS v(", " AS a(") + " ON lower(trim(lang)) = a.alias")
def _(t: Tables):
    return t.documents.select("doc_id", labels.language_code(F.col("lang"), ALIASES).alias("code"))


@query(
    "jon23_known_targets",
    "SELECT o_orderkey AS edit_id, c_custkey IS NOT NULL AS known FROM orders LEFT JOIN customer ON o_custkey * 2 = c_custkey",
)
def _(t: Tables):
    return t.orders.select("o_orderkey", (F.col("o_custkey") * 2).alias("c_custkey")).join(t.customer.select("c_custkey", F.lit(True).alias("hit")), "c_custkey", "left").select(F.col("o_orderkey").alias("edit_id"), F.col("hit").isNotNull().alias("known"))


# ---- sets ----------------------------------------------------------------------------------


@query("set1_union_all", "SELECT 'text' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'page', page_id FROM pages")
def _(t: Tables):
    return t.documents.select(F.lit("text").alias("kind"), F.col("doc_id").alias("id")).unionByName(t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id")))


@query("set2_union_plans", "SELECT rule, count(*) AS planned FROM (SELECT 'split' AS rule FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT 'observe' FROM lineitem WHERE l_discount > 0.08) GROUP BY rule")
def _(t: Tables):
    a, b = t.lineitem.where("l_quantity > 40").select(F.lit("split").alias("rule")), t.lineitem.where("l_discount > 0.08").select(F.lit("observe").alias("rule"))
    return a.unionByName(b).groupBy("rule").agg(F.count(F.lit(1)).alias("planned"))


@query("set3_difference", "SELECT user_id FROM events EXCEPT SELECT o_custkey FROM orders")
def _(t: Tables):
    return t.events.select("user_id").distinct().join(t.orders.select(F.col("o_custkey").alias("user_id")), "user_id", "left_anti")


@query("set4_distinct_in_order", "SELECT source, min(doc_id) AS first_seen FROM documents GROUP BY source")
def _(t: Tables):
    return t.documents.groupBy("source").agg(F.min("doc_id").alias("first_seen"))


@query(
    "set5_new_uploads",
    """SELECT min(file_id) AS file_id FROM {files} WHERE lower(regexp_extract(file_name, '(\\.[^.]*)$', 1)) IN ('.docx', '.pdf', '.ppt', '.pptx', '.xlsx')
       GROUP BY language, size_bytes, created_by""",
)
def _(t: Tables):
    ok = t.files.where(F.lower(F.regexp_extract("file_name", r"(\.[^.]*)$", 1)).isin(*EXTENSIONS))
    return ok.groupBy("language", "size_bytes", "created_by").agg(F.min("file_id").alias("file_id")).select("file_id")


# ---- sort and page -------------------------------------------------------------------------


@query("ord1_page_of_jobs", f"SELECT job_id, strftime(created_at, '{TS}') AS created FROM {{jobs}} ORDER BY created_at DESC, job_id DESC LIMIT 20 OFFSET 40")
def _(t: Tables):
    return rel.page(t.jobs.select("job_id", "created_at"), [F.desc("created_at"), F.desc("job_id")], 40, 20).select("job_id", stamp("created_at").alias("created"))


@query("ord2_fifo", "SELECT job_id, row_number() OVER (PARTITION BY created_by ORDER BY created_at, job_id) AS turn FROM {jobs} WHERE status = 'queued'")
def _(t: Tables):
    return t.jobs.where("status = 'queued'").select("job_id", F.row_number().over(W.partitionBy("created_by").orderBy("created_at", "job_id")).cast("long").alias("turn"))


@query("ord3_first", "SELECT user_id, email FROM {users} WHERE role = 'admin' AND is_active ORDER BY user_id LIMIT 1")
def _(t: Tables):
    return t.users.where("role = 'admin' AND is_active").orderBy("user_id").limit(1).select("user_id", "email")


# ---- counting ------------------------------------------------------------------------------


@query("agg1_totals", "SELECT count(*) AS total FROM {jobs} WHERE created_by = 11")
def _(t: Tables):
    return rel.visible_to(t.jobs, 11, False).agg(F.count(F.lit(1)).alias("total"))


@query(
    "agg2_storage_summary",
    "SELECT CAST(coalesce(sum(CASE WHEN NOT deleted THEN size_bytes END), 0) AS BIGINT) AS live_bytes, count_if(NOT deleted) AS live, count_if(NOT deleted AND kind = 'input') AS inputs, count_if(NOT deleted AND kind = 'output') AS outputs, count_if(deleted) AS removed FROM {files}",
)
def _(t: Tables):
    live = ~F.col("deleted")
    return t.files.agg(
        F.coalesce(F.sum(F.when(live, F.col("size_bytes"))), F.lit(0)).alias("live_bytes"),
        F.count_if(live).alias("live"),
        F.count_if(live & (F.col("kind") == "input")).alias("inputs"),
        F.count_if(live & (F.col("kind") == "output")).alias("outputs"),
        F.count_if("deleted").alias("removed"),
    )


@query("agg27_active_admins", "SELECT count_if(is_active AND role = 'admin') AS active_admins, count_if(is_active AND role = 'admin') > 1 AS may_disable FROM {users}")
def _(t: Tables):
    n = F.count_if(F.col("is_active") & (F.col("role") == "admin"))
    return t.users.agg(n.alias("active_admins"), (n > 1).alias("may_disable"))


@query("agg30_usage_totals", "SELECT role, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY role")
def _(t: Tables):
    return t.conversations.groupBy("role").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.length("text")).alias("characters"))


# ---- settings ------------------------------------------------------------------------------


