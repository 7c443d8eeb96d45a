"""Regression metrics over action events, rule policy, model responses, snapshots.

The event log is derived from ``events`` by whole-number arithmetic: up to three
samples per event, with guard decisions and roles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import sidecar
from paperloom.plans.registry import query
from paperloom.sources.tables import Tables

DECISIONS = ("applied", "observed", "rejected", "skipped", "unknown", "applied")
ROLES = ("body", "title", "caption", "body", "table")
REASONS = ("same_body_column", "cross_column", "mixed_region_same_line_text_continuation", "multi_line_blocks", "unknown_region")


def _pick(key: str, values) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


#: (event columns, sample columns) as expressions that Spark and DuckDB read alike.
EVENT = [
    ("event_id", "event_id"),
    ("action", "event_type"),
    ("decision", _pick("event_id", DECISIONS)),
    ("rule_kind", "CASE WHEN user_id % 3 = 0 THEN 'text_only' ELSE 'structure' END"),
    ("role", f"CASE WHEN event_id % 4 = 0 THEN NULL ELSE {_pick('user_id', ROLES)} END"),
    ("stated_body", "CASE WHEN event_id % 11 = 0 THEN event_id % 5 ELSE NULL END"),
    ("n_samples", "event_id % 4"),
    ("runs", "user_id % 17"),
]
SAMPLE = [
    ("event_id", "event_id"),
    ("action", "action"),
    ("decision", "decision"),
    ("rule_kind", "rule_kind"),
    ("k", "k"),
    ("guard_decision", "CASE WHEN (event_id + k) % 5 = 0 THEN '' WHEN (event_id + k) % 3 = 0 THEN 'allowed' ELSE 'rejected' END"),
    ("reason", _pick("(event_id + 2 * k)", REASONS)),
    ("left_role", _pick("(event_id + k)", ROLES)),
    ("right_role", f"CASE WHEN k = 2 THEN NULL ELSE {_pick('(event_id + 3 * k)', ROLES)} END"),
]
EVENTS_SQL = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in EVENT) + " FROM events)"
SAMPLES_SQL = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in SAMPLE) + f" FROM (SELECT *, unnest(range(0, n_samples)) AS k FROM {EVENTS_SQL}))"


def log(t: Tables):
    return t.events.selectExpr(*(f"{e} AS {c}" for c, e in EVENT))


def samples(t: Tables):
    rows = log(t).where("n_samples > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_samples") - 1)))
    return rows.selectExpr(*(f"{e} AS {c}" for c, e in SAMPLE))


ROLE_COUNTS_SQL = f"""SELECT event_id, role, CAST(sum(n) AS BIGINT) AS n FROM (
      SELECT event_id, 'body' AS role, stated_body AS n FROM {EVENTS_SQL} WHERE stated_body IS NOT NULL
      UNION ALL SELECT event_id, role, 1 FROM {EVENTS_SQL} WHERE stated_body IS NULL AND role IS NOT NULL
      UNION ALL SELECT s.event_id, s.left_role, 1 FROM {SAMPLES_SQL} s JOIN {EVENTS_SQL} e ON s.event_id = e.event_id WHERE e.stated_body IS NULL
      UNION ALL SELECT s.event_id, s.right_role, 1 FROM {SAMPLES_SQL} s JOIN {EVENTS_SQL} e ON s.event_id = e.event_id WHERE e.stated_body IS NULL AND s.right_role IS NOT NULL) GROUP BY 1, 2"""


def role_counts(t: Tables):
    """Stated counts win; else the event's role and its samples' roles. One pass, no self-join."""
    per_sample = F.transform(
        F.when(F.col("n_samples") > 0, F.sequence(F.lit(0).cast("long"), F.col("n_samples") - 1)).otherwise(F.array().cast("array<bigint>")),
        lambda k: F.array(
            F.element_at(F.array(*map(F.lit, ROLES)), ((F.col("event_id") + k) % len(ROLES) + 1).cast("int")),
            F.when(k != 2, F.element_at(F.array(*map(F.lit, ROLES)), ((F.col("event_id") + 3 * k) % len(ROLES) + 1).cast("int"))),
        ),
    )
    named = F.filter(F.concat(F.array("role"), F.flatten(per_sample)), lambda r: r.isNotNull())
    counted = F.transform(named, lambda r: F.struct(r.alias("role"), F.lit(1).cast("long").alias("n")))
    stated = F.array(F.struct(F.lit("body").alias("role"), F.col("stated_body").alias("n")))
    rows = log(t).select("event_id", "action", "decision", "rule_kind", F.explode(F.when(F.col("stated_body").isNotNull(), stated).otherwise(counted)).alias("c"))
    return rows.groupBy("event_id", "action", "decision", "rule_kind", "c.role").agg(F.sum("c.n").alias("n"))


@query("agg4_actions_by_decision", f"SELECT action, count_if(decision = 'applied') AS applied, count_if(decision = 'observed') AS observed, count_if(decision = 'rejected') AS rejected, count_if(decision = 'skipped') AS skipped, count_if(decision = 'unknown') AS unknown FROM {EVENTS_SQL} GROUP BY action")
def _(t: Tables):
    return log(t).groupBy("action").pivot("decision", ["applied", "observed", "rejected", "skipped", "unknown"]).agg(F.count(F.lit(1))).na.fill(0)


@query("agg5_event_role_counts", ROLE_COUNTS_SQL)
def _(t: Tables):
    return role_counts(t).select("event_id", "role", "n")


@query("agg6_structure_roles", f"SELECT e.action, r.role, CAST(sum(r.n) AS BIGINT) AS n FROM ({ROLE_COUNTS_SQL}) r JOIN {EVENTS_SQL} e ON r.event_id = e.event_id WHERE e.rule_kind = 'structure' GROUP BY 1, 2")
def _(t: Tables):
    return role_counts(t).where("rule_kind = 'structure'").groupBy("action", "role").agg(F.sum("n").alias("n"))


@query("agg8_guard_decisions", f"SELECT reason, count_if(guard_decision = 'allowed') AS allowed, count_if(guard_decision = 'rejected') AS rejected FROM {SAMPLES_SQL} WHERE rule_kind = 'structure' AND guard_decision <> '' GROUP BY reason")
def _(t: Tables):
    return samples(t).where("rule_kind = 'structure' AND guard_decision <> ''").groupBy("reason").pivot("guard_decision", ["allowed", "rejected"]).agg(F.count(F.lit(1))).na.fill(0)


@query("agg9_multiline_counters", f"SELECT count_if(action = 'click' AND decision = 'rejected' AND reason = 'multi_line_blocks') AS rejected_blocks, count_if(action = 'view' AND decision = 'observed' AND reason = 'unknown_region') AS observed_blocks FROM {SAMPLES_SQL}")
def _(t: Tables):
    return samples(t).agg(
        F.count_if(F.expr("action = 'click' AND decision = 'rejected' AND reason = 'multi_line_blocks'")).alias("rejected_blocks"),
        F.count_if(F.expr("action = 'view' AND decision = 'observed' AND reason = 'unknown_region'")).alias("observed_blocks"),
    )


@query("agg10_first_match", f"SELECT action, min_by(runs, event_id) AS runs FROM {EVENTS_SQL} GROUP BY action")
def _(t: Tables):
    return log(t).groupBy("action").agg(F.min_by("runs", "event_id").alias("runs"))


SAFE = "reason = 'mixed_region_same_line_text_continuation'"
BODY_SQL = f"""SELECT decision, CAST(sum(CASE WHEN decision = 'applied' THEN greatest(body - safe, 0) ELSE body END) AS BIGINT) AS hits FROM (
    SELECT r.event_id, e.decision, r.n AS body, coalesce(s.safe, 0) AS safe FROM ({ROLE_COUNTS_SQL}) r JOIN {EVENTS_SQL} e ON r.event_id = e.event_id
    LEFT JOIN (SELECT event_id, count(*) FILTER (WHERE left_role = 'body') + count(*) FILTER (WHERE right_role = 'body') AS safe FROM {SAMPLES_SQL} WHERE {SAFE} GROUP BY 1) s ON s.event_id = r.event_id
    WHERE r.role = 'body' AND e.rule_kind = 'structure') WHERE body > 0 GROUP BY decision"""


@query("agg11_body_hits", BODY_SQL)
def body_hits(t: Tables):
    safe = samples(t).where(SAFE).groupBy("event_id").agg((F.count_if(F.col("left_role") == "body") + F.count_if(F.col("right_role") == "body")).alias("safe"))
    body = role_counts(t).where("role = 'body' AND rule_kind = 'structure' AND n > 0").join(safe, "event_id", "left")
    hits = F.when(F.col("decision") == "applied", F.greatest(F.col("n") - F.coalesce("safe", F.lit(0)), F.lit(0))).otherwise(F.col("n"))
    return body.groupBy("decision").agg(F.sum(hits).alias("hits"))


@query("agg28_nested_overflow", f"SELECT event_id, n_samples AS blocks, count_if(guard_decision = 'rejected') AS overflowing FROM {SAMPLES_SQL} JOIN (SELECT event_id AS e, n_samples FROM {EVENTS_SQL}) ON event_id = e GROUP BY 1, 2")
def _(t: Tables):
    rows = samples(t).groupBy("event_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("guard_decision") == "rejected").alias("overflowing"))
    return rows.select("event_id", "blocks", "overflowing")


@query("agg31_plan_by_kind", f"SELECT rule_kind, count(*) AS planned, list_sort(list(event_id))[1:8]::VARCHAR AS first_ids FROM {EVENTS_SQL} GROUP BY 1")
def _(t: Tables):
    # The eight smallest ids by rank: no group is collected into one cell.
    from pyspark.sql import Window as W

    total = log(t).groupBy("rule_kind").agg(F.count(F.lit(1)).alias("planned"))
    first = log(t).select("rule_kind", "event_id", F.row_number().over(W.partitionBy("rule_kind").orderBy("event_id")).alias("r")).where("r <= 8")
    ids = first.groupBy("rule_kind").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    return total.join(ids, "rule_kind").select("rule_kind", "planned", F.concat(F.lit("["), F.array_join(F.col("ids").cast("array<string>"), ", "), F.lit("]")).alias("first_ids"))


@query("agg32_plan_roles", f"SELECT coalesce(role, 'unknown') AS role, CAST(sum(greatest(n_samples, 1)) AS BIGINT) AS n FROM {EVENTS_SQL} GROUP BY 1")
def _(t: Tables):
    return log(t).groupBy(F.coalesce("role", F.lit("unknown")).alias("role")).agg(F.sum(F.greatest("n_samples", F.lit(1))).alias("n"))


# ---- policy --------------------------------------------------------------------------------


# ---- responses, snapshots, JSON ------------------------------------------------------------


@query("src10_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _(t: Tables):
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k")).where("k IS NOT NULL")


@query("src11_config_dimension", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t: Tables):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("src12_checksum", "SELECT doc_id, sha256(text) AS checksum FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("checksum"))


@query("evt1_event_json", f"SELECT event_id, '{{\"action\":\"' || action || '\",\"decision\":\"' || decision || '\",\"runs\":' || runs || '}}' AS line FROM {EVENTS_SQL}")
def _(t: Tables):
    return log(t).select("event_id", F.to_json(F.struct("action", "decision", "runs")).alias("line"))


@query("evt2_snapshot", "SELECT page, count(*) AS paragraphs, string_agg(part_key, ',' ORDER BY part_key, order_key, line_no) AS part_keys FROM {boxes} GROUP BY page")
def _(t: Tables):
    """Nested pages: an array of paragraphs per page, ordered by value."""
    nested = t.boxes.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("part_key", "order_key", "line_no"))).alias("p"))
    return nested.select("page", F.size("p").cast("long").alias("paragraphs"), F.array_join(F.transform("p", lambda x: x["part_key"].cast("string")), ",").alias("part_keys"))


@query("snk3_sidecar_filter", f"SELECT event_id, role, rule_kind FROM {EVENTS_SQL} WHERE role IS NOT NULL AND (role <> 'body' OR rule_kind <> 'structure')")
def _(t: Tables):
    return log(t).where("role IS NOT NULL AND (role <> 'body' OR rule_kind <> 'structure')").select("event_id", "role", "rule_kind")


@query("met1_rollup", f"SELECT (SELECT count(*) FROM {EVENTS_SQL}) AS events, (SELECT count(*) FROM {SAMPLES_SQL}) AS samples, (SELECT coalesce(sum(hits), 0)::BIGINT FROM ({BODY_SQL})) AS body_hits")
def _(t: Tables):
    one = log(t).agg(F.count(F.lit(1)).alias("events"), F.sum("n_samples").alias("samples"))
    return one.crossJoin(body_hits(t).agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("body_hits")))


@query("txt7_merge_boxes", "SELECT order_key, min(x1) AS x1, max(x2) AS x2, string_agg(part_key, ' ' ORDER BY line_no, part_key, supp_key) AS text FROM {boxes} GROUP BY order_key")
def _(t: Tables):
    words = F.array_sort(F.collect_list(F.struct("line_no", "part_key", "supp_key")))
    return t.boxes.groupBy("order_key").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.array_join(F.transform(words, lambda w: w["part_key"].cast("string")), " ").alias("text"))


@query("fmt9_segment_map", "SELECT doc_id, count(*) AS segments, string_agg('[T]' || line, chr(10) ORDER BY pos) AS translated FROM (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) GROUP BY doc_id")
def _(t: Tables):
    """Split, map each segment, join in order: arrays of one text, so nothing is shuffled."""
    p = F.split("text", "\n")
    return t.documents.select("doc_id", F.size(p).cast("long").alias("segments"), F.array_join(F.transform(p, lambda x: F.concat(F.lit("[T]"), x)), "\n").alias("translated"))


@query("fmt10_format_report", "SELECT a.l_orderkey AS order_key, count(*) AS runs, count_if(a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus) AS equal_format FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem) a JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND b.r = a.r + 1 GROUP BY 1")
def _(t: Tables):
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    pair = t.lineitem.select("l_orderkey", "l_returnflag", "l_linestatus", F.lead(F.struct("l_returnflag", "l_linestatus")).over(w).alias("next"))
    same = (F.col("next.l_returnflag") == F.col("l_returnflag")) & (F.col("next.l_linestatus") == F.col("l_linestatus"))
    return pair.where("next IS NOT NULL").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.count(F.lit(1)).alias("runs"), F.count_if(same).alias("equal_format"))


#: A stored preview of each file: none, broken, of an older version, or a current one with two blocks that need some steps.
_BLOCK = lambda k, font, size, now: f"'{{{{\"font_name\":\"', {font}, '\",\"original\":', CAST({size} AS VARCHAR(9)), '.5,\"current\":', CAST({now} AS VARCHAR(9)), '.5,\"ref\":', CASE WHEN file_id % 4 = {k} THEN 'null' ELSE '7' END, '}}}}'"
FILE_KIND = "CASE WHEN lower(file_name) LIKE '%.pdf' THEN 'pdf' WHEN lower(file_name) LIKE '%.docx' THEN 'docx' WHEN lower(file_name) LIKE '%.xlsx' THEN 'xlsx' WHEN lower(file_name) LIKE '%.pptx' THEN 'pptx' ELSE 'other' END"
PREVIEW = f"""CASE file_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '{{{{broken' ELSE CONCAT('{{{{\"schema_version\":', CASE WHEN file_id % 9 = 2 THEN '9' ELSE '10' END, ',\"document_kind\":\"', CASE WHEN file_id % 9 = 3 THEN 'pdf' ELSE kind_ END,
    '\",\"granularity\":\"', CASE WHEN file_id % 2 = 0 THEN 'line' ELSE 'block' END, '\",\"created_at\":\"day ', CAST(file_id % 28 AS VARCHAR(9)), '\",\"blocks\":[', {_BLOCK(0, "CASE WHEN file_id % 5 = 0 THEN '' ELSE 'F1' END", "9 + file_id % 3", "10 + file_id % 2")}, ',', {_BLOCK(1, "'F1'", "9 + file_id % 4", "12")}, ']}}}}') END""".replace("{{", "{").replace("}}", "}")
_STRUCT = "{'font_name': x.font_name, 'original': x.original, 'current': x.current, 'ref': x.ref}"
FMT8_SQL = (
    f"WITH k AS (SELECT *, {FILE_KIND} AS kind_ FROM {{files}}), p AS (SELECT file_id, kind_, size_bytes, {PREVIEW} AS payload FROM k),\n"
    + """    v AS (SELECT *, json_valid(payload) AS ok, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.created_at') END AS made, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.granularity') END AS g,
          CASE WHEN json_valid(payload) THEN from_json(json_extract(payload, '$.blocks'), '[{"font_name":"VARCHAR","original":"DOUBLE","current":"DOUBLE","ref":"INTEGER"}]') END AS b,
          CASE WHEN json_valid(payload) THEN CAST(json_extract_string(payload, '$.schema_version') AS INTEGER) = 10 AND json_extract_string(payload, '$.document_kind') = kind_ ELSE FALSE END AS current FROM p),
    m AS (SELECT *, coalesce(current, FALSE) AND kind_ = 'pdf' AND g <> 'block' AS migrate FROM v),
    m2 AS (SELECT *, CASE WHEN NOT coalesce(current, FALSE) THEN [{'font_name': 'F0', 'original': 10.0, 'current': 10.0, 'ref': 0}] WHEN migrate AND b[1].font_name = b[2].font_name AND b[1].original = b[2].original
          THEN [{'font_name': b[1].font_name, 'original': b[1].original, 'current': greatest(b[1].current, b[2].current), 'ref': b[1].ref}] ELSE b END AS b2 FROM m),
    c AS (SELECT *, coalesce(current, FALSE) AND kind_ = 'pdf' AND len(list_filter(b2, lambda x: x.original > x.current)) > 0 AS clean, coalesce(current, FALSE) AND kind_ = 'pdf' AND len(list_filter(b2, lambda x: x.font_name = '')) > 0 AS do_fonts,
          coalesce(current, FALSE) AND kind_ IN ('docx', 'xlsx', 'pptx') AND len(list_filter(b2, lambda x: x.ref IS NULL)) > 0 AS refs FROM m2)
    SELECT file_id, concat_ws(',', CASE WHEN NOT coalesce(current, FALSE) THEN 'rebuild' END, CASE WHEN migrate THEN 'migrate' END, CASE WHEN clean THEN 'clean' END, CASE WHEN do_fonts THEN 'fonts' END, CASE WHEN refs THEN 'refs' END) AS steps,
           coalesce(made, 'today') AS created_at, len(b2) AS blocks, list_sum(list_transform(b2, lambda x: CASE WHEN clean THEN greatest(x.original, x.current) ELSE x.current END)) AS current_size,
           array_to_string(list_transform(b2, lambda x: CASE WHEN NOT do_fonts OR x.font_name <> '' THEN x.font_name WHEN len(list_filter(b2, lambda y: y.font_name <> '')) > 0 THEN 'F1' ELSE 'default' END), ',') AS fonts,
           coalesce(array_to_string(list_transform(range(1, len(b2) + 1), lambda i: CAST(CASE WHEN refs THEN coalesce(b2[i].ref, i - 1) ELSE b2[i].ref END AS VARCHAR)), ','), '') AS refs FROM c"""
)


@query("fmt8_schema_dispatch", FMT8_SQL)
def _(t: Tables):
    """Each file's preview after loading: what was done to it, and its blocks in today's schema."""
    files = t.files.withColumn("kind_", F.expr(FILE_KIND)).select("file_id", "kind_", F.expr(PREVIEW).alias("payload"))
    built = F.array(F.struct(F.lit("F0").alias("font_name"), F.lit(10.0).alias("original"), F.lit(10.0).alias("current"), F.lit(0).alias("ref")))
    out = sidecar.loaded(files, "payload", F.col("kind_"), built, F.lit("today"))
    text = lambda name: F.array_join(F.transform("blocks", lambda b: b[name].cast("string")), ",")
    total = F.aggregate("blocks", F.lit(0.0), lambda a, b: a + b["current"])
    return out.select("file_id", F.array_join("steps", ",").alias("steps"), "created_at", F.size("blocks").cast("long").alias("blocks"), total.alias("current_size"), text("font_name").alias("fonts"), text("ref").alias("refs"))
