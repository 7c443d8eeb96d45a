"""Rules of strings, settings, responses and policies over whole tables.

The tables have no columns for some of these rules. ``Rows`` derives them by plain SQL
expressions that Spark and DuckDB read alike, so that both sides start from the same
rows while each states the rule in its own way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions import geometry as geo
from paperloom.functions import labels
from paperloom.operators import dedup, folds
from paperloom.operators import relational as rel
from paperloom.plans.merging import RECORDS_SQL, records
from paperloom.plans.registry import query, values_sql
from paperloom.plans.relational import ALIAS_ROWS, ALIASES
from paperloom.plans.text import FONT_NAMES, LINES
from paperloom.sources.fragments import AXIS_TEXT
from paperloom.sources.tables import NAMES, Tables, dealt


class Rows:
    """Columns derived from a table, or from the lines of ``documents``."""

    def __init__(self, base: str, columns: dict[str, str], where: str = "TRUE"):
        self.base, self.columns, self.where = base, columns, where
        source = LINES if base == "lines" else base if base in NAMES else f"{{{base}}}"
        self.sql = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source} WHERE {where})"

    def df(self, t: Tables) -> DataFrame:
        base = dedup.numbered_lines(t.documents, "doc_id", "text") if self.base == "lines" else getattr(t, self.base)
        return base.where(self.where).selectExpr(*(f"{e} AS {c}" for c, e in self.columns.items()))


def _text(number: str) -> str:
    return f"CAST({number} AS VARCHAR(19))"


# ---- values of settings and requests -------------------------------------------------------

SECRETS = Rows("documents", {"doc_id": "doc_id", "secret": "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN substr(text, 1, 3) WHEN 2 THEN NULL ELSE substr(text, 1, 12) END"})


@query("prj2_mask_secret", f"SELECT doc_id, CASE WHEN coalesce(secret, '') = '' THEN '' WHEN length(secret) <= 4 THEN '****' ELSE '****' || right(secret, 4) END AS masked FROM {SECRETS.sql}")
def _(t: Tables):
    return SECRETS.df(t).select("doc_id", labels.mask_secret(F.col("secret")).alias("masked"))


USAGE = Rows(
    "events",
    {
        "event_id": "event_id",
        "j": f"""CASE event_id % 4 WHEN 0 THEN CONCAT('{{"prompt_tokens": ', {_text("user_id")}, ', "completion_tokens": 7}}') WHEN 1 THEN CONCAT('{{"input_tokens": 3, "output_tokens": ', {_text("user_id")}, ', "total_tokens": ', {_text("event_id")}, '}}')
            WHEN 2 THEN props ELSE NULL END""",
    },
)


@query(
    "prj12_token_usage",
    """WITH u AS (SELECT event_id, coalesce(CAST(json_extract_string(j, '$.input_tokens') AS BIGINT), CAST(json_extract_string(j, '$.prompt_tokens') AS BIGINT), 0) AS input_tokens,
              coalesce(CAST(json_extract_string(j, '$.output_tokens') AS BIGINT), CAST(json_extract_string(j, '$.completion_tokens') AS BIGINT), 0) AS output_tokens, CAST(json_extract_string(j, '$.total_tokens') AS BIGINT) AS stated FROM """
    + USAGE.sql
    + ") SELECT event_id, input_tokens, output_tokens, coalesce(stated, input_tokens + output_tokens) AS total_tokens FROM u",
)
def _(t: Tables):
    j = F.col("j")
    out = USAGE.df(t).select(
        "event_id",
        F.coalesce(labels.json_number(j, "$.input_tokens", "$.prompt_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(labels.json_number(j, "$.output_tokens", "$.completion_tokens"), F.lit(0)).alias("output_tokens"),
        labels.json_number(j, "$.total_tokens").alias("stated"),
    )
    return out.select("event_id", "input_tokens", "output_tokens", F.coalesce("stated", F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))


LANGUAGES = Rows("documents", {"doc_id": "doc_id", "src": "CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN upper(lang) WHEN 2 THEN 'auto' ELSE CONCAT(' ', lang) END", "dst": "CASE doc_id % 3 WHEN 0 THEN 'English' WHEN 1 THEN 'fr-fr ' ELSE NULL END"})
_CODE = lambda c: f"coalesce((SELECT code FROM {values_sql(ALIAS_ROWS, 'alias, code')} WHERE alias = lower(trim(coalesce({c}, '')))), lower(trim(coalesce({c}, ''))))"


@query("flt10_same_language", f"SELECT doc_id, s = d AND s NOT IN ('', 'auto') AS same FROM (SELECT doc_id, {_CODE('src')} AS s, {_CODE('dst')} AS d FROM {LANGUAGES.sql})")
def _(t: Tables):
    s, d = (labels.language_code(F.col(c), ALIASES) for c in ("src", "dst"))
    return LANGUAGES.df(t).select("doc_id", ((s == d) & ~s.isin("", "auto")).alias("same"))


ENDPOINTS = Rows(
    "pages",
    {
        "page_id": "page_id",
        "url": f"CASE page_id % 6 WHEN 0 THEN CONCAT('https://10.', {_text('page_id % 250')}, '.2.3/x') WHEN 1 THEN CONCAT('https://172.', {_text('page_id % 40')}, '.0.1/') WHEN 2 THEN replace(url, '.example.com', '.internal') WHEN 3 THEN NULL WHEN 4 THEN CONCAT('https://localhost/', {_text('page_id')}) ELSE url END",
    },
)
PRIVATE = r"^(10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"


@query(
    "flt11_endpoint_allowed",
    f"""SELECT page_id, coalesce(url, '') LIKE 'https://%' AND host <> '' AND NOT regexp_matches(host, '{PRIVATE}') AND host <> 'localhost' AND NOT regexp_matches(host, '\\.(local|localhost|internal)$') AS allowed
        FROM (SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '^[a-z]+://([^/:?#]*)', 1)) AS host FROM {ENDPOINTS.sql})""",
)
def _(t: Tables):
    """Public https endpoints only: private, loopback and local hosts are refused; null is refused."""
    url = F.col("url")
    host = F.lower(F.coalesce(F.parse_url(url, F.lit("HOST")), F.lit("")))
    private = host.rlike(PRIVATE) | (host == "localhost") | host.rlike(r"\.(local|localhost|internal)$")
    return ENDPOINTS.df(t).select("page_id", ((F.coalesce(F.parse_url(url, F.lit("PROTOCOL")), F.lit("")) == "https") & (host != "") & ~private).alias("allowed"))


SLIDES = Rows("documents", {"doc_id": "doc_id", "deck": "source", "part": f"CONCAT('ppt/', CASE WHEN doc_id % 3 = 0 THEN 'notesSlides/notesSlide' ELSE 'slides/slide' END, {_text('n_chars % 200 + 1')}, '.xml')"})


@query("ord6_natural_part_order", f"SELECT doc_id, part, row_number() OVER (PARTITION BY deck ORDER BY contains(part, 'notesSlides'), CAST(regexp_extract(part, '([0-9]+)\\.xml$', 1) AS INT), doc_id) AS place FROM {SLIDES.sql}")
def _(t: Tables):
    """Slides before notes, each by their numbers, within a deck."""
    order = W.partitionBy("deck").orderBy(F.contains(F.col("part"), F.lit("notesSlides")), F.regexp_extract("part", r"([0-9]+)\.xml$", 1).cast("int"), "doc_id")
    return SLIDES.df(t).select("doc_id", "part", F.row_number().over(order).cast("long").alias("place"))


# ---- settings as rows: each user has some --------------------------------------------------

#: Which keys a user has stored and wants, with their values; and the defaults (fixed values).
STORED = {"timeout": f"CASE WHEN c_custkey % 4 > 0 THEN {_text('60 + c_custkey % 90')} END", "concurrency": f"CASE WHEN c_custkey % 5 > 0 THEN {_text('1 + c_custkey % 16')} END", "ocr": "CASE c_custkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'Off' END", "model": "lower(c_mktsegment)"}
WANTED = {"timeout": f"CASE WHEN c_custkey % 3 > 0 THEN {_text('60 + c_nationkey * 3')} END", "ocr": "CASE WHEN c_custkey % 2 = 0 THEN 'true' END", "model": "CASE WHEN c_custkey % 7 > 0 THEN 'building' END", "other": "'1'"}
DEFAULTS = [("timeout", "120"), ("concurrency", "10"), ("ocr", "false"), ("model", "base"), ("retention", "7")]


def _pairs_sql(columns: dict[str, str]) -> str:
    """One row for each user and key; in ``STORED`` those with a value, in ``WANTED`` all."""
    some = " WHERE value IS NOT NULL" if columns is STORED else ""
    return f"(SELECT * FROM (SELECT c_custkey AS user_id, unnest([{', '.join(repr(k) for k in columns)}]) AS key, unnest([{', '.join(columns.values())}]) AS value FROM customer){some})"


def _pairs(t: Tables, columns: dict[str, str]) -> DataFrame:
    each = ", ".join(f"'{k}', {e}" for k, e in columns.items())
    out = t.customer.selectExpr("c_custkey AS user_id", f"stack({len(columns)}, {each}) AS (key, value)")
    return out.where("value IS NOT NULL") if columns is STORED else out


@query(
    "eav1_typed_settings",
    f"""SELECT user_id, CAST(max(CASE WHEN key = 'timeout' THEN value END) AS INT) AS timeout, CAST(max(CASE WHEN key = 'concurrency' THEN value END) AS INT) AS concurrency,
        lower(max(CASE WHEN key = 'ocr' THEN value END)) IN ('1', 'true', 'yes', 'on') AS ocr, coalesce(CAST(max(CASE WHEN key = 'retention' THEN value END) AS INT), 7) AS retention FROM {_pairs_sql(STORED)} GROUP BY user_id""",
)
def _(t: Tables):
    wide = _pairs(t, STORED).groupBy("user_id").pivot("key", ["timeout", "concurrency", "ocr", "retention"]).agg(F.first("value"))
    return wide.select("user_id", F.col("timeout").cast("int"), F.col("concurrency").cast("int"), F.lower("ocr").isin("1", "true", "yes", "on").alias("ocr"), F.coalesce(F.col("retention").cast("int"), F.lit(7)).alias("retention"))


@query("eav2_seed_missing", f"SELECT c_custkey AS user_id, d.key, d.value FROM customer, {values_sql(DEFAULTS, 'key, value').replace(' AS v(', ' AS d(')} WHERE NOT EXISTS (SELECT 1 FROM {_pairs_sql(STORED)} s WHERE s.user_id = c_custkey AND s.key = d.key)")
def _(t: Tables):
    """Defaults of the keys that a user has no row for: all keys, less those stored."""
    every = t.customer.select(F.col("c_custkey").alias("user_id"), F.explode(F.create_map(*(F.lit(x) for pair in DEFAULTS for x in pair))).alias("key", "value"))
    return every.join(_pairs(t, STORED).select("user_id", "key"), ["user_id", "key"], "left_anti")


@query("eav3_changed_settings", f"SELECT s.user_id, s.key, s.value, w.value AS new_value FROM {_pairs_sql(STORED)} s JOIN {_pairs_sql(WANTED)} w ON s.user_id = w.user_id AND s.key = w.key WHERE w.value IS NOT NULL AND w.value <> s.value")
def _(t: Tables):
    return rel.upsert_changed(_pairs(t, STORED), _pairs(t, WANTED), ["user_id", "key"])


@query(
    "eav4_override",
    f"""SELECT user_id, least(CAST(value AS INT), 100) AS timeout FROM (SELECT coalesce(w.user_id, s.user_id) AS user_id, coalesce(w.key, s.key) AS key, coalesce(w.value, s.value) AS value
        FROM {_pairs_sql(STORED)} s FULL OUTER JOIN {_pairs_sql(WANTED)} w ON s.user_id = w.user_id AND s.key = w.key) WHERE key = 'timeout'""",
)
def _(t: Tables):
    merged = rel.merge_settings(_pairs(t, STORED), _pairs(t, WANTED), ["user_id", "key"])
    return merged.where("key = 'timeout'").select("user_id", F.least(F.col("value").cast("int"), F.lit(100)).alias("timeout"))


# ---- gates, policies, answers of a model ---------------------------------------------------

HALF = "TIMESTAMP '2024-01-16 00:00:00'"
GATES = Rows("events", {"sample": "event_type", "gate": f"CONCAT('gate', {_text('user_id % 20')})", "base": f"CASE WHEN ts < {HALF} THEN 1 END", "cur": f"CASE WHEN ts >= {HALF} AND user_id % 20 <> 7 THEN 1 END"})


@query(
    "agg14_jon22_gate",
    f"""WITH b AS (SELECT sample, gate, sum(base)::BIGINT AS base FROM {GATES.sql} WHERE base IS NOT NULL GROUP BY ALL), c AS (SELECT sample, gate, sum(cur)::BIGINT AS cur FROM {GATES.sql} WHERE cur IS NOT NULL GROUP BY ALL),
        j AS (SELECT coalesce(b.sample, c.sample) AS sample, coalesce(b.gate, c.gate) AS gate, coalesce(cur, 0) - coalesce(base, 0) AS delta FROM b FULL JOIN c ON b.sample = c.sample AND b.gate = c.gate)
        SELECT sample, gate, delta, delta > 0 AS regressed, bool_or(delta > 0) OVER (PARTITION BY sample) AS failed FROM j""",
)
def _(t: Tables):
    """Counters of the first half of the log are the baseline, those of the second the run; a gate may be in one only."""
    v = GATES.df(t)
    side = lambda c: v.where(F.col(c).isNotNull()).groupBy("sample", "gate").agg(F.sum(c).alias(c))
    both = side("base").join(side("cur"), ["sample", "gate"], "full_outer").withColumn("delta", (F.coalesce("cur", F.lit(0)) - F.coalesce("base", F.lit(0))).cast("long"))
    failed = both.groupBy("sample").agg(F.bool_or(F.col("delta") > 0).alias("failed"))
    return both.join(failed, "sample").select("sample", "gate", "delta", (F.col("delta") > 0).alias("regressed"), "failed")


#: Kinds of rules and their modes where nothing is set (fixed values).
KIND_DEFAULT = {"text_only": "apply", "style_only": "apply", "structure": "observe", "render": "apply"}
RULE_DEFAULT = {"merge_same_line_fragment_bridge": "apply", "split_wrapped_same_line_tail": "apply", "remove_subsumed": "apply", "collapse_overlap": "apply"}
_RULE = "CASE event_id % 6 WHEN 0 THEN 'skip_translation' WHEN 1 THEN 'merge_same_line' WHEN 2 THEN 'remove_subsumed' WHEN 3 THEN 'collapse_overlap' WHEN 4 THEN 'render_axis_label' ELSE 'normalize_body_font_sizes' END"
POLICIES = Rows("events", {"event_id": "event_id", "rule": _RULE, "kind": "CASE event_id % 6 WHEN 0 THEN 'text_only' WHEN 4 THEN 'render' WHEN 5 THEN 'style_only' ELSE 'structure' END", "env": "CASE user_id % 6 WHEN 0 THEN 'Off' WHEN 1 THEN NULL WHEN 2 THEN 'bogus' WHEN 3 THEN ' APPLY ' WHEN 4 THEN '' ELSE 'observe' END"})


@query(
    "pol1_rule_modes",
    f"""SELECT rule, mode, count(*) AS n FROM (SELECT rule, CASE WHEN lower(trim(env)) IN ('apply', 'observe', 'off') THEN lower(trim(env)) WHEN rule IN ('merge_same_line_fragment_bridge', 'split_wrapped_same_line_tail', 'remove_subsumed', 'collapse_overlap') THEN 'apply'
        WHEN kind = 'structure' THEN 'observe' ELSE 'apply' END AS mode FROM {POLICIES.sql}) GROUP BY ALL""",
)
def _(t: Tables):
    """The mode each logged rule ran in: what is set, else the rule's default, else its kind's."""
    table = lambda d: F.create_map(*(F.lit(x) for p in d.items() for x in p))
    env = F.lower(F.trim("env"))
    mode = F.coalesce(F.when(env.isin("apply", "observe", "off"), env), F.element_at(table(RULE_DEFAULT), F.col("rule")), F.element_at(table(KIND_DEFAULT), F.col("kind")))
    return POLICIES.df(t).groupBy("rule", mode.alias("mode")).agg(F.count(F.lit(1)).alias("n"))


def completion(kind: Column, body: str) -> Column:
    """The text of an answer in one of three shapes; null for what can't be read."""
    parts = F.from_json(F.get_json_object(body, "$.content"), "array<struct<type:string,text:string>>")
    text = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "")
    return F.when(kind == "chat", F.get_json_object(body, "$.choices[0].message.content")).when(kind == "messages", text).otherwise(F.get_json_object(body, "$.output[0].content[0].text"))


def answers(t: Tables) -> DataFrame:
    """Turns of conversations as answers of a model, in three shapes by the turn; every eleventh conversation's can't be read."""
    kind = F.when(F.col("turn") % 3 == 0, "chat").when(F.col("turn") % 3 == 1, "messages").otherwise("responses")
    text = F.col("text")
    chat = F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices"))
    parts = F.struct(F.array(*(F.struct(F.lit(k).alias("type"), x.alias("text")) for k, x in (("text", text), ("tool", F.lit("x")), ("text", F.lit("!"))))).alias("content"))
    response = F.struct(F.array(F.struct(F.array(F.struct(text.alias("text"))).alias("content"))).alias("output"))
    body = F.when(F.col("conv_id") % 11 == 0, "not json").when(kind == "chat", F.to_json(chat)).when(kind == "messages", F.to_json(parts)).otherwise(F.to_json(response))
    return t.conversations.select("conv_id", "turn", kind.alias("kind"), body.alias("body"))


@query("mdl1_completions", "SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN CASE WHEN turn % 3 = 1 THEN NULL END ELSE text || CASE WHEN turn % 3 = 1 THEN '!' ELSE '' END END AS text FROM conversations")
def _(t: Tables):
    return answers(t).select("conv_id", "turn", completion(F.col("kind"), "body").alias("text"))


# ---- geometry ------------------------------------------------------------------------------

DIRECTIONS = Rows("boxes", {"order_key": "order_key", "line_no": "line_no", "part_key": "part_key", "supp_key": "supp_key", "dx": "CAST(part_key % 21 - 10 AS DOUBLE) / 10", "dy": "CAST(supp_key % 21 - 10 AS DOUBLE) / 10"})


@query("geo10_rotation", f"SELECT *, CASE WHEN abs(dx) <= 0.2 AND dy < -0.8 THEN 90 WHEN abs(dx) <= 0.2 AND dy > 0.8 THEN 270 END AS rotation FROM {DIRECTIONS.sql}")
def _(t: Tables):
    return DIRECTIONS.df(t).withColumn("rotation", geo.rotation(F.col("dx"), F.col("dy")))


SPANS = Rows("lineitem", {"sheet": "l_orderkey", "part_key": "l_partkey", "r0": "CAST(l_linenumber AS BIGINT)", "r1": "CAST(l_linenumber + l_partkey % 3 AS BIGINT)", "c0": "CAST(l_suppkey % 5 AS BIGINT)", "c1": "CAST(l_suppkey % 5 + l_partkey % 2 AS BIGINT)"})


@query(
    "geo18_merged_cells",
    f"SELECT sheet, part_key, r AS row_no, unnest(range(c0, c1 + 1)) AS column_no, r0 AS anchor_row, c0 AS anchor_column FROM (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM {SPANS.sql})",
)
def _(t: Tables):
    """The cells of every merged range, each with the range's anchor."""
    rows = SPANS.df(t).select("*", F.explode(F.sequence("r0", "r1")).alias("row_no"))
    return rows.select("sheet", "part_key", "row_no", F.explode(F.sequence("c0", "c1")).alias("column_no"), F.col("r0").alias("anchor_row"), F.col("c0").alias("anchor_column"))


_WHY = "CASE WHEN regexp_like(text, '^[0-9(]') THEN 'inline_numbered_markers' WHEN label <> 'plain text' THEN 'fallback_line_visual_split' WHEN length(text) >= 16 THEN 'multiline_body_block' ELSE 'other' END"
TECHNICAL = "[A-Z]{2}|[0-9=/%]"


@query(
    "grd2_split_guard",
    f"""WITH r AS ({RECORDS_SQL}), s AS (SELECT *, {_WHY.replace("regexp_like", "regexp_matches")} AS asked, regexp_matches(text, '{TECHNICAL}') AS technical FROM r)
        SELECT asked, region, CASE WHEN asked = 'multiline_body_block' THEN 'multiline_body_block' WHEN asked = 'fallback_line_visual_split' AND technical THEN 'fallback_line_technical_label'
         WHEN region IS NULL OR region = 'unknown' THEN 'unknown_region' WHEN asked = 'inline_numbered_markers' AND region = 'body_column' THEN 'numbered_marker_same_region' ELSE 'ordinary_body_split' END AS why, count(*) AS n FROM s GROUP BY ALL""",
)
def _(t: Tables):
    """What the guard says to splitting each fragment of the documents' pages."""
    r = records(t).withColumns({"asked": F.expr(_WHY), "technical": F.col("text").rlike(TECHNICAL)})
    why = geo.split_guard(F.col("region"), F.col("asked"), F.lit(True), F.col("technical"))["reason"]
    return r.groupBy("asked", "region", why.alias("why")).agg(F.count(F.lit(1)).alias("n"))


# ---- strings -------------------------------------------------------------------------------

HALVES = Rows("documents", {"doc_id": "doc_id", "a": "substr(text, 1, 12)", "b": "CASE doc_id % 4 WHEN 0 THEN substr(text, 8, 12) WHEN 1 THEN substr(text, 12, 12) WHEN 2 THEN substr(text, 30, 12) ELSE substr(text, 1, 12) END"}, "text IS NOT NULL")


@query("dup7_overlap_merge", f"SELECT doc_id, CASE WHEN n >= 2 THEN a || substr(b, n + 1) ELSE a || b END AS merged FROM (SELECT doc_id, a, b, list_max(list_filter(range(0, 13), lambda k: k <= length(a) AND k <= length(b) AND right(a, k) = left(b, k))) AS n FROM {HALVES.sql})")
def _(t: Tables):
    a, b = F.col("a"), F.col("b")
    fits = F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda k: F.right(a, k) == F.left(b, k))
    n = F.coalesce(F.array_max(fits), F.lit(0))
    return HALVES.df(t).select("doc_id", F.when(n >= 2, F.concat(a, b.substr(n + 1, F.length(b)))).otherwise(F.concat(a, b)).alias("merged"))


#: Characters that texts are made odd with: full-width letters, zero-width and no-break blanks, a glyph block, a product without blanks.
ODD = "replace(replace(replace(text, 'th', 'T​H'), ', ', ' Ａ■ 3x4 '), 'es', 'e■s')"


@query("str1_canonical")
def _(t: Tables):
    return dealt(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", F.sha2(folds.canonical(F.expr(ODD)), 256).alias("canonical_sha256"))


@query("str2_sanitize")
def _(t: Tables):
    return dealt(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", F.sha2(folds.sanitized(F.expr(ODD)), 256).alias("clean_sha256"))


PADDED = Rows("lines", {"doc_id": "doc_id", "pos": "CAST(pos AS BIGINT)", "s": "CONCAT(CASE pos % 4 WHEN 0 THEN '  ' WHEN 1 THEN chr(9) ELSE '' END, CASE WHEN pos % 7 = 6 THEN '' ELSE substr(line, 1, 9) END, CASE pos % 3 WHEN 0 THEN chr(10) ELSE ' ' END)"})


@query("str3_keep_blanks", rf"SELECT doc_id, pos, CASE WHEN trim(s, ' ' || chr(9) || chr(10)) = '' THEN s ELSE regexp_extract(s, '^[ \t\n]*') || 'NEW' || regexp_extract(s, '[ \t\n]*$') END AS replaced FROM {PADDED.sql}")
def _(t: Tables):
    s = F.col("s")
    return PADDED.df(t).select("doc_id", "pos", F.when(F.regexp_replace(s, "\\s+", "") == "", s).otherwise(F.concat(F.regexp_extract(s, "^(\\s*)", 1), F.lit("NEW"), F.regexp_extract(s, "(\\s*)$", 1))).alias("replaced"))


TOC = Rows("lines", {"doc_id": "doc_id", "pos": "CAST(pos AS BIGINT)", "s": f"CASE pos % 4 WHEN 0 THEN CONCAT(substr(line, 1, 24), ' ..... ', {_text('pos + 1')}) WHEN 1 THEN CONCAT(substr(line, 1, 24), '. . . . xi') WHEN 2 THEN CONCAT(substr(line, 1, 24), ' ', {_text('pos')}) ELSE substr(line, 1, 24) END"})
TOC_RE = r"^(.*?[^ .\t])([ \t]*(?:\.[ \t]*){3,})([0-9]+|[ivxlc]+)$"


@query("str8_toc_split", f"SELECT doc_id, pos, nullif(regexp_extract(s, '{TOC_RE}', 1), '') AS title, nullif(regexp_extract(s, '{TOC_RE}', 2), '') AS leader, nullif(regexp_extract(s, '{TOC_RE}', 3), '') AS page FROM {TOC.sql}")
def _(t: Tables):
    part = lambda k: F.nullif(F.regexp_extract("s", TOC_RE, k), F.lit(""))
    return TOC.df(t).select("doc_id", "pos", part(1).alias("title"), part(2).alias("leader"), part(3).alias("page"))


#: Names that ran together: a document's first words without blanks, some behind an abbreviation.
CAMEL = "CONCAT(CASE doc_id % 3 WHEN 0 THEN 'ADC' WHEN 1 THEN 'I2C' ELSE 'x' END, replace(initcap(substr(replace(text, chr(10), ' '), 1, 40)), ' ', ''))"


@query("str9_camel_split")
def _(t: Tables):
    s = F.expr(CAMEL)
    return t.documents.select("doc_id", s.alias("s"), F.regexp_replace(F.regexp_replace(s, "(?<=[a-z0-9])(?=[A-Z])", " "), "(?<=[A-Z0-9])(?=[A-Z][a-z])", " ").alias("spaced"))


@query("str10_compose_toc", "SELECT p_partkey, p_name || repeat('.', greatest(p_partkey % 40 - length(p_name), 4)) || ' ' || p_size AS entry FROM part")
def _(t: Tables):
    dots = F.greatest(F.col("p_partkey") % 40 - F.length("p_name"), F.lit(4)).cast("int")
    return t.part.select("p_partkey", F.concat("p_name", F.repeat(F.lit("."), dots), F.lit(" "), F.col("p_size").cast("string")).alias("entry"))


@query("str11_display_width")
def _(t: Tables):
    return t.documents.select("doc_id", folds.display_width(F.regexp_replace("text", "(?i)the", "电压")).alias("width"))


#: Lists in one line, made of a document's first words.
LIST = "CASE doc_id % 4 WHEN 0 THEN CONCAT('Steps: 1. ', substr(text, 1, 9), ' 2. ', substr(text, 10, 9), ' 10) x') WHEN 1 THEN CONCAT('(1) ', substr(text, 1, 9), ' (2) b') WHEN 2 THEN CONCAT('1. ', substr(text, 1, 9)) ELSE substr(text, 1, 30) END"
BREAK = r"(?<=\S)[ \t]+(?=(?:\d{1,2}[.)]|\(\d{1,2}\))\s)"


@query("str12_marker_breaks")
def _(t: Tables):
    s = F.expr(LIST)
    return t.documents.select("doc_id", s.alias("s"), labels.numbered_marker_count(s).alias("markers"), F.regexp_replace(s, BREAK, "\n").alias("broken"))


@query("rw9_split_numbered")
def _(t: Tables):
    """A line with two list markers or more is cut before each."""
    v = t.documents.select("doc_id", F.expr(LIST).alias("s")).where("s IS NOT NULL").withColumn("markers", labels.numbered_marker_count(F.col("s")))
    return v.select("doc_id", F.posexplode(F.when(F.col("markers") >= 2, F.split("s", BREAK)).otherwise(F.array("s"))).alias("part", "line"))


@query("str13_font_tokens")
def _(t: Tables):
    got = t.part.select("p_partkey", F.expr(FONT_NAMES).alias("name")).withColumn("tokens", labels.font_tokens(F.col("name")))
    has = lambda *w: F.arrays_overlap("tokens", F.array(*map(F.lit, w)))
    return got.select("p_partkey", "name", F.array_join("tokens", " ").alias("tokens"), has("bold", "black", "heavy").alias("bold"), has("italic", "oblique").alias("italic"), has("courier", "mono", "consolas").alias("mono"), has("times", "serif", "georgia").alias("serif"))


#: Fonts at hand (fixed values); wanted are those that parts name.
FONTS = ("arial bold", "courier new", "times roman italic", "noto sans", "noto sans mono", "georgia bold", "source han serif")
WANTED_FONT = "CASE p_partkey % 6 WHEN 0 THEN 'arial narrow bold' WHEN 1 THEN 'courier new oblique' WHEN 2 THEN 'times roman' WHEN 3 THEN 'noto sans mono' WHEN 4 THEN p_name ELSE 'source han serif heavy' END"


@query(
    "jon19_font_match",
    f"""SELECT p_partkey, max_by(have, (score, have)) AS match FROM (SELECT p_partkey, have, len(list_intersect(string_split(w, ' '), string_split(have, ' '))) * 10 AS score FROM (SELECT p_partkey, {WANTED_FONT} AS w FROM part), (SELECT unnest({list(FONTS)!r}) AS have))
        WHERE score >= 20 GROUP BY p_partkey""",
)
def _(t: Tables):
    """The font at hand that shares most words with the wanted one, two at least; the fonts are few, so they go along with each row."""
    wanted = t.part.select("p_partkey", F.split(F.expr(WANTED_FONT), " ").alias("w"))
    best = F.array_max(F.array(*(F.struct((F.size(F.array_intersect("w", F.array(*map(F.lit, x.split())))) * 10).alias("score"), F.lit(x).alias("have")) for x in FONTS)))
    return wanted.select("p_partkey", best.alias("b")).where("b.score >= 20").select("p_partkey", F.col("b.have").alias("match"))


SCRIPTS = Rows("documents", {"doc_id": "doc_id", "s": "CONCAT(substr(text, 1, 9), CASE doc_id % 6 WHEN 0 THEN '한' WHEN 1 THEN 'か漢' WHEN 2 THEN '漢' WHEN 3 THEN 'Р' ELSE '' END)"})


@query("str14_script_font", f"SELECT doc_id, CASE WHEN regexp_matches(s, '[\\x{{ac00}}-\\x{{d7af}}]') THEN 'korea' WHEN regexp_matches(s, '[\\x{{3040}}-\\x{{30ff}}]') THEN 'japan' WHEN regexp_matches(s, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'china' WHEN regexp_matches(s, '[\\x{{0400}}-\\x{{04ff}}]') THEN 'cyrillic' ELSE 'latin' END AS family FROM {SCRIPTS.sql}")
def _(t: Tables):
    return SCRIPTS.df(t).select("doc_id", labels.script_of(F.col("s")).alias("family"))


THAI = "replace(replace(text, ' the ', ' กข คง '), ' de ', ' ก ค ')"


@query("str15_thai_wrap")
def _(t: Tables):
    """Texts without Thai pass; between Thai words a break may follow the blank. Words are those that blanks part: there is no dictionary."""
    s = F.expr(THAI)
    wrapped = F.when(s.rlike("[\\u0e00-\\u0e7f]"), F.regexp_replace(s, "(?<=[\\u0e00-\\u0e7f]) (?=[\\u0e00-\\u0e7f])", " ​")).otherwise(s)
    return t.documents.select("doc_id", F.sha2(wrapped, 256).alias("wrapped_sha256"), F.regexp_count(wrapped, F.lit("​")).alias("breaks"))


PROGRESS = Rows("events", {"event_id": "event_id", "line": f"CASE event_id % 5 WHEN 0 THEN CONCAT(chr(27), '[32m', event_type, '   part ', {_text('user_id')}, '/', {_text('user_id % 9')}, chr(27), '[0m') WHEN 1 THEN CONCAT(event_type, ' 1/2 ', {_text('user_id')}, '/150 ') WHEN 2 THEN '' ELSE event_type END"})


@query(
    "str16_progress_line",
    rf"""WITH b AS (SELECT event_id, trim(regexp_replace(regexp_replace(line, '\x1b\[[0-9;]*[A-Za-z]', '', 'g'), '\s+', ' ', 'g')) AS bare FROM {PROGRESS.sql}), l AS (SELECT event_id, bare, list_last(regexp_extract_all(bare, '[0-9]+/[0-9]+')) AS last FROM b)
        SELECT event_id, bare, CASE WHEN CAST(split_part(last, '/', 2) AS BIGINT) > 0 THEN CAST(split_part(last, '/', 1) AS BIGINT) END AS current, CASE WHEN CAST(split_part(last, '/', 2) AS BIGINT) > 0 THEN CAST(split_part(last, '/', 2) AS BIGINT) END AS total FROM l""",
)
def _(t: Tables):
    """A line of a program's output without its escapes, and the last count in it, unless it is of none."""
    bare = F.trim(F.regexp_replace(F.regexp_replace("line", "\\x1b\\[[0-9;]*[A-Za-z]", ""), "\\s+", " "))
    v = PROGRESS.df(t).select("event_id", bare.alias("bare"))
    last = F.try_element_at(F.regexp_extract_all("bare", F.lit("(\\d+/\\d+)"), 1), F.lit(-1))
    total = F.split_part(last, F.lit("/"), F.lit(2)).cast("long")
    return v.select("event_id", "bare", F.when(total > 0, F.split_part(last, F.lit("/"), F.lit(1)).cast("long")).alias("current"), F.when(total > 0, total).alias("total"))


WRAPS = Rows("lines", {"doc_id": "doc_id", "pos": "CAST(pos AS BIGINT)", "s": "replace(substr(line, 1, 60), 'e', '_/e')"})


@query("str24_wrap_tokens", rf"SELECT doc_id, pos, array_to_string(regexp_extract_all(s, '\s+|[A-Za-z0-9_./:%#@&+=-]+|.'), '|') AS tokens FROM {WRAPS.sql}")
def _(t: Tables):
    return WRAPS.df(t).select("doc_id", "pos", F.array_join(F.regexp_extract_all("s", F.lit("(\\s+|[A-Za-z0-9_./:%#@&+=-]+|.)"), 1), "|").alias("tokens"))


AXES = Rows("documents", {"doc_id": "doc_id", "s": AXIS_TEXT.replace("concat(", "CONCAT(").replace("CONCAT(trim(", "CONCAT(CASE WHEN doc_id % 5 = 0 THEN '[x] ' ELSE '' END, trim(")}, "text IS NOT NULL")


@query("txt6_axis_labels", rf"SELECT doc_id, reverse(s) AS reversed, trim(regexp_replace(s, '[ ]*[(\[][^)\]]*[)\]][ ]*', ' ')) AS body, nullif(regexp_extract(s, '[(\[]([^)\]]*)[)\]]', 1), '') AS unit FROM {AXES.sql}")
def _(t: Tables):
    unit = F.nullif(F.regexp_extract("s", r"[(\[]([^)\]]*)[)\]]", 1), F.lit(""))
    body = F.trim(F.concat(F.regexp_extract("s", r"^(.*?)(?:[ ]*[(\[][^)\]]*[)\]][ ]*(.*))?$", 1), F.when(unit.isNotNull(), F.lit(" ")).otherwise(""), F.regexp_extract("s", r"^(.*?)(?:[ ]*[(\[][^)\]]*[)\]][ ]*(.*))?$", 2)))
    return AXES.df(t).select("doc_id", F.reverse("s").alias("reversed"), body.alias("body"), unit.alias("unit"))


DEFINITIONS = Rows("lines", {"doc_id": "doc_id", "pos": "CAST(pos AS BIGINT)", "s": "CASE pos % 3 WHEN 0 THEN replace(substr(line, 1, 40), ', ', ':  ') ELSE substr(line, 1, 40) END", "styles": "CAST(1 + (doc_id + pos) % 3 AS BIGINT)"})


@query("rw14_definition_lines", f"SELECT doc_id, pos, CASE WHEN styles >= 2 AND contains(s, ':') THEN split_part(s, ':', 1) || ':' END AS prefix, CASE WHEN styles >= 2 AND contains(s, ':') THEN ltrim(substr(s, strpos(s, ':') + 1)) ELSE s END AS body FROM {DEFINITIONS.sql}")
def _(t: Tables):
    """A translated definition line is split at its first colon, so that both parts get the source's styles."""
    splits = (F.col("styles") >= 2) & F.contains(F.col("s"), F.lit(":"))
    at = F.locate(":", F.col("s"))
    return DEFINITIONS.df(t).select("doc_id", "pos", F.when(splits, F.col("s").substr(F.lit(1), at)).alias("prefix"), F.when(splits, F.ltrim(F.col("s").substr(at + 1, F.length("s")))).otherwise(F.col("s")).alias("body"))
