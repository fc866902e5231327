"""Conversations, secrets, slugs, rate windows and audit summaries."""

from pyspark.sql import functions as F

from suite.base import NOT_WS, WS, WS_CHARS, Query, table
from tablewright.functions.payload import tool_names
from tablewright.functions.secrets import SENSITIVE_KEYS, redact_json, redact_record, redact_text
from tablewright.functions.text import slug
from tablewright.operators import events as ev


def _conversations(spark, sf):
    return table(spark, sf, "conversations")


def transcript(spark, sf):
    return ev.transcript(_conversations(spark, sf), "conv_id", "turn")


# System lines with an odd turn answer a tool use, others are internal; assistants call a tool every other turn.
_PAYLOAD = """CASE WHEN role = 'system' AND {turn} THEN concat('{{"tool_use_id":"u', CAST(conv_id AS STRING), '"}}')
  WHEN role = 'assistant' AND turn % 2 = 1 THEN '{{"tool_calls":[{{"name":"dedupe"}}]}}' END"""


def history(spark, sf):
    payload = F.expr(_PAYLOAD.format(turn="conv_id % 2 = 1"))
    messages = _conversations(spark, sf).withColumn("payload", payload)
    return ev.history(messages, "conv_id", "turn", payload="payload")


_HISTORY = """
SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'tool' ELSE role END AS role, text AS content,
  CASE WHEN role = 'system' THEN 'u' || conv_id END AS tool_use_id,
  CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN '[{"name":"dedupe"}]' END AS tool_calls
FROM conversations WHERE role <> 'system' OR conv_id % 2 = 1"""

# Each message gets one of six endings, some of them no valid suggestions line.
_ENDINGS = """concat(text, CASE (conv_id + turn) % 6 WHEN 0 THEN '\n\nSUGGESTIONS:["Yes", "Not now"]'
  WHEN 1 THEN '\nSUGGESTIONS: ["one"]  ' WHEN 2 THEN ' SUGGESTIONS:["a", 1]' WHEN 3 THEN ' SUGGESTIONS:[]'
  WHEN 4 THEN ' SUGGESTIONS:[broken]' ELSE '  ' END)"""


def suggestions(spark, sf):
    messages = _conversations(spark, sf).select("conv_id", "turn", F.expr(_ENDINGS).alias("text"))
    split = ev.split_suggestions(messages)
    return split.withColumn("suggestions", F.array_join("suggestions", "|"))


_TRAILING = rf"(?s)SUGGESTIONS:{WS}*(\[[^\n]*\]){WS}*$"
_SUGGESTIONS = f"""
SELECT conv_id, turn, rtrim(CASE WHEN ok THEN regexp_replace(text, '{_TRAILING}', '') ELSE text END, '{WS_CHARS}') AS text,
  CASE WHEN ok THEN array_to_string(list_transform(items, lambda x: x ->> '$'), '|') END AS suggestions
FROM (SELECT *, items IS NOT NULL AND len(items) > 0 AND json_valid(raw)
        AND len(list_filter(CAST(items AS JSON[]), lambda x: json_type(x) = 'VARCHAR')) = len(items) AS ok
      FROM (SELECT *, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON[]) END AS items
            FROM (SELECT conv_id, turn, text, regexp_extract(text, '{_TRAILING}', 1) AS raw
                  FROM (SELECT conv_id, turn, {_ENDINGS} AS text FROM conversations) a) b) c) d"""

_CALLS = """concat('{"tool_calls":[{"name":"', event_type, '"},{"id":1},{"name":', CAST(event_id AS STRING),
  '},{"name":"u', CAST(user_id AS STRING), '"}],"prompt":', CAST(user_id AS STRING), ',"completion":7}')"""


def executed_tools(spark, sf):
    payload = table(spark, sf, "events").select("event_id", F.expr(_CALLS).alias("payload"))
    return payload.select("event_id", F.array_join(tool_names(F.col("payload")), ",").alias("tools"))


def token_usage(spark, sf):
    usage = table(spark, sf, "events").select("event_type", F.expr(_CALLS).alias("payload"))
    return ev.token_usage(usage, "event_type", "payload")


def titles(spark, sf):
    return ev.titles(_conversations(spark, sf), "conv_id", "turn")


def redact(spark, sf):
    return table(spark, sf, "documents").select("doc_id", redact_text(F.col("text")).alias("text"))


def redact_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", redact_text(F.col("html"), strict=True).alias("html"))


_KEYS = "|".join(sorted(SENSITIVE_KEYS, key=len, reverse=True))
_BEARER = r"\bbearer" + WS + r"+[A-Za-z0-9._\-]+"


def _redact_sql(c, pattern):
    return f"""regexp_replace(regexp_replace({c}, '{pattern}', '\\1\\2***', 'gi'), '{_BEARER}', 'Bearer ***', 'gi')"""


_SECRET = """concat('{"token": ', CAST(event_id AS STRING), ', "kind": "', event_type,
  '", "nested": {"Password": "p", "n": ', CAST(user_id AS STRING), '}}')"""


def redact_payload(spark, sf):
    payload = table(spark, sf, "events").select("event_id", F.expr(_SECRET).alias("payload"))
    return payload.select("event_id", redact_json(F.col("payload")).alias("payload"))


def redact_typed(spark, sf):
    """The same with the record as typed struct and map."""
    rows = table(spark, sf, "events").select(
        "event_id",
        F.struct(
            F.col("event_type").alias("secret"),
            F.create_map(F.lit("cookie"), F.col("event_type"), F.lit("kind"), F.col("event_type")).alias("more"),
        ).alias("record"),
    )
    hidden = rows.select("event_id", redact_record(F.col("record"), rows.schema["record"].dataType).alias("record"))
    return hidden.select("event_id", F.to_json("record").alias("record"))


def slugs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", slug(F.col("text")).alias("slug"))


def unique_slugs(spark, sf):
    return ev.unique_slugs(table(spark, sf, "customer"), "c_custkey", "c_mktsegment")


def _windows(client, limit, window):
    def run(spark, sf):
        found = ev.over_limit(table(spark, sf, "events"), client, "ts", limit, window)
        return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))

    return run


def _windows_sql(client, limit, unit):
    return f"""SELECT {client}, strftime(date_trunc('{unit}', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS events
FROM events GROUP BY {client}, date_trunc('{unit}', ts) HAVING count(*) > {limit}"""


def active_rows(spark, sf):
    sessions = table(spark, sf, "orders").select(
        "o_orderkey",
        F.expr("CASE WHEN o_orderstatus = 'F' THEN o_orderdate END").alias("revoked_at"),
        F.expr("o_orderdate + INTERVAL 30 DAYS").alias("expires_at"),
    )
    now = F.lit("1998-01-15 00:00:00").cast("timestamp_ntz")
    return ev.active_rows(sessions, now).select("o_orderkey")


def audit_summary(spark, sf):
    found = ev.audit_summary(table(spark, sf, "events"), "event_type", "ts")
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


QUERIES = [
    Query("transcript", transcript, "SELECT * FROM conversations WHERE role <> 'system'"),
    Query("history", history, _HISTORY),
    Query("suggestions", suggestions, _SUGGESTIONS),
    Query(
        "tool_names",
        executed_tools,
        "SELECT event_id, concat(event_type, ',u', CAST(user_id AS VARCHAR)) AS tools FROM events",
    ),
    Query(
        "token_usage",
        token_usage,
        "SELECT event_type, CAST(sum(user_id + 7) AS BIGINT) AS total_tokens FROM events GROUP BY event_type",
    ),
    Query(
        "titles",
        titles,
        f"""SELECT conv_id, left(regexp_replace(trim(arg_min(text, turn), '{WS_CHARS}'), '{WS}+', ' ', 'g'), 80) AS title
FROM conversations WHERE role = 'user' GROUP BY conv_id""",
    ),
    Query(
        "redact",
        redact,
        f"SELECT doc_id, {_redact_sql('text', f'({_KEYS})({WS}*[:=]{WS}*|{WS}+)' + NOT_WS[:-1] + ',;]+')} AS text FROM documents",
    ),
    Query(
        "redact_strict",
        redact_pages,
        f"""SELECT page_id, regexp_replace(regexp_replace(html,
  '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])({_KEYS})({WS}*[:=]{WS}*){NOT_WS[:-1]},;]+', '\\1\\2\\3***', 'gi'),
  '{_BEARER}', 'Bearer ***', 'gi') AS html FROM pages""",
    ),
    Query(
        "redact_json",
        redact_payload,
        """SELECT event_id, concat('{"token": "***", "kind": "', event_type, '", "nested": {"Password": "***", "n": ',
  CAST(user_id AS VARCHAR), '}}') AS payload FROM events""",
    ),
    Query(
        "redact_record",
        redact_typed,
        """SELECT event_id, concat('{"secret":"***","more":{"cookie":"***","kind":"', event_type, '"}}') AS record
FROM events""",
    ),
    Query(
        "slug",
        slugs,
        """SELECT doc_id, left(trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')),
  '[^a-z0-9]+', '-', 'g'), '-'), 60) AS slug FROM documents""",
    ),
    Query(
        "unique_slugs",
        unique_slugs,
        """SELECT c_custkey, CASE WHEN c_custkey = min(c_custkey) OVER (PARTITION BY c_mktsegment) THEN base
  ELSE left(base, 58 - length(to_base(c_custkey, 36))) || '--' || lower(to_base(c_custkey, 36)) END AS slug
FROM (SELECT c_custkey, c_mktsegment, regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '-', 'g') AS base FROM customer) t""",
    ),
    Query(
        "unique_slug_counts",
        lambda spark, sf: unique_slugs(spark, sf).agg(F.count("*").alias("n_rows"), F.countDistinct("slug").alias("n_slugs")),
        "SELECT count(*) AS n_rows, count(DISTINCT c_custkey) AS n_slugs FROM customer",
    ),
    Query("rate_windows", _windows("event_type", 5, "1 hour"), _windows_sql("event_type", 5, "hour")),
    Query("rate_windows_user", _windows("user_id", 3, "1 day"), _windows_sql("user_id", 3, "day")),
    Query(
        "active_rows",
        active_rows,
        """SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'
  AND o_orderdate + INTERVAL 30 DAYS > TIMESTAMP '1998-01-15 00:00:00'""",
    ),
    Query(
        "audit_summary",
        audit_summary,
        """SELECT event_type, strftime(ts, '%Y-%m-%d') AS window_start, count(*) AS events FROM events GROUP BY ALL""",
    ),
]
