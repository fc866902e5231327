"""Conversations, logs and events as tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.payload import suggestions, tool_names, usage_total, without_suggestions
from tablewright.functions.text import one_line_title, slug, slug_with_suffix
from tablewright.operators.result import quoted

# Requests allowed per window, by action.
RATE_LIMITS = {
    "register": (10, "1 hour"),
    "login": (20, "1 minute"),
    "mfa": (10, "1 minute"),
    "reset": (5, "1 hour"),
}


def transcript(messages: DataFrame, conversation: str, order: str, role: str = "role") -> DataFrame:
    """What users and assistants said, in order, without system lines.

    The sort is by conversation and position, so one endless conversation is
    spread over as many tasks as its rows need.
    """
    return messages.filter(F.col(role) != "system").orderBy(conversation, order)


def history(
    messages: DataFrame,
    conversation: str,
    order: str,
    role: str = "role",
    text: str = "text",
    payload: str | None = None,
) -> DataFrame:
    """The messages a model is given, in order.

    System lines are internal: they turn into ``tool`` lines if their payload
    names the tool use they answer, and are left out otherwise. Other lines
    carry the tool calls of their payload. The result is one row per message,
    not one array per conversation, which a very long one would not fit into.
    """
    if payload is None:
        told = messages.filter(F.col(role) != "system")
        columns = [F.col(role).alias("role"), F.col(text).alias("content")]
    else:
        json = F.try_parse_json(payload)
        use = F.try_variant_get(json, "$.tool_use_id", "string")
        system = F.col(role) == "system"
        told = messages.filter(~system | use.isNotNull())
        calls = F.try_variant_get(json, "$.tool_calls", "array<variant>")
        columns = [
            F.when(system, F.lit("tool")).otherwise(F.col(role)).alias("role"),
            F.col(text).alias("content"),
            F.when(system, use).alias("tool_use_id"),
            F.when(~system, F.to_json(calls)).alias("tool_calls"),
        ]
    return told.select(conversation, order, *columns).orderBy(conversation, order)


def split_suggestions(messages: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by what comes before a trailing suggestions line and add the ``suggestions``."""
    c = F.col(text)
    return messages.select(
        *[F.col(quoted(k)) for k in messages.columns if k != text],
        without_suggestions(c).alias(text),
        suggestions(c).alias("suggestions"),
    )


def executed_tools(messages: DataFrame, payload: str) -> DataFrame:
    """Add the names of the tools each message called."""
    return messages.withColumn("executed_tools", tool_names(F.col(payload)))


def titles(messages: DataFrame, conversation: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """Title of each conversation from its first user message.

    The text is cut to title length before it is compared and shuffled, and
    each task passes on one candidate per conversation.
    """
    asked = messages.filter(F.col(role) == "user")
    short = asked.select(conversation, order, one_line_title(F.col(text)).alias("title"))
    return short.groupBy(conversation).agg(F.min_by("title", order).alias("title"))


def token_usage(messages: DataFrame, conversation: str, usage: str, **paths: str) -> DataFrame:
    """Tokens used per conversation."""
    total = usage_total(F.col(usage), **paths)
    return messages.groupBy(conversation).agg(F.coalesce(F.sum(total), F.lit(0)).alias("total_tokens"))


def unique_slugs(names: DataFrame, id_: str, name: str) -> DataFrame:
    """A slug per row; the lowest id keeps the plain one, the others (and empty ones) get a suffix.

    The join is on slug and id, which is unique, so a name shared by a third
    of the rows does not end up in one task.
    """
    slugs = names.select(F.col(quoted(id_)).alias("id"), slug(F.col(quoted(name))).alias("base"))
    first = slugs.filter(F.col("base") != "").groupBy("base").agg(F.min("id").alias("id"))
    marked = slugs.join(first.withColumn("plain", F.lit(True)), ["base", "id"], "left")
    final = F.when(F.col("plain"), F.col("base")).otherwise(slug_with_suffix(F.col("base"), F.col("id")))
    return marked.select(F.col("id").alias(id_), final.alias("slug"))


def over_limit(events: DataFrame, client: str, at: str, limit: int, window: str) -> DataFrame:
    """Clients and fixed windows with more events than allowed.

    Also runs on a stream; set a watermark on ``at`` first.
    """
    counted = events.groupBy(F.col(client), F.window(at, window).alias("window")).agg(F.count(F.lit(1)).alias("events"))
    exceeded = counted.filter(F.col("events") > limit)
    return exceeded.select(client, F.col("window.start").alias("window_start"), "events")


def active_rows(rows: DataFrame, now, revoked: str = "revoked_at", expires: str = "expires_at") -> DataFrame:
    """Rows neither revoked nor expired; order by creation, newest first, to list them."""
    return rows.filter(F.col(revoked).isNull() & (F.col(expires) > now))


AUDIT = T.StructType(
    [
        T.StructField("event_type", T.StringType(), False),
        T.StructField("user_id", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("at", T.TimestampNTZType()),
    ]
)


def append_audit(events: DataFrame, path: str) -> None:
    """Add audit lines; there is no way to change or remove one."""
    lines = events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in AUDIT.fields])
    lines.write.mode("append").parquet(path)


def audit_summary(events: DataFrame, event_type: str, at: str, window: str = "1 day") -> DataFrame:
    """Events per type and window."""
    counted = events.groupBy(F.col(event_type), F.window(at, window).alias("window")).agg(
        F.count(F.lit(1)).alias("events")
    )
    return counted.select(event_type, F.col("window.start").alias("window_start"), "events")
