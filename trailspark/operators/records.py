"""Format A rows: JSON content, row classes and the latest version of each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The markers by which user rows are told apart.
COMMAND_NAME = r"<command-name>\s*([^<\n]+?)\s*</command-name>"
COMMAND_ARGS = r"<command-args>\s*([\s\S]*?)\s*</command-args>"
INTERRUPTED = "[Request interrupted"
ECHO = "<local-command-stdout>"
HARNESS = r"^<(system-reminder|task-notification|background-task|tool-reminder)\b"
# Fixed value: white space as the reference's trim sees it.
BLANKS = r"[\s   -     　﻿]+"


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANKS}|{BLANKS}$", "")


def json_value(c: Column) -> Column:
    """The JSON text as a VARIANT; NULL unless the whole text is one JSON value.

    The text is parsed inside brackets, so that anything after the value
    makes it invalid.
    """
    v = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).cast("array<variant>")
    return F.when(F.size(v) == 1, F.get(v, F.lit(0)))


def is_kind(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def content_columns(content: Column) -> dict[str, Column]:
    """Column expressions over a ``json_value`` named ``_v`` (see :func:`with_content`)."""
    v = F.col("_v")
    blocks = F.expr("transform(_b, b -> named_struct('type', case when schema_of_variant(try_variant_get(b, '$.type', 'variant')) = 'STRING' then try_variant_get(b, '$.type', 'string') end, 'text', case when schema_of_variant(try_variant_get(b, '$.text', 'variant')) = 'STRING' then try_variant_get(b, '$.text', 'string') end))")
    return {"valid": v.isNotNull(), "blocks": blocks}


def with_content(df: DataFrame, content: Column) -> DataFrame:
    """Adds ``json_ok``, ``text`` (string, or text blocks joined by line ends) and ``has_result``."""
    df = df.withColumn("_v", json_value(content))
    df = df.withColumn("_s", F.schema_of_variant("_v"))
    df = df.withColumn("_b", F.when(F.col("_s").startswith("ARRAY"), F.col("_v").try_cast("array<variant>")))
    df = df.withColumn("_b", content_columns(content)["blocks"])
    joined = F.expr("array_join(transform(filter(_b, b -> b.type = 'text' and b.text is not null), b -> b.text), '\\n')")
    return df.select(
        *[c for c in df.columns if c not in ("_v", "_s", "_b")],
        F.col("_v").isNotNull().alias("json_ok"),
        F.coalesce(F.when(F.col("_s") == "STRING", F.variant_get("_v", "$", "string")), joined, F.lit("")).alias("text"),
        F.coalesce(F.expr("exists(_b, b -> b.type = 'tool_result')"), F.lit(False)).alias("has_result"),
    )


def row_class(type_: Column, text: Column, has_result: Column, *off: Column) -> Column:
    """Class of a user row: prompt, command, interruption, command-output or other.

    ``off`` are flags (meta, compact summary, sidechain) any of which makes a
    row ``other``; a null flag means false.
    """
    t = trim_all(text)
    skip = ~F.coalesce(type_ == "user", F.lit(False)) | has_result
    for flag in off:
        skip = skip | F.coalesce(flag, F.lit(False))
    return (
        F.when(skip | (t == ""), "other")
        .when(t.startswith(INTERRUPTED), "interruption")
        .when(t.rlike(COMMAND_NAME), "command")
        .when(t.startswith(ECHO), "command-output")
        .when(t.rlike(HARNESS), "other")
        .otherwise("prompt")
    )


def classified(records: DataFrame, content: Column | None = None) -> DataFrame:
    """Adds json_ok, text, has_result and row_class to format A rows.

    ``content`` may leave out the content of rows whose class the caller
    doesn't need; a null content is as an unreadable one.
    """
    df = with_content(records, F.col("message.content") if content is None else content)
    return df.withColumn("row_class", row_class(F.col("type"), F.col("text"), F.col("has_result"), F.col("isMeta"), F.col("isCompactSummary"), F.col("isSidechain")))


def session_of() -> Column:
    return F.coalesce(F.col("sessionId"), F.col("session_id"))


def latest(rows: DataFrame, key: str = "uuid", order: str = "line_no") -> DataFrame:
    """One row per non-null ``key``: the one with the greatest ``order``.

    Equal copies collapse; rows with a null key are left out; a null order
    counts as the least. Among differing rows of one order the greatest by
    the remaining columns is taken, so the result doesn't depend on the
    order of the input. Partial aggregation runs before the shuffle.
    """
    rest = [c for c in rows.columns if c not in (key, order)]
    best = F.max(F.struct(order, *rest)).alias("_m")
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"_m.{c}").alias(c) for c in [order, *rest]])
