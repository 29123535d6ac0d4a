"""Transcript folders: discovery of session files, JSONL with line numbers, heads, tails and titles."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import running_counts
from ..operators.records import json_value

UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
ROLLOUT = r"rollout-.*-([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})\.jsonl$"
REFS = "agent string, session_id string, file_path string, updated_at timestamp, size_bytes bigint"
#: Files above this many bytes are left out of reports over many sessions.
LARGEST = 30 * 1024 * 1024


def read_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file_path, line_no, raw, value``: the readable JSON lines, ``value`` as VARIANT.

    Blank and unreadable lines are left out but count in ``line_no`` (from
    1). Files are split as text, so no file has to fit into one task: lines
    are numbered by block and place, spread over tasks.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("raw"))
    n = running_counts(rows, "file_path", ["block", "at"], {"line_no": F.lit(True)})
    return n.select("file_path", "line_no", "raw", json_value(F.col("raw")).alias("value")).filter("value is not null")


def head(lines: DataFrame, k: int) -> DataFrame:
    """The first ``k`` readable lines of each file."""
    return _nearest(lines, k, F.col("line_no"))


def tail(lines: DataFrame, k: int) -> DataFrame:
    """The last ``k`` readable lines of each file."""
    return _nearest(lines, k, -F.col("line_no"))


def _nearest(lines: DataFrame, k: int, order) -> DataFrame:
    from pyspark.sql import Window

    # A rank limit: Spark keeps only k rows per file before the shuffle.
    w = Window.partitionBy("file_path").orderBy(order)
    return lines.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")


def _files(spark: SparkSession, root: str, **options) -> DataFrame:
    if not os.path.isdir(root.removeprefix("file://")):
        return spark.createDataFrame([], "file_path string, updated_at timestamp, size_bytes bigint")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl")
    for k, v in options.items():
        reader = reader.option(k, v)
    # Only names, times and sizes are read: the content column is pruned.
    return reader.load(root).select(F.col("path").alias("file_path"), F.col("modificationTime").alias("updated_at"), F.col("length").alias("size_bytes"))


def list_a(spark: SparkSession, root: str) -> DataFrame:
    """Format A session files ``root/<project>/<uuid>.jsonl``; a missing root has none."""
    f = _files(spark, root, recursiveFileLookup="true").filter(F.col("file_path").rlike(f"/[^/]+/{UUID}\\.jsonl$"))
    depth = len(root.removeprefix("file://").rstrip("/").split("/")) + 2
    f = f.filter(F.size(F.split(F.regexp_replace("file_path", "^file:/+", "/"), "/")) == depth)
    return f.select(F.lit("a").alias("agent"), F.regexp_extract("file_path", f"({UUID})\\.jsonl$", 1).alias("session_id"), "file_path", "updated_at", "size_bytes")


def list_b(spark: SparkSession, root: str, index: str | None = None) -> DataFrame:
    """Format B session files anywhere under ``root``, with the title of the index, if any."""
    f = _files(spark, root, recursiveFileLookup="true").withColumn("session_id", F.regexp_extract("file_path", ROLLOUT, 1)).filter("session_id != ''")
    f = f.select(F.lit("b").alias("agent"), "session_id", "file_path", "updated_at", "size_bytes")
    if index is None or not os.path.exists(index):
        return f.withColumn("title", F.lit(None).cast("string"))
    return f.join(titles(spark, index), "session_id", "left").select("agent", "session_id", "file_path", "updated_at", "size_bytes", "title")


def titles(spark: SparkSession, index: str) -> DataFrame:
    """``session_id, title`` of a session index; the last entry of an id wins."""
    rows = read_jsonl(spark, index).select("line_no", F.try_variant_get("value", "$.id", "string").alias("session_id"), F.try_variant_get("value", "$.thread_name", "string").alias("title"))
    return rows.filter("session_id is not null").groupBy("session_id").agg(F.max_by("title", "line_no").alias("title"))


def find(refs: DataFrame, id_or_prefix: str) -> str | None:
    """The one session of this id, else of this prefix; None if there is none.

    Raises ValueError when several sessions share the prefix.
    """
    got = [r.session_id for r in refs.filter(F.col("session_id").startswith(id_or_prefix)).select("session_id").distinct().orderBy("session_id").limit(100).collect()]
    if id_or_prefix in got:
        return id_or_prefix
    if len(got) > 1:
        raise ValueError(f"{id_or_prefix} stands for {len(got)} sessions: {', '.join(got[:5])}")
    return got[0] if got else None


def in_scope(refs: DataFrame, agent: str = "all", since: str | None = None, limit: int | None = None, largest: int | None = LARGEST) -> DataFrame:
    """The refs of a report: agent and time filter, newest ``limit``, and only then the size limit ``largest`` (None: no limit)."""
    if agent not in ("all", "a", "b"):
        raise ValueError(f"unknown agent {agent}")
    out = refs if agent == "all" else refs.filter(F.col("agent") == agent)
    if since:
        if since[:-1].isdigit() and since.endswith("d"):
            out = out.filter(F.col("updated_at") >= F.current_timestamp() - F.make_dt_interval(F.lit(int(since[:-1]))))
        else:
            out = out.filter(F.col("updated_at") >= F.lit(since).cast("timestamp"))
    if limit is not None:
        out = out.orderBy(F.desc_nulls_last("updated_at"), "session_id").limit(limit)
    return out if largest is None else out.filter(F.col("size_bytes") <= largest)


#: First lines in which a file of each agent names its folder.
WITHIN = {"a": 8, "b": 3}


def first_folder(lines: DataFrame, agent: str = "a") -> DataFrame:
    """``file_path, cwd``: the first text ``cwd`` in the first lines of each file."""
    def text(path: str):
        x = F.try_variant_get("value", path, "variant")
        return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))

    c = F.coalesce(text("$.cwd"), text("$.payload.cwd"))
    return head(lines, WITHIN[agent]).withColumn("cwd", c).filter("cwd is not null").groupBy("file_path").agg(F.min_by("cwd", "line_no").alias("cwd"))


#: Readers by agent: adding one makes its files part of every report.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"a": list_a, "b": list_b}


def rate_limits(refs: DataFrame, lines: DataFrame, files: int = 5, last: int = 60) -> DataFrame:
    """The newest quota report in the last lines of the newest files: one row or none."""
    newest = refs.orderBy(F.desc("updated_at"), "file_path").limit(files).select("file_path", "updated_at")
    v = lambda p, t: F.try_variant_get("value", f"$.payload.rate_limits.{p}", t)
    t = tail(lines.join(newest, "file_path"), last).select("updated_at", "line_no", v("primary.used_percent", "double").alias("used_percent"), v("primary.window_minutes", "bigint").alias("window_minutes"), v("plan_type", "string").alias("plan"))
    return t.filter("used_percent is not null").agg(F.max(F.struct("updated_at", "line_no", "used_percent", "window_minutes", "plan")).alias("m")).filter("m is not null").select("m.used_percent", "m.window_minutes", "m.plan")


# The members of a format A line that the engine reads, with their types.
FIELDS_A = [
    ("type", "string"), ("uuid", "string"), ("parentUuid", "string"), ("sessionId", "string"), ("session_id", "string"), ("timestamp", "string"), ("cwd", "string"), ("gitBranch", "string"), ("version", "string"), ("requestId", "string"),
    ("isSidechain", "boolean"), ("isMeta", "boolean"), ("isCompactSummary", "boolean"), ("compactMetadata", "struct<trigger:string,preTokens:bigint>"), ("aiTitle", "string"), ("operation", "string"),
]
USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>"


def records_a(lines: DataFrame) -> DataFrame:
    """Format A lines of :func:`read_jsonl` in the columns of the ``claude_records`` table."""
    g = lambda p, t: F.try_variant_get("value", f"$.{p}", t)
    message = F.when(g("message", "variant").isNotNull(), F.struct(g("message.id", "string").alias("id"), g("message.role", "string").alias("role"), g("message.model", "string").alias("model"), F.to_json(g("message.content", "variant")).alias("content"), g("message.usage", USAGE).alias("usage")))
    result = g("toolUseResult", "struct<agentId:string,agentType:string,totalTokens:bigint,totalToolUseCount:bigint,totalDurationMs:bigint>")
    return lines.select("file_path", F.col("line_no").cast("bigint").alias("line_no"), *[g(n, t).alias(n) for n, t in FIELDS_A], message.alias("message"), result.alias("toolUseResult"), F.to_json(g("attachment", "variant")).alias("attachment"), F.lit(None).cast("timestamp_ntz").alias("ingested_at"))


def lines_b(lines: DataFrame) -> DataFrame:
    """Format B lines of :func:`read_jsonl` in the columns of the ``codex_lines`` table."""
    g = lambda p, t: F.try_variant_get("value", f"$.{p}", t)
    return lines.select(F.xxhash64("file_path", "line_no").alias("line_id"), "file_path", F.col("line_no").cast("bigint").alias("line_no"), g("timestamp", "string").alias("timestamp"), g("type", "string").alias("type"), F.to_json(g("payload", "variant")).alias("payload"))
