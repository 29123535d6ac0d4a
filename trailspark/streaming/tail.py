"""Growing transcripts as streams: tailing, weekly counts, matching of git events, step numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.times import micros
from ..operators.records import json_value


def tail_jsonl(spark: SparkSession, folder: str, fields: dict[str, str], time_field: str = "timestamp", late: str = "2 days") -> DataFrame:
    """A stream of the JSON lines that arrive in a folder, once each.

    ``fields``: member path -> type, one column each (named by its last
    part). Unreadable and half-written lines, and lines without a readable
    time, are left out. ``ts`` is the time, with a watermark of ``late``.
    """
    raw = spark.readStream.format("text").load(folder)
    v = raw.select(json_value(F.col("value")).alias("v")).filter("v is not null")
    cols = [F.try_variant_get("v", f"$.{p}", t).alias(p.split(".")[-1]) for p, t in fields.items()]
    out = v.select(*cols, F.timestamp_micros(micros(F.try_variant_get("v", f"$.{time_field}", "string"))).alias("ts")).filter("ts is not null").withWatermark("ts", late)
    keys = [c for c in ("uuid", "id") if c in out.columns]
    return out.dropDuplicatesWithinWatermark(keys) if keys else out


def weekly_counts(stream: DataFrame, by: str) -> DataFrame:
    """Rows per week (from Monday) and value; windows start four days after the epoch's Thursday."""
    return stream.groupBy(F.window("ts", "7 days", startTime="4 days"), by).agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("week"), by, "n")


def with_git(prompts: DataFrame, events: DataFrame, seconds: int = 20) -> DataFrame:
    """Prompts joined with the event of their session that is nearest and at most ``seconds`` away.

    Both streams need a watermark on ``ts``; both sides' state is dropped
    once the watermark passes, and only then a prompt's row comes out.
    """
    e = events.select(F.col("session_id").alias("e_session"), F.col("ts").alias("e_ts"), "head")
    near = F.expr(f"session_id = e_session and e_ts between ts - interval {seconds} seconds and ts + interval {seconds} seconds")
    d = F.abs(F.unix_micros("ts") - F.unix_micros("e_ts"))
    met = prompts.join(e, near).select("session_id", "ts", d.alias("d"), "head", F.unix_micros("e_ts").alias("e_us"))
    best = met.groupBy("session_id", "ts").agg(F.min(F.struct("d", "e_us", "head")).alias("b"))
    return best.select("session_id", "ts", F.timestamp_micros("b.e_us").alias("e_ts"), F.col("b.head").alias("head"))


def numbered_steps(stream: DataFrame, idle: str | None = "30 days") -> DataFrame:
    """Adds the step number in its session to each row, across micro-batches.

    ``stream``: session_id, line_no, opens. Rows of a batch are taken in
    order of line_no; a session's state is its last number, and it is
    forgotten after an ``idle`` time without rows (numbers then begin anew);
    None keeps it for ever.
    """

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else -1
        pdf = pd.concat(list(pdfs)).sort_values("line_no")
        idx = pdf["opens"].fillna(False).astype(int).cumsum() + last
        if len(pdf):
            state.update((int(idx.iloc[-1]),))
            if wait:
                state.setTimeoutDuration(wait)
        yield pd.DataFrame({"session_id": key[0], "line_no": pdf["line_no"], "step_idx": idx.astype("int64")})

    wait = max(1, int(pd.Timedelta(idle).total_seconds() * 1000)) if idle else None
    return stream.select("session_id", "line_no", "opens").groupBy("session_id").applyInPandasWithState(run, "session_id string, line_no bigint, step_idx bigint", "last bigint", "append", GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout)
