"""Prompt-bearing steps with features, neighbours and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.times import micros, week_key
from ..session import materialize
from . import records as rec
from .ordered import with_neighbours


def once(steps: DataFrame) -> DataFrame:
    """Each step once; of rows of one id the greatest by step_idx, then by the other columns."""
    rest = [c for c in steps.columns if c not in ("id", "step_idx")]
    return steps.filter("id is not null").groupBy("id").agg(F.max(F.struct("step_idx", *rest)).alias("_r")).select("id", "_r.*")


def featured(steps: DataFrame) -> DataFrame:
    """Steps with a non-blank prompt, once, with their time and features."""
    return once(steps).filter(tx.trimmed(F.col("promptText")) != "").withColumn("us", micros(F.col("timestamp"))).withColumns(tx.prompt_features(F.col("promptText")))


def signals(steps: DataFrame) -> DataFrame:
    """Steps with a non-blank prompt: features, gap to the prompt before, and whether the next one corrects.

    The gap is null where a time is unreadable or runs backwards. Order in a
    session is step_idx, then id.
    """
    s = featured(steps)
    n = with_neighbours(s, "session_id", ["step_idx", "id"], before={"us": "_prev_us"}, after={"is_correction": "_next_correction"})
    gap = F.floor((F.col("us") - F.col("_prev_us")) / 1000).cast("bigint")
    return n.withColumns({"gap_ms": F.when(gap >= 0, gap), "corrected_by_next": F.coalesce("_next_correction", F.lit(False)), "week": week_key(F.col("us"))}).drop("_prev_us", "_next_correction", "place")


def rate(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of).otherwise(0.0)


def session_stats(sig: DataFrame) -> DataFrame:
    """Sums, rates and the median gap of each session."""
    return sig.groupBy("session_id").agg(
        F.count("*").alias("steps"), F.count_if("is_correction").alias("corrections"), F.sum("chars").alias("prompt_chars"),
        tx.half_up(F.sum("chars") / F.count("*")).cast("bigint").alias("avg_prompt_chars"), tx.half_up(F.avg("specificity"), 4).alias("avg_specificity"), F.sum("vague").alias("vague_count"), F.median("gap_ms").alias("median_gap_ms"),
    )


def totals(sig: DataFrame, by: str) -> DataFrame:
    """Overall (``overall`` 1) and per-value totals in one pass."""
    t = sig.rollup(by)
    return t.agg(
        F.grouping(by).cast("int").alias("overall"),
        F.count_distinct("session_id").alias("sessions"), F.count("*").alias("steps"), F.count_if("is_correction").alias("corrections"), F.sum("chars").alias("prompt_chars"),
        tx.half_up(F.sum("chars") / F.count("*")).cast("bigint").alias("avg_prompt_chars"), tx.half_up(F.sum("vague") / F.count("*") * 100).cast("double").alias("_v"), tx.half_up(F.avg("specificity"), 4).alias("avg_specificity"),
    ).select("*", (F.col("_v") / 10).alias("vague_per_ten"), tx.half_up(F.col("corrections") / F.col("steps"), 6).alias("correction_rate"), tx.half_up(F.col("steps") / F.col("sessions"), 6).alias("steps_per_session")).drop("_v")


def weekly(sig: DataFrame) -> DataFrame:
    """Sessions, prompts and rates per week (Monday, UTC)."""
    b = lambda c: tx.half_up(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")), 6)
    return sig.filter("week is not null").groupBy("week").agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("steps"), b("is_correction").alias("correction_rate"), b("aborted").alias("interruption_rate"), tx.half_up(F.avg("specificity"), 4).alias("avg_specificity"))


def pearson(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``n, r``: the correlation; null for fewer than 4 pairs or no variance."""
    ok = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    g = ok.agg(F.count("*").alias("n"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("c"))
    return g.select("n", F.when((F.col("n") >= 4) & (F.col("vx") > 0) & (F.col("vy") > 0), tx.half_up(F.col("c") / F.sqrt(F.col("vx") * F.col("vy")), 6)).alias("r"))


def correction_rates(sig: DataFrame) -> DataFrame:
    """Mean specificity and share of corrections of each session with two or more prompts, not rounded."""
    return sig.groupBy("session_id").agg(F.avg("specificity").alias("specificity"), (F.count_if("is_correction") / F.count("*")).alias("correction_rate"), F.count("*").alias("n")).filter("n >= 2").drop("n")


def ninetieth(rows: DataFrame, value: str) -> DataFrame:
    """One row ``n, p90``: the value of rank ``floor(n * 0.9)`` (from 0); null if there is none.

    Distinct values are counted first and numbered by ranges (see
    ``ordered``), so no task gathers or sorts all of them.
    """
    counts = materialize(rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c")))
    parts = materialize(counts.repartitionByRange("v").withColumn("_part", F.spark_partition_id()))
    # A row per partition: how many values lie in it, and before it.
    sums = parts.groupBy("_part").agg(F.sum("c").alias("all"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = sums.select(F.col("_part").alias("_p"), "all", F.coalesce(F.sum("all").over(w), F.lit(0)).alias("before"))
    total = sums.agg(F.sum("all").alias("n"))
    # Only the partition that the rank falls in is sorted.
    hit = spans.crossJoin(F.broadcast(total)).filter((F.col("before") <= F.floor(F.col("n") * 0.9)) & (F.col("before") + F.col("all") > F.floor(F.col("n") * 0.9)))
    inside = parts.join(F.broadcast(hit), F.col("_part") == F.col("_p")).withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("_part").orderBy("v")))
    got = inside.filter(F.col("upto") > F.floor(F.col("n") * 0.9)).agg(F.min("v").alias("p90"))
    return total.select("n").crossJoin(F.broadcast(got))


def subagents_per_session(records: DataFrame, steps: DataFrame) -> DataFrame:
    """One row ``subagents_per_session``: subagent results over the sessions that either table knows; 0 without sessions.

    Re-ingested lines count once. Sessions without a prompt count too.
    """
    when = F.coalesce("ingested_at", F.lit("1970-01-01").cast("timestamp_ntz"))
    ran = F.coalesce((F.col("type") == "user") & F.col("toolUseResult.agentId").isNotNull(), F.lit(False))
    lines = records.filter("file_path is not null and line_no is not null").select("file_path", "line_no", F.struct(when.alias("at"), rec.session_of().alias("session_id"), ran.alias("ran")).alias("r"))
    per = lines.groupBy("file_path", "line_no").agg(F.max("r").alias("r")).groupBy(F.col("r.session_id").alias("session_id")).agg(F.count_if("r.ran").alias("n"))
    each = per.unionByName(steps.select("session_id", F.lit(0).cast("bigint").alias("n"))).groupBy("session_id").agg(F.sum("n").alias("n"))
    return each.agg(rate(F.coalesce(F.sum("n"), F.lit(0)), F.count("session_id")).alias("subagents_per_session"))


def archetype(t: DataFrame) -> DataFrame:
    """The style of prompting that the overall totals speak of: ordered rules, the first that holds."""
    r = F.col("steps_per_session")
    # Thresholds of the rules.
    name = F.when(F.col("steps") == 0, "unknown").when(F.col("steer_rate") > 0.25, "micromanager").when((F.col("avg_prompt_chars") > 700) & (r < 4), "cannonballer").when((F.col("command_rate") > 0.25) | (F.col("subagents_per_session") >= 1.5), "delegator").when((r >= 8) & (F.col("avg_prompt_chars") < 300), "gardener").otherwise("balanced")
    return t.select(name.alias("archetype"), "steps", "sessions", "avg_prompt_chars")


def unanchored() -> Column:
    """Whether a prompt is long and names no path and no code."""
    return (F.col("chars") > 200) & ~F.col("has_path") & ~F.col("has_code")


def lints(sig: DataFrame) -> DataFrame:
    """A row for each rule that the prompts trip, with the numbers it was judged by; ``all-clear`` if none."""
    c = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    hour = F.hour(F.timestamp_micros("us"))
    g = sig.agg(
        F.count("*").alias("n"), F.coalesce(F.sum("vague"), F.lit(0)).alias("vague"), c(unanchored()).alias("unanchored"), c(F.col("is_correction")).alias("corrections"),
        c(F.col("aborted")).alias("aborted"), c(F.col("gap_ms") < 15_000).alias("fast"), F.count("gap_ms").alias("gaps"), c(hour < 5).alias("night"), c(F.col("chars") > 3000).alias("mega"),
    )
    n = F.col("n")
    # The rules' least counts and shares.
    rules = [
        ("vague-filler", F.col("vague"), n, tx.half_up(F.col("vague") / n * 100) / 10 > 1.5),
        ("unanchored-epics", F.col("unanchored"), n, (n >= 5) & (F.col("unanchored") / n > 0.3)),
        ("correction-heavy", F.col("corrections"), n, F.col("corrections") / n > 0.15),
        ("interrupt-heavy", F.col("aborted"), n, F.col("aborted") / n > 0.15),
        ("rapid-fire", F.col("fast"), F.col("gaps"), (F.col("gaps") >= 5) & (F.col("fast") / F.col("gaps") > 0.2)),
        ("night-owl", F.col("night"), n, (n >= 10) & (F.col("night") / n > 0.2)),
        # The value of :func:`ninetieth` is above 3000 if this many are.
        ("mega-prompts", F.col("mega"), n, F.col("mega") >= n - F.floor(n * 0.9)),
    ]
    rows = g.filter("n > 0").select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), a.alias("hits"), b.alias("of"), F.coalesce(cond, F.lit(False)).alias("tripped")) for r, a, b, cond in rules])).alias("x")).select("x.*")
    hit = rows.filter("tripped").select("rule", "hits", "of")
    none = rows.agg(F.count_if("tripped").alias("k")).filter("k = 0").select(F.lit("all-clear").alias("rule"), F.lit(0).cast("bigint").alias("hits"), F.lit(0).cast("bigint").alias("of"))
    return hit.unionByName(none)


def lint_examples(sig: DataFrame, most: int = 3) -> DataFrame:
    """``rule, place, example``: the first prompts (by session, step_idx, id) that speak for each tripped rule that quotes any."""
    # The rules that quote prompts, and which.
    quoted = {"vague-filler": F.col("vague") > 0, "unanchored-epics": unanchored(), "correction-heavy": F.col("corrected_by_next"), "interrupt-heavy": F.coalesce("aborted", F.lit(False))}
    order = ["session_id", "step_idx", "id"]
    out = None
    for rule, cond in quoted.items():
        # At most a few rows, so the array is bounded.
        top = sig.filter(cond).orderBy(*order).limit(most).agg(F.array_sort(F.collect_list(F.struct(*order, F.col("promptPreview").alias("example")))).alias("t"))
        rows = top.select(F.lit(rule).alias("rule"), F.posexplode("t").alias("place", "x")).select("rule", "place", "x.example")
        out = rows if out is None else out.unionByName(rows)
    return out.join(lints(sig).select("rule"), "rule", "left_semi")
