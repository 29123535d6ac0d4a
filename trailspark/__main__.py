"""``python -m trailspark COMMAND --a ROOT --b ROOT``: reports over transcript folders."""

from __future__ import annotations

import argparse
import os
import sys
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report
from .functions import text as tx
from .functions.times import micros
from .operators import cluster, facts, format_a, format_b, rollups, signals
from .session import build_session, materialize
from .sources import sidecars, transcripts

#: Files per scope unless ``--limit`` says otherwise.
SCOPES = {"prompter": 25, "distill": 50, "intents": 50, "models": 100, "project": 200, "efficacy": 200, "faq": 300, "analyze": None, "compare": None}
#: What the first prompt of a session that the engine itself started begins with.
SENTINEL = "[trailspark]"


def refs(spark: SparkSession, a: str | None, b: str | None, index: str | None = None) -> DataFrame:
    """The session files of both agents."""
    out = transcripts.list_a(spark, a or "/nonexistent").withColumn("title", F.lit(None).cast("string"))
    return out.unionByName(transcripts.list_b(spark, b or "/nonexistent", index))


class Scope:
    """The files of a report, read once: lines of both formats, facts by session, normalized steps and tool calls."""

    def __init__(self, spark: SparkSession, files: DataFrame, subagents: bool = False, repo: str | None = None) -> None:
        paths: dict[str, list[str]] = {"a": [], "b": []}
        for r in files.select("agent", "file_path").collect():  # bounded by the scope's limit of files
            paths[r.agent].append(r.file_path)
        if not paths["a"] and not paths["b"]:
            raise SystemExit("no session files in scope")
        empty = spark.createDataFrame([], "file_path string, line_no bigint, value variant, raw string")
        read = lambda p: transcripts.read_jsonl(spark, p) if p else empty
        self.records, self.codes = transcripts.records_a(read(paths["a"])), transcripts.lines_b(read(paths["b"]))
        la, lb = format_a.lines(self.records), format_b.lines(self.codes)
        kept = facts.without_internal(facts.facts(self.records, self.codes), SENTINEL)
        kept = kept if subagents else facts.without_subagents(kept)
        # Normalized tables are written once; every part of a report reads them.
        self.files = materialize(facts.in_repo(kept, repo) if repo else kept)
        self.facts = facts.by_session(self.files)
        only = self.files.select("file_path")
        self.rows_a, self.rows_b = format_a.in_steps(la.join(only, "file_path", "left_semi")), format_b.in_turns(lb.join(only, "file_path", "left_semi"))

    def _own(self, df: DataFrame) -> DataFrame:
        """A format B step carries its file; facts name the session."""
        named = self.files.filter("agent = 'b'").select(F.col("file_path").alias("_f"), F.col("session_id").alias("_s"))
        return df.join(named, F.col("session_id") == F.col("_f"), "left").withColumn("session_id", F.coalesce("_s", "session_id")).drop("_f", "_s")

    @cached_property
    def steps(self) -> DataFrame:
        return materialize(format_a.steps_table(self.rows_a).unionByName(self._own(format_b.steps_table(self.rows_b))))

    @cached_property
    def calls(self) -> DataFrame:
        return materialize(rollups.calls_once(format_a.calls_table(self.rows_a).unionByName(self._own(format_b.calls_table(self.rows_b)))))

    @cached_property
    def once(self) -> DataFrame:
        return signals.once(self.steps).withColumn("us", micros(F.col("timestamp")))

    def signals(self) -> DataFrame:
        return signals.signals(self.steps)

    def stats(self) -> DataFrame:
        return self.signals().groupBy("session_id").agg(F.count("*").alias("prompts"), F.count_if("is_correction").alias("corrections"), F.sum("chars").alias("prompt_chars"), F.sum("specificity").alias("specificity_sum"), F.sum("vague").alias("vague"), F.median("gap_ms").alias("median_gap_ms"))

    def workflow(self) -> DataFrame:
        return facts.workflow(self.facts, rollups.workflow(self.calls))

    def answers(self) -> DataFrame:
        """``id, answer`` of each step of either format."""
        a = format_a.responses(self.rows_a).join(format_a.steps(self.rows_a).select("file_path", "step_idx", F.col("step_id").alias("id")), ["file_path", "step_idx"])
        b = format_b.responses(self.rows_b).join(format_b.turns(self.rows_b).select("file_path", "turn_idx", F.concat_ws("#", "file_path", "turn_id").alias("id")), ["file_path", "turn_idx"])
        both = a.select(F.lower("id").alias("id"), F.col("response").alias("answer")).unionByName(b.select(F.lower("id").alias("id"), F.col("response").alias("answer")))
        return both.groupBy("id").agg(F.min("answer").alias("answer"))


def reports(name: str, s: Scope, args: argparse.Namespace) -> list[tuple[str, DataFrame]]:
    """The named parts of a report."""
    spark = s.records.sparkSession
    if name == "compare":
        pick = spark.createDataFrame([("a", args.id), ("b", args.other)], "side string, session_id string")
        return [("comparison", facts.compared(s.facts, pick).orderBy("metric"))]
    if name == "analyze":
        f = s.facts.withColumn("duration_ms", facts.duration_ms())
        return [("sessions", f.orderBy("session_id")), ("tools", rollups.tool_stats(s.calls).orderBy(F.desc("calls"), "name")), ("volume", facts.volume_shares(s.files))]
    if name == "distill":
        seq = rollups.tool_sequences(s.calls).withColumn("sequence", F.array_join("sequence", " > "))
        found = cluster.clusters(s.signals())
        # What is reported is capped by kind.
        caps = {"directive": 15, "question": 15, "correction": 10}
        parts = [found.filter(F.col("kind") == k).orderBy(F.desc("members"), "leader_id").limit(n) for k, n in caps.items()]
        return [("recurring prompts", parts[0].unionByName(parts[1]).unionByName(parts[2])), ("tool sequences", seq.orderBy(F.desc(F.col("count") * F.col("n")), "sequence").limit(12))]
    if name == "faq":
        q = cluster.examples(s.signals().filter("is_question and not is_correction"), s.answers()).filter("answer is not null")
        keyed = q.join(s.steps.select(F.col("id").alias("_i"), "promptText"), F.col("leader_id") == F.col("_i")).select(tx.question_key(F.col("promptText")).alias("key"), tx.preview(F.col("promptText"), 200).alias("question"), "answer", F.col("session_id").alias("source"))
        return [("questions", keyed.orderBy("question"))]
    if name == "intents":
        first = rollups.first_prompts(s.once)
        parts = [("intents", first.groupBy("intent").agg(F.count("*").alias("sessions")).orderBy(F.desc("sessions"), "intent"))]
        if args.themes:
            with open(args.themes) as f:
                themes = report.read_themes(f.read())
            parts.append(("themes", facts.themes_of(s.facts, spark.createDataFrame(themes, "theme string, sessions array<string>")).orderBy("theme", "session_id")))
        return parts
    if name == "models":
        m = facts.model_files(s.records, s.codes, s.files)
        weekly = m.filter("week is not null").groupBy("week", "model").agg(F.sum("api_calls").alias("calls"))
        parts = [("models", facts.model_stats(m).orderBy("agent", F.desc("api_calls"))), ("weeks", weekly.orderBy(F.desc("week"), F.desc("calls"), "model").limit(40))]
        if args.cache:
            parts.append(("history", facts.daily_history(sidecars.usage_cache(spark, args.cache).groupBy(F.col("date").alias("day")).agg(F.map_from_entries(F.collect_list(F.struct("model", "tokens"))).alias("tokens_by_model"))).orderBy(F.desc("tokens"))))
        return parts
    if name == "efficacy":
        changes = sidecars.instruction_changes(spark, args.repo or ".", args.files.split(",")).select(F.concat_ws(" ", "file", F.substring("commit", 1, 8)).alias("change_id"), micros(F.col("date")).alias("t"))
        return [("efficacy", rollups.efficacy(changes, facts.steering_samples(s.facts, s.stats()), args.window).orderBy("change_id", F.desc("side")))]
    if name == "project":
        files = sidecars.instruction_files(spark, args.repo or ".", args.files.split(","))
        return [
            ("projects", facts.project_report(s.facts, s.stats().select("session_id", "corrections")).orderBy("cwd")), ("workflow", s.workflow().orderBy("session_id")), ("servers", rollups.server_stats(s.calls).orderBy(F.desc("calls"), "mcpServer")),
            ("tools", rollups.tool_stats(s.calls).orderBy(F.desc("calls"), "name").limit(12)), ("recent", s.facts.select("agent", "session_id", "title", "started_raw", "steps", "total_tokens").orderBy(F.desc_nulls_last("started_raw"), "session_id").limit(10)), ("instructions", files),
        ]
    sig = s.signals()
    metrics = facts.session_metrics(s.facts, s.stats())
    w = s.workflow()
    return [("totals", facts.aggregate(metrics)), ("weeks", signals.weekly(sig).orderBy(F.desc("week")).limit(10)), ("rules tripped", signals.lints(sig)), ("workflow", facts.workflow_totals(w)), ("workflow rules tripped", facts.workflow_lints(w))]


def fork(spark: SparkSession, found: DataFrame, args: argparse.Namespace) -> str:
    """Writes the session up to a step as a new file beside the old one."""
    try:
        sid = transcripts.find(found, args.id or "")
    except ValueError as e:
        raise SystemExit(str(e)) from None
    if sid is None:
        raise SystemExit(f"no session {args.id}")
    ref = found.filter(F.col("session_id") == sid).orderBy("file_path").first()
    lines = transcripts.read_jsonl(spark, ref.file_path)
    anchor = spark.createDataFrame([(ref.file_path, args.at)], "file_path string, step_idx long")
    if ref.agent == "a":
        rows = format_a.in_steps(format_a.lines(transcripts.records_a(lines)))
        if args.step:
            named = format_a.steps(rows).filter(F.col("step_id") == args.step).select("file_path", "step_idx")
            if named.isEmpty():
                raise SystemExit(f"session {sid} has no step {args.step}")
            anchor = named
        kept = format_a.fork(rows, anchor).filter("kept").select("line_no")
    else:
        rows = format_b.in_turns(format_b.lines(transcripts.lines_b(lines))).select("file_path", "line_no", "turn_idx")
        here = not rows.filter(F.col("turn_idx") == args.at).isEmpty()
        kept = rows.filter(F.coalesce(F.col("turn_idx") <= args.at, F.lit(True)) if here else F.lit(False)).select("line_no")
    if kept.isEmpty():
        raise SystemExit(f"session {sid} has no step {args.at}")
    total = lines.count()
    new, to, n, copied = report.write_fork(lines.join(kept, "line_no"), ref.file_path.removeprefix("file:").rpartition("/")[0], sid, agent=ref.agent)
    return f"{new}: {n} lines kept, {total - n} dropped, {copied} files copied in {to}"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="trailspark", description=__doc__)
    p.add_argument("command", choices=["list", "fork", *SCOPES])
    p.add_argument("--a", default=os.environ.get("TRAILSPARK_A"), help="root of format A transcripts (or TRAILSPARK_A)")
    p.add_argument("--b", default=os.environ.get("TRAILSPARK_B"), help="root of format B transcripts (or TRAILSPARK_B)")
    p.add_argument("--index", help="session index of format B")
    p.add_argument("--agent", default="all")
    p.add_argument("--since", help="such as 30d, or a date")
    p.add_argument("--limit", type=int)
    p.add_argument("--largest", type=int, default=transcripts.LARGEST, help="bytes beyond which a file is skipped (and reported)")
    p.add_argument("--include-subagents", action="store_true", help="keep sessions that agents started")
    p.add_argument("--id", help="session id or prefix")
    p.add_argument("--other", help="second session of compare")
    p.add_argument("--at", type=int, default=0, help="step at which fork cuts")
    p.add_argument("--step", help="id of the step at which fork cuts (format A)")
    p.add_argument("--repo", help="folder to which sessions are limited; its instruction files are read")
    p.add_argument("--files", default="AGENTS.md,CLAUDE.md", help="instruction files, by comma")
    p.add_argument("--window", type=int, default=10, help="sessions on each side of a change")
    p.add_argument("--themes", help="file with a model's themes")
    p.add_argument("--cache", help="usage cache with tokens by day")
    p.add_argument("--out", help="answer file that faq adds to")
    p.add_argument("--json", action="store_true")
    p.add_argument("--html", help="file to write a page to")
    args = p.parse_args(argv)
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    found = refs(spark, args.a, args.b, args.index)
    if args.command == "list":
        one = [transcripts.in_scope(found, g, args.since, args.limit or 15) for g in (["a", "b"] if args.agent == "all" else [args.agent])]
        shown = (one[0] if len(one) == 1 else one[0].unionByName(one[1])).orderBy(F.desc_nulls_last("updated_at"), "session_id")
        parts = [("sessions", shown.select("agent", tx.short_id(F.col("session_id")).alias("id"), "title", "updated_at", "size_bytes"))]
    elif args.command == "fork":
        print(fork(spark, found, args))
        return 0
    else:
        scope = transcripts.in_scope(found, args.agent, args.since, args.limit or SCOPES[args.command], None)
        if args.command in ("analyze", "compare") and (args.id or args.command == "compare"):
            try:
                ids = [transcripts.find(found, x or "") for x in ((args.id, args.other) if args.command == "compare" else (args.id,))]
            except ValueError as e:
                raise SystemExit(str(e)) from None
            if None in ids:
                raise SystemExit("no such session")
            args.id, args.other = ids[0], ids[-1]
            scope = found.filter(F.col("session_id").isin(ids))
        skipped = scope.filter(F.col("size_bytes") > args.largest).count()
        if skipped:
            print(f"{skipped} files of more than {args.largest} bytes skipped", file=sys.stderr)
        parts = reports(args.command, Scope(spark, scope.filter(F.col("size_bytes") <= args.largest), args.include_subagents or bool(args.id), args.repo if args.command in ("project", "efficacy", "faq", "intents") else None), args)
        if args.command == "faq" and args.out:
            old = open(args.out).read() if os.path.exists(args.out) else None
            new, n = report.merge_answers(old, [r.asDict() for r in parts[0][1].collect()])
            with open(args.out, "w") as f:
                f.write(new)
            print(f"{n} answers added to {args.out}", file=sys.stderr)
    if args.html:
        with open(args.html, "w") as f:
            f.write(report.as_html(f"trailspark {args.command}", parts))
    elif args.json:
        print("{" + ",\n".join(f'"{n}": {report.as_json(d)}' for n, d in parts) + "}")
    else:
        print("\n\n".join(f"{n}\n{report.text_table(d)}" for n, d in parts))
    return 0


if __name__ == "__main__":
    sys.exit(main())
