"""Small files beside the transcripts: usage cache, change logs, installed commands, settings."""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def usage_cache(spark: SparkSession, path: str) -> DataFrame:
    """``date, model, tokens`` of a usage cache; a missing or unreadable file has no row."""
    kind = "dailyModelTokens array<struct<date:string,tokensByModel:map<string,bigint>>>"
    if not os.path.exists(path):
        return spark.createDataFrame([], "date string, model string, tokens bigint")
    doc = spark.read.schema(kind).option("multiLine", True).json(path)
    return doc.select(F.explode("dailyModelTokens").alias("d")).select("d.date", F.explode("d.tokensByModel").alias("model", "tokens"))


def git_trace(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The trace lines of these project folders; folders without one are skipped."""
    kind = "ts string, event string, session_id string, head string, branch string, dirty_files int"
    paths = [p for f in folders if os.path.exists(p := os.path.join(f, "git-trace.jsonl"))]
    return spark.read.schema(kind).json(paths) if paths else spark.createDataFrame([], kind)


def git_log(repo: str, file: str) -> str:
    got = subprocess.run(["git", "-C", repo, "log", "--follow", "--format=%H|%cI|%s", "--", file], capture_output=True, text=True)
    return got.stdout if got.returncode == 0 else ""


def instruction_changes(spark: SparkSession, repo: str, files: list[str], log: Callable[[str, str], str] = git_log) -> DataFrame:
    """``file, commit, date, subject`` of the changes to instruction files; a subject may hold ``|``."""
    rows = []
    for f in files:
        for line in log(repo, f).splitlines():
            parts = line.split("|", 2)
            if len(parts) >= 2 and parts[0] and parts[1]:
                rows.append((f, parts[0], parts[1], parts[2] if len(parts) > 2 else ""))
    return spark.createDataFrame(rows, "file string, commit string, date string, subject string").orderBy("date", "commit")


def instruction_files(spark: SparkSession, repo: str, files: list[str], log: Callable[[str, str], str] = git_log) -> DataFrame:
    """Whether each file is there, its size and time of change, and how many commits touched it."""
    rows = []
    for f in files:
        p = os.path.join(repo, f)
        there = os.path.exists(p)
        try:
            commits = len([x for x in log(repo, f).splitlines() if x.strip()])
        except (OSError, ValueError):
            commits = 0
        rows.append((f, there, os.path.getsize(p) if there and os.path.isfile(p) else None, os.path.getmtime(p) if there else None, commits))
    return spark.createDataFrame(rows, "file string, present boolean, size_bytes bigint, changed double, commits bigint").withColumn("changed", F.timestamp_seconds("changed"))


def installed_commands(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``name`` of each skill folder, command file and plugin under the roots, and of what plugins install, once.

    A plugin stands in ``plugins/installed_plugins.json`` as ``name@source``,
    with the folders that it is installed in.
    """
    names: set[str] = set()

    def listed(root: str) -> None:
        for sub, ending in (("skills", ""), ("commands", ".md")):
            folder = os.path.join(root, sub)
            if os.path.isdir(folder):
                names.update(n.removesuffix(ending) for n in os.listdir(folder) if n.endswith(ending) and not n.startswith("."))

    for root in roots:
        listed(root)
        try:
            with open(os.path.join(root, "plugins", "installed_plugins.json")) as f:
                plugins = json.load(f).get("plugins", {})
        except (OSError, ValueError, AttributeError):
            continue
        for name, entries in plugins.items() if isinstance(plugins, dict) else ():
            names.add(name.partition("@")[0])
            for e in entries if isinstance(entries, list) else [entries]:
                if isinstance(e, dict) and isinstance(e.get("installPath"), str):
                    listed(e["installPath"])
    return spark.createDataFrame([(n,) for n in sorted(names)], "name string")


def retention_days(settings: str, default: int = 30) -> int:
    """How long transcripts are kept, by the settings file."""
    try:
        with open(settings) as f:
            v = json.load(f).get("cleanupPeriodDays")
        return v if isinstance(v, int) and not isinstance(v, bool) else default
    except (OSError, ValueError, AttributeError):
        return default
