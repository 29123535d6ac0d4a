"""Sinks for small result frames: text, JSON, HTML, answer files and forked transcripts."""

from __future__ import annotations

import html
import json
import os
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a report shows; result frames of reports are small by design, and more is an error.
MOST_ROWS = 10_000


def rows_of(df: DataFrame) -> tuple[list[str], list[list]]:
    got = df.limit(MOST_ROWS + 1).collect()
    if len(got) > MOST_ROWS:
        raise ValueError(f"a report shows at most {MOST_ROWS} rows; write the frame as a table instead")
    return df.columns, [list(r) for r in got]


def cell(v) -> str:
    if v is None:
        return "—"
    if isinstance(v, bool):
        return "yes" if v else "no"
    if isinstance(v, int):
        return f"{v:,}"
    if isinstance(v, float):
        return f"{v:,.4f}".rstrip("0").rstrip(".")
    return str(v)


def text_table(df: DataFrame) -> str:
    """Columns padded to their widest cell under a rule of dashes."""
    head, rows = rows_of(df)
    cells = [head, *[[cell(v) for v in r] for r in rows]]
    width = [max(len(r[i]) for r in cells) for i in range(len(head))]
    line = lambda r: "  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip()
    return "\n".join([line(head), "  ".join("-" * w for w in width), *map(line, cells[1:])])


def as_json(df: DataFrame) -> str:
    head, rows = rows_of(df)
    return json.dumps([dict(zip(head, r)) for r in rows], ensure_ascii=False, default=str, indent=2)


def as_html(title: str, parts: list[tuple[str, DataFrame]]) -> str:
    """One self-contained page; columns of numbers are set to the right."""
    out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title>", "<style>body{font:15px/1.5 system-ui;margin:2rem auto;max-width:70rem}table{border-collapse:collapse}td,th{padding:.25rem .75rem;border-bottom:1px solid #ddd;text-align:left}.n{text-align:right}</style>", f"<h1>{html.escape(title)}</h1>"]
    for name, df in parts:
        head, rows = rows_of(df)
        num = [sum(isinstance(r[i], (int, float)) and not isinstance(r[i], bool) for r in rows) >= 0.6 * max(1, len(rows)) for i in range(len(head))]
        td = lambda tag, v, i: f"<{tag}{' class=n' if num[i] else ''}>{html.escape(v)}</{tag}>"
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(td('th', h, i) for i, h in enumerate(head))}</tr>")
        out.extend("<tr>" + "".join(td("td", cell(v), i) for i, v in enumerate(r)) + "</tr>" for r in rows)
        out.append("</table>")
    return "\n".join(out)


#: Most characters of an answer in the answer file.
ANSWER_CHARS = 1500


def merge_answers(existing: str | None, entries: list[dict]) -> tuple[str, int]:
    """Adds the entries whose key the file doesn't hold yet; what it holds stays byte for byte.

    An entry has key, question, answer and source. Returns the new text and
    the number of entries added.
    """
    known = set(re.findall(r"<!-- key:([0-9a-f]{12}) -->", existing or ""))
    fresh = []
    for e in entries:
        if e["key"] not in known:
            known.add(e["key"])
            a = e["answer"] if len(e["answer"]) <= ANSWER_CHARS else e["answer"][:ANSWER_CHARS] + "…"
            fresh.append(f"<!-- key:{e['key']} -->\n## {e['question']}\n\n{a}\n\n_From {e['source']}_\n")
    base = existing if existing is not None else "# Recurring questions\n"
    return (base.rstrip("\n") + "\n\n" if fresh and base and not base.endswith("\n\n") else base) + "\n".join(fresh), len(fresh)


def _listed(text: str) -> list:
    """The JSON list between the first ``[`` and the last ``]`` of a model's answer; raises ValueError without one."""
    a, b = text.find("["), text.rfind("]")
    got = json.loads(text[a : b + 1]) if 0 <= a < b else None
    if not isinstance(got, list):
        raise ValueError("the answer holds no list")
    return got


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def read_grades(text: str, known: set[str]) -> list[dict]:
    """The grades in a model's answer: objects with a known ``id`` and numbers ``clarity`` and ``context``; a ``tip`` that is no text is empty.

    Raises ValueError if the answer holds no list.
    """
    return [g | {"tip": g["tip"] if isinstance(g.get("tip"), str) else ""} for g in _listed(text) if isinstance(g, dict) and isinstance(g.get("id"), str) and g["id"] in known and _number(g.get("clarity")) and _number(g.get("context"))]


def grade_averages(spark: SparkSession, grades: list[dict]) -> DataFrame:
    """One row ``grades, avg_clarity, avg_context``: means to one place; null without grades."""
    rows = [(float(g["clarity"]), float(g["context"])) for g in grades]
    one = lambda c: (F.floor(F.avg(c) * 10 + 0.5) / 10).alias(f"avg_{c}")
    return spark.createDataFrame(rows, "clarity double, context double").agg(F.count("*").alias("grades"), one("clarity"), one("context"))


def read_themes(text: str) -> list[tuple[str, list[str]]]:
    """``theme, sessions`` (short ids) of a model's answer; what isn't of that form is left out."""
    return [(t["theme"], [x for x in t["sessions"] if isinstance(x, str)]) for t in _listed(text) if isinstance(t, dict) and isinstance(t.get("theme"), str) and isinstance(t.get("sessions"), list)]


def write_fork(kept: DataFrame, folder: str, old_id: str, raw: str = "raw", agent: str = "a") -> tuple[str, str, int, int]:
    """Writes the kept lines of one session as a new file under a new id.

    ``kept``: line_no and ``raw`` of one session. The old id is replaced
    where it stands as a JSON string. A format A fork takes a copy of the
    session's side folder (named by the old id) with it; a format B fork's
    meta line names the session that it was forked from. Returns id, path,
    lines written and files copied.
    """
    new_id = str(uuid.uuid4())
    path = os.path.join(folder, f"{new_id}.jsonl" if agent == "a" else f"rollout-fork-{new_id}.jsonl")
    n = 0
    with open(path, "w") as f:
        for r in kept.select("line_no", F.col(raw).alias("raw")).orderBy("line_no").toLocalIterator():
            line = r.raw.replace(f'"{old_id}"', f'"{new_id}"')
            if agent == "b":
                line = _as_fork(line, old_id, new_id)
            f.write(line + "\n")
            n += 1
    side, copied = os.path.join(folder, old_id), 0
    if agent == "a" and os.path.isdir(side):
        shutil.copytree(side, os.path.join(folder, new_id))
        copied = sum(len(files) for _, _, files in os.walk(side))
    return new_id, path, n, copied


def _as_fork(line: str, old_id: str, new_id: str) -> str:
    """A meta line with the new id and where it was forked from; any other line as it is."""
    if "session_meta" not in line:
        return line
    try:
        v = json.loads(line)
    except ValueError:
        return line
    if not isinstance(v, dict) or v.get("type") != "session_meta" or not isinstance(v.get("payload"), dict):
        return line
    v["payload"] |= {"id": new_id, "forked_from_id": old_id}
    return json.dumps(v, ensure_ascii=False)
