"""Plain versions of the general operators, for comparison on small inputs."""

from __future__ import annotations

import json
from collections import defaultdict


def drift(rows):
    """rows: (file_id, machine, exported_at, raw) -> set of (file_id, change, old, new)."""
    kinds = {str: "string", bool: "boolean", int: "number", float: "number", list: "array", dict: "object"}
    files, head = {}, {}

    def enter(o, base, into):
        for k, v in o.items():
            if v is None:
                continue
            p = f"{base}.{k}" if base else k
            into[p][0].add(kinds[type(v)])
            if isinstance(v, str):
                into[p][1].add(v)
            if isinstance(v, dict):
                enter(v, p, into)

    for fid, machine, at, raw in rows:
        try:
            o = json.loads(raw)
        except (TypeError, ValueError):
            continue
        if not isinstance(o, dict):
            continue
        head[fid] = (machine, at)
        enter(o, "", files.setdefault(fid, defaultdict(lambda: (set(), set()))))
    out = set()
    by = defaultdict(list)
    for fid, (m, at) in head.items():
        by[m].append((at, fid))
    for seq in by.values():
        seq.sort()
        for (_, a), (_, b) in zip(seq, seq[1:]):
            A, B = files[a], files[b]
            out |= {(b, "retyped", p, p) for p in A.keys() & B.keys() if A[p][0] != B[p][0]}
            gone, new = sorted(A.keys() - B.keys()), sorted(B.keys() - A.keys())
            for rule in (1, 2):
                for g in list(gone):
                    for n in new:
                        if g.rpartition(".")[0] != n.rpartition(".")[0] or A[g][0] != B[n][0]:
                            continue
                        bare = lambda p: p.rpartition(".")[2].lower().replace("_", "").replace("-", "")
                        if bare(g) == bare(n) if rule == 1 else A[g][0] == {"string"} and A[g][1] == B[n][1]:
                            out.add((b, "renamed", g, n))
                            gone.remove(g)
                            new.remove(n)
                            break
            out |= {(b, "removed", g, "") for g in gone} | {(b, "added", "", n) for n in new}
    return out
