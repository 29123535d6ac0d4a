"""Credentials embedded in code, configuration and prose: finding and redacting.

Text is parsed into key paths with offsets: JSON by its members; other text
by its assignments (env, properties, INI, TOML, YAML, code), whose keys
stand below the sections, mappings and list entries that their lines lie in;
and by forms that imply a key (command options, headers, URLs, netrc, PEM,
prose). Text that only begins like JSON is read both ways. A value is taken
when the path of its key is sensitive and its shape is that of a literal, or
when its shape alone is that of a known token. Offsets point into the
original text, so a redaction is spliced in without touching anything else.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUT = "…"
#: What a redaction writes: safe inside quotes, JSON, URLs and shell words.
REDACTED = "REDACTED"

# Last words of a key that holds something a person chooses and types.
PASSWORDS = {"password", "passwd", "passwort", "pwd", "pass", "passphrase", "passcode", "kennwort", "contraseña", "clave"}
# Last words of a key that holds a credential of any kind.
SENSITIVE = PASSWORDS | {"secret", "token", "apikey", "credential", "credentials", "cookie"}
# Words before "key" that make it no credential.
PLAIN_KEYS = {"public", "primary", "foreign", "sort", "cache", "partition", "group", "map", "index", "row", "object", "hash", "lookup", "host", "pub", "key", "translation", "idempotency"}
# Keys that say nothing themselves: the one above, or the entry's name, tells what they hold.
NEUTRAL = {"value", "val", "default", "plain", "plaintext", "raw", "current", "content"}
NAMING = {"name", "key"}
# Starts of references and calls, for values that are no literals.
REFERENCES = ("os.environ[", "os.environ.get(", "os.getenv(", "process.env.", "get_token(", "getenv(", "System.getenv(", "ENV[", "env.", "vault.", "vault:", "secrets.", "self.", "this.", "config.", "config[", "settings.", "args.", "${", "$(", "{{", "<", "%(", "REPLACE_ME", "CHANGE_ME", "CHANGEME", "YOUR_", "your-", "your_", "xxxx", "XXXX", "****", "...")
# Words that stand in for a value, or tell its type or state.
STAND_INS = re.compile(
    r"(?i)^(example|dummy|placeholder|redacted|none|null|nil|true|false|undefined|todo|tbd|n/a|empty|required|optional|string|str|text|varchar|bool|boolean|number|int|integer|bytes|any|object|secretstr"
    r"|secret|password|token|changeme|change_me|replace_me|your[-_].*|replace[-_].*|hidden|masked|protected|enabled|disabled|missing|unset|invalid|incorrect|wrong|valid|yes|no|on|off|same|unchanged|prompt|file|env|vault)$"
)
#: Signs that mask a value.
MASKS = set("*x.•#-_?…")

PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*(?:(PRIVATE KEY)|PUBLIC KEY|CERTIFICATE)-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*(?:(PRIVATE KEY)|PUBLIC KEY|CERTIFICATE)-----")
# Shapes of known tokens: prefix, rest, least length of the rest.
KNOWN = re.compile(
    r"(?<![A-Za-z0-9_/+-])(?:"
    r"gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{16,}|xox[abeoprs]-[A-Za-z0-9-]{10,}"
    r"|sk-(?:[a-z]+-)?[A-Za-z0-9_-]{20,}|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|AIza[A-Za-z0-9_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,}"
    r"|(?:gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|sk-|AKIA|ASIA|AIza|eyJ)[A-Za-z0-9_.-]+(?=…\s*$))"
)
#: A key and the sign after it. A value may itself begin with a key ("use this: PASSWORD=..."), so it isn't part of the match.
KEY = re.compile(r"""(?<![\w.-])(?P<name>[\w.-]+)["'`]?\]?[ \t]*(?P<sep>:=|=>|=(?![=~])|:(?![:/]))[ \t]*""")
VALUE = re.compile(r"""(?P<q>\"\"\"|'''|["'`])(?P<qv>.*?)(?:(?P=q)|(?P<qcut>…\s*$)|$)|(?P<uv>[^\s"'`,;…)\]}&|\\]+)(?P<ucut>…\s*$)?""", re.M)
BLOCK = re.compile(r"[|>][+-]?[ \t]*\n(?P<indent>[ \t]+)(?P<v>[^\s…]+)(?P<cut>…\s*\Z)?[ \t]*(?=\n|\Z)")
OPTION = re.compile(r"""(?<![\w-])--(?P<name>[A-Za-z][\w-]*)[ \t]+(?:(?P<q>["'])(?P<qv>[^"'\n]*?)(?:(?P=q)|(?P<qcut>…\s*$))|(?P<uv>[^\s"'`…-][^\s"'`…]*)(?P<ucut>…\s*$)?)""", re.M)
URL = re.compile(r"""(?<=[A-Za-z0-9+.-])://[^\s/:@"'`<>]*:(?P<v>[^\s/@"'`<>]+)(?:@|(?P<cut>…\s*$))""")
AUTH = re.compile(r"""(?i)\bauthorization["']?\s*[:=]\s*["']?(?:bearer|basic|token|digest|apikey)\s+(?P<v>[A-Za-z0-9._~+/=-]+)(?P<cut>…\s*$)?""")
USER = re.compile(r"""(?:^|\s)(?:-u|--user)[ \t=]+["']?[^\s:"']+:(?P<v>[^\s"'…]+)(?P<cut>…\s*$)?""", re.M)
SHORT = re.compile(r"""\s-p[ \t]+["']?(?P<v>[^\s"'…]+)(?P<cut>…\s*$)?""")
NETRC = re.compile(r"""\blogin[ \t]+\S+[ \t]+password[ \t]+(?P<v>[^\s…]+)(?P<cut>…\s*$)?""")
PROSE = re.compile(
    r"""(?i)\b(?P<name>password|passwort|passphrase|kennwort|contraseña|clave|token|secret|api key|pwd)\s+(?:is|ist|lautet|es|was|war|=)\s+["'`]?(?P<v>[^\s"'`…]+)(?P<cut>…\s*$)?"""
)
AFTER = re.compile(r"""(?i)\s\((?:that|this|which|das|dies|eso)\s+(?:is|ist|es)\s+(?:the|das|la)\s+(?:password|passwort|contraseña|token|secret)\)""")
#: A text without any of these, in lower case, holds no case: each form above needs one of them, and each sensitive key does.
HINTS = tuple(w for w in sorted({*SENSITIVE, "pass", "key", "authorization", "://", "login", "-u", "-----begin", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "sk-", "akia", "asia", "aiza", "eyj"}) if w == "pass" or "pass" not in w)


def hinted(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in HINTS)


#: Lines that give structure: a section, or a key with its indent and list signs.
LINE = re.compile(r"""^(?P<indent>[ \t]*(?:-[ \t]+)*)(?:(?:export[ \t]+)?(?P<q>["']?)(?P<key>[\w.-]+)(?P=q)[ \t]*[:=]|\[\[?[ \t]*(?P<section>[^\[\]\n]+?)[ \t]*\]\]?[ \t]*$)""", re.M)

_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+")


@lru_cache(maxsize=100_000)
def kind_of(name: str) -> str | None:
    """What a key of this name holds, judged by its last words: ``password``, another ``secret``, ``neutral`` or nothing of either."""
    words = [w.lower() for w in _WORD.findall(name.replace("-", "_"))]
    if not words:
        return None
    last = words[-1]
    two = "".join(words[-2:])
    if last in PASSWORDS or two in PASSWORDS:
        return "password"
    if last in SENSITIVE or words[-3:] == ["access", "key", "id"] or (last == "key" and len(words) > 1 and words[-2] not in PLAIN_KEYS):
        return "secret"
    return "neutral" if last in NEUTRAL and len(words) == 1 else None


def path_kind(path: tuple[str, ...] | list[str]) -> str | None:
    """What the last key of a path holds; a neutral one takes after the nearest that isn't."""
    for name in reversed(path):
        k = kind_of(name)
        if k != "neutral":
            return k
    return None


def literal(v: str, kind: str, quoted: bool, cut: bool, bare: bool = False, code: bool = False) -> bool:
    """Whether a value is a literal credential, not a placeholder, mask, reference or plain word.

    ``kind``: that of the key. ``cut``: the value was cut off. ``bare``: it
    is all that stands after the key on a line of configuration. ``code``: it
    stands unquoted behind a declaration, where only calls and names stand.
    """
    if not v or v.startswith(REFERENCES) or STAND_INS.match(v):
        return False
    if (len(set(v.lower())) < 2 or set(v.lower()) <= MASKS) and not (cut and len(v) < 3):
        return False
    if cut and any(r.startswith(v) for r in REFERENCES):
        return False
    if code and not quoted:
        return False
    if not quoted and (re.match(r"[\w.]+[\[(]", v) or v[0] in "$<{(%*["):
        return False
    if re.fullmatch(r"\d+(\.\d+)+", v):
        return False
    has_digit = any(c.isdigit() for c in v)
    plain = v.replace("_", "").replace("-", "").replace(".", "").isalpha()
    if cut and not v.isdigit():
        return has_digit or not plain or not v.islower() or quoted
    if re.search(r"\s", v):
        return False
    if kind == "password":
        # A word is one where nothing but the value can stand.
        return len(v) >= 4 and (quoted or bare or not plain)
    if v.isdigit() or len(v) < 6:
        return False
    if plain and not has_digit:
        return len(v) >= 16 and not v.islower() and not v.isupper() and (quoted or bare)
    return True


def structure(text: str) -> tuple[list[int], list[tuple[str, ...]], dict[int, str]]:
    """Starts of the lines with a key or section, the keys each lies in (its own last), and by its path the ``name`` of an entry.

    A section (INI, TOML) holds all lines up to the next one; a mapping (YAML)
    those indented more. A list sign counts as indent.
    """
    starts: list[int] = []
    paths: list[tuple[str, ...]] = []
    named: dict[int, str] = {}
    section: tuple[str, ...] = ()
    stack: list[tuple[int, str, int]] = []  # indent, key, number of the entry
    entry = 0
    for m in LINE.finditer(text):
        if m["section"] is not None:
            section, stack = tuple(re.split(r"[.\s\"']+", m["section"])), []
            starts.append(m.start())
            paths.append(section)
            continue
        depth = len(m["indent"].expandtabs(8))
        while stack and stack[-1][0] >= depth:
            stack.pop()
        if "-" in m["indent"] or not stack:
            entry += 1
        own = entry
        starts.append(m.start())
        paths.append((*section, *(k for _, k, _ in stack), m["key"]))
        if m["key"].lower() in NAMING and (v := VALUE.match(text, m.end() + len(re.match(r"[ \t]*", text[m.end() : m.end() + 80])[0]))):
            named[own] = v["qv"] if v["q"] else v["uv"] or ""
        stack.append((depth, m["key"], own))
        named[-m.start() - 1] = str(own)
    return starts, paths, named


class _Spans:
    """Places taken so far, without overlaps; kept in order."""

    def __init__(self) -> None:
        self.taken: list[tuple[int, int]] = []
        self.found: list[tuple[int, int, str]] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.taken, (a, a))
        return not (i and self.taken[i - 1][1] > a) and not (i < len(self.taken) and self.taken[i][0] < b)

    def put(self, a: int, b: int, key: str | None) -> None:
        if a < b and self.free(a, b):
            insort(self.taken, (a, b))
            if key is not None:
                self.found.append((a, b, key))


def _blocks(text: str, s: _Spans) -> None:
    """Private key blocks are finds; public ones and certificates are set aside, so that nothing in them is taken for a value."""
    at = 0
    while m := PEM.search(text, at):
        end = PEM_END.search(text, m.end())
        cut = re.search(r"…\s*\Z", text) if end is None else None
        b = end.end() if end else cut.start() if cut else len(text) if not m[1] else m.end()
        if m[1] and (end or cut):
            s.put(m.start(), b, "private key")
        elif not m[1]:
            s.put(m.start(), b, None)
        at = b


def _assignments(text: str, s: _Spans) -> None:
    lines = None
    for m in KEY.finditer(text):
        name = m["name"]
        kind = kind_of(name)
        if kind is None:
            continue
        start = m.end()
        if kind == "neutral":
            # What the line lies in tells; looked at only where it can matter.
            lines = lines or structure(text)
            line = text.rfind("\n", 0, m.start()) + 1
            i = bisect_left(lines[0], line)
            if i == len(lines[0]) or lines[0][i] != line or not text[line : m.start()].strip(" \t-\"'") == "":
                continue
            kind = path_kind(lines[1][i][:-1]) or kind_of(lines[2].get(int(lines[2].get(-line - 1, 0)), ""))
            name = ".".join(lines[1][i])
            if kind not in ("password", "secret"):
                continue
        if block := BLOCK.match(text, start):
            if literal(block["v"], kind, False, block["cut"] is not None, True):
                s.put(*block.span("v"), name)
            continue
        v = VALUE.match(text, start)
        if v is None:
            continue
        quoted = v["q"] is not None
        value, cut = (v["qv"], v["qcut"] is not None) if quoted else (v["uv"], v["ucut"] is not None)
        head = text[text.rfind("\n", max(0, m.start() - 40), m.start()) + 1 if "\n" in text[max(0, m.start() - 40) : m.start()] else max(0, m.start() - 40) : m.start()]
        code = bool(re.search(r"\b(?:const|let|var|val|final)\s+$", head))
        # Spaces around an equals sign are code's way, unless a section says otherwise.
        alone = re.match(r"[ \t]*(?:\r?\n|\Z|#)", text[v.end() : v.end() + 80]) is not None and re.fullmatch(r"[ \t]*(?:-[ \t]+)*(?:export[ \t]+|env[ \t]+|(?:[\w.-]+[ \t]+)?)?", head) is not None
        spaced = m["sep"] == "=" and text[start - 1 : start] in (" ", "\t")
        bare = alone and (not spaced or bool(re.search(r"(?m)^\[[^\]\n]+\][ \t]*$", text[: m.start()])))
        if value and not value.startswith("-----BEGIN") and literal(value, kind, quoted, cut, bare, code):
            s.put(*v.span("qv" if quoted else "uv"), name)


def spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, key)`` of the credentials of a plain text, without overlaps."""
    s = _Spans()
    if "-----BEGIN" in text:
        _blocks(text, s)
    for pattern, key in ((AUTH, "authorization"), (URL, "url"), (USER, "user"), (NETRC, "netrc"), (SHORT, "login")):
        for m in pattern.finditer(text):
            v = m["v"]
            if key == "login":  # of a login command only
                line = max(text.rfind(c, 0, m.start()) for c in "\n|;") + 1
                if not re.search(r"\blogin\b", text[line : m.start()]):
                    continue
            if not v.startswith(REFERENCES) and not STAND_INS.match(v) and not (set(v.lower()) <= MASKS and not m["cut"]):
                s.put(*m.span("v"), key)
    _assignments(text, s)
    for m in OPTION.finditer(text):
        if kind := {"password": "password", "secret": "secret"}.get(kind_of(m["name"])):
            quoted = m["q"] is not None
            v, cut = (m["qv"], m["qcut"] is not None) if quoted else (m["uv"], m["ucut"] is not None)
            if literal(v, kind, quoted, cut, True):
                s.put(*m.span("qv" if quoted else "uv"), m["name"])
    for m in KNOWN.finditer(text):
        s.put(*m.span(), "known shape")
    for m in PROSE.finditer(text):
        v = m["v"]
        a, b = m.span("v")
        if m["cut"] is None:
            while v and v[-1] in ".,;:!?)":
                v, b = v[:-1], b - 1
        if literal(v, kind_of(m["name"]) or "secret", False, m["cut"] is not None):
            s.put(a, b, "prose")
    for m in AFTER.finditer(text):
        b = m.start()  # the word before the remark
        a = b
        while a and text[a - 1] not in " \t\n\"'`(/":
            a -= 1
        if literal(text[a:b], "password", False, False):
            s.put(a, b, "prose")
    return sorted(s.found)


TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[{}\[\]:,]', re.S)
ESCAPE = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def unescape(raw: str) -> tuple[str, list[int]]:
    """The text of a JSON string's inside, and for each character where it starts in ``raw`` (plus the end)."""
    out, at, i, n = [], [], 0, len(raw)
    while i < n:
        at.append(i)
        c = raw[i]
        if c == "\\" and i + 1 < n:
            e = raw[i + 1]
            if e == "u" and re.match(r"[0-9a-fA-F]{4}", raw[i + 2 : i + 6]):
                out.append(chr(int(raw[i + 2 : i + 6], 16)))
                i += 6
            else:
                out.append(ESCAPE.get(e, e))
                i += 2
        else:
            out.append(c)
            i += 1
    at.append(n)
    return "".join(out), at


def json_strings(text: str) -> Iterator[tuple[str, int, int]]:
    """``(key path, start, end)`` of the inside of each string value of a JSON text, cut-off text included."""
    path: list = []
    stack: list[bool] = []  # is an object
    key, pending = None, None
    for m in TOKEN.finditer(text):
        t = m.group()
        if t[0] == '"':
            if pending is not None:
                yield pending
            pending = (".".join(x for x in [*path, key] if x), m.start() + 1, m.end() - (len(t) > 1 and t[-1] == '"'))
        elif t == ":":
            if pending is not None:
                key, pending = text[pending[1] : pending[2]], None
        elif t in "{[":
            stack.append(t == "{")
            path.append(key or "")
            key = None
        else:
            if pending is not None:
                yield pending
                pending = None
            if t in "}]" and stack:
                stack.pop()
                key = path.pop()
            if t == "," and stack and stack[-1]:
                key = None
    if pending is not None:
        yield pending


_BLANKS = re.compile(r"\s*")
_DECODER = json.JSONDecoder(strict=False)
_PIECE = re.compile(r'\s*("(?:[^"\\]|\\.)*"|[{}\[\]:,]|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|(?:true|false|null)\b)', re.S)
#: What a cut may leave of a string, number or word, up to the end of the text.
_CUT_PIECE = re.compile(r'\s*(?:"(?:[^"\\]|\\.)*\\?|[-+\d.eE]*(?:…\s*)?|(?:t|tr|tru|true|f|fa|fal|fals|false|n|nu|nul|null)(?:…\s*)?|…\s*)\Z', re.S)


def json_end(text: str, start: int = 0) -> int:
    """Where the JSON object or array at ``start`` ends: the end of the text if it was cut off, ``start`` if it is none."""
    try:
        return _DECODER.raw_decode(text, start)[1]
    except (ValueError, RecursionError):  # cut, nested deeply, or no JSON
        pass
    stack: list[str] = []
    want, at = "value", start  # or "first" (of an array), "key", "key1", "colon", "next"
    while m := _PIECE.match(text, at):
        t, at = m[1], m.end()
        if want in ("value", "first") and t not in ("}", "]", ":", ","):
            if t in ("{", "["):
                stack.append(t)
                want = "key1" if t == "{" else "first"
            else:
                want = "next"
        elif want in ("key", "key1") and t[0] == '"':
            want = "colon"
        elif want == "colon" and t == ":":
            want = "value"
        elif want == "next" and t == ",":
            want = "key" if stack[-1] == "{" else "value"
        elif (t == "}" and want in ("next", "key1") and stack[-1] == "{") or (t == "]" and want in ("next", "first") and stack[-1] == "["):
            stack.pop()
            want = "next"
            if not stack:
                return at
        else:
            return start
    rest = _CUT_PIECE.match(text, at)
    # What is left must be part of what may stand here: words and numbers are values only.
    fits = rest and (want in ("value", "first") or rest.group().strip(" \t\r\n…") == "" or (want in ("key", "key1") and rest.group().lstrip()[0] == '"'))
    return len(text) if fits else start


def string_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, key)`` of the credentials in the double-quoted strings of a text, and of those under a sensitive JSON path."""
    found = []
    named: dict[str, str] = {}  # by path of the object: what its member "name" says
    for path, a, b in json_strings(text):
        raw = text[a:b]
        above, _, name = path.rpartition(".")
        if name.lower() in NAMING:
            named[above] = raw
        kind = path_kind(path.split(".")) if name else None
        if kind is None and kind_of(name) == "neutral":
            kind = kind_of(named.get(above, ""))
        kind = None if kind == "neutral" else kind
        own = hinted(raw)
        if not own and not kind:
            continue
        if "\\" in raw:
            plain, at = unescape(raw)
        else:
            plain, at = raw, None
        got = spans(plain) if own else []
        if not got and kind:
            # Only a string that the text ends in is without its closing quote.
            body = plain.rstrip()
            cut = b == len(text) and body.endswith(CUT)
            body = body[:-1] if cut else plain
            if literal(body, kind, True, cut) and not (cut and re.search(r"\s", body)):
                got = [(0, len(body), path)]
        for s, e, key in got:
            found.append((a + (at[s] if at else s), a + (at[e] if at else e), key))
    return found


def find(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, key)`` of the credentials in a field, as character offsets into it.

    Null, empty and blank texts have none. Text of any length is read whole.
    JSON, cut or not, and lines of it are read by their strings, since
    nothing else in them can be a credential. Other text that begins with a
    bracket (INI, logs, code, reprs, what follows on JSON) is read as a
    whole; a string with escapes in it is judged by what it stands for.
    """
    if not text or not hinted(text):
        return []
    if text.lstrip()[:1] not in ("{", "["):
        return spans(text)
    found = string_spans(text)
    end, at = 0, _BLANKS.match(text).end()
    while text[at : at + 1] in ("{", "[") and (e := json_end(text, at)) > at:
        end, at = e, _BLANKS.match(text, e).end()
    if at >= len(text):
        return found
    escaped = [(a, b) for _, a, b in json_strings(text) if "\\" in text[a:b]]
    for a, b, key in spans(text):
        if a >= end and not any(a < y and x < b for x, y, _ in found) and not any(x < a and b <= y for x, y in escaped):
            found.append((a, b, key))
    return sorted(found)


def redact(text: str | None) -> str | None:
    """The text with each credential replaced by ``REDACTED``; all else stays byte for byte."""
    got = find(text)
    if not got:
        return text
    parts, last = [], 0
    for a, b, _ in sorted(got):
        parts += [text[last:a], REDACTED]
        last = b
    return "".join([*parts, text[last:]])


def _found(batches):
    for b in batches:
        out = []
        for rid, field, text in zip(*(b.column(c).to_pylist() for c in ("row_id", "field", "text"))):
            for s, e, key in find(text):
                start = len(text[:s].encode("utf-8", "surrogatepass"))
                secret = text[s:e]
                out.append((rid, field, key, start, len(secret.encode("utf-8", "surrogatepass")), secret))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["row_id", "field", "key", "start", "size", "secret"])


def scan(rows: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """``row_id, field, key, start, size, secret``: each credential with its place in bytes.

    Repeated rows give repeated finds. Other columns aren't read. No shuffle.
    """
    texts = rows.select(F.col(row_id).cast("string").alias("row_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x")).select("row_id", "x.field", "x.text")
    return texts.filter("text is not null").mapInArrow(_found, "row_id string, field string, key string, start bigint, size bigint, secret string")


def redacted(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``rows`` with the credentials of these text columns replaced; nulls stay null."""

    @F.pandas_udf("string")
    def clean(s):
        return s.map(redact, na_action="ignore")

    return rows.withColumns({f: clean(F.col(f)) for f in fields})
