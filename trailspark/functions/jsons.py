"""JSON of any depth and with numbers of any length, for Python workers."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring


class Number:
    """A whole number of more digits than Python reads, as text."""

    __slots__ = ("text",)

    def __init__(self, text: str) -> None:
        self.text = text

    def __eq__(self, other) -> bool:
        return isinstance(other, Number) and other.text == self.text

    def __hash__(self) -> int:
        return hash(self.text)


#: Digits up to which a whole number is read as such.
DIGITS = 4_000
_BLANKS = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?|true|false|null")
_WORDS = {"true": True, "false": False, "null": None}


def parse(text: str | None):
    """The JSON value of a text, or None when the text is null or no JSON.

    NaN and infinities are none. Depth and the length of numbers are bounded
    by memory only.
    """
    if text is None:
        return None
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        pass
    except ValueError as e:
        if "digits" not in str(e):
            return None
    try:
        return _read(text)
    except (ValueError, IndexError):
        return None


def _refuse(name: str):
    raise ValueError(name)


def _bad():
    raise ValueError("no JSON")


def _read(text: str):
    skip = lambda i: _BLANKS.match(text, i).end()

    def key(i: int) -> tuple[str, int]:
        if text[i] != '"':
            _bad()
        k, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i] != ":":
            _bad()
        return k, skip(i + 1)

    stack: list[list] = []  # container, key that waits for its value
    i = skip(0)
    while True:
        c = text[i]
        if c in "{[":
            new = {} if c == "{" else []
            i = skip(i + 1)
            if text[i] == ("}" if c == "{" else "]"):
                value, i = new, i + 1
            else:
                stack.append([new, None])
                if c == "{":
                    stack[-1][1], i = key(i)
                continue
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
        else:
            m = _SCALAR.match(text, i) or _bad()
            i = m.end()
            if m[1] is None:
                value = _WORDS[m[0]]
            elif m[2] or m[3]:
                value = float(m[0])
            else:
                value = int(m[1]) if len(m[1]) <= DIGITS else Number(m[1])
        while stack:
            top, k = stack[-1]
            is_object = type(top) is dict
            if is_object:
                top[k] = value
            else:
                top.append(value)
            i = skip(i)
            c = text[i]
            if c == ",":
                i = skip(i + 1)
                if is_object:
                    stack[-1][1], i = key(i)
                break
            if c != ("}" if is_object else "]"):
                _bad()
            value, i = top, i + 1
            stack.pop()
        else:
            return value if skip(i) == len(text) else _bad()


def dump(value) -> str:
    """The JSON text of a value that :func:`parse` gave."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except (RecursionError, TypeError, ValueError):
        pass
    out: list[str] = []
    stack: list = [value]
    while stack:
        v = stack.pop()
        t = type(v)
        if t is _Raw:
            out.append(v.text)
        elif t is Number:
            out.append(v.text)
        elif t is dict:
            out.append("{")
            stack.append(_Raw("}"))
            for n, (k, x) in enumerate(reversed(v.items())):
                stack.append(x)
                stack.append(_Raw(json.dumps(k, ensure_ascii=False) + ": "))
                if n < len(v) - 1:
                    stack.append(_Raw(", "))
        elif t is list:
            out.append("[")
            stack.append(_Raw("]"))
            for n, x in enumerate(reversed(v)):
                stack.append(x)
                if n < len(v) - 1:
                    stack.append(_Raw(", "))
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


class _Raw(Number):
    """Text to be written as it is."""

    __slots__ = ()


def clean(s: str) -> str:
    """The text as Arrow takes it: lone surrogates become question marks."""
    return s.encode("utf-8", "replace").decode("utf-8") if not s.isascii() else s
