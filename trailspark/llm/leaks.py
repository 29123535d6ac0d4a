"""Held-out test passages that leak into training text.

Pigeonhole edit matching: a stretch of ``m`` words with a budget of ``k``
edits is split into ``k + 1`` pieces, at least one of which must stand
unchanged. Texts are reduced to words (escapes, entities, markup, invisible
characters, line prefixes and case go), and the pieces are looked up in the
words' letters without blanks, so how words are joined or split doesn't
matter to a hit. The look-up takes all letter positions of many texts at
once: the hashes of the first and the last letters of a piece are compared
with those at the position. Around each hit the words are cut anew by the
words of the item, and the stretch is verified with Myers' bit-parallel edit
distance over words.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Least words of a stretch; one edit per so many words.
STRETCH, PER_EDIT = 12, 6
#: Most bytes of test items that are indexed at once; more are done block by block. An index holds
#: 28 bytes for each word and the letters of it, so at most 16 bytes for each byte of items.
ITEM_BYTES = 4_000_000
#: Letters that are hashed at once.
LETTERS = 1 << 19

ESCAPED = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([nrtbf])|([\"'/\\]))")
TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--|-->|<!\[CDATA\[|\]\]>")
PREFIX = re.compile(r"(?m)^(?:[ \t]*(?:[-*+•‣◦>#|%;]+|//+|--+|/\*+|\d{1,3}[.):\]](?=\s)|\(\d{1,3}\)|\[\d{1,3}\](?=\s)|[a-zA-Z][.)](?=\s)))+[ \t]*")
INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}\p{Me}\p{Cs}]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
WORDS = re.compile(r"[^\W\d_]+|\d+")
OTHERS = re.compile(r"[\W_]+")
SENTENCE_END = re.compile(r"(?<=[.?!])\s+")
_ASCII_OTHERS = bytes(i for i in range(128) if not chr(i).isalnum())


def _escape(m) -> str:
    if m[1] or m[2]:
        return chr(int(m[1] or m[2], 16))
    return "\n" if m[3] in ("n", "r") else " " if m[3] else m[4]


def _bare(text: str, tag: str) -> str:
    while "\\" in text and (less := ESCAPED.sub(_escape, text)) != text:
        text = less
    while "&" in text and (less := html.unescape(text)) != text:
        text = less
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "<" in text:
        text = TAG.sub(tag, text)
    return PREFIX.sub(" ", text)


def plain(text: str) -> str:
    """The text without escapes (of any depth), entities, tags, invisible characters and line prefixes."""
    return _bare(text, " ")


def forms(text: str) -> list[str]:
    """:func:`plain`, and where a tag holds several words the text with these too: it may be no tag."""
    first = plain(text)
    if "<" not in text and "&" not in text and "\\" not in text:
        return [first]
    other = _bare(text, lambda m: " " + m[0][1:-1] + " " if m[0].count(" ") + m[0].count("\n") > 2 else " ")
    return [first] if other == first else [first, other]


def words_of(text: str) -> list[str]:
    """The words of a text in lower case; runs of digits are words of their own."""
    return WORDS.findall(CAMEL.sub(" ", plain(text)).casefold())


def letters_of(plain_text: str) -> str:
    """The letters and digits of the words of a plain text, without anything between them."""
    if plain_text.isascii():
        return plain_text.lower().encode().translate(None, _ASCII_OTHERS).decode()
    return OTHERS.sub("", plain_text.casefold())


def myers(pattern: list[str], text: list[str]) -> int:
    """Least edit distance of the pattern to any stretch of the text (Myers' bit vectors, words as symbols)."""
    masks: dict[str, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    return _myers([masks.get(w, 0) for w in text], 0, len(pattern))


def _myers(places: list[int], first: int, m: int) -> int:
    """The same for words ``first`` to ``first + m``; ``places`` holds for each word of the text a mask of where it stands."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for e in places:
        eq = e >> first & full
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best = score
    return best


def cut_anew(letters: str, starts: set[int], known: set[str]) -> list[str]:
    """Words of ``letters`` that may be joined or split: the cheapest way through a lattice.

    ``starts`` are the places where the text itself begins a word. A known
    word is free where the text has it so, and cheap elsewhere; any other
    word ends where the text ends one or a known word begins, and costs 1 and
    a little for each letter.
    """
    n = len(letters)
    sizes = sorted({len(w) for w in known})
    at: list[list[int]] = [[] for _ in range(n + 1)]
    for p in range(n):
        at[p] = [k for k in sizes if letters[p : p + k] in known and p + k <= n]
    cost, back = [float("inf")] * (n + 1), [0] * (n + 1)
    cost[0] = 0.0
    edges = sorted({*starts, n} - {0})
    after = {a: i for i, a in enumerate(edges)}
    following, nxt = [n] * (n + 1), n
    for p in range(n, -1, -1):
        following[p] = nxt
        if p in after:
            nxt = p
    own = {0, *edges}
    for p in range(n):
        c = cost[p]
        if c == float("inf"):
            continue
        for k in at[p]:
            e = p + k
            own_word = p in own and following[p] == e
            new = c + (0 if own_word else 0.3 if k > 2 else 0.6)
            if new < cost[e]:
                cost[e], back[e] = new, p
        stop = following[p]
        for q in range(p + 1, stop + 1):
            if q == stop or (at[q] and at[q][-1] > 2):
                new = c + 1 + 0.09 * (q - p)
                if new < cost[q]:
                    cost[q], back[q] = new, p
    out, p = [], n
    while p:
        out.append(letters[back[p] : p])
        p = back[p]
    return out[::-1]


#: Letters of the grams by which pieces are looked up; a piece takes the longest that it holds.
GRAMS = (16, 8, 4, 2, 1)
_MULTIPLY = {2: 0x9E3779B97F4A7C15, 4: 0xC2B2AE3D27D4EB4F, 8: 0x165667B19E3779F9, 16: 0xD6E8FEB86659FD93}
_SPREAD = np.uint64(0xFF51AFD7ED558CCD)


def grams(codes: np.ndarray) -> dict[int, np.ndarray]:
    """The 64-bit hashes of all grams of 1, 2, 4, 8 and 16 letters, by doubling."""
    out = {1: codes.astype(np.uint64)}
    with np.errstate(over="ignore"):
        for k, m in _MULTIPLY.items():
            h = out[k // 2]
            out[k] = h[: -(k // 2)] * np.uint64(m) + h[k // 2 :] if len(h) > k // 2 else h[:0]
            out[k] ^= out[k] >> np.uint64(29)
    return out


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Index:
    """The pieces of all test items, by gram size: sorted hashes of their first letters, of their last ones, and their place."""

    def __init__(self, items: list[tuple], stretch: int = STRETCH, per_edit: int = PER_EDIT, shared: set | None = None) -> None:
        self.budgets = [(stretch, stretch // per_edit), (stretch + per_edit, (stretch + per_edit) // per_edit)]
        self.piece = min(m // (k + 1) for m, k in self.budgets)
        self.items: list = []
        self.runs: list[str] = []
        for item, text in items:
            run: list[str] = []
            for s in SENTENCE_END.split(text):
                w = words_of(s)
                if shared is not None and " ".join(w) in shared:
                    self._add(item, run)
                    run = []
                else:
                    run.extend(w)
            self._add(item, run)
        found: dict[int, list[tuple]] = {k: [] for k in GRAMS}
        for r in range(len(self.runs)):
            _, start = self.words(r)
            h = grams(_codes(self.runs[r].replace(" ", "")))
            a = np.array(start[: -self.piece], dtype=np.int64)
            size = np.array(start[self.piece :], dtype=np.int64) - a
            place = np.arange(len(a), dtype=np.int32)
            for k, up in zip(GRAMS, (1 << 40, *GRAMS)):
                of = (size >= k) & (size < up)
                if of.any():
                    found[k].append((h[k][a[of]], h[k][(a + size - k)[of]], size[of].astype(np.int32), np.full(of.sum(), r, dtype=np.int32), place[of]))
        self.tables: dict[int, tuple] = {}
        for k, parts in found.items():
            if parts:
                first, last, size, run, place = (np.concatenate(x) for x in zip(*parts))
                o = np.argsort(first, kind="stable")
                bits = max(16, min(25, int(len(o) * 32).bit_length()))
                seen = np.zeros(1 << bits, dtype=bool)
                with np.errstate(over="ignore"):
                    seen[(first * _SPREAD) >> np.uint64(64 - bits)] = True
                self.tables[k] = (first[o], last[o], size[o], run[o], place[o], bits, np.packbits(seen))

    def _add(self, item, run: list[str]) -> None:
        if len(run) >= self.budgets[0][0]:
            self.items.append(item)
            self.runs.append(" ".join(run))

    def words(self, r: int) -> tuple[list[str], list[int]]:
        """The words of a run and where each starts in its letters (and the end)."""
        w = self.runs[r].split(" ")
        start = [0]
        for x in w:
            start.append(start[-1] + len(x))
        return w, start

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def hits(self, letters: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, run and place of each piece that stands in the letters, from hashes (a few may be none)."""
        out: list[list] = [[], [], []]
        if not hasattr(self, "_seen"):
            self._seen = {k: np.unpackbits(t[-1]).view(bool) for k, t in self.tables.items()}
        longest = max((int(t[2].max()) for t in self.tables.values()), default=0)
        for a in range(0, len(letters), LETTERS):
            # Segments overlap by the longest piece.
            h = grams(_codes(letters[a : a + LETTERS + longest]))
            for k, (first, last, size, run, place, bits, _) in self.tables.items():
                own = h[k][:LETTERS]
                with np.errstate(over="ignore"):
                    may = np.flatnonzero(self._seen[k][(own * _SPREAD) >> np.uint64(64 - bits)])
                if not len(may):
                    continue
                lo, hi = np.searchsorted(first, own[may], "left"), np.searchsorted(first, own[may], "right")
                n = hi - lo
                pos = np.repeat(may, n)
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                end = pos + size[at] - k
                ok = end < len(h[k])
                ok[ok] = h[k][end[ok]] == last[at[ok]]
                out[0].append(pos[ok] + a)
                out[1].append(run[at[ok]])
                out[2].append(place[at[ok]])
        return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in out)

    def search(self, text: str) -> set:
        """The items of which the text holds a stretch."""
        return self.search_all([text])[0]

    def search_all(self, texts: list[str]) -> list[set]:
        """The items of which each text holds a stretch. Texts of any length are read whole."""
        found: list[set] = [set() for _ in texts]
        if not self.tables:
            return found
        plains, whose = [], []
        for i, t in enumerate(texts):
            for p in forms(t):
                plains.append(p)
                whose.append(i)
        streams = [letters_of(p) for p in plains]
        start = 0
        while start < len(streams):
            end, total = start, 0
            while end < len(streams) and (end == start or total + len(streams[end]) <= LETTERS):
                total += len(streams[end])
                end += 1
            self._search(plains[start:end], streams[start:end], whose[start:end], found)
            start = end
        return found

    def _search(self, plains: list[str], streams: list[str], whose: list[int], found: list[set]) -> None:
        # No piece holds the sign between two texts.
        offset = np.concatenate([[0], np.cumsum([len(s) + 1 for s in streams])]).astype(np.int64)
        pos, run, place = self.hits("\0".join(streams))
        if not len(pos):
            return
        doc = np.searchsorted(offset, pos, "right") - 1
        pos = pos - offset[doc]
        order = np.lexsort((place, pos, run, doc))
        doc, pos, run, place = doc[order].tolist(), pos[order].tolist(), run[order].tolist(), place[order].tolist()
        n, i = len(doc), 0
        d_words = None
        while i < n:
            # Hits of one run that lie near each other, in both, are judged together.
            d, r, j = doc[i], run[i], i + 1
            while j < n and doc[j] == d and run[j] == r and 0 <= place[j] - place[i] <= 24 and abs((pos[j] - pos[j - 1]) - 6 * (place[j] - place[j - 1])) <= 90:
                j += 1
            into = found[whose[d]]
            if self.items[r] not in into:
                if d_words is None or d_words[0] != d:
                    w = WORDS.findall(CAMEL.sub(" ", plains[d]).casefold())
                    d_words = (d, w, [0, *np.cumsum([len(x) for x in w]).tolist()])
                if self._verify(d_words[1], d_words[2], streams[d], r, min(place[i:j]), max(place[i:j]), min(pos[i:j]), max(pos[i:j])):
                    into.add(self.items[r])
            i = j

    def _verify(self, words: list[str], starts: list[int], letters: str, r: int, i0: int, i1: int, p0: int, p1: int) -> bool:
        """Whether a stretch of the run that holds one of the pieces ``i0`` to ``i1`` stands around ``p0`` to ``p1``."""
        own, own_start = _run(self, r)
        long, most = self.budgets[-1]
        a, b = max(0, i0 + self.piece - long), min(len(own), i1 + long)
        # The text's words around, as many as may be needed: an inserted word counts for 40 letters at most.
        need = own_start[i0] - own_start[a] + 40 * (most + 1)
        j0 = max(0, bisect_right(starts, p0) - 1)
        while need > 0 and j0 > 0:
            j0 -= 1
            need -= min(40, len(words[j0]))
        need = own_start[b] - own_start[i1] + 40 * (most + 1)
        j1 = min(len(words), bisect_right(starts, p1))
        while need > 0 and j1 < len(words):
            need -= min(40, len(words[j1]))
            j1 += 1
        masks: dict[str, int] = {}
        for x in range(a, b):
            masks[own[x]] = masks.get(own[x], 0) | 1 << (x - a)
        stretches = [(m, k, s - a) for m, k in self.budgets for s in range(max(a, i0 + self.piece - m), min(i1, b - m) + 1)]

        def near(places) -> list[tuple]:
            """The stretches of which enough words are there at all."""
            have = 0
            for e in places:
                have |= e
            return [x for x in stretches if (have >> x[2] & (1 << x[0]) - 1).bit_count() >= x[0] - x[1]]

        places = [masks.get(w, 0) for w in words[j0:j1]]
        if any(_myers(places, s, m) <= k for m, k, s in near(places)):
            return True
        part = letters[starts[j0] : starts[j1]]
        if near(e for w, e in masks.items() if w in part):
            places = [masks.get(w, 0) for w in cut_anew(part, {x - starts[j0] for x in starts[j0:j1]}, set(masks))]
            return any(_myers(places, s, m) <= k for m, k, s in near(places))
        return False


@lru_cache(maxsize=4096)
def _run(index: Index, r: int) -> tuple[list[str], list[int]]:
    return index.words(r)


def shared_sentences(items: list[tuple]) -> set:
    """The sentences (as words) that stand in more than one item."""
    where: dict[str, object] = {}
    many: set = set()
    for item, text in items:
        for s in SENTENCE_END.split(text):
            w = " ".join(words_of(s))
            if w and where.setdefault(w, item) != item:
                many.add(w)
    return many


def _search(index, key_type):
    def run(batches):
        ix = index.value
        for b in batches:
            docs, items = [], []
            for d, found in zip(b.column("doc").to_pylist(), ix.search_all(b.column("text").to_pylist())):
                for item in found:
                    docs.append(d)
                    items.append(item)
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.field("doc").type), pa.array(items, key_type)], names=["doc", "item"])

    return run


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, parts: list[str], stretch: int = STRETCH, per_edit: int = PER_EDIT) -> DataFrame:
    """``key, item_key``: the documents that hold a stretch of an item, with each such item.

    A stretch is at least ``stretch`` words of one of the item's ``parts`` in
    their order, with at most one edit per ``per_edit`` words; sentences that
    stand in more than one item don't count. Null, empty and blank texts and
    parts hold none. A pair comes once, repeated documents or not.

    The items are the stated query set. Their size is checked: up to
    ``ITEM_BYTES`` they go to all tasks as one index; more are searched block
    by block against all documents, and the index of a block is given up
    before the next is made.
    """
    texts = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).filter("text is not null and text != ''")
    flat = items.select(F.col(item_key).alias("item"), F.explode(F.array(*parts)).alias("part")).filter("item is not null and part is not null and part != ''").distinct()
    size = flat.agg(F.coalesce(F.sum(F.octet_length("part")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // ITEM_BYTES))
    kind = flat.schema["item"].dataType.simpleString()
    key_type = pa.int64() if kind in ("bigint", "int") else pa.string()
    spark = docs.sparkSession
    out = None
    # Of several blocks each reads the sentences shared with any other from a table.
    shared = materialize(_shared(flat)) if blocks > 1 else None
    for n in range(blocks):
        part = flat if blocks == 1 else flat.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == n)
        rows = [tuple(r) for r in part.orderBy("item", "part").collect()]
        common = shared_sentences(rows) if shared is None else {r[0] for r in shared.join(_sentences(part), "s", "left_semi").collect()}
        index = spark.sparkContext.broadcast(Index(rows, stretch, per_edit, common))
        got = texts.mapInArrow(_search(index, key_type), f"doc {docs.schema[key].dataType.simpleString()}, item {'bigint' if key_type == pa.int64() else 'string'}")
        if blocks > 1:
            got = materialize(got)
            index.destroy()
        out = got if out is None else out.unionByName(got)
    return out.distinct().select(F.col("doc").alias(key), F.col("item").alias(item_key))


def _sentences(flat: DataFrame) -> DataFrame:
    @F.pandas_udf("array<string>")
    def cut(s):
        return s.map(lambda t: [" ".join(words_of(x)) for x in SENTENCE_END.split(t)])

    return flat.select("item", F.explode(cut("part")).alias("s")).filter("s != ''").distinct()


def _shared(flat: DataFrame) -> DataFrame:
    return _sentences(flat).groupBy("s").agg(F.count("*").alias("n")).filter("n > 1").select("s")
