"""Encoding of a whole corpus with a public byte-level tokenizer.

Overlapping chunk encoding: every text is cut into overlapping chunks of
``chunk`` characters (a short one is a single chunk). Each is pre-tokenised on its own; in the overlap of
two neighbours the first place where both have a pre-token boundary is a
boundary of the whole text too (the pattern reads forward only, so equal
boundaries go on equally), and there the text is cut for good. The pieces
are encoded in parallel and their ids joined in order. Where an overlap has
no common boundary (a run of thousands of letters) the neighbours are
encoded as one piece.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Characters of a chunk and of the overlap of neighbours.
CHUNK, OVERLAP = 16_000, 1_000
#: Characters at a chunk's end whose pre-tokens may depend on what follows.
TAIL = 200


def default_ranks() -> str:
    """Path of the public vocabulary ``byte_bpe_50k``; ``TRAILSPARK_RANKS`` names another."""
    own = os.environ.get("TRAILSPARK_RANKS")
    if own:
        return own
    spec = importlib.util.find_spec("public_tokenizers")
    base = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(base, "byte_bpe_50k.tiktoken")


# Fixed value: the pre-tokenisation pattern of the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_COMPILED = regex.compile(PATTERN)


@lru_cache(maxsize=4)
def encoding(path: str):
    """The encoder of a rank file, once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def decode(ids: list[int], path: str | None = None) -> str:
    """The text of ids; bytes are joined before they are read as UTF-8."""
    return encoding(path or default_ranks()).decode_bytes(ids).decode("utf-8", "replace")


def _edges(batches):
    for b in batches:
        keys, nos, starts, texts, lasts = (b.column(n).to_pylist() for n in ("key", "no", "start", "part", "last"))
        heads, tails = [], []
        for no, start, text, last in zip(nos, starts, texts, lasts):
            head, tail = [], []
            stop = len(text) - (0 if last else TAIL)
            for m in _COMPILED.finditer(text):
                s = m.start()
                # A piece mustn't end in white space: its pre-tokens depend on what follows.
                if not s or text[s - 1].isspace():
                    continue
                if s < OVERLAP and no:
                    head.append(start + s)
                if not last and len(text) - OVERLAP <= s < stop:
                    tail.append(start + s)
            heads.append(head)
            tails.append(tail)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nos, pa.int32()), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=["key", "no", "head", "tail"])


def _encode(path: str):
    def run(batches):
        enc = encoding(path)
        for b in batches:
            ids = [enc.encode_ordinary(t) if t else [] for t in b.column("part").to_pylist()]
            cols = [b.column(c) for c in b.schema.names if c != "part"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.list_(pa.int32()))], names=[c for c in b.schema.names if c != "part"] + ["ids"])

    return run


def encode(docs: DataFrame, key: str, text: str, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``key, ids`` of each row of ``docs``: the token ids of ``text``.

    No special tokens are made: text that looks like one is plain text. Null
    and empty texts give an empty list. Each row gives one row, repeated
    keys too; other columns aren't read. ``path`` is a rank file that every
    worker can read.
    """
    path = path or default_ranks()
    docs = docs.select(F.col(key).alias("doc"), F.col(text).alias("part"))
    kind = docs.schema["doc"].dataType.simpleString()
    none = F.lit(None)
    # A text of one chunk has no neighbour to be stitched to: it is a piece as it stands.
    single = docs.filter(F.coalesce(F.length("part") <= chunk, F.lit(True))).select("doc", none.cast("bigint").alias("key"), none.cast("int").alias("no"), none.cast("bigint").alias("copies"), "part")
    step = chunk - OVERLAP
    # Texts of several chunks, spread over the tasks and written once. A row's key tells repeated documents apart only by their content.
    long = docs.filter(F.length("part") > chunk).select("doc", "part", F.xxhash64("part", "doc").alias("key"))
    cut = materialize(long.groupBy("key", "doc", "part").agg(F.count("*").alias("copies")).withColumn("n", F.length("part")))
    chunks = cut.select("key", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - OVERLAP - 1) / step))).alias("no"), "n", "part").select(
        "key", F.col("no").cast("int").alias("no"), (F.col("no") * step).cast("bigint").alias("start"), F.expr(f"substring(part, cast(no * {step} + 1 as int), {chunk})").alias("part"), (F.col("no") * step + chunk >= F.col("n")).alias("last")
    )
    edges = materialize(chunks.repartition("key", "no").mapInArrow(_edges, "key bigint, no int, head array<bigint>, tail array<bigint>"))
    # A cut is the first boundary that a chunk's tail and the next one's head share.
    tails = edges.select("key", (F.col("no") + 1).alias("no"), "tail")
    cuts = edges.select("key", "no", "head").join(tails, ["key", "no"]).select("key", F.array_min(F.array_intersect("head", "tail")).alias("at")).filter("at is not null")
    places = cuts.groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("at"))
    at = F.coalesce("at", F.array().cast("array<bigint>"))
    ends = F.arrays_zip(F.concat(F.array(F.lit(0).cast("bigint")), at).alias("a"), F.concat(at, F.array(F.col("n").cast("bigint"))).alias("b"))
    stitched = (
        cut.join(places, "key", "left").select("doc", "key", "copies", "part", F.posexplode(ends).alias("no", "ab"))
        .select("doc", "key", "no", "copies", F.expr("substring(part, cast(ab.a + 1 as int), cast(ab.b - ab.a as int))").alias("part"))
        .repartition("key", "no")
    )
    coded = lambda df: df.mapInArrow(_encode(path), f"doc {kind}, key bigint, no int, copies bigint, ids array<int>")
    joined = coded(stitched).groupBy("key", "doc", "copies").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("p")).select("doc", F.flatten("p.ids").alias("ids"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_c")).select("doc", "ids")
    return coded(single).select("doc", "ids").unionByName(joined).withColumnRenamed("doc", key)
