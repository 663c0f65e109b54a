"""Encoding of a corpus with a public byte-level BPE vocabulary.

Every text is cut into overlapping chunks, and each chunk is pre-tokenised by itself.
Neighbours are stitched where their pre-token boundaries resynchronise in the overlap;
the pieces between the stitches are encoded, and the ids of a text's pieces joined. As
pre-tokens never depend on what stands before a common boundary, they are the ids of the
whole text. A text shorter than a chunk is one chunk and one piece. Decoding
concatenates the raw bytes.

The pieces of a text stay in the task that reads it, in order, so nothing is shuffled;
those of a giant text are spread over tasks, so that it doesn't hold up one.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's own pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a chunk, and how far it reaches into its neighbour.
CHUNK, OVERLAP = 1_024, 192
#: Pieces of a text of more characters are spread over tasks.
GIANT = 4_000_000
#: Characters at the end of a chunk whose boundaries what follows could move.
MARGIN = 4


@lru_cache(4)
def vocabulary(path: str = VOCABULARY) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _pattern() -> regex.Pattern:
    return regex.compile(PATTERN)


def _kind(ch: str) -> str:
    """L letter, N number, S white space, C control (about which engines differ) or O."""
    c = unicodedata.category(ch)[0]
    return c if c in "LN" else "C" if c == "C" and ch not in "\t\n\r\v\f" else "S" if ch.isspace() else "O"


def sure(text: str, at: int) -> bool:
    """Whether a pre-token starts here in any text that has these two characters: no
    pre-token goes on from a letter to what isn't one, from a number to what isn't one, nor
    from anything to white space. What ends there doesn't end in white space, whose
    pre-tokens look at what follows."""
    a, b = _kind(text[at - 1]), _kind(text[at])
    return a not in "SC" and b != "C" and (b == "S" or a in "LN" and a != b)


def boundaries(text: str) -> list[int]:
    """Where pre-tokens of a text start."""
    return [m.start() for m in _pattern().finditer(text)]


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    return vocabulary(path).decode_bytes(ids).decode("utf-8", "replace")


def pieces(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The text cut where a pre-token starts in both of two overlapping chunks.

    Chunk k is [k*chunk, (k+1)*chunk + overlap). It and its successor both see the first
    `overlap` characters of the latter, and are cut at the first boundary there that both
    have and that no context could move. Where there is none, they stay together.
    """
    if len(text) <= chunk + overlap:
        return [text]
    cuts, before = [0], None
    for at in range(0, len(text), chunk):
        part = text[at : at + chunk + overlap]
        starts = [at + x for x in boundaries(part)]
        if before is not None:
            end = min(at + overlap, len(text))
            common = (x for x in starts if at < x < end - MARGIN and x in before and sure(text, x))
            if (x := next(common, None)) is not None:
                cuts.append(x)
        before = {x for x in starts if x >= at + chunk}
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def _cut(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, k, n, text): the pieces of each text, in order, n of them; null and empty texts have one."""
    for b in batches:
        cut = [pieces(t or "", chunk, overlap) for t in b.column("text").to_pylist()]
        at = pa.array([i for i, ps in enumerate(cut) for _ in ps], pa.int32())
        k = pa.array([k for ps in cut for k in range(len(ps))], pa.int32())
        n = pa.array([len(ps) for ps in cut for _ in ps], pa.int32())
        text = pa.array([p for ps in cut for p in ps], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("row").take(at), k, n, text], ["doc_id", "row", "k", "n", "text"])


def _shipped(name: str) -> tiktoken.Encoding:
    return vocabulary(SparkFiles.get(name))


def _encode(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """The ids of each piece."""
    enc = _shipped(name)
    for b in batches:
        ids = [enc.encode_ordinary(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "row", "k")), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "row", "k", "ids"])


def _encode_joined(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """The ids of each text, whose pieces come one after the other, maybe in several batches."""
    enc, open_ = _shipped(name), []
    for b in batches:
        docs, out = [], []
        for d, k, n, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "k", "n", "text")), strict=True):
            ids = enc.encode_ordinary(t)
            open_ = ids if k == 0 else open_ + ids
            if k == n - 1:
                docs.append(d)
                out.append(open_)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])


def encode(docs: DataFrame, path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, giant: int = GIANT) -> DataFrame:
    """(doc_id, ids) of every row of (doc_id, text). Null and empty texts have no ids: an empty list.

    Special tokens in a text are ordinary text. Repeated rows give repeated results. The
    vocabulary's file is sent to the executors. Extra columns are not passed on.
    """
    docs.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)
    d = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    cut = lambda part: part.mapInArrow(lambda b: _cut(b, chunk, overlap), "doc_id bigint, row bigint, k int, n int, text string")
    size = F.coalesce(F.length("text"), F.lit(0))
    here = cut(d.filter(size <= giant)).mapInArrow(lambda b: _encode_joined(b, name), "doc_id bigint, ids array<int>")
    spread = cut(d.filter(size > giant)).repartition("row", "k")
    coded = spread.mapInArrow(lambda b: _encode(b, name), "doc_id bigint, row bigint, k int, ids array<int>")
    # One text's ids are one value of the result, so they meet in one place in the end.
    whole = coded.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    return here.unionByName(whole.select("doc_id", F.flatten(F.col("parts.ids")).alias("ids")))
