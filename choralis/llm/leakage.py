"""Held-out evaluation passages inside a training corpus.

A passage leaks if a text holds a stretch of it of at least `SPAN` words, in which a
word may differ now and then. Passages and texts are compared as sequences of words,
letters and digits only, without case.

Prefix-filtered join. Passages and texts are sets of shingles of `WIDTH` words. However
the changed words lie in a stretch, at least `APART` apart, some of its shingles stay whole;
so of a passage's shingles only as many must be looked up as meet each of these cases.
Shingles are ordered by rarity in the corpus, and the most frequent are left out as
long as every case is still met: what remains is the passage's prefix. It is joined with the
shingles of the texts by hash. A match fixes how text and passage align, which gives bounds
by length and position, and the words along that diagonal are compared, item-sized
window by window, so what is reported is exact.

The corpus is read once, whatever the number of items: only texts that pass a filter of
all items' shingles go on, with the places where they do, and rarity, join and comparison
work on these. Whether a shingle is rare is counted over all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choralis.llm.common import Bits, stored

SPAN, WIDTH = 12, 5
#: Changed words are at least so many apart.
APART = 8
WORDS = regex.compile(r"[\p{L}\p{N}\p{M}]+")
ASCII_WORDS = re.compile("[a-z0-9]+")
POWER = np.uint64(0x9E3779B97F4A7C15)


def words(s: str) -> list[str]:
    if s.isascii():
        return ASCII_WORDS.findall(s.replace("'", "").lower())
    return WORDS.findall(s.replace("'", "").replace("\u2019", "").replace("\u02bc", "").casefold())


def width_of(n: int) -> int:
    """Words of a shingle of a passage of n words: WIDTH, or fewer where a changed word would leave none whole."""
    return min(WIDTH, (n - 1) // 2)


@lru_cache(64)
def survivors(size: int, width: int, whole: bool) -> tuple[frozenset[int], ...]:
    """Of a window of `size` words whose first one agrees, the sets of shingles that may be
    all that changed words leave. whole: the window is the passage, so that its last word agrees."""
    at = range(1, size - 1 if whole else size)
    cases = [()]
    for n in range(1, 2 + size // APART):
        cases += [c for c in combinations(at, n) if all(b - a >= APART for a, b in zip(c, c[1:], strict=False))]
    sets = {frozenset(s for s in range(size - width + 1) if not any(s <= p < s + width for p in c)) for c in cases}
    return tuple(sorted((s for s in sets if not any(t < s for t in sets)), key=sorted))


def prefix(counts: list[int], hashes: list[int], n_words: int) -> list[int]:
    """Positions of the shingles of a passage that are looked up."""
    size = min(SPAN, n_words)
    cases = [frozenset(i + s for s in c) for i in range(n_words - size + 1) for c in survivors(size, width_of(n_words), n_words < SPAN)]
    left = [len(c) for c in cases]
    within: list[list[int]] = [[] for _ in counts]
    for j, c in enumerate(cases):
        for s in c:
            within[s].append(j)
    keep = []
    for s in sorted(range(len(counts)), key=lambda s: (-counts[s], hashes[s], s)):
        if all(left[j] > 1 for j in within[s]):
            for j in within[s]:
                left[j] -= 1
        else:
            keep.append(s)
    return sorted(keep)


def longest(text: list[str], passage: list[str], shift: int) -> int:
    """Words of the longest stretch along a diagonal (text position - passage position)
    in which any APART words running have at most one that differs and both ends agree."""
    lo, hi = max(0, -shift), min(len(passage), len(text) - shift)
    best, start, last = 0, None, -1
    bad = -9
    for p in range(lo, hi):
        if text[p + shift] == passage[p]:
            if start is None:
                start = p
            last = p
            best = max(best, last - start + 1)
        elif start is not None:
            if p - bad < APART:
                # Two differences too close: a stretch may go on from behind the earlier one.
                start = bad + 1 if bad + 1 < p and bad >= start else None
            bad = p
    return best


class Shingler(dict):
    """Hashes of the shingles of many texts at once, from hashes of their words, which it keeps."""

    def __missing__(self, w: str) -> int:
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h

    def hashes(self, ws: list[str], width: int) -> np.ndarray:
        """The hash at each word of the `width` words from there on; none for the last few."""
        if len(self) > 500_000:
            self.clear()
        own = np.array([self[w] for w in ws], np.uint64)
        n = max(0, len(own) - width + 1)
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = out * POWER + own[k : k + n]
        return out.view(np.int64)


def _shingles(items: DataFrame) -> DataFrame:
    """(item_id, item, n_words, pos, h) of each passage of three words or more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["item_id", "item", "n_words", "pos", "h"]
        for b in batches:
            shingler, rows = Shingler(), []
            for i, key, p in zip(*(b.column(c).to_pylist() for c in ("item_id", "item", "passage")), strict=True):
                if len(ws := words(p)) >= 3:
                    rows += [(i, key, len(ws), pos, h) for pos, h in enumerate(shingler.hashes(ws, width_of(len(ws))).tolist())]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return items.mapInArrow(scan, "item_id bigint, item bigint, n_words bigint, pos bigint, h bigint")


def _places(docs: DataFrame, bits, widths: list[int]) -> DataFrame:
    """(row, doc_id, text, n_words, hits) of the texts that may hold a shingle of an item, and where."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, among = Shingler(), bits.value.among
        kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())]))
        for b in batches:
            each = [words(t) for t in b.column("text").to_pylist()]
            ends = np.cumsum([len(ws) for ws in each])
            flat = [w for ws in each for w in ws]
            hits: dict[int, list] = {}
            for width in widths:
                hs = shingler.hashes(flat, width)
                at = among(hs)
                doc = np.searchsorted(ends, at, "right")
                inside = at + width <= ends[doc]
                for d, p, h in zip(doc[inside].tolist(), at[inside].tolist(), hs[at[inside]].tolist(), strict=True):
                    hits.setdefault(d, []).append({"h": h, "at": p - (int(ends[d - 1]) if d else 0)})
            which = sorted(hits)
            take = pa.array(which, pa.int32())
            cols = [b.column("row").take(take), b.column("doc_id").take(take), b.column("text").take(take)]
            cols += [pa.array([len(each[d]) for d in which], pa.int32()), pa.array([hits[d] for d in which], kind)]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "text", "n_words", "hits"])

    rows = docs.filter("text is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(scan, "row bigint, doc_id bigint, text string, n_words int, hits array<struct<h:bigint,at:int>>")


def _prefixes(shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """(item_id, item, m_words, pos, h) of the shingles that are looked up, by their counts (h, n) in the corpus."""
    each = shingles.join(counts, "h", "left").groupBy("item_id", "item", "n_words").agg(F.array_sort(F.collect_list(F.struct("pos", "h", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, key, n, s in zip(*(b.column(c).to_pylist() for c in ("item_id", "item", "n_words", "s")), strict=True):
                hs = [x["h"] for x in s]
                rows += [(i, key, n, p, hs[p]) for p in prefix([x["n"] for x in s], hs, n)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item_id", "item", "m_words", "pos", "h"])

    return each.mapInArrow(choose, "item_id bigint, item bigint, m_words bigint, pos bigint, h bigint")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = lru_cache(4096)(words)
    for b in batches:
        rows = []
        for d, t, cands in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "cands")), strict=True):
            ws = words(t)
            for c in cands:
                p = of(c["passage"])
                n = max(longest(ws, p, s) for s in c["shifts"])
                if n >= min(SPAN, len(p)):
                    rows.append((d, c["item_id"], n))
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "item_id", "n_words"])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words): the texts that hold items, and the longest stretch of each.

    Null and empty texts and passages hold nothing. A passage of fewer words than SPAN
    counts if all of it is there, and one of fewer than three words never does. Rows
    repeated under one id count as one with the longest stretch.
    """
    spark = docs.sparkSession
    given = items.select("item_id", "passage").filter("passage is not null").distinct().withColumn("item", F.xxhash64("item_id", "passage"))
    given = stored(given)
    shingles = stored(_shingles(given))
    # One width, but for passages shorter than SPAN.
    widths = sorted({width_of(r[0]) for r in shingles.select(F.least("n_words", F.lit(SPAN))).distinct().collect()})
    found = stored(_places(docs, spark.sparkContext.broadcast(Bits.of(shingles.select("h"))), widths))
    hits = found.select("row", "n_words", F.explode("hits").alias("_h")).select("row", "n_words", "_h.*")
    need = _prefixes(shingles, hits.groupBy("h").agg(F.count("*").alias("n")))
    # Text and passage must overlap along the diagonal in enough words.
    both = F.least(F.col("m_words"), F.col("n_words") - F.col("shift")) - F.greatest(F.lit(0), -F.col("shift"))
    met = hits.join(need, "h").withColumn("shift", (F.col("at") - F.col("pos")).cast("int")).filter(both >= F.least(F.lit(SPAN), "m_words"))
    pairs = met.groupBy("row", "item_id", "item").agg(F.collect_set("shift").alias("shifts")).join(given, ["item_id", "item"])
    # A text's candidates are bounded by its own length, so they may meet in one place.
    cands = pairs.groupBy("row").agg(F.collect_list(F.struct("item_id", "passage", "shifts")).alias("cands"))
    exact = found.select("row", "doc_id", "text").join(cands, "row").select("doc_id", "text", "cands").mapInArrow(_verify, "doc_id bigint, item_id bigint, n_words int")
    return exact.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))
