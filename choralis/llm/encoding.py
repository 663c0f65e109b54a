"""Text that was decoded with the wrong character encoding.

1. Over the whole corpus, count adjacent character pairs of which one isn't ASCII.
   Tokens that some inverse mapping turns into well-formed UTF-8 stay out of the
   counts, else frequent damage would teach the model that it is normal.
2. Score each pair of a value by its pointwise mutual information. The damage
   lies in the maximum-scoring segments of improbability, of which a word may have several.
3. Only in those runs try inverse mappings: the text as it came back to bytes by
   the encoding it was read with, and read again by the one it was written in.
   A mapping counts if the text it gives is far more probable under the same
   counts. Runs of a value vote together, as one mistake hurt them all.

Pairs are counted exactly, by Spark. The executors get the most frequent of them, at
most MOST_PAIRS a model, as sorted arrays of numbers (16 bytes a pair, so 100 MB at most for the
three models, in the driver and in each worker); rarer pairs are as pairs that were never seen.
What is sent doesn't grow with the corpus, nor do counts of different pairs ever mix.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import log2
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choralis.llm.common import stored
from choralis.llm.lookalike import PROTOTYPE, skeleton

#: Pairs of a model that the executors get.
MOST_PAIRS = 1 << 21
#: Probabilities are floored, so that what is rare isn't therefore improbable.
CHAR_FLOOR, PAIR_FLOOR = 1e-3, 1e-8
LOW, HIGH = -7.0, 5.0
#: A pair below this is improbable; runs are the segments where such pairs prevail.
IMPROBABLE = -2.0
#: Bits that a value's text must gain by an inverse mapping from one single-byte
#: encoding to another. Well-formed UTF-8 hardly arises by chance and needs less.
GAIN, GAIN_UTF8 = 9.0, 3.0
#: Bits that a run of words must gain within a line whose other words are not explained: as
#: it is picked out of all runs of the line, it needs more.
GAIN_RUN = 18.0

# Encodings that text is wrongly read with, and those it is written in.
READ_AS = ["cp1252", "cp1250", "cp1251", "cp1253", "cp437", "cp850", "cp866", "mac_roman", "koi8_r"]
READ_AS_WIDE = ["gb18030", "cp932", "big5", "cp949"]
WRITTEN_IN = ["cp1252", "cp1250", "cp1251", "cp1253", "koi8_r", "cp866", "iso8859_2", "iso8859_5", "iso8859_7", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp932", "euc_jp", "gb18030"]

TOKEN = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")
LINES = re.compile(r"[\r\n]+")
#: Share of a line's words outside ASCII that a single-byte mapping must explain for weak
#: evidence to count; a run of words that gains enough by itself counts in any line.
SHARE = 0.6
#: Bits that a word costs a run if the run's mapping doesn't explain it.
MISSED = 4.5
NON_ASCII = re.compile(r"[^\x00-\x7f]+")
#: Signs of damage by themselves: the replacement character and the C1 controls.
BROKEN = re.compile(r"[\ufffd\x80-\x9f]")
FIELDS = {"name": 0, "artist_name": 1, "plain_lyrics": 2}


def _single(name: str) -> dict[int, int]:
    """Character to byte, where undefined bytes stand for the control of that number, as browsers read them."""
    out = {}
    for b in range(128, 256):
        try:
            ch = bytes([b]).decode(name)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ord(ch), b)
    for b in range(128, 160):
        out.setdefault(b, b)
    return out


_BYTES = {n: _single(n) for n in READ_AS}
#: Encodings that read the byte A0 as a no-break space.
SPACED = frozenset(n for n, table in _BYTES.items() if table.get(0xA0) == 0xA0)


def to_bytes(s: str, name: str) -> bytes | None:
    """The bytes that, read by this encoding, give s."""
    if name in _BYTES:
        table, out = _BYTES[name], bytearray()
        for ch in s:
            o = ord(ch)
            if o < 128:
                out.append(o)
            elif (b := table.get(o)) is not None:
                out.append(b)
            else:
                return None
        return bytes(out)
    try:
        return s.encode(name)
    except UnicodeEncodeError:
        return None


def from_bytes(b: bytes, name: str) -> str | None:
    try:
        return b.decode(name)
    except UnicodeDecodeError:
        return None


def utf8_inverses(s: str) -> Iterator[tuple[str, str]]:
    """(encoding, text) for each reading of s that was UTF-8 in truth; applied again
    while it can be, for text that was hurt twice."""
    for name in READ_AS + READ_AS_WIDE:
        t, last = s, None
        for _ in range(3):
            b = to_bytes(t, name)
            u = b and from_bytes(b, "utf-8")
            if b and not u and name in SPACED:
                # The last byte was read as a no-break space, and went with blanks.
                u = from_bytes(b + b"\xa0", "utf-8")
            if not u or u == t or len(u) >= len(t) + 1 or u.isascii() and not t.isascii() and len(u) > 1 and not b.isascii():
                break
            t = last = u
        if last is not None:
            yield name, last


def reversible(token: str) -> bool:
    """Two characters or more outside ASCII in a row that are the bytes of UTF-8."""
    return any(len(r) > 1 and next(utf8_inverses(r), None) is not None for r in NON_ASCII.findall(token)) or BROKEN.search(token) is not None


def pair(a: str, b: str) -> int:
    return ord(a) << 21 | ord(b)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair and character counts of a partition. ASCII is counted by its bytes."""
    tokens: list[Counter] = [Counter() for _ in FIELDS]
    ascii_ = np.zeros((len(FIELDS), 256), np.int64)
    pairs: list[Counter] = [Counter() for _ in FIELDS]
    chars: list[Counter] = [Counter() for _ in FIELDS]

    def fold(k: int) -> None:
        for t, n in tokens[k].items():
            if reversible(t):
                continue
            padded = f" {folded(t)} "
            for a, b in zip(padded, padded[1:], strict=False):
                if a > "\x7f" or b > "\x7f":
                    pairs[k][pair(a, b)] += n
            for ch in padded:
                if ch > "\x7f":
                    chars[k][ch] += n
        tokens[k].clear()

    for b in batches:
        for f, v in zip(b.column("field").to_pylist(), b.column("value").to_pylist(), strict=True):
            k = FIELDS.get(f, 2)
            raw = v.encode()
            ascii_[k] += np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
            if len(raw) != len(v):
                tokens[k].update(TOKEN.findall(v))
        for k in range(len(FIELDS)):
            if len(tokens[k]) > 100_000:
                fold(k)
    rows = []
    for k in range(len(FIELDS)):
        fold(k)
        rows += [(k, 0, c, n) for c, n in pairs[k].items()]
        rows += [(k, 1, ord(c), n) for c, n in chars[k].items()]
        rows += [(k, 1, c, int(ascii_[k][c])) for c in range(128) if ascii_[k][c]]
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["model", "kind", "key", "n"])


class Pairs:
    """Counts of the corpus, one model for each kind of field; a pair's score is the best of the three."""

    def __init__(self, model: np.ndarray, kind: np.ndarray, key: np.ndarray, n: np.ndarray) -> None:
        self.keys, self.counts, self.chars = [], [], []
        for k in range(len(FIELDS)):
            mine = np.flatnonzero((model == k) & (kind == 0))
            mine = mine[np.argsort(key[mine])]
            self.keys.append(key[mine])
            self.counts.append(n[mine])
            own = (model == k) & (kind == 1)
            self.chars.append(dict(zip(key[own].tolist(), n[own].tolist(), strict=True)))
        self.total = [max(1, sum(c.values())) for c in self.chars]
        self._ready()

    def _ready(self) -> None:
        self.cache: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "cache"}

    def __setstate__(self, s: dict) -> None:
        self.__dict__.update(s)
        self._ready()

    def score(self, a: str, b: str) -> float:
        key = a + b
        s = self.cache.get(key)
        if s is None:
            c, best = pair(a, b), LOW
            for keys, counts, chars, n in zip(self.keys, self.counts, self.chars, self.total, strict=True):
                i = int(np.searchsorted(keys, c))
                if i == len(keys) or keys[i] != c:
                    continue
                # One occurrence is the value's own; it proves nothing.
                p = max((int(counts[i]) - 1) / n, PAIR_FLOOR)
                pa_, pb = (max(chars.get(ord(x), 0) / n, CHAR_FLOOR) for x in (a, b))
                if p > PAIR_FLOOR:
                    best = max(best, log2(p / (pa_ * pb)))
            s = min(best, HIGH)
            if len(self.cache) > 500_000:
                self.cache.clear()
            self.cache[key] = s
        return s

    def scores(self, token: str) -> list[float]:
        """Of each adjacent pair of the token between blanks; pairs of ASCII only are
        0. Case is folded where it says nothing: in other alphabets, and in words
        of capitals, of one leading capital or of capitals here and there."""
        p = f" {folded(token)} "
        return [self.score(a, b) if a > "\x7f" or b > "\x7f" else 0.0 for a, b in zip(p, p[1:], strict=False)]

    def text(self, token: str) -> float:
        return sum(self.scores(token))


def folded(token: str) -> str:
    letters = [c for c in token if c.isalpha()]
    latin = any(c.isascii() for c in letters)
    upper = [c for c in letters[1:] if c.isupper()]
    if not latin or not upper or len(upper) == len(letters) - 1 or sum(c.isascii() for c in upper) >= 2:
        return token.lower()
    return token


def segments(scores: list[float]) -> list[tuple[int, int]]:
    """First and last pair of each maximal scoring segment of improbability, by the linear
    algorithm of Ruzzo and Tompa: segments are disjoint, and none gets better by growing or shrinking."""
    out: list[tuple[int, int, float, float]] = []
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + IMPROBABLE - s
        if total <= before:
            continue
        first, last, left, right = i, i, before, total
        while True:
            j = next((j for j in range(len(out) - 1, -1, -1) if out[j][2] < left), None)
            if j is None or out[j][3] >= right:
                out.append((first, last, left, right))
                break
            first, left = out[j][0], out[j][2]
            del out[j:]
    return [(a, b) for a, b, _, _ in out]


def stretch(gains: list[float | None]) -> tuple[float, int, int]:
    """(bits, first, end) of the maximum-scoring run of words, given the bits that a mapping
    gains for each, or null for a word that it doesn't explain."""
    best, run, start = (0.0, 0, 0), 0.0, 0
    for i, g in enumerate(gains):
        if run <= 0:
            run, start = 0.0, i
        run += -MISSED if g is None else g
        if run > best[0]:
            best = (run, start, i + 1)
    return best


def _runs(token: str, model: Pairs) -> list[tuple[int, int]]:
    """Characters of each improbable run, widened to whole stretches outside ASCII."""
    out: list[tuple[int, int]] = []
    for first, last in segments(model.scores(token)):
        lo, hi = max(0, first - 1), min(len(token), last + 1)
        while lo > 0 and token[lo - 1] > "\x7f":
            lo -= 1
        while hi < len(token) and token[hi] > "\x7f":
            hi += 1
        if out and lo <= out[-1][1]:
            lo, hi = out.pop()[0], hi
        out.append((lo, hi))
    return out


def _look_alikes(run: str) -> bool:
    """Whether what isn't ASCII in the run is blank, or made of letters that look like
    Latin ones: other characters, but no other encoding."""
    return all(ord(ch) in PROTOTYPE or not skeleton(ch).strip() or ch >= "\uff00" for ch in run if ch > "\x7f")


#: The scripts in which whole words are written; a mapping may not mix them.
_SCRIPT = re.compile(r"([A-Za-zÀ-ɏ])|([Ѐ-ӿ])|([Ͱ-Ͽ])|([぀-ヿ一-鿿])")


def _mixed(s: str) -> bool:
    return len({m.lastindex for m in _SCRIPT.finditer(s)}) > 1


#: What stands for a mapping where a run holds a sign of damage by itself.
LOST = "lost"


def inspect(token: str, model: Pairs) -> list[tuple[str, float, str]]:
    """(mapping, bits gained, text) of each inverse mapping of the token's improbable
    runs that makes it more probable; empty for a token without such a run.

    A mapping is tried in each run by itself, and in what lies between the first and the last."""
    runs = _runs(token, model)
    if not runs:
        return []
    now, best = model.text(token), {}

    def note(name: str, gain: float, t: str) -> None:
        if name not in best or gain > best[name][0]:
            best[name] = (gain, t)

    for spans in [runs] + ([[(runs[0][0], runs[-1][1])]] if len(runs) > 1 else []):
        changed: dict[str, list[tuple[int, int, str]]] = {}
        for lo, hi in spans:
            for name, u in utf8_inverses(token[lo:hi]):
                changed.setdefault(f"utf-8 as {name}", []).append((lo, hi, u))
        for name, parts in changed.items():
            t = _replaced(token, parts)
            gain, shorter = model.text(t) - now, len(token) - len(t)
            if gain > 0 or t.isascii() or shorter >= 2 and not _mixed(t) and gain > -6:
                note(name, max(gain, 0) + 4 * shorter, t)
    if not best:
        for name in READ_AS:
            changed = {}
            for lo, hi in runs:
                run = token[lo:hi]
                b = None if _look_alikes(run) else to_bytes(run, name)
                if b is None or b.isascii():
                    continue
                for real in WRITTEN_IN:
                    u = from_bytes(b, real) if real != name else None
                    if u is not None and u != run and not u.isascii() and u.isprintable():
                        changed.setdefault(real, []).append((lo, hi, u))
            for real, parts in changed.items():
                t = _replaced(token, parts)
                if _mixed(t):
                    continue
                s = model.scores(t)
                outside = [x for x in s if x]
                if outside and sum(outside) / len(outside) >= IMPROBABLE:
                    note(f"{real} as {name}", sum(s) - now, t)
    out = [(m, g, t) for m, (g, t) in best.items()]
    # The replacement character and the C1 controls are in no pair of the counts, so they lie in a run.
    return out + ([(LOST, 0.0, token)] if any(BROKEN.search(token[lo:hi]) for lo, hi in runs) else [])


def _replaced(token: str, parts: list[tuple[int, int, str]]) -> str:
    for lo, hi, u in reversed(parts):
        token = token[:lo] + u + token[hi:]
    return token


class Doctor:
    """Inspects values; keeps what it found for each token, as tokens recur."""

    def __init__(self, model: Pairs) -> None:
        self.model, self.memo = model, {}

    def token(self, t: str) -> list[tuple[str, float, str]]:
        got = self.memo.get(t)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            got = self.memo[t] = inspect(t, self.model)
        return got

    def value(self, v: str) -> tuple[bool, str | None, str | None]:
        """(hurt, restored text or null, mapping)."""
        if v.isascii():
            return False, None, None
        found, gains = [], Counter()
        for line in LINES.split(v):
            if line.isascii():
                continue
            cands = [(t, self.token(t)) for t in TOKEN.findall(line)]
            here, count = Counter(), Counter()
            for _, c in cands:
                for m, g in {m: g for m, g, _ in sorted(c, key=lambda x: x[1])}.items():
                    here[m] += g
                    count[m] += 1
            for m, g in here.items():
                # A single-byte encoding hurts a whole stretch: most words of the line, or a run that suffices alone.
                if m.startswith("utf-8") or count[m] >= SHARE * len(cands):
                    gains[m] += g
                elif (bits := self._stretch([t for t, _ in cands], m)[0]) >= GAIN_RUN:
                    gains[m] += bits
            found += [(t, c) for t, c in cands if c]
        gains.pop(LOST, None)
        votes = [m for m, g in gains.items() if g >= (GAIN_UTF8 if m.startswith("utf-8") else GAIN)]
        if not votes:
            return any(m == LOST for _, c in found for m, _, _ in c), None, None
        order = sorted(votes, key=lambda m: (-gains[m], m))
        change = {}
        for t, cands in found:
            by = {m: x for m, _, x in sorted(cands, key=lambda c: c[1])}
            for m in order:
                if m in by:
                    change[t] = by[m]
                    break
        fixed = "".join(self._line(x, change, order[0]) for x in re.split(r"([\r\n]+)", v))
        return True, None if BROKEN.search(fixed) else fixed, order[0]


    def _stretch(self, tokens: list[str], mapping: str) -> tuple[float, int, int]:
        return stretch([max((g for m, g, _ in self.token(t) if m == mapping), default=None) for t in tokens])

    def _line(self, line: str, change: dict[str, str], best: str) -> str:
        """The line with its words restored; as a whole, where the best mapping is one
        of single bytes and explains most of its words, or the run of words that it explains."""
        toks = TOKEN.findall(line)
        if not best.startswith("utf-8") and sum(t in change for t in toks) >= SHARE * len(toks) > 0:
            real, _, name = best.partition(" as ")
            b = to_bytes(line, name)
            if b and (u := from_bytes(b, real)) and not _mixed("".join(TOKEN.findall(u))):
                return u
        words = lambda x: TOKEN.sub(lambda m: change.get(m[0], m[0]), x)
        if not best.startswith("utf-8") and toks:
            real, _, name = best.partition(" as ")
            bits, first, end = self._stretch(toks, best)
            at = [m.span() for m in TOKEN.finditer(line)]
            if bits >= GAIN_RUN:
                lo, hi = at[first][0], at[end - 1][1]
                b = to_bytes(line[lo:hi], name)
                if b and (u := from_bytes(b, real)) and not _mixed("".join(TOKEN.findall(u))):
                    return words(line[:lo]) + u + words(line[hi:])
        return words(line)


def pair_model(values: DataFrame) -> Broadcast:
    """Counts over all values (field, id, value), at the executors."""
    counts = values.filter("value is not null").mapInArrow(_count, "model int, kind int, key bigint, n bigint").groupBy("model", "kind", "key").agg(F.sum("n").alias("n"))
    # A pair's own occurrence proves nothing, so pairs that occur once are as pairs that don't: they needn't come.
    counts = stored(counts.filter("kind = 1 or n > 1"))
    # By powers of two: the least count of which a model has no more than MOST_PAIRS pairs.
    steps = counts.filter("kind = 0").groupBy("model", F.floor(F.log2("n")).cast("int").alias("step")).agg(F.count("*").alias("pairs")).collect()
    least = {}
    for k in range(len(FIELDS)):
        left = MOST_PAIRS
        for r in sorted((r for r in steps if r["model"] == k), key=lambda r: -r["step"]):
            left -= r["pairs"]
            if left < 0:
                least[k] = 2 << r["step"]
                break
    kept = reduce(or_, [(F.col("model") == k) & (F.col("n") >= least.get(k, 0)) for k in range(len(FIELDS))])
    rows = counts.filter((F.col("kind") == 1) | kept).toArrow()
    return values.sparkSession.sparkContext.broadcast(Pairs(*(rows[c].to_numpy() for c in ("model", "kind", "key", "n"))))


def repair(values: DataFrame, model: Broadcast | None = None) -> DataFrame:
    """Hurt values only: (field, id, value, restored, mapping).

    restored is null where the original can't be had in full. Null values are never
    hurt, nor are empty ones; equal rows give equal rows.
    """
    model = model or pair_model(values)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doctor = Doctor(model.value)
        for b in batches:
            rows = []
            for f, i, v in zip(*(b.column(c).to_pylist() for c in ("field", "id", "value")), strict=True):
                if v and not v.isascii():
                    hurt, fixed, how = doctor.value(v)
                    if hurt:
                        rows.append((f, i, v, fixed, how))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "id" else pa.string()) for c, n in zip(cols, names, strict=True)], names)

    names = ["field", "id", "value", "restored", "mapping"]
    return values.select("field", "id", "value").mapInArrow(scan, "field string, id bigint, value string, restored string, mapping string")
