"""Texts that were cut off: at a limit of their source, or in transfer.

Two kinds of evidence are added up as log odds.

Lengths: for each source, lengths are log-normal, right-censored at unknown
limits, in characters or in bytes. Each length that far more texts have than those around
it is a candidate, whether or not longer texts exist (a limit may have been raised,
or hold for a part of a source only). Parameters, and the share of texts that a limit cuts of those that
reach it, are fitted by maximum likelihood (EM over the histogram of lengths) with each candidate, and a
limit is taken if the censored model is far more likely than the plain one. The posterior that a
value at the limit is a censored one follows from that share, the tail and the density there.

Endings: how often does the corpus, inside its texts, end a unit (a line or a sentence)
with what this text ends with, against going on after it? Counted for the whole unit,
for its frame (frequent words kept, others as a blank), for its last two words and
its last word. A last word that the corpus has nowhere else is likely a piece of one.
A character broken in transfer, or a stored length above the text's, add to it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choralis.llm.common import Bits, stored
from choralis.llm.lookalike import form

#: A word of at least this share of all words is kept in frames; there are at most 1/share such words.
FREQUENT = 1e-3
#: A whole unit of few words that ends this share of all texts is a customary close.
CLOSING = 1e-3
#: A whole unit that occurs so often, or is gone on from, is judged by itself alone.
OFTEN = 30
#: Prior log odds of a cut that isn't at a limit.
PRIOR = math.log(0.15 / 0.85)
#: Log-likelihood by which a limit must explain a source's lengths better than none does.
CLEAR = 10.0
#: The same for a limit that longer texts exceed: as it is picked out of all lengths, it needs more.
CLEAR_EXCEEDED = 25.0
#: A limit cuts at least this share of the texts that reach it.
LEAST_SHARE = 0.05
#: Lengths above this that fewer than PEAK texts have are binned by their logarithm, so a source's histogram stays small.
FINE, PEAK = 1 << 16, 3

TOKEN = re.compile(r"[\u3005-\u3007\u3040-\u30ff\u3400-\u9fff]|[^\W_\u3005-\u3007\u3040-\u30ff\u3400-\u9fff]+(?:['’][^\W_\u3005-\u3007\u3040-\u30ff\u3400-\u9fff]+)*|[^\w\s]")
UNIT = re.compile(r"[\r\n\v\f]+|(?<=[.!?])[\"”']?\s+(?=[^\W\d_a-zа-яα-ω])")
EAST = re.compile(r"[\u3005-\u3007\u3040-\u30ff\u3400-\u9fff]")
STOP = frozenset(".!?\"”…")
#: Marks that a source puts where it cut.
ELLIPSIS = re.compile(r"(…|\.{3})\s*$")
MASK = np.uint64((1 << 63) - 1)
BASE = np.uint64(0x9E3779B97F4A7C15)
LEVELS = R, K, B, C, T = range(5)


def units(s: str) -> list[str]:
    return [u for u in UNIT.split(s.strip()) if u and not u.isspace()]


class Hasher(dict):
    """Numbers words, and hashes sequences of them by the batch: the hash of a prefix is a
    running sum of word hashes, each times a power for its place."""

    def __init__(self, frequent: frozenset[str]) -> None:
        super().__init__()
        self.frequent = frequent
        self.own, self.frame = [], []
        self.powers = np.ones(1, np.uint64)

    def __missing__(self, w: str) -> int:
        low = w.lower()
        h = xxhash.xxh64_intdigest(low)
        self.own.append(h)
        self.frame.append(h if low in self.frequent else 7)
        i = self[w] = len(self.own) - 1
        return i

    def renew(self) -> None:
        """Forget all words when they are many; between batches only."""
        if len(self) > 500_000:
            self.clear()
            self.own, self.frame = [], []

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.array([self[w] for w in words], np.int64)

    def levels(self, at: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
        """Hashes of the levels R, K, B and C behind each word. at: numbers of the words of all
        units, one unit of so many words after the other, none empty."""
        n = np.array(sizes, np.int64)
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        place = np.arange(len(at)) - np.repeat(start, n)
        while len(self.powers) <= n.max():
            self.powers = np.concatenate([self.powers, self.powers * self.powers[-1] * BASE])
        power = self.powers[place]
        own = np.array(self.own, np.uint64)[at]
        out = []
        for h in (own, np.array(self.frame, np.uint64)[at]):
            terms = h * power
            total = np.cumsum(terms)
            out.append(total - np.repeat(total[start] - terms[start], n))
        before = np.concatenate([[np.uint64(0)], own[:-1]])
        before[start] = 0
        out += [before * np.uint64(31) + own, own]
        return [(x & MASK).astype(np.int64) for x in out]


#: What tells hashes of different levels apart in the filter.
SALT = 0x5851F42D4C957F2D


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def frequent_words(texts: DataFrame) -> frozenset[str]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["w", "n"])
        for b in batches:
            for t in b.column("text").to_pylist():
                ws = TOKEN.findall(t.lower())
                n.update(ws)
                n[""] += len(ws)
            if len(n) > 500_000:
                yield out()
                n.clear()
        yield out()

    words = texts.mapInArrow(count, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    # The total is the row of no word. No more words than 1 / FREQUENT can be frequent, so the largest counts are all that come.
    top = {r["w"]: r["n"] for r in words.orderBy(F.desc("n"), "w").limit(int(1 / FREQUENT) + 1).collect()}
    total = top.pop("", 0)
    return frozenset(w for w, n in top.items() if n >= total * FREQUENT)


def wanted(ends: DataFrame) -> Bits:
    """A filter of the hashes that endings ask for, sized by how many they are. What it
    lets through in vain costs time only."""
    return Bits.of(ends.select(*[F.col(c).bitwiseXOR(F.lit(lv * SALT >> 3)).alias(c) for lv, c in zip((R, K, B), "rkb", strict=True)]))


def unit_counts(texts: DataFrame, frequent, asked) -> DataFrame:
    """(level, h, whole, goes_on): how often what h stands for ended a unit inside a text,
    and how often a unit went on after it, for what passes the filter `asked`, and for all
    last words. The last unit of a text isn't counted but at level T, as a whole, for
    customary closes. Totals are at level -1."""
    schema = pa.schema([("level", pa.int32()), ("h", pa.int64()), ("whole", pa.int64()), ("goes_on", pa.int64())])

    def part(level: int, h: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        u, back = np.unique(h, return_inverse=True)
        whole = np.bincount(back, last, len(u)).astype(np.int64)
        return [np.full(len(u), level, np.int32), u, whole, np.bincount(back, minlength=len(u)) - whole]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, among = Hasher(frequent.value), asked.value.among
        for b in batches:
            hasher.renew()
            words, sizes, closes = [], [], []
            for t in b.column("text").to_pylist():
                us = units(t)
                for u in us[:-1]:
                    if ws := TOKEN.findall(u):
                        words += ws
                        sizes.append(len(ws))
                if us:
                    closes.append(xxhash.xxh64_intdigest(us[-1].strip()) & int(MASK))
            close = np.array(closes, np.int64)
            parts = [part(T, close, np.ones(len(close)))]
            if words:
                last = np.zeros(len(words), bool)
                last[np.cumsum(sizes) - 1] = True
                at = hasher.numbers(words)
                for lv, h in enumerate(hasher.levels(at, sizes)[:C]):
                    keep = np.zeros(len(h), bool)
                    keep[among(h ^ np.int64(lv * SALT >> 3))] = True
                    # All pairs at ends are counted, to know how many are seen but once.
                    keep = keep | last if lv == B else keep
                    parts.append(part(lv, h[keep], last[keep]))
                # Of single words all are counted, by their numbers.
                own = (np.array(hasher.own, np.uint64) & MASK).astype(np.int64)
                whole, every = (np.bincount(x, minlength=len(own)) for x in (at[last], at))
                seen = np.flatnonzero(every)
                parts.append([np.full(len(seen), C, np.int32), own[seen], whole[seen], (every - whole)[seen]])
                parts.append([np.array([x], np.int64) for x in (-1, 0, len(sizes), len(words) - len(sizes))])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*parts, strict=True), schema, strict=True)], schema=schema)

    counts = texts.mapInArrow(count, "level int, h bigint, whole bigint, goes_on bigint")
    return counts.groupBy("level", "h").agg(F.sum("whole").alias("whole"), F.sum("goes_on").alias("goes_on"))


def endings(docs: DataFrame, frequent) -> DataFrame:
    """One row per text that isn't blank, with its lengths and the hashes of its last unit."""
    names = ["doc_id", "source", "chars", "bytes", "marked", "broken", "prose", "stopped", "pictured", "wordy", "east", "missing", "r", "k", "b", "c", "t"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.bool_()] * 7, pa.int64(), *[pa.int64()] * 5]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(frequent.value)
        for b in batches:
            hasher.renew()
            rows, ends_ = [], []
            for i, src, t, n in zip(*(b.column(c).to_pylist() for c in ("doc_id", "source", "text", "n_chars")), strict=True):
                us = units(t)
                if not us:
                    continue
                size, raw = len(t), len(t.encode())
                marked = ELLIPSIS.search(us[-1]) is not None
                last = ELLIPSIS.sub("", us[-1]).strip() if marked else us[-1].strip()
                # Letters that only look alike would be words seen nowhere else.
                ends_.append(TOKEN.findall(form(last)) or [""])
                stops = [u.strip()[-1] in STOP for u in us[:-1]]
                prose = len(stops) >= 2 and sum(stops) >= 0.8 * len(stops)
                # A stored length is evidence only if it can't be another way to count the same text.
                missing = n - size if n is not None and n != raw and n > size else 0
                tail, word = us[-1].strip()[-1], ends_[-1][-1]
                pictured = unicodedata.category(tail) in ("So", "Sk", "Mn", "Cf") and tail != "\ufffd" or tail in ")]}" and last.count("(") == last.count(")")
                rows.append((i, src, size, raw, marked, tail == "\ufffd", prose, tail in STOP, pictured, word.isalpha() and len(ends_[-1]) > 1, EAST.match(word) is not None, missing, 0, 0, 0, 0, xxhash.xxh64_intdigest(us[-1].strip()) & int(MASK)))
            out = _batch(rows, schema)
            if rows:
                sizes = [len(e) for e in ends_]
                at = np.cumsum(sizes) - 1
                for name, h in zip("rkbc", hasher.levels(hasher.numbers([w for e in ends_ for w in e]), sizes), strict=True):
                    out = out.set_column(names.index(name), name, pa.array(h[at], pa.int64()))
            yield out

    ddl = ", ".join(f"{n} {'string' if n == 'source' else 'boolean' if k == pa.bool_() else 'bigint'}" for n, k in zip(names, kinds, strict=True))
    return docs.select("doc_id", "source", "text", "n_chars").mapInArrow(scan, ddl)


def _phi(x: np.ndarray) -> np.ndarray:
    return np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def _tail(x: float) -> float:
    return max(0.5 * math.erfc(x / math.sqrt(2)), 1e-300)


def fit(length: np.ndarray, n: np.ndarray, limits_: list[tuple[float, float]]) -> tuple[float, float, list[float], float]:
    """(mu, sigma, shares, log-likelihood) of log-lengths by EM. limits_: (limit, slack); lengths
    from limit - slack to limit are those of texts censored there. shares: of the texts that
    reach each limit, the part that is cut there."""
    x = np.log(length)
    at = np.zeros(len(x), bool)
    cut: list[tuple[float, float, float, float]] = []
    for limit, slack in limits_:
        here = (length >= limit - slack) & (length <= limit) & ~at
        at |= here
        cut.append((math.log(limit), float(n[here].sum()), float(n[length > limit].sum()), 1 + slack))
    xf, nf = x[~at], n[~at]
    total = float(n.sum())
    if not nf.sum():
        return float(x.mean()), 1.0, [1.0] * len(cut), -math.inf
    mu = float((n * x).sum() / n.sum())
    sd = max(0.05, math.sqrt(float((n * (x - mu) ** 2).sum() / n.sum())))
    for _ in range(60 if cut else 1):
        s1, s2 = float((nf * xf).sum()), float((nf * xf * xf).sum())
        for c, m, _above, _wide in cut:
            z = (c - mu) / sd
            lam = float(_phi(np.array(z))) / _tail(z)
            s1 += m * (mu + sd * lam)
            s2 += m * (mu * mu + sd * sd + sd * lam * (c + mu))
        mu, before = s1 / total, mu
        sd, was = math.sqrt(max(s2 / total - mu * mu, 2.5e-3)), sd
        if abs(mu - before) + abs(sd - was) < 1e-9:
            break
    ll = float((nf * (-np.log(sd * math.sqrt(2 * math.pi)) - (xf - mu) ** 2 / (2 * sd * sd) - xf)).sum())
    shares = []
    for c, m, above, wide in cut:
        shares.append(m / max(m + above, 1e-9))
        ll += m * math.log(max(_tail((c - mu) / sd) * shares[-1] / wide, 1e-300))
        ll += above * math.log(1 - shares[-1]) if above else 0.0
    return mu, sd, shares, ll


def candidates(length: np.ndarray, n: np.ndarray, slack: int) -> list[int]:
    """Positions of the lengths that far more texts have than those around, and of the greatest length."""
    total = np.concatenate([[0.0], np.cumsum(n)])
    upto = lambda v: total[np.searchsorted(length, v, "right")]
    at = total[1:] - upto(length - slack - 1)
    width = np.maximum(10.0, np.floor(length * 0.02))
    # On either side: where lengths thin out all at once, the last of them are no peak.
    around = np.maximum(upto(length - slack - 1) - upto(length - slack - 1 - width), upto(length + width) - upto(length))
    expected = (around + 0.5) / width * (1 + slack)
    clear = at * np.log(np.maximum(at, 1e-9) / expected) - (at - expected)
    share = at / (total[-1] - total[1:] + at)
    ok = (at >= PEAK) & (at > expected) & (clear > CLEAR) & (share >= LEAST_SHARE) | (np.arange(len(length)) == len(length) - 1) & (at >= PEAK)
    return np.flatnonzero(ok & (n > 0)).tolist()


def fit_source(h: pd.DataFrame) -> pd.DataFrame:
    """The limits of one source, all in the unit that explains its lengths best, from its histogram (unit, length, n)."""
    best: tuple[float, list[tuple]] = (0.0, [])
    for unit, g in h.groupby("unit"):
        g = g.groupby("length", as_index=False)["n"].sum().sort_values("length")
        length, n = g["length"].to_numpy(float), g["n"].to_numpy(float)
        # Bytes may end up to three short of the limit, where a character didn't fit.
        slack = 3.0 if unit == "bytes" else 0.0
        if len(length) < 5:
            continue
        plain = now = fit(length, n, [])[-1]
        open_, taken, fitted = [float(length[i]) for i in candidates(length, n, slack)], [], None
        # One limit after the other, each against the model with those before it.
        while open_:
            tried = [(got[-1] - (CLEAR_EXCEEDED if c < length[-1] else CLEAR), c, got) for c in open_ if (got := fit(length, n, [*taken, (c, slack)]))]
            gain, c, got = max(tried, key=lambda t: (t[0], t[1]))
            if gain <= now:
                break
            taken.append((c, slack))
            fitted, now = got, got[-1]
            # What is near is the same limit, seen through the slack.
            open_ = [x for x in open_ if abs(x - c) > 3]
        if taken and now - plain > best[0]:
            mu, sd, shares, _ = fitted
            rows = []
            for (c, _), share in zip(taken, shares, strict=True):
                z = (math.log(c) - mu) / sd
                density = float(_phi(np.array(z))) / (sd * c)
                odds = math.log(share * _tail(z) / max(density * (1 + slack), 1e-300))
                rows.append((unit, int(c), int(slack), odds, float(n[(length >= c - slack) & (length <= c)].sum()), float(n.sum()), mu, sd, share))
            best = (now - plain, rows)
    cols = ["source", "unit", "limit", "slack", "log_odds", "at_limit", "texts", "mu", "sigma", "share"]
    return pd.DataFrame([(h["source"].iloc[0], *r) for r in best[1]], columns=cols)


def limits(ends: DataFrame) -> DataFrame:
    """(source, unit, limit, slack, log_odds, ...) of each limit of each source whose lengths are censored.

    A text that was collected again counts once, else copies of a long text look like a limit.
    The histogram is aggregated first; a source's own is at most some ten thousand bins."""
    ends = ends.select("source", "chars", "bytes", "r", "t").distinct()
    each = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")]))
    exact = ends.filter("source is not null").select("source", each.alias("_h")).groupBy("source", "_h.unit", "_h.length").agg(F.count("*").alias("n"))
    fine = (F.col("length") <= FINE) | (F.col("n") >= PEAK)
    binned = F.when(fine, F.col("length")).otherwise(F.round(F.exp(F.round(F.log("length"), 3))).cast("bigint"))
    hist = exact.withColumn("length", binned).groupBy("source", "unit", "length").agg(F.sum("n").alias("n"))
    schema = "source string, unit string, limit bigint, slack int, log_odds double, at_limit double, texts double, mu double, sigma double, share double"
    return hist.groupBy("source").applyInPandas(fit_source, schema)


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, source, cut, log_odds, at_limit) of every text that isn't null, empty or blank.

    Whole texts are read; repeated rows are repeated; a null source has no limit.
    """
    d = docs.filter("text is not null")
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_words(d.select("text")))
    # Both are read several times below, and are narrow: computed once and kept in the shared folder.
    ends = stored(endings(d, frequent))
    counts = stored(unit_counts(d.select("text"), frequent, spark.sparkContext.broadcast(wanted(ends))))
    total, word, pair = F.col("level") == -1, F.col("level") == C, F.col("level") == B
    totals = counts.agg(
        F.coalesce(F.sum(F.when(total, F.col("whole"))), F.lit(0)).alias("units"),
        F.coalesce(F.sum(F.when(total, F.col("goes_on"))), F.lit(0)).alias("prefixes"),
        F.count_if(word & (F.col("whole") == 1) & (F.col("goes_on") == 0)).alias("singles"),
        F.count_if(pair & (F.col("whole") == 1) & (F.col("goes_on") == 0)).alias("pairs"),
    ).first()
    units_, prefixes = max(1, totals["units"]), max(1, totals["prefixes"])
    # A last word that is nowhere else: so rare among whole units, so frequent among pieces of words.
    unseen = math.log(max(totals["singles"] / units_, 1e-3) / 0.5)
    unseen_pair = math.log(max(totals["pairs"] / units_, 1e-3) / 0.8)
    texts = ends.agg(F.count("*")).first()[0]

    # Each ending meets the counts of its levels by hash, in one join: rows (doc, level, hash).
    asked = ends.select("doc_id", F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), F.col(c).alias("h")) for lv, c in zip(LEVELS, "rkbct", strict=True)])).alias("_q")).select("doc_id", "_q.*")
    met = asked.join(counts, ["level", "h"], "left").groupBy("doc_id")
    sums = [F.max(F.when(F.col("level") == lv, F.coalesce(F.col(c), F.lit(0)))).alias(f"{x}{c[0]}") for lv, x in zip(LEVELS, "rkbct", strict=True) for c in ("whole", "goes_on")]
    e = ends.join(met.agg(*sums), "doc_id")

    # A row for each source that has limits; written, so that Spark knows its size when it chooses the join.
    lim = stored(limits(ends).groupBy("source").agg(F.collect_list(F.struct("log_odds", "unit", "limit", "slack")).alias("limits")))
    size = lambda l: F.when(l["unit"] == "bytes", F.col("bytes")).otherwise(F.col("chars"))
    hit = F.filter("limits", lambda l: (size(l) <= l["limit"]) & (size(l) >= l["limit"] - l["slack"]))
    e = e.join(lim, "source", "left").withColumn("limit_odds", F.array_max(F.transform(hit, lambda l: l["log_odds"]))).drop("limits")
    facts = Facts(units_, prefixes, unseen, unseen_pair, max(3.0, CLOSING * texts))
    return e.mapInPandas(lambda parts: (facts.decide(x) for x in parts), "doc_id bigint, source string, cut boolean, log_odds double, at_limit boolean, ending double")


@dataclass(frozen=True)
class Facts:
    """Totals of the corpus that the decision needs."""

    units: int
    prefixes: int
    unseen: float
    unseen_pair: float
    customary: float

    def ratio(self, x: pd.DataFrame, level: str) -> np.ndarray:
        """Log likelihood ratio of a whole unit against one that was cut, from the counts of a level."""
        w, g = (x[f"{level}{c}"].to_numpy(float) for c in "wg")
        return np.log((w + 0.5) / (self.units + 1)) - np.log((g + 0.5) / (self.prefixes + 1))

    def ending(self, x: pd.DataFrame, at_limit: np.ndarray) -> np.ndarray:
        n = {lv: x[f"{lv}w"].to_numpy(float) + x[f"{lv}g"].to_numpy(float) for lv in "rkbc"}
        lr = {lv: self.ratio(x, lv) for lv in "rkbc"}
        frame = np.where(n["k"] >= 5, lr["k"], np.where(n["b"] >= 5, lr["b"], np.nan))
        # Where words are written without spaces, each letter is a word here, and the last two say most.
        east = x["east"].to_numpy(bool)
        frame = np.where(east, np.where(n["b"] >= 5, lr["b"], np.nan), frame)
        known = np.where(np.isnan(frame), 0.0, frame)
        out = np.where(np.isnan(frame), lr["c"], frame)
        # A last word that ends few units speaks against an end, whatever the frame says.
        out = np.where((x["cw"] == 0) | (lr["c"] < -2) & ~east, known + np.minimum(lr["c"], 0), out)
        out = np.where((n["b"] == 0) & x["wordy"].to_numpy(bool), np.minimum(out, np.clip(known, -3, 3) + self.unseen_pair), out)
        out = np.where(n["c"] == 0, np.clip(known, -3, 3) + self.unseen, out)
        out = np.where(n["r"] >= OFTEN, np.clip(lr["r"], -6, 6), out)
        prose, stopped = x["prose"].to_numpy(bool), x["stopped"].to_numpy(bool)
        out = np.where(prose, np.where(stopped, np.maximum(out, 3), np.minimum(out, -4)), out)
        closing = x["tw"].to_numpy(float) >= self.customary
        out = np.where(closing, np.maximum(out, 3), out)
        # A stop, a bracket or a picture closes a text, unless it stands at the limit, where a source may put an ellipsis.
        out = np.where((stopped | x["pictured"].to_numpy(bool)) & ~at_limit, np.maximum(out, 0), out)
        return np.where(x["broken"].to_numpy(bool), -8.0, out)

    def decide(self, x: pd.DataFrame) -> pd.DataFrame:
        at_limit = x["limit_odds"].notna().to_numpy()
        ending = self.ending(x, at_limit)
        odds = np.where(at_limit, x["limit_odds"].to_numpy(float) - np.clip(ending, -3, 3), PRIOR - ending)
        odds = odds + np.where(x["missing"] >= 10, 3.0, 0.0)
        return pd.DataFrame({"doc_id": x["doc_id"], "source": x["source"], "cut": odds > 0, "log_odds": odds, "at_limit": at_limit, "ending": ending})


def rates(judged: DataFrame) -> DataFrame:
    """Of each source: texts, cut ones, those at its limit, and the rate."""
    return judged.groupBy("source").agg(
        F.count("*").alias("texts"), F.count_if("cut").alias("cut"), F.count_if(F.col("cut") & F.col("at_limit")).alias("at_limit"), F.avg(F.col("cut").cast("int")).alias("rate")
    )
