"""Languages of texts and of the passages of mixed texts.

Hierarchical discrimination: linear support vector machines tell the family of
a line first; within the family, one machine for each pair of languages votes.
Features are the letter sequences of words (one to four letters, word ends marked),
hashed to a fixed number of dimensions. A line's margin is the mean over its
features, so a word adds a vector that is computed once and kept.

The machines are trained here, on a bounded sample of labelled texts (PER_LANGUAGE a
language), twice: labels are partly wrong and texts partly mixed, so lines on which
the first round disagrees with their label are left out of the second.

Lines are then joined to passages by the most probable path (Viterbi) with a cost for
each change of language. A language is in a text if a passage of it has two lines.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FAMILIES = {"germanic": ["en", "de", "nl", "sv"], "romance": ["fr", "es", "it", "pt"], "slavic": ["pl", "ru"], "hellenic": ["el"], "japonic": ["ja"]}
LANGUAGES = [x for xs in FAMILIES.values() for x in xs]
PAIRS = [(a, b) for xs in FAMILIES.values() for a, b in combinations(xs, 2)]
# Names of the languages in labels, by code.
NAMES = {
    "en": "eng english englisch anglais inglés inglese inglês engels engelska",
    "de": "deu ger german deutsch allemand alemán tedesco alemão duits tyska",
    "nl": "nld dut dutch nederlands flemish néerlandais niederländisch",
    "sv": "swe swedish svenska schwedisch suédois",
    "fr": "fra fre french français francais französisch francés francese",
    "es": "spa spanish español espanol castellano spanisch espagnol castilian",
    "it": "ita italian italiano italienisch italien",
    "pt": "por portuguese português portugues portugiesisch portugais brazilian",
    "pl": "pol polish polski polnisch polonais",
    "ru": "rus russian русский russisch russe",
    "el": "ell gre greek ελληνικά griechisch grec gr",
    "ja": "jpn japanese 日本語 japanisch japonais jp",
}
BY_NAME = {n: c for c, ns in NAMES.items() for n in [c, *ns.split()]}

#: Texts of each language in the training sample, and lines of each text.
PER_LANGUAGE, PER_TEXT = 150, 24
#: Characters of a text of the sample, in which its lines are looked for.
SAMPLED = 20_000
DIMENSIONS = 1 << 15
EPOCHS, RATE, DECAY, BATCH = 6, 60.0, 1e-4, 128
#: Steepness with which a margin becomes a probability, and the cost of a change of language.
STEEP, SWITCH = 3.0, 3.0
LINES_IN_TEXT, LINES_IN_A_ROW = 4, 2

LINE = re.compile(r"\r\n|\r|\n")
WORD = re.compile(r"[^\W\d_]+")
#: Sung syllables and marks, which are of no language.
SUNG = re.compile(r"(?:(?:la|na|da|do|sha|oh|ooh+|ah|aah|hey|ho|mm+|hmm+|uh|yeah|woo|ye|whoa|x\d*|fade|instrumental|chorus|verse|bridge|refrain|repeat)\b[\s,.!\-~\[\]():0-9]*)+", re.I)


def language_of_label(label: str | None) -> str | None:
    """Two-letter code of a label in any usual notation; null if it names no language."""
    s = (label or "").strip().lower()
    if s in BY_NAME:
        return BY_NAME[s]
    head = re.split(r"[-_ (,;/]", s)[0]
    return BY_NAME.get(head)


@lru_cache(1 << 17)
def grams(word: str) -> tuple[int, ...]:
    """Hashed letter sequences of a word."""
    w = f"<{word}>"
    return tuple(zlib.crc32(w[i : i + n].encode()) % DIMENSIONS for n in (1, 2, 3, 4) for i in range(len(w) - n + 1))


def lines_of(text: str) -> list[str]:
    """Lines that aren't blank."""
    return [x for x in LINE.split(text) if x.strip()]


def words_of(line: str) -> list[str]:
    """Words of a line; none for a line of sung syllables or marks only."""
    if SUNG.fullmatch(line.strip().strip("([{")):
        return []
    return WORD.findall(line.lower())


class Machine:
    """Linear machines: columns of weights over hashed features, the families' first, then the pairs'."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray) -> None:
        self.weights, self.bias = weights.astype(np.float32), bias.astype(np.float32)
        self._ready()

    def _ready(self) -> None:
        self.index: dict[str, int] = {}
        self.vectors = np.zeros((1024, len(self.bias) + 1), np.float32)

    def __getstate__(self) -> tuple:
        return self.weights, self.bias

    def __setstate__(self, s: tuple) -> None:
        self.weights, self.bias = s
        self._ready()

    def number(self, word: str) -> int:
        i = self.index.get(word)
        if i is None:
            i = self.index[word] = len(self.index)
            if i == len(self.vectors):
                self.vectors = np.vstack([self.vectors, np.zeros_like(self.vectors)])
            g = list(grams(word))
            self.vectors[i, :-1] = self.weights[g].sum(axis=0)
            self.vectors[i, -1] = len(g)
        return i

    def margins(self, lines: list[list[str]]) -> np.ndarray:
        """One row of margins per line, each of one word at least."""
        if len(self.index) > 300_000:
            self._ready()
        get, number = self.index.get, self.number
        flat = [i if (i := get(w)) is not None else number(w) for ws in lines for w in ws]
        at = np.cumsum([0, *[len(ws) for ws in lines[:-1]]])
        sums = np.add.reduceat(self.vectors[flat], at, axis=0)
        return sums[:, :-1] / sums[:, -1:] + self.bias

    def scores(self, lines: list[list[str]]) -> np.ndarray:
        """Log-probability of each language for each line: its family's, and within it the pairs' votes."""
        return _log_scores(self.margins(lines))


def _log_scores(m: np.ndarray) -> np.ndarray:
    log_sigmoid = lambda x: -np.logaddexp(0, -STEEP * x)
    out = np.zeros((len(m), len(LANGUAGES)), np.float64)
    for k, (_, langs) in enumerate(FAMILIES.items()):
        for x in langs:
            out[:, LANGUAGES.index(x)] += log_sigmoid(m[:, k])
    for k, (a, b) in enumerate(PAIRS, len(FAMILIES)):
        out[:, LANGUAGES.index(a)] += log_sigmoid(m[:, k])
        out[:, LANGUAGES.index(b)] += log_sigmoid(-m[:, k])
    return out - np.logaddexp.reduce(out, axis=1, keepdims=True)


def _svm(rows: list[np.ndarray], y: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Hinge loss with decay, by averaged mini-batch subgradient steps; classes weigh alike."""
    rng = np.random.default_rng(seed)
    w, b, avg, avg_b, steps = np.zeros(DIMENSIONS), 0.0, np.zeros(DIMENSIONS), 0.0, 0
    share = {1.0: max(1, (y > 0).sum()) / len(y), -1.0: max(1, (y < 0).sum()) / len(y)}
    weight = np.array([0.5 / share[v] for v in y])
    size = np.array([len(r) for r in rows])
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            flat = np.concatenate([rows[i] for i in part])
            n = size[part]
            line = np.repeat(np.arange(len(part)), n)
            m = np.bincount(line, w[flat], len(part)) / n + b
            miss = (m * y[part] < 1) * y[part] * weight[part]
            rate = RATE / (1 + steps * 0.01)
            w *= 1 - rate * DECAY / BATCH
            w += np.bincount(flat, (miss / n)[line], DIMENSIONS) * rate / len(part)
            b += 0.01 * rate * miss.mean()
            steps += 1
            avg += w
            avg_b += b
    return avg / max(1, steps), avg_b / max(1, steps)


def train(lines: list[list[str]], labels: list[str]) -> Machine:
    """Machines from lines with (partly wrong) labels."""
    rows = [np.array([g for w in ws for g in grams(w)], np.int64) for ws in lines]
    labels_ = np.array(labels)
    family = np.array([next(f for f, xs in FAMILIES.items() if x in xs) for x in labels])
    keep = np.ones(len(rows), bool)
    machine = None
    for round_ in range(2):
        w = np.zeros((DIMENSIONS, len(FAMILIES) + len(PAIRS)))
        bias = np.zeros(w.shape[1])
        for k, f in enumerate(FAMILIES):
            if (family[keep] == f).any() and (family[keep] != f).any():
                at = np.flatnonzero(keep)
                w[:, k], bias[k] = _svm([rows[i] for i in at], np.where(family[at] == f, 1.0, -1.0), k)
            else:
                bias[k] = 1.0 if (family[keep] == f).any() else -1.0
        for k, (a, b) in enumerate(PAIRS, len(FAMILIES)):
            at = np.flatnonzero(keep & ((labels_ == a) | (labels_ == b)))
            both = {a, b} <= set(labels_[at])
            if both:
                w[:, k], bias[k] = _svm([rows[i] for i in at], np.where(labels_[at] == a, 1.0, -1.0), k)
            else:
                bias[k] = 1.0 if a in labels_[at] else -1.0
        machine = Machine(w, bias)
        if round_ == 0 and len(lines):
            guess = machine.scores(lines).argmax(axis=1)
            keep = np.array([LANGUAGES[g] == x for g, x in zip(guess, labels, strict=True)])
    return machine


def sample(lyrics: DataFrame, labels: DataFrame, usable: Callable[[str], bool]) -> tuple[list[list[str]], list[str]]:
    """Lines of the training sample and their labels, on the driver: at most
    PER_LANGUAGE * PER_TEXT lines a language, chosen by a hash of the id."""
    codes = F.create_map(*[F.lit(x) for n, c in BY_NAME.items() for x in (n, c)])
    raw = F.lower(F.trim("lang"))
    lang = F.coalesce(codes[raw], codes[F.regexp_extract(raw, r"^([^-_ (,;/]+)", 1)])
    named = labels.select(F.col("lyrics_id").alias("id"), lang.alias("lang")).filter("lang is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = named.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= PER_LANGUAGE).select("id", "lang")
    # At most PER_LANGUAGE * 12 ids: the texts are picked from the scan by a broadcast of those.
    rows = lyrics.select("id", F.substring("plain_lyrics", 1, SAMPLED).alias("plain_lyrics")).filter("plain_lyrics is not null").join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id").agg(F.min("lang").alias("lang"), F.min("plain_lyrics").alias("plain_lyrics")).collect()
    lines, out = [], []
    for r in sorted(rows, key=lambda r: r["id"]):
        if not usable(r["plain_lyrics"]):
            continue
        ws = [w for x in lines_of(r["plain_lyrics"]) if (w := words_of(x))][:PER_TEXT]
        lines += ws
        out += [r["lang"]] * len(ws)
    return lines, out


def passages(score: np.ndarray) -> list[int]:
    """Language of each line on the most probable path."""
    first = score.argmax(axis=1)
    if (first == first[0]).all():
        return first.tolist()
    best, back = score[0], []
    for row in score[1:]:
        k = int(best.argmax())
        stay = best >= best[k] - SWITCH
        back.append(np.where(stay, np.arange(len(best)), k))
        best = np.where(stay, best, best[k] - SWITCH) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def segments(text: str, machine: Machine) -> list[tuple[str, int, int, float]]:
    """(language, first line, last line, confidence) of each passage. Lines are counted
    from 0 among those that aren't blank; sung syllables belong to the passage before."""
    ls = lines_of(text)
    at = [(i, ws) for i, x in enumerate(ls) if (ws := words_of(x))]
    if not at:
        return []
    score = machine.scores([ws for _, ws in at])
    return _segments(at, score)


def _segments(at: list[tuple[int, list[str]]], score: np.ndarray) -> list[tuple[str, int, int, float]]:
    path = passages(score)
    out, start = [], 0
    for k in range(1, len(path) + 1):
        if k == len(path) or path[k] != path[start]:
            confidence = float(np.exp(score[start:k, path[start]].mean()))
            out.append((LANGUAGES[path[start]], at[start][0], at[k - 1][0], confidence, k - start))
            start = k
    return out


SCHEMA = "id bigint, lines int, segments array<struct<lang:string,first:int,last:int,confidence:double,n:int>>"
_ARROW = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("confidence", pa.float64()), ("n", pa.int32())]))


def identify(lyrics: DataFrame, labels: DataFrame, hurt: Callable[[], Callable[[str], bool]] | None = None) -> DataFrame:
    """(id, lines, segments) of every row: passages with language and confidence.

    Null, empty and blank texts and those of sung syllables only have no passages.
    hurt: gives, at the executor, a function that tells texts to leave out.
    """
    lines, known = sample(lyrics, labels, lambda t: "�" not in t)
    machine = lyrics.sparkSession.sparkContext.broadcast(train(lines, known) if lines else None)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, is_hurt = machine.value, hurt() if hurt else lambda t: False
        for b in batches:
            ids, counts, out, flat, spans = [], [], [], [], []
            for i, t in zip(b.column("id").to_pylist(), b.column("plain_lyrics").to_pylist(), strict=True):
                if t and is_hurt(t):
                    continue
                ls = lines_of(t) if t else []
                at = [(k, ws) for k, x in enumerate(ls) if (ws := words_of(x))] if m else []
                ids.append(i)
                counts.append(len(ls))
                spans.append((at, len(flat)))
                flat += [ws for _, ws in at]
            score = m.scores(flat) if flat else None
            for at, first in spans:
                out.append([dict(zip(("lang", "first", "last", "confidence", "n"), s, strict=True)) for s in _segments(at, score[first : first + len(at)])] if at else [])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int32()), pa.array(out, _ARROW)], ["id", "lines", "segments"])

    return lyrics.select("id", "plain_lyrics").mapInArrow(scan, SCHEMA)


def languages_in(found: DataFrame) -> DataFrame:
    """(id, lines, langs): the languages of passages of two lines or more."""
    s = F.filter("segments", lambda x: x["n"] >= LINES_IN_A_ROW)
    return found.select("id", "lines", F.array_sort(F.array_distinct(F.transform(s, lambda x: x["lang"]))).alias("langs"))


def label_codes(labels: DataFrame) -> DataFrame:
    """(id, label): the two-letter code that a label names, or null."""
    codes = F.create_map(*[F.lit(x) for n, c in BY_NAME.items() for x in (n, c)])
    raw = F.lower(F.trim("lang"))
    return labels.select(F.col("lyrics_id").alias("id"), F.coalesce(codes[raw], codes[F.regexp_extract(raw, r"^([^-_ (,;/]+)", 1)]).alias("label"))


def missing_or_wrong(lyrics: DataFrame, labels: DataFrame, hurt=None) -> DataFrame:
    """(id, lang): a row for each language of the texts of four lines or more that are
    mixed, or whose label is missing or another one. The join is on ids, without texts."""
    f = languages_in(identify(lyrics, labels, hurt)).filter((F.col("lines") >= LINES_IN_TEXT) & (F.size("langs") > 0))
    f = f.join(label_codes(labels), "id", "left")
    case = (F.size("langs") > 1) | F.col("label").isNull() | (F.col("label") != F.element_at("langs", 1))
    return f.filter(case).select("id", F.explode("langs").alias("lang")).distinct()
