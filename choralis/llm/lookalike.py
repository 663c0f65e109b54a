"""Text that looks the same but is made of other characters.

The skeleton of a text: decompose it (NFKD), replace every character by the
prototype of its look-alikes, decompose again. Texts of one skeleton look the
same. The skeleton serves comparison; form() is the text to read: width and styled
forms, ligatures, loose accents, spaces and invisible characters in their plain
form, and letters of another alphabet within a word as those of the word's own.

The look-alike table is Unicode's own list of confusables, as far as it names letters that
look like Latin ones, with small capitals by their names, and with a few fixed entries that
come first. Everyday Greek and Cyrillic letters are taken from the fixed entries only, as others
of them look Latin in some typefaces at most.

Whether letters stand for others is decided by the skeleton of each word: a word that its
prototypes change is a case unless it is really of another script, by its own letters or,
where all of them look Latin, by the words beside it. A value is a case if its form is
another text of the same skeleton.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choralis.llm import confusables

# Letters of other alphabets that look like Latin ones, by Latin letter.
LOOK_ALIKES = {
    "a": "аαɑ", "b": "Ьƅ", "c": "сϲᴄ", "d": "ԁ", "e": "еҽ", "f": "ẝ", "g": "ɡց", "h": "һհ", "i": "іιɩ", "j": "јϳ",
    "k": "κк", "l": "ӏⅼ", "n": "ոη", "o": "оοօᴏ", "p": "рρ", "q": "ԛզ", "r": "г", "s": "ѕꜱ", "u": "υսʋᴜ", "v": "νѵᴠ",
    "w": "ԝωѡᴡ", "x": "хχ", "y": "уγүʏ", "z": "ᴢ",
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫ",
    "K": "КΚᏦ", "L": "Ꮮ", "M": "МΜϺᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅᏚ", "T": "ТΤᎢ",
    "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "УΥҮ", "Z": "ΖᏃ",
}
#: Signs that only make another look alike in a skeleton: quotes and dashes of one kind.
SIGNS = {"'": "\u2018\u2019\u02bc\u201b`\u00b4", '"': "\u201c\u201d\u201e\u201f", "-": "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"}

#: Greek and Cyrillic letters in everyday use.
EVERYDAY = re.compile("[\u0370-\u03ff\u0400-\u045f]")


def _listed() -> dict[str, str]:
    """Letters that Unicode lists as look-alikes of a Latin letter, and small capitals, outside ordinary Latin text."""
    small = confusables.small_capitals()
    out = dict(small)
    for ch, p in confusables.prototypes().items():
        p = small.get(p, p)
        letter = unicodedata.category(ch) in ("Lu", "Ll", "Lo") and unicodedata.normalize("NFKD", ch) == ch and not EVERYDAY.match(ch)
        if letter and ch > "\u024f" and len(p) == 1 and p.isalpha() and p < "\u0100":
            out.setdefault(ch, p)
    return out


PROTOTYPE = {ord(x): a for x, a in _listed().items()} | {ord(x): a for a, xs in (LOOK_ALIKES | SIGNS).items() for x in xs}

_EMOJI = r"[\u00a9\u00ae\u203c\u2049\u2122\u2139\u2190-\u21ff\u2300-\u27bf\u2900-\u297f\u2b00-\u2bff\u3030\u303d\u3297\u3299\U0001f000-\U0001faff#*0-9\u20e3]"
#: What joins or presents an emoji is part of it.
EMOJI = re.compile(rf"{_EMOJI}[\ufe0e\ufe0f\U0001f3fb-\U0001f3ff\u20e3]+(?:\u200d{_EMOJI}[\ufe0e\ufe0f\U0001f3fb-\U0001f3ff]*)*|[\U0001f000-\U0001faff\u2600-\u27bf](?:\u200d{_EMOJI}[\ufe0e\ufe0f\U0001f3fb-\U0001f3ff]*)+|[\U0001f000-\U0001faff][\U000e0020-\U000e007f]+")
#: Joiners that scripts of their own need.
JOINED = re.compile("(?<=[\u0600-\u08ff\u0900-\u0dff])[\u200c\u200d](?=[\u0600-\u08ff\u0900-\u0dff])")
SPACES = re.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff]")
#: Width and styled forms and ligatures: what Unicode itself calls such.
STYLES = ("<wide>", "<narrow>", "<font>", "<circle>", "<square>", "<super>", "<sub>", "<fraction>")
#: Ordinary signs among them, and full-width signs, which are ordinary between East Asian letters.
PLAIN = frozenset("ªº²³¹½¼¾™℠℡№℃℉㎏㎝")
MARK = re.compile("[\u0300-\u036f\u3099\u309a\u1ab0-\u1aff\u1dc0-\u1dff]")
WORD = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f]+[^\W\d_]*)*")
_SCRIPTS = re.compile("(?P<L>[A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff])|(?P<C>[\u0400-\u052f])|(?P<G>[\u0370-\u03ff\u1f00-\u1fff])|(?P<A>[\u0530-\u058f])|(?P<H>[\u13a0-\u13ff])")
#: Those of alphabets that aren't told apart here.
_REST = frozenset(chr(o) for o in PROTOTYPE if chr(o).isalpha() and not _SCRIPTS.match(chr(o)) and not unicodedata.name(chr(o), "").startswith("LATIN"))
_EAST = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


@lru_cache(1 << 16)
def _styled(ch: str) -> bool:
    d = unicodedata.decomposition(ch)
    if not d or ch in PLAIN or ch.isspace():
        return False
    return d.startswith(STYLES) or "\ufb00" <= ch <= "\ufb4f" or "\u2160" <= ch <= "\u217f" or ch in "\u017f\u013f\u0140"


@lru_cache(1 << 16)
def _decomposed(s: str) -> str:
    return unicodedata.normalize("NFKD", INVISIBLE.sub("", s))


def skeleton(s: str) -> str:
    """Equal for texts of equal look. Idempotent."""
    if s.isascii():
        return s.translate(PROTOTYPE) if "`" in s else s
    s = EMOJI.sub(lambda m: m[0].replace("\u200d", "\ue000").replace("\ufe0f", ""), s) if "\u200d" in s else s
    return unicodedata.normalize("NFKD", _decomposed(SPACES.sub(" ", s)).translate(PROTOTYPE))


def _scripts(word: str) -> set[str]:
    return {m.lastgroup for m in _SCRIPTS.finditer(word)} | ({"R"} if not _REST.isdisjoint(word) else set())


#: Look-alikes that are of no other alphabet: in a word they always stand for another letter.
_ODD = re.compile("[" + "".join(chr(o) for o in PROTOTYPE if chr(o).isalpha() and _scripts(chr(o)) <= {"L"}) + "]")
_OTHER = re.compile("[\u0370-\u03ff\u0400-\u052f\u0530-\u058f\u13a0-\u13ff\u1f00-\u1fff" + "".join(sorted(_REST)) + "]|" + _ODD.pattern)
_BREAK = re.compile(r"[\r\n\v\f]")


def foreign_words(s: str) -> list[re.Match]:
    """Words, where they stand, whose letters stand for others: that mix alphabets, hold a
    letter that is only a look-alike, or are made of letters that all look Latin and aren't
    beside words of their own script."""
    if not _OTHER.search(s):
        return []
    out, unsure, end, lines = [], [], 0, [[]]
    # What tells the script of a line: words that can be read in one way only.
    for m in WORD.finditer(s):
        w = m[0]
        if _BREAK.search(s, end, m.start()):
            lines.append([])
        end = m.end()
        sc = {"L"} if w.isascii() else _scripts(w)
        if not w.isascii() and (len(sc) > 1 or _ODD.search(w)):
            out.append(m)
            sc = {"?"}
        elif sc and sc <= {"C", "G", "A", "H", "R"} and skeleton(w).isascii():
            sc = {"~"}
            unsure.append((len(lines) - 1, len(lines[-1])))
        lines[-1].append((m, sc))
    if unsure:
        told = [sc for ws in lines for _, sc in ws if sc and sc != {"?"} and sc != {"~"}]
        latin = re.search("[A-Za-z]", s) is not None and all(sc == {"L"} for sc in told)
        for i, j in unsure:
            ws = lines[i]
            tells = lambda part: next((sc for _, sc in part if sc and sc != {"?"} and sc != {"~"}), None)
            beside = [sc for sc in (tells(ws[:j][::-1]), tells(ws[j + 1 :])) if sc]
            if all(sc == {"L"} for sc in beside) if beside else latin:
                out.append(ws[j][0])
    return sorted(out, key=lambda m: m.start())


def _styles(s: str) -> set[str]:
    """Styled characters of a text; full-width signs among East Asian letters are ordinary."""
    east = _EAST.search(s) is not None
    return {ch for ch in set(s) if ch > "\x7f" and _styled(ch) and (not east or unicodedata.category(ch)[0] in "LN")}


def standing_in(s: str | None) -> list[str]:
    """Kinds of characters in s that stand for ordinary ones of the same look; none for null."""
    if not s or s.isascii():
        return []
    kinds = []
    bare = JOINED.sub("", EMOJI.sub("", s))
    if SPACES.search(bare):
        kinds.append("space")
    if INVISIBLE.search(bare):
        kinds.append("invisible")
    if MARK.search(bare) and unicodedata.normalize("NFC", bare) != bare:
        kinds.append("accent")
    if _styles(bare):
        kinds.append("style")
    if foreign_words(bare):
        kinds.append("alphabet")
    return kinds


_BACK = {s: {ord(a): x for a, xs in LOOK_ALIKES.items() for x in reversed(xs) if s in _scripts(x)} for s in "CG"}


def _own(word: str) -> str:
    """A mixed word in the alphabet to which its letters can all be brought: Latin, if
    all others look like Latin ones, else that of the letter that doesn't."""
    latin = word.translate(PROTOTYPE)
    if not _scripts(latin) - {"L"}:
        return latin
    for s in "CG":
        t = word.translate(_BACK[s])
        if _scripts(t) == {s}:
            return t
    return word


def form(s: str | None) -> str | None:
    """The one readable form of a text. Null stays null; idempotent."""
    if s is None or s.isascii():
        return s
    keep = {}

    def hide(m: re.Match) -> str:
        keep[k := chr(0xF0000 + len(keep))] = m[0]
        return k

    t = JOINED.sub(hide, EMOJI.sub(hide, s))
    t = INVISIBLE.sub("", SPACES.sub(" ", t))
    if styles := _styles(t):
        t = "".join(unicodedata.normalize("NFKC", c) if c in styles else c for c in t)
    t = unicodedata.normalize("NFC", t)
    for m in reversed(foreign_words(t)):
        t = t[: m.start()] + _own(m[0]) + t[m.end() :]
    return "".join(keep.get(c, c) for c in t)


def other_characters(s: str | None) -> bool:
    """Whether s looks like ordinary text but is made of other characters: its form is another
    text of the same skeleton, or a word mixes alphabets and can't be brought to one."""
    if not s or s.isascii():
        return False
    f = form(s)
    if f == s:
        return bool(foreign_words(JOINED.sub("", EMOJI.sub("", s))))
    return skeleton(f) == skeleton(s)


def forms(values: DataFrame) -> DataFrame:
    """(field, id, value) as (field, id, form, skeleton, kinds): every value in one form.

    A null value has null for all three. Extra columns are not passed on.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("value").to_pylist()
            cols = [b.column("field"), b.column("id"), pa.array([form(x) for x in v], pa.string()), pa.array([x if x is None else skeleton(x) for x in v], pa.string())]
            kinds = pa.array([x if x is None else standing_in(x) for x in v], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*cols, kinds], ["field", "id", "form", "skeleton", "kinds"])

    return values.select("field", "id", "value").mapInArrow(scan, "field string, id bigint, form string, skeleton string, kinds array<string>")


def groups(values: DataFrame) -> DataFrame:
    """Originals that look the same: (field, skeleton, spellings, values), for each
    skeleton with more than one spelling. Spellings are counted before the shuffle
    and only told apart after; no group's values are gathered."""
    raw = values.select("field", F.col("id"), F.col("value").alias("raw")).filter("raw is not null")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("raw").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("field"), b.column("raw"), pa.array([skeleton(x) for x in v], pa.string())], ["field", "raw", "skeleton"])

    s = raw.select("field", "raw").mapInArrow(scan, "field string, raw string, skeleton string")
    each = s.groupBy("field", "skeleton", "raw").agg(F.count("*").alias("n"))
    return each.groupBy("field", "skeleton").agg(F.count("*").alias("spellings"), F.sum("n").alias("values"), F.min("raw").alias("least")).filter("spellings > 1")


def found(values: DataFrame, hurt=None) -> DataFrame:
    """(field, id) of values that hold a character standing in for another. hurt: gives, at
    the executor, a function that tells values of a wrong encoding, which don't count here."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_hurt = hurt() if hurt else lambda v: False
        for b in batches:
            rows = [
                (f, i)
                for f, i, v in zip(*(b.column(c).to_pylist() for c in ("field", "id", "value")), strict=True)
                if v and not v.isascii() and other_characters(v) and not is_hurt(v)
            ]
            cols = list(zip(*rows, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], ["field", "id"])

    return values.select("field", "id", "value").mapInArrow(scan, "field string, id bigint").distinct()
