import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from choralis.llm import encoding as E

CLEAN = {
    "fr": "Je cherche encore une étoile égarée à côté de la gare derrière la fenêtre déjà",
    "de": "Wir können nicht mehr schlafen über den Wolken schöne süße Stille Märchen Brücke",
    "pt": "Não podemos mais dormir a canção do coração além das nuvens você até verão",
    "ru": "Мы больше не можем уснуть до самой зари твой тихий голос на чужой кухне",
    "el": "Κανείς δεν ακούει την καρδιά μου πάνω στη στέγη το τελευταίο τρένο",
    "ja": "知らない台所でどこへ行くのか分からない",
    "en": "Don’t tell the meadow what the river hid",
}


@pytest.fixture(scope="module")
def doctor(spark):
    rows = [("plain_lyrics", i * 10 + j, s) for i, s in enumerate(CLEAN.values()) for j in range(6)]
    v = spark.createDataFrame(rows, "field string, id bigint, value string")
    return E.Doctor(E.pair_model(v).value)


CASES = [(k, r, w) for k in CLEAN for r in ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437") for w in ["utf-8"]]


@pytest.mark.parametrize("lang,read,written", CASES)
def test_restores_utf8(doctor, lang, read, written):
    table = {b: c for c, b in E._BYTES[read].items()}
    hurt = "".join(chr(b) if b < 128 else chr(table[b]) for b in CLEAN[lang].encode(written))
    assert doctor.value(hurt)[:2] == (True, CLEAN[lang])


def test_restores_twice_hurt(doctor):
    s = CLEAN["fr"].encode().decode("cp1252", "replace")
    if "�" not in s:
        twice = s.encode().decode("cp1252", "replace")
        assert doctor.value(twice)[0]


@pytest.mark.parametrize("lang,read,written", [("ru", "cp1252", "cp1251"), ("ru", "cp1251", "koi8_r"), ("ru", "cp866", "cp1251"), ("el", "cp1252", "cp1253"), ("de", "cp1251", "cp1252"), ("fr", "cp437", "cp1252")])
def test_restores_single_bytes(doctor, lang, read, written):
    hurt = CLEAN[lang].encode(written).decode(read)
    assert doctor.value(hurt)[:2] == (True, CLEAN[lang])


@pytest.mark.parametrize("s", [*CLEAN.values(), *(x.upper() for x in CLEAN.values()), "plain", "", "drifting – ember", "a – b — c “d” … • e", "Thе сarlеt gambler", "Ｗｉｄｅ", "a b", "👩‍🎤"])
def test_leaves_the_rest(doctor, s):
    assert not doctor.value(s)[0]


def test_only_a_stretch(doctor):
    s = CLEAN["en"] + "\n" + CLEAN["fr"].encode().decode("latin-1") + "\n" + CLEAN["ru"]
    assert doctor.value(s)[:2] == (True, CLEAN["en"] + "\n" + CLEAN["fr"] + "\n" + CLEAN["ru"])


@pytest.mark.parametrize("lang,read,written", [("ru", "cp1252", "cp1251"), ("el", "cp1252", "cp1253"), ("ru", "cp1251", "koi8_r")])
def test_part_of_a_line(doctor, lang, read, written):
    """Less than most of a line's words are hurt."""
    w = CLEAN[lang].split()
    hurt = [*w, *(x.encode(written).decode(read) for x in w[3:8]), *w[:3]]
    assert doctor.value(" ".join(hurt))[:2] == (True, " ".join([*w, *w[3:8], *w[:3]]))


def test_stretch_is_the_maximum():
    g = [2.0, None, 6, 5, None, 7, None, None, 3]
    w = [-E.MISSED if x is None else x for x in g]
    bits, lo, hi = E.stretch(g)
    assert bits == sum(w[lo:hi]) == max(sum(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1))
    assert E.stretch([None])[0] == 0


def test_lost_characters(doctor):
    assert doctor.value("Pit�zan")[:2] == (True, None)


@given(st.lists(st.integers(-9, 5), max_size=24))
@settings(max_examples=200, deadline=None)
def test_segments_are_all_maximal_ones(s):
    """By the definition: the best segment, then the best ones to its left and to its right."""
    w = [E.IMPROBABLE - x for x in s]

    def best(lo, hi):
        found = [(sum(w[i:j]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)]
        if not found or max(found)[0] <= 0:
            return []
        *_, i, j = max(found)
        return best(lo, i) + [(i, j - 1)] + best(j, hi)

    got = E.segments([float(x) for x in s])
    want = best(0, len(s))
    # Where segments tie, the split may differ; what they cover by score doesn't.
    assert [sum(w[a : b + 1]) for a, b in got] == [sum(w[a : b + 1]) for a, b in want]


def test_two_runs_of_a_word(doctor):
    """Both damaged stretches of one token are found and restored."""
    bad = "ü".encode().decode("cp1252")
    word = f"s{bad}dliche-Br{bad}cke"
    assert doctor.value(f"Wir {word} Stille")[:2] == (True, "Wir südliche-Brücke Stille")


def test_rare_pairs_stay_behind(spark, monkeypatch):
    """Above the bound, the most frequent pairs are kept, with exact counts."""
    rows = [("name", i, "é" + chr(0x430 + k)) for k in range(12) for i in range(2 + (1 << k // 2))]
    df = spark.createDataFrame(rows, "field string, id bigint, value string")
    whole = E.pair_model(df).value
    monkeypatch.setattr(E, "MOST_PAIRS", 8)
    some = E.pair_model(df).value
    assert len(some.keys[0]) <= 8 < len(whole.keys[0])
    exact = dict(zip(whole.keys[0].tolist(), whole.counts[0].tolist(), strict=True))
    kept = dict(zip(some.keys[0].tolist(), some.counts[0].tolist(), strict=True))
    assert all(exact[k] == n for k, n in kept.items()) and min(kept.values()) > max(n for k, n in exact.items() if k not in kept)
    assert exact[E.pair("é", chr(0x430))] == 3


def test_table(spark):
    df = spark.createDataFrame([("name", 1, None), ("name", 2, ""), ("name", 3, "cafÃ© " * 20000), ("name", 3, "cafÃ© " * 20000)], "field string, id bigint, value string")
    assert {r["id"] for r in E.repair(df).collect()} == {3}
    assert E.repair(df.limit(0)).collect() == []
