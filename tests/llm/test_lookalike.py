import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from choralis.llm import lookalike as K

CASES = {
    "Ｗｉｄｅ": ("Wide", "style"),
    "𝙴𝚕𝚒𝚣𝚊": ("Eliza", "style"),
    "ﬁﬆ": ("fist", "style"),
    "été": ("été", "accent"),
    "z‍ero": ("zero", "invisible"),
    "so­ft": ("soft", "invisible"),
    "a b": ("a b", "space"),
    "a　b": ("a b", "space"),
    "Thе сat": ("The cat", "alphabet"),
    "веcна": ("весна", "alphabet"),
    "Е eu não ѕei": ("E eu não sei", "alphabet"),
}


@pytest.mark.parametrize("s", list(CASES))
def test_cases(s):
    want, kind = CASES[s]
    assert K.standing_in(s) == [kind]
    assert K.form(s) == want
    assert K.skeleton(s) == K.skeleton(want)


@pytest.mark.parametrize("s", [None, "", "plain", "été", "Привет мир", "Κανείς δεν", "どこへ行くの！", "It’s – “so” …", "👩‍🎤 ❤️", "½ ™ №", "a\r\nb\tc"])
def test_ordinary(s):
    assert K.standing_in(s) == []
    assert K.form(s) == s


@given(st.text(max_size=20))
@settings(max_examples=300, deadline=None)
def test_idempotent(s):
    assert K.skeleton(K.skeleton(s)) == K.skeleton(s)
    f = K.form(s)
    assert K.form(f) == f or K.form(K.form(f)) == K.form(f)


@given(st.text(alphabet="abcéöñСевос", max_size=12))
@settings(max_examples=200, deadline=None)
def test_skeleton_ignores_composition(s):
    assert K.skeleton(unicodedata.normalize("NFD", s)) == K.skeleton(unicodedata.normalize("NFC", s))


@pytest.mark.parametrize(
    "s,want",
    [
        ("sin\u0261 it", "sing it"),
        ("the \u0185ird", "the bird"),
        ("l\u0269ght", "light"),
        ("bli\u1d22zard", "blizzard"),
        ("st\u0251r", "star"),
        # A word wholly of look-alikes, in a text that holds real words of that script.
        ("the \u0441\u043e\u0440 is here\nПривет, мир", "the cop is here\nПривет, мир"),
        ("Люблю тебя\nsay \u03bf\u03c1\u03b1 now\nу меня", "Люблю тебя\nsay opa now\nу меня"),
        ("ring the \u054d\u0585", "ring the Uo"),
    ],
)
def test_letters_are_judged_word_by_word(s, want):
    assert K.standing_in(s) == ["alphabet"]
    assert K.form(s) == want and K.skeleton(s) == K.skeleton(want)


@pytest.mark.parametrize("s", ["Sing with me\nу меня сухо, а там\nо", "hello у нас", "Не с тобой\nover and over", "ο κόσμος\nmy world"])
def test_real_words_of_look_alikes(s):
    assert K.standing_in(s) == [] and K.form(s) == s


@pytest.mark.parametrize("s,want", [("\u1d18aypal", "paypal"), ("paypa\ua4f2", "paypal"), ("\u0251pple", "apple"), ("\ua7b5eta", "\u00dfeta"), ("pa\u13e2er", "paPer"), ("\u2c9fpen", "open")])
def test_letters_that_unicode_lists(s, want):
    assert K.other_characters(s) and K.standing_in(s) == ["alphabet"]
    assert K.skeleton(s) == K.skeleton(want)


@pytest.mark.parametrize("s", list(CASES))
def test_a_case_is_another_text_of_the_same_skeleton(s):
    assert K.other_characters(s) and K.form(s) != s and K.skeleton(K.form(s)) == K.skeleton(s)


def test_table_of_unicode():
    from choralis.llm import confusables

    t = confusables.prototypes()
    assert len(t) > 5000 and t["\u0430"] == "a" and t["\ua4f2"] == "l"
    assert all(K.PROTOTYPE[ord(x)] == a for a, xs in K.LOOK_ALIKES.items() for x in xs)


def test_table(spark):
    rows = [("name", 1, "Thе cat"), ("name", 1, "Thе cat"), ("name", 2, "The cat"), ("name", 3, None), ("name", 4, ""), ("name", 5, "ａ" * 100_000)]
    df = spark.createDataFrame(rows, "field string, id bigint, value string")
    assert sorted((r["field"], r["id"]) for r in K.found(df).collect()) == [("name", 1), ("name", 5)]
    g = K.groups(df).collect()
    assert [(r["spellings"], r["values"]) for r in g] == [(2, 3)]
    assert {r["id"]: r["form"] for r in K.forms(df).collect()}[3] is None
    assert K.found(df.limit(0)).collect() == [] and K.groups(df.limit(0)).collect() == []
