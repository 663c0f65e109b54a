import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from choralis.llm import leakage as L

WORDS = [f"w{i}" for i in range(400)]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(5)
    items = [(i, " ".join(passage(rng, rng.randint(25, 60))).capitalize() + ".") for i in range(40)]
    docs, want = [], set()
    for d in range(200):
        text = passage(rng, rng.randint(0, 80))
        if d % 3 == 0:
            i, p = items[rng.randrange(40)]
            w = L.words(p)
            n = rng.choice([8, 11, 12, 13, 20, len(w)])
            n = min(n, len(w))
            k = rng.randint(0, len(w) - n)
            part = w[k : k + n]
            for q in range(3, n - 3, 9):
                part[q] = "changed"
            text = text + [x.upper() + "," for x in part] + passage(rng, 20)
            if n >= 12:
                want.add((d, i))
        docs.append((d, "\n".join(" ".join(text[j : j + 7]) for j in range(0, len(text), 7)), "x", d))
    docs += [(900, None, "x", 0), (901, "", "x", 0), (902, " ".join(passage(rng, 60_000)), "x", 0)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, item_id string, n int"), spark.createDataFrame(items + [(99, None), (98, "")], "item_id bigint, passage string"), want


def test_finds_planted(cases):
    docs, items, want = cases
    got = {(r["doc_id"], r["item_id"]) for r in L.leaks(docs, items).collect()}
    assert got == want and len(want) > 20


def test_same_as_all_diagonals(cases):
    """The prefix filter loses nothing: comparing every diagonal gives the same."""
    docs, items, _ = cases
    ds, ps = [(r["doc_id"], L.words(r["text"] or "")) for r in docs.collect() if r["doc_id"] < 900], [(r["item_id"], L.words(r["passage"] or "")) for r in items.collect()]
    want = {}
    for d, w in ds:
        for i, p in ps:
            n = max((L.longest(w, p, s) for s in range(-len(p), len(w)) if any(w[q + s] == p[q] for q in range(max(0, -s), min(len(p), len(w) - s)))), default=0)
            if n >= L.SPAN:
                want[d, i] = n
    got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in L.leaks(docs, items).collect() if r["doc_id"] < 900}
    assert got == want


def test_empty(cases):
    docs, items, _ = cases
    assert L.leaks(docs, items.limit(0)).collect() == [] and L.leaks(docs.limit(0), items).collect() == []


def test_short_passages_and_repeated_rows(spark):
    """A short passage must be there as a whole, but for a word inside."""
    items = spark.createDataFrame([(1, "one two three"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "no"), (4, "red red red red red red red red red red red red red")], "item_id bigint, passage string")
    docs = spark.createDataFrame([(1, "x one TWO, three y"), (1, "x one TWO, three y"), (2, "a b c X e f g h"), (3, "a b c d e f g"), (4, "no"), (5, "red " * 5000), (6, "one 2 three")], "doc_id bigint, text string")
    assert {tuple(r) for r in L.leaks(docs, items).collect()} == {(1, 1, 3), (2, 2, 8), (5, 4, 13), (6, 1, 3)}


@given(st.integers(3, 60), st.lists(st.integers(0, 9), min_size=60, max_size=60), st.data())
@settings(max_examples=200, deadline=None)
def test_prefix_meets_every_stretch(n, counts, data):
    """However changed words lie in a stretch, a shingle of the prefix stays whole."""
    width = L.width_of(n)
    kept = L.prefix(counts[: n - width + 1], list(range(n)), n)
    size = data.draw(st.integers(min(L.SPAN, n), n))
    start = data.draw(st.integers(0, n - size))
    bad, p = set(), start + data.draw(st.integers(1, 12))
    while p < start + size - 1:
        bad.add(p)
        p += data.draw(st.integers(L.APART, 20))
    assert any(start <= s and s + width <= start + size and not bad & set(range(s, s + width)) for s in kept)
