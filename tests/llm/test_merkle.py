import pytest

from choralis.llm import merkle as M

SCHEMA = "id bigint, name_lower string, artist_name_lower string, album_name_lower string, duration double, root string, n int"
ROWS = [
    (1, "Home", "ann", None, 100.0),
    (2, "ann!", "  HOME ", "", 100.0),
    (3, "home", "ann", "", None),
    (4, "h o m e", "a-n-n", None, None),
    (5, "homeann", "", "", None),
    (6, "straße", "x", "y", 0.0),
    (7, "STRASSE", "y", "x", -0.0),
    (8, None, None, None, None),
    (9, "!!", "", " ", None),
    (9, "!!", "", " ", None),
    (10, "home", "home", "ann", 100.0),
]


def brute(rows):
    groups = {}
    for i, a, b, c, d in rows:
        leaves = sorted("".join(x for x in (s or "").casefold() if x.isalnum()) for s in (a, b, c))
        groups.setdefault((tuple(leaves), None if d is None else d + 0.0), set()).add(i)
    return groups


def test_same_as_brute_force(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA)
    g = brute(ROWS)
    assert {tuple(r) for r in M.copies(df).collect()} == {(min(v), i) for v in g.values() for i in v if i != min(v)}
    assert sorted((r["first_id"], r["copies"]) for r in M.collapse(df).collect()) == sorted((min(v), len(v)) for v in g.values())


def test_hot_group_is_salted(spark, monkeypatch):
    monkeypatch.setattr(M, "HOT", 5)
    monkeypatch.setattr(M, "MOST", 1)
    monkeypatch.setattr(M, "MOST", 10_000)
    rows = [(i, "A" if i % 2 else "a ", "b", None, 1.0) for i in range(300)] + ROWS[:4]
    rows = [(i + (1000 if k >= 300 else 0), *r) for k, (i, *r) in enumerate(rows)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    g = brute(rows)
    assert {tuple(r) for r in M.copies(df).collect()} == {(min(v), i) for v in g.values() for i in v if i != min(v)}


def test_collisions_of_digests_merge_nothing(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(M, "root", lambda s, ordered: F.lit(7).cast("bigint"))
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA)
    g = brute(ROWS)
    assert {tuple(r) for r in M.copies(df).collect()} == {(min(v), i) for v in g.values() for i in v if i != min(v)}


@pytest.mark.parametrize("f", [M.copies, M.collapse])
def test_empty(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).collect() == []
