import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from choralis.functions import text as X
from choralis.plans import topology as P


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


NORMAL = {
    "Don’t Stop (Me) Now!": "dont stop me now",
    "ＡＢＣ …x": "abc x",
    "ΟΔΟΣ a": "οδος a",
    "İstanbul": "i̇stanbul",
    "straße Ⅰ ﬁ": "straße i fi",
    "": "",
    "   ": "",
    "!!!": "",
    "a\u0085b\x1cc﻿d": "a b c d",
    "Rebecca Dëlreti": "rebecca dëlreti",
    "é": "é",
}


def test_normalize(spark):
    assert column(spark, list(NORMAL), X.normalize) == list(NORMAL.values())
    assert [X.normalize_py(x) for x in NORMAL] == list(NORMAL.values())
    assert column(spark, [None], X.normalize) == [""]


@given(st.text(max_size=30))
@settings(max_examples=200, deadline=None)
def test_normalize_has_no_punctuation_left(s):
    n = X.normalize_py(s)
    assert not set(n) & set(X.SPACED + X.DELETED)
    assert n == " ".join(n.split())


def test_fnv(spark):
    assert column(spark, ["AbC", "", "é", None], X.fnv1a) == [2631054091, 2166136261, X.fnv1a_py("é"), None]


def test_room_hashes_the_artist_first(spark):
    df = spark.createDataFrame([("A", "B")], "a string, t string")
    df = df.select(X.normalize(F.col("a")).alias("a"), X.normalize(F.col("t")).alias("t"))
    got = df.select(X.room(F.col("a"), F.col("t"), 100)).first()[0]
    assert got == X.fnv1a_py("a b") % 100 == X.room_py("A", "B", 100) != X.fnv1a_py("b a") % 100


def test_super_route(spark):
    assert column(spark, ["abc"], X.super_route) == ["super-4"]


def test_limits(spark):
    raw = [None, "", "abc", "0", "-5", "15abc", "1e3", "500", "99999999999", " 7"]
    assert column(spark, raw, X.parse_limit) == [20, 20, 20, 20, 1, 15, 1, 100, 100, 7]


def test_floats(spark):
    got = column(spark, [None, "", "201.0", "201s", "1e2", ".5x", "abc", "NaN", "-Infinity"], X.parse_float)
    assert got[:6] == [None, None, 201.0, 201.0, 100.0, 0.5]
    assert math.isnan(got[6]) and math.isnan(got[7]) and got[8] == -math.inf


def test_classify(spark):
    df = spark.createDataFrame([(5, 0), (11, 0), (12, 7), (9, 1), (13, 7), (13, 8), (13, 3)], "n int, t int")
    assert [r[0] for r in df.select(X.classify_record(F.col("n"), F.col("t"))).collect()] == ["skip", "tracks", "lyrics", "tracks", "tracks", "lyrics", "error"]


def test_topology():
    t = P.plan_topology(225 << 30)
    assert t.rooms % 100 == 0 and t.aggregators % 6 == 0
    assert P.plan_topology(0) == P.Topology(100, 6)
    assert list(P.Topology(2900, 42).rooms_of(40)) == list(range(2880, 2900))
    assert not P.Topology(2900, 42).rooms_of(41)
    assert P.index_parts(32254478) == 4
    with pytest.raises(ValueError):
        P.plan_topology(10**16)
