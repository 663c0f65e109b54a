import datetime

from choralis.llm import survivor as S

LYRICS = "id bigint, track_id bigint, plain_lyrics string, synced_lyrics string, instrumental int, source string, updated_at timestamp, trust int, n int, field string"
T = [datetime.datetime(2024, 1, i + 1) for i in range(5)]


def tables(spark, rows):
    rows = [(*r, None, 1, "x") for r in rows]
    return spark.createDataFrame(rows, LYRICS), spark.createDataFrame([("good", 5), ("bad", 1), ("good", 4)], "source string, trust int")


def test_clear_winners(spark):
    rows = [
        (1, 10, "short", None, 0, "bad", T[0]),
        (2, 10, "longer text", None, None, "good", T[1]),
        (2, 10, "longer text", None, None, "good", T[1]),
        (3, 10, "N/A", "x", None, "good", T[4]),
        # longest isn't the latest: no winner
        (4, 11, "longest text", None, 1, "good", T[0]),
        (5, 11, "short", None, 0, "good", T[1]),
        # two that are equal: no winner
        (6, 12, "same", None, 0, "bad", T[0]),
        (7, 12, "text", None, 0, "bad", T[0]),
        # one record only: no case
        (8, 13, "alone", None, 0, "bad", T[0]),
        (9, None, "none", None, 0, None, None),
        # a null time is the earliest, a null source the least trusted
        (10, 14, "aaaa", None, None, None, None),
        (11, 14, "aaaa", None, None, "bad", T[0]),
    ]
    got = {tuple(r) for r in S.clear_winners(*tables(spark, rows)).collect()}
    assert got == {(10, "plain_lyrics", 2), (10, "synced_lyrics", 3), (10, "instrumental", 1), (11, "instrumental", 5), (14, "plain_lyrics", 11)}


def test_survivors(spark):
    rows = [
        (1, 10, "tie", None, 0, "bad", T[0]),
        (2, 10, "tie", "---", None, "bad", T[0]),
        (3, 10, "  ", "s", 1, "good", T[0]),
        (4, 11, None, None, None, None, None),
    ]
    got = {r["track_id"]: r.asDict() for r in S.survivors(*tables(spark, rows)).collect()}
    assert (got[10]["plain_lyrics"], got[10]["plain_lyrics_id"]) == ("tie", 1)
    assert (got[10]["synced_lyrics"], got[10]["synced_lyrics_id"]) == ("s", 3)
    assert (got[10]["instrumental"], got[10]["instrumental_id"]) == (1, 3)
    assert got[11]["plain_lyrics"] is None and got[11]["plain_lyrics_id"] is None


def test_empty(spark):
    lyrics, sources = tables(spark, [])
    assert S.clear_winners(lyrics, sources).collect() == [] and S.survivors(lyrics, sources).collect() == []
    assert S.clear_winners(lyrics, sources.limit(0)).collect() == []
