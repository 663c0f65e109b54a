import math

import pytest
from pyspark.sql import functions as F

from choralis.operators import catalog as C
from choralis.operators import lookup as L
from choralis.operators import search as S
from choralis.plans import queries as Q
from choralis.plans import topology as P
from choralis.sources import tables as T

TRACK = "id bigint, name string, artist_name string, album_name string, duration double, last_lyrics_id bigint, value string"
LYRIC = "id bigint, plain_lyrics string, synced_lyrics string, lyricsfile string, instrumental int, track_id bigint"
REQUEST = "req_id bigint, kind string, q string, track_name string, artist_name string, album_name string, duration string, id string, limit_raw string"


@pytest.fixture(scope="module")
def tables(spark):
    tracks = spark.createDataFrame(
        [
            (1, "Home", "Ann", "First", 100.0, 10, "x"),
            (2, "Home!", "ANN", "Second", 102.0, 10, "x"),
            (3, "Road", "Bob", None, None, None, None),
            (4, None, None, None, 0.0, 99, "x"),
            (5, "Road", "Bob", "!!!", 50.0, 11, "x"),
            (5, "Road", "Bob", "!!!", 50.0, 11, "x"),
        ],
        TRACK,
    )
    lyrics = spark.createDataFrame([(10, "La LA", "", None, 1, 1), (11, "", "[00:01] Nobody", "f", None, 5), (11, "", "[00:01] Nobody", "f", None, 5)], LYRIC)
    return tracks, lyrics


@pytest.fixture(scope="module")
def catalog(tables):
    return C.with_room(C.build_catalog(*tables), 10).cache()


def test_build(catalog):
    rows = {r["id"]: r for r in catalog.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    assert (rows[1]["plainLyrics"], rows[1]["syncedLyrics"], rows[1]["instrumental"]) == ("La LA", None, True)
    assert (rows[4]["trackName"], rows[4]["duration"], rows[4]["plainLyrics"], rows[4]["instrumental"]) == ("", 0.0, None, False)
    assert rows[5]["plainLyrics"] is None and rows[5]["syncedLyrics"].endswith("Nobody")


def test_branches_are_the_catalog(tables, catalog):
    whole = catalog.drop("room")
    union = C.catalog_union(*tables)
    assert whole.exceptAll(union).isEmpty() and union.exceptAll(whole).isEmpty()


def test_empty_tables(spark):
    c = C.build_catalog(spark.createDataFrame([], TRACK), spark.createDataFrame([], LYRIC))
    assert c.isEmpty()
    r = spark.createDataFrame([], REQUEST)
    r2 = C.with_room(c, 10)
    assert L.get_batch(r2, r).isEmpty() and S.search_batch(r2, r).isEmpty() and S.search_lyrics_batch(r2, r).isEmpty()
    assert C.build_stats(spark.createDataFrame([], TRACK), spark.createDataFrame([], LYRIC)).first()["tracks"] == 0


def one(df):
    r = df.first()
    return r and r["id"]


def test_get(catalog):
    assert one(L.get(catalog, "home", "ann")) == 1
    assert one(L.get(catalog, "home", "ann", rooms=10)) == 1
    assert one(L.get(catalog, "home", "ann", album="second")) == 2
    assert one(L.get(catalog, "home", "ann", duration=104.0)) == 2
    assert one(L.get(catalog, "home", "ann", duration=104.01)) is None
    assert one(L.get(catalog, "home", "ann", duration=math.nan)) == 1
    assert one(L.get(catalog, "road", "bob", album="!!!")) == 3
    with pytest.raises(L.BadRequest):
        L.get(catalog, "", "ann")


def test_get_by_id(catalog):
    assert one(L.get_by_id(catalog, 5)) == 5 and one(L.get_by_id(catalog, 77)) is None
    with pytest.raises(L.BadRequest):
        L.get_by_id(catalog, 0)


def test_search(catalog):
    ids = lambda df: [r["id"] for r in df.orderBy("id").collect()]
    assert ids(S.search(catalog, q="ann om")) == [1, 2]
    assert ids(S.search(catalog, q="!!!")) == [1, 2, 3, 4, 5]
    assert ids(S.search(catalog, q="!!!", limit=-1)) == [1] and ids(S.search(catalog, q="!!!", limit=0)) == [1, 2, 3, 4, 5]
    assert ids(S.search(catalog, track="!!!", artist="bob")) == [3, 5]
    assert ids(S.search(catalog, artist="bob")) == []
    assert ids(S.search_lyrics(catalog, "la la")) == [1, 2]
    assert ids(S.search_lyrics(catalog, "[00:01]")) == [5]
    with pytest.raises(L.BadRequest):
        S.search_lyrics(catalog, "")


@pytest.fixture(scope="module")
def requests(spark):
    rows = [
        (1, "search", "ann om", None, None, None, None, None, "1"),
        (2, "search", "!!!", None, None, None, None, None, None),
        (3, "search", None, "!!!", "bob", None, None, None, None),
        (4, "search", None, None, "bob", None, None, None, None),
        (5, "search", "", "road", "", "", None, None, "x"),
        (6, "search_lyrics", "LA la", None, None, None, None, None, None),
        (7, "search_lyrics", None, None, None, None, None, None, None),
        (8, "get", None, "home", "ann", None, "104", None, None),
        (9, "get", None, "home", "ann", None, "abc", None, None),
        (10, "get", None, "home", "ann", "second", None, None, None),
        (11, "get", None, "home", None, None, None, None, None),
        (12, "get_by_id", None, None, None, None, None, "5", None),
        (13, "get_by_id", None, None, None, None, None, "0", None),
        (14, "get_by_id", None, None, None, None, None, "5x", None),
        (15, "get_by_id", None, None, None, None, None, "99999999999999999999", None),
        (1, "search", "ann om", None, None, None, None, None, "1"),
    ]
    return spark.createDataFrame(rows, REQUEST)


def grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["req_id"], []).append(r["id"])
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("block", [1, 50_000])
def test_batches_equal_single_requests(catalog, requests, block):
    assert grouped(S.search_batch(catalog, requests, block)) == {1: [1], 2: [1, 2, 3, 4, 5], 3: [3, 5], 5: [3, 5]}
    assert grouped(S.search_lyrics_batch(catalog, requests, block)) == {6: [1, 2]}


def test_get_batches(catalog, requests):
    assert {r["req_id"]: r["id"] for r in L.get_batch(catalog, requests).collect()} == {8: 2, 9: 1, 10: 2}
    got = {r["req_id"]: r["room"] is not None for r in L.get_by_id_batch(C.id_index(catalog), requests).collect()}
    assert got == {12: True}
    status = {r["req_id"]: r["status"] for r in L.request_status(requests).collect()}
    assert [status[i] for i in (1, 4, 7, 8, 11, 12, 13, 14, 15)] == ["ok", "empty", "400", "ok", "400", "ok", "400", "404", "ok"]


def test_parts_are_a_fold(spark):
    sizes = [7, 5, 10, 1, 1, 12, 3]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "room int, id bigint, size bigint")
    got = {r["id"]: r["part"] for r in C.room_parts(df, F.col("size"), roll=12).collect()}
    part, filled, want = 0, 0, {}
    for i, s in enumerate(sizes):
        want[i] = part
        filled += s + 1
        if filled >= 12:
            part, filled = part + 1, 0
    assert got == want


def test_write_and_prune(spark, catalog, tmp_path):
    path = f"file://{tmp_path}/c"
    T.write_catalog(catalog.drop("room"), path, P.Topology(10, 6))
    back = T.read_catalog(spark, path)
    assert back.count() == 5
    plan = L.get(back, "home", "ann", rooms=10)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(room" in plan and "EqualTo(nameLower,home)" in plan
    assert one(T.get_by_id_pruned(spark, path, 5)) == 5 and T.get_by_id_pruned(spark, path, 6).isEmpty()
    manifest, topology = T.read_manifest(spark, path)
    assert manifest["total_records"] == 5 and topology["rooms"] == 10 and topology["index_files"] == 1


def test_dense_index(spark):
    index = spark.createDataFrame([(1, 7), (3, 2)], "id bigint, room int")
    assert [r["room"] for r in C.dense_index(index, 4).orderBy("id").collect()] == [0, 7, 0, 2]


def test_json_rooms(spark, catalog, tmp_path):
    line = C.api_json(catalog).filter("id = 3").first()["json"]
    assert '"plainLyrics":null' in line
    (tmp_path / "r.json").write_text(f"[{line},{line}]")
    assert T.read_json_rooms(spark, str(tmp_path / "r.json")).count() == 2


def test_streaming(spark, catalog, requests, tmp_path):
    from choralis.streaming.serve import answer, serve

    requests.write.parquet(f"{tmp_path}/in")
    q = serve(spark.readStream.schema(requests.schema).parquet(f"{tmp_path}/in"), catalog, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(f"{tmp_path}/out").select("req_id", "kind", "id")
    want = answer(catalog, requests)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_all_core_queries_run(spark, sf):
    for name, f in Q.QUERIES.items():
        assert f(spark, sf).columns, name


def test_no_limit_is_the_usual_one(spark, catalog):
    assert S.search(catalog, q="road", limit=0).count() == 2 and S.search_lyrics(catalog, "la", limit=0).count() == 2


def test_texts_are_fetched_for_chosen_rows_only(tables, catalog):
    tracks, lyrics = tables
    names = C.names_only(tracks)
    for whole, narrow in (
        (L.get(catalog, "home", "ann"), L.get(names, "home", "ann", lyrics=lyrics)),
        (L.get(catalog, "nothing", "ann"), L.get(names, "nothing", "ann", lyrics=lyrics)),
        (L.get_by_id(catalog, 5), L.get_by_id(names, 5, lyrics=lyrics)),
        (S.search(catalog, q="!!!"), S.search(names, q="!!!", lyrics=lyrics)),
    ):
        assert sorted(map(repr, whole.collect())) == sorted(map(repr, narrow.collect())) and whole.columns == narrow.columns


def test_rows_and_errors_of_id_requests(spark, catalog):
    asked = [(1, "1"), (2, "1"), (3, "abc"), (4, "0"), (5, "77"), (6, None), (7, "5")]
    r = spark.createDataFrame([(i, "get_by_id", None, None, None, None, None, v, None) for i, v in asked] * 2, REQUEST)
    index = C.id_index(catalog)
    assert sorted((x["req_id"], x["id"]) for x in L.get_by_id_rows(catalog, index, r).collect()) == [(1, 1), (2, 1), (7, 5)]
    got = {x["req_id"]: (x["code"], x["body"]) for x in L.get_by_id_responses(catalog, index, r).collect()}
    assert {i: c for i, (c, _) in got.items()} == {1: 200, 2: 200, 3: 404, 4: 400, 5: 404, 6: 404, 7: 200}
    assert got[5][1] == '{"code":404,"name":"TrackNotFound","message":"Failed to find specified track"}'
    assert '"name":"BadRequest"' in got[4][1] and '"name":"NotFound"' in got[3][1]


def test_part_files_are_those_of_the_fold(spark, catalog, tmp_path):
    T.write_parts(catalog, str(tmp_path / "p"), roll=300)
    back = T.read_parts(spark, str(tmp_path / "p"))
    fold = C.room_parts(catalog, C.record_bytes(), 300)
    assert sorted(map(tuple, back.select("room", "part", "id").collect())) == sorted(map(tuple, fold.select("room", "part", "id").collect()))
    assert back.select(*catalog.columns).exceptAll(catalog).isEmpty() and back.count() == catalog.count()
    for room, part in {(r["room"], r["part"]) for r in fold.collect()}:
        assert len(list((tmp_path / "p" / f"room={room}" / f"part={part}").glob("*.parquet"))) == 1


def test_binary_index(spark, tmp_path):
    import numpy as np

    rooms = np.arange(25, dtype="<u2") * 7 % 11
    for part in range(3):
        (tmp_path / f"index-{part}.bin").write_bytes(rooms[part * 10 : part * 10 + 10].tobytes())
    got = {r["id"]: r["room"] for r in T.read_binary_index(spark, str(tmp_path), 10).collect()}
    assert got == dict(enumerate(rooms.tolist()))


def test_written_catalogue_serves_ids(spark, catalog, tmp_path):
    T.write_catalog(catalog.drop("room"), str(tmp_path), P.Topology(10, 6))
    assert T.get_by_id_pruned(spark, str(tmp_path), 5).collect() == L.get_by_id(catalog, 5).collect()
    assert T.get_by_id_pruned(spark, str(tmp_path), 4000).isEmpty()
    with pytest.raises(L.BadRequest):
        T.get_by_id_pruned(spark, str(tmp_path), 0)
