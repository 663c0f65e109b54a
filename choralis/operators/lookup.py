"""Exact lookups: by names, and by id; for one request or for a table of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choralis.functions import text as X
from choralis.schema import API_COLUMNS

DURATION_TOLERANCE = 2.0


# What answers without a row say.
ROUTE_404 = (404, "NotFound", "Endpoint not found")
TRACK_404 = (404, "TrackNotFound", "Failed to find specified track")
ID_400 = (400, "BadRequest", "Invalid track ID")
HEALTH = {"status": "ok", "version": "0.1.0"}


class BadRequest(ValueError):
    """A request that lacks what it needs."""


def envelope(error: tuple[int, str, str]) -> Column:
    """The JSON body of an error."""
    return F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in zip(("code", "name", "message"), error, strict=True)]))


def in_band(duration: Column, asked: Column) -> Column:
    """Within two seconds, ends included. Null and NaN ask for nothing; Spark
    orders NaN above all numbers, so it is named."""
    return asked.isNull() | F.isnan(asked) | duration.between(asked - DURATION_TOLERANCE, asked + DURATION_TOLERANCE)


def with_texts(rows: DataFrame, lyrics: DataFrame | None) -> DataFrame:
    """Served columns of chosen rows. lyrics: the lyrics table, where `rows` come from a catalogue of
    names only (catalog.names_only); only the records that the rows name are picked from its scan.
    The rows are those of one answer, at most a hundred, so they may be broadcast."""
    if lyrics is None:
        return rows.select(*API_COLUMNS)
    from choralis.operators.catalog import NO_LYRICS, dedup_ids, project_lyrics

    keys = rows.select(F.col("last_lyrics_id").alias("id")).filter("id is not null").distinct()
    own = dedup_ids(project_lyrics(lyrics.join(F.broadcast(keys), "id", "left_semi")), "lyrics_id")
    names = rows.drop("instrumental", *NO_LYRICS)
    both = own.join(F.broadcast(names), names.last_lyrics_id == own.lyrics_id, "right")
    return both.withColumn("instrumental", F.coalesce("instrumental", F.lit(False))).select(*API_COLUMNS)


def get(
    catalog: DataFrame, track: str, artist: str, album: str | None = None, duration: float | None = None, rooms: int | None = None, lyrics: DataFrame | None = None
) -> DataFrame:
    """The matching record of the smallest id, or no row; lyrics as in with_texts().

    With `rooms` (the catalogue is partitioned by `room`) only one room is read: its
    number is computed here, so that it reaches the scan as a literal.
    """
    if not track or not artist:
        raise BadRequest("track_name and artist_name are required")
    df = catalog
    if rooms:
        df = df.filter(F.col("room") == X.room_py(artist, track, rooms))
    df = df.filter((F.col("nameLower") == X.normalize_py(track)) & (F.col("artistNameLower") == X.normalize_py(artist)))
    if album:
        df = df.filter(F.col("albumNameLower") == X.normalize_py(album))
    if duration is not None and not math.isnan(duration):
        df = df.filter(in_band(F.col("duration"), F.lit(float(duration))))
    return with_texts(df.orderBy("id").limit(1), lyrics)


def check_id(id: int) -> None:
    if id < 1:
        raise BadRequest(ID_400[2])


def get_by_id(catalog: DataFrame, id: int, lyrics: DataFrame | None = None) -> DataFrame:
    check_id(id)
    return with_texts(catalog.filter(F.col("id") == id).orderBy("id").limit(1), lyrics)


def valid_id(raw: Column) -> Column:
    """The id of a path, null unless it is all digits and at least 1."""
    n = F.when(raw.rlike("^[0-9]+$"), raw.try_cast("bigint"))
    return F.when(n >= 1, n)


def distinct_requests(requests: DataFrame) -> DataFrame:
    """One row per req_id; repeated rows are ordered by all their columns."""
    rest = [c for c in requests.columns if c != "req_id"]
    return requests.groupBy("req_id").agg(F.min(F.struct(*rest)).alias("_r")).select("req_id", "_r.*")


def request_status(requests: DataFrame, rooms: int | None = None) -> DataFrame:
    """What the request's form alone decides: 400 for a get or a lyrics search
    that lacks a parameter and for a bad id; 'empty' for a search by artist or
    album only; else 'ok'."""
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    kind = F.col("kind")
    bad, ok = F.lit("400"), F.lit("ok")
    return distinct_requests(requests).select(
        "req_id",
        "kind",
        F.when(kind == "get", F.when(given("track_name") & given("artist_name"), ok).otherwise(bad))
        .when(kind == "get_by_id", F.when(~F.coalesce(F.col("id"), F.lit("")).rlike("^[0-9]+$"), F.lit("404")).when(F.col("id").rlike("^0+$"), bad).otherwise(ok))
        .when(kind == "search", F.when(given("q") | given("track_name"), ok).otherwise(F.lit("empty")))
        .when(kind == "search_lyrics", F.when(given("q"), ok).otherwise(bad))
        .otherwise(F.lit("404"))
        .alias("status"),
    )


def get_batch(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """For each 'get' request with both names: the smallest matching id, or null.

    Equal questions are asked once: a request that is made in a third of all rows
    is one row of the join with the catalogue. Its answer is one row, too, so the
    join that hands answers back is small on that side; AQE splits the other.
    """
    r = (
        distinct_requests(requests)
        .filter((F.col("kind") == "get") & (F.coalesce("track_name", F.lit("")) != "") & (F.coalesce("artist_name", F.lit("")) != ""))
        .select(
            "req_id",
            X.normalize(F.col("track_name")).alias("qt"),
            X.normalize(F.col("artist_name")).alias("qa"),
            F.when(F.coalesce("album_name", F.lit("")) != "", X.normalize(F.col("album_name"))).alias("ql"),
            X.parse_float(F.col("duration")).alias("qd"),
        )
        .withColumn("qk", F.struct("qt", "qa", "ql", "qd"))
    )
    asked = r.select("qk").distinct()
    c = catalog.select("id", "nameLower", "artistNameLower", "albumNameLower", "duration")
    on = (c.nameLower == F.col("qk.qt")) & (c.artistNameLower == F.col("qk.qa"))
    on = on & (F.col("qk.ql").isNull() | (c.albumNameLower == F.col("qk.ql"))) & in_band(c.duration, F.col("qk.qd"))
    answers = asked.join(c, on).groupBy("qk").agg(F.min("id").alias("id"))
    return r.join(answers, r.qk.eqNullSafe(answers.qk), "left").select("req_id", "id")


def get_by_id_batch(index: DataFrame, requests: DataFrame) -> DataFrame:
    """For each 'get_by_id' request with a valid id: the room that holds it, or null where it is unknown."""
    r = distinct_requests(requests).filter(F.col("kind") == "get_by_id").select("req_id", valid_id(F.col("id")).alias("id")).filter(F.col("id").isNotNull())
    return r.join(index.select("id", "room"), "id", "left").select("req_id", "id", "room")


def get_by_id_rows(catalog: DataFrame, index: DataFrame, requests: DataFrame) -> DataFrame:
    """For each 'get_by_id' request with a known id: req_id and the served row. The index gives the
    room and the room the row, so of a catalogue partitioned by room only asked ones are read.
    Each id is fetched once, however often it is asked for."""
    r = get_by_id_batch(index, requests).filter("room is not null")
    rows = r.select("id", "room").distinct().join(catalog, ["id", "room"]).select(*API_COLUMNS)
    return r.select("req_id", "id").join(rows, "id").select("req_id", *API_COLUMNS)


def get_by_id_responses(catalog: DataFrame, index: DataFrame, requests: DataFrame) -> DataFrame:
    """(req_id, code, body) of each 'get_by_id' request: the row as JSON, or the error that it gets."""
    status = request_status(requests).filter(F.col("kind") == "get_by_id")
    rows = get_by_id_rows(catalog, index, requests).select("req_id", F.to_json(F.struct(*API_COLUMNS), {"ignoreNullFields": "false"}).alias("row"))
    error = F.when(F.col("status") == "404", envelope(ROUTE_404)).when(F.col("status") == "400", envelope(ID_400)).otherwise(envelope(TRACK_404))
    code = F.when(F.col("row").isNotNull(), 200).when(F.col("status") == "400", ID_400[0]).otherwise(404)
    return status.join(rows, "req_id", "left").select("req_id", code.alias("code"), F.coalesce("row", error).alias("body"))
