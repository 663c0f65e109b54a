"""The build: project both tables, join them, derive the search columns and rooms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choralis.functions import text as X
from choralis.plans import topology as P
from choralis.schema import API_COLUMNS, CATALOG

NO_LYRICS = ["plainLyrics", "syncedLyrics", "lyricsfile"]


def dedup_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per id. Rows that share an id are ordered by all their columns, so
    the kept one is the same on every run; the aggregate combines before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def project_tracks(tracks: DataFrame) -> DataFrame:
    """The columns of a track that the catalogue keeps; null texts are empty, a null duration 0."""
    return tracks.select(
        "id",
        F.coalesce("name", F.lit("")).alias("trackName"),
        F.coalesce("artist_name", F.lit("")).alias("artistName"),
        F.coalesce("album_name", F.lit("")).alias("albumName"),
        F.coalesce("duration", F.lit(0.0)).alias("duration"),
        "last_lyrics_id",
    )


def project_lyrics(lyrics: DataFrame) -> DataFrame:
    """The columns of a lyrics record that the catalogue keeps; empty texts are null."""
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    return lyrics.select(
        F.col("id").alias("lyrics_id"),
        empty("plain_lyrics").alias("plainLyrics"),
        empty("synced_lyrics").alias("syncedLyrics"),
        empty("lyricsfile").alias("lyricsfile"),
        F.coalesce(F.col("instrumental") != 0, F.lit(False)).alias("instrumental"),
    )


def finish(joined: DataFrame) -> DataFrame:
    """Joined rows as catalogue rows, search columns included."""
    return (
        joined.withColumns({"name": F.col("trackName"), "instrumental": F.coalesce("instrumental", F.lit(False))})
        .withColumns(
            {
                "nameLower": X.normalize(F.col("trackName")),
                "artistNameLower": X.normalize(F.col("artistName")),
                "albumNameLower": X.normalize(F.col("albumName")),
            }
        )
        .select(*CATALOG.fieldNames())
    )


def build_catalog(tracks: DataFrame, lyrics: DataFrame) -> DataFrame:
    """Left join: each track once, with its lyrics where they exist.

    Both sides are unique by id before the join, so it can't multiply rows. A
    lyrics record that many tracks share skews only the track side, which AQE
    splits; null keys never reach the join's hash table and stay where they are.
    """
    t, l = dedup_ids(project_tracks(tracks)), dedup_ids(project_lyrics(lyrics), "lyrics_id")
    return finish(t.join(l, t.last_lyrics_id == l.lyrics_id, "left"))


def names_only(tracks: DataFrame) -> DataFrame:
    """The catalogue without texts but with the key of each row's lyrics: for lookups that choose
    rows by names and then fetch the texts of the chosen ones."""
    t = dedup_ids(project_tracks(tracks))
    lower = {f"{a}Lower": X.normalize(F.col(f"{b}Name")) for a, b in (("name", "track"), ("artistName", "artist"), ("albumName", "album"))}
    return t.withColumns({"name": F.col("trackName"), "instrumental": F.lit(False)} | {c: F.lit(None).cast("string") for c in NO_LYRICS} | lower)


def matched(tracks: DataFrame, lyrics: DataFrame) -> DataFrame:
    t, l = dedup_ids(project_tracks(tracks)), dedup_ids(project_lyrics(lyrics), "lyrics_id")
    return finish(t.join(l, t.last_lyrics_id == l.lyrics_id))


def _bare(t: DataFrame) -> DataFrame:
    return finish(t.withColumns({c: F.lit(None).cast("string") for c in NO_LYRICS} | {"instrumental": F.lit(False)}))


def null_lyrics(tracks: DataFrame) -> DataFrame:
    """Tracks that name no lyrics."""
    return _bare(dedup_ids(project_tracks(tracks)).filter(F.col("last_lyrics_id").isNull()))


def unmatched(tracks: DataFrame, lyrics: DataFrame) -> DataFrame:
    """Tracks that name lyrics which aren't there."""
    t = dedup_ids(project_tracks(tracks)).filter(F.col("last_lyrics_id").isNotNull())
    return _bare(t.join(lyrics.select(F.col("id").alias("last_lyrics_id")), "last_lyrics_id", "left_anti"))


def catalog_union(tracks: DataFrame, lyrics: DataFrame) -> DataFrame:
    """The catalogue as its three disjoint branches."""
    return null_lyrics(tracks).unionByName(matched(tracks, lyrics)).unionByName(unmatched(tracks, lyrics))


def with_room(catalog: DataFrame, rooms: int) -> DataFrame:
    return catalog.withColumn("room", X.room(F.col("artistNameLower"), F.col("nameLower"), rooms))


def record_bytes() -> Column:
    """Bytes of a catalogue row as JSON, nulls included."""
    return F.octet_length(F.to_json(F.struct(*CATALOG.fieldNames()), {"ignoreNullFields": "false"})).cast("bigint")


def text_bytes() -> Column:
    """UTF-8 bytes of a row's own texts: a size that any engine computes alike."""
    texts = [f.name for f in CATALOG if f.dataType.simpleString() == "string"]
    return sum((F.octet_length(F.coalesce(F.col(c), F.lit(""))).cast("bigint") for c in texts), F.lit(0).cast("bigint"))


def room_parts(catalog: DataFrame, size: Column, roll: int = P.PART_ROLL_BYTES) -> DataFrame:
    """Which part file of its room each record goes to, in the order of ids.

    A part is closed by the record with which it reaches `roll` bytes; every record
    costs one byte more than its size for the separator. Closing resets the count, so
    this is a fold, not a division of a running sum. Ids and sizes alone are shuffled,
    and a task streams through its sorted rooms, a step per part.
    """
    each = catalog.select("room", "id", size.alias("bytes")).repartition("room").sortWithinPartitions("room", "id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room, part, filled = None, 0, 0
        for b in batches:
            rooms, sizes = b.column("room").to_numpy(), b.column("bytes").to_numpy()
            out = np.zeros(len(rooms), np.int32)
            total = np.cumsum(sizes + 1)
            at = 0
            while at < len(rooms):
                if rooms[at] != room:
                    room, part, filled = rooms[at], 0, 0
                end = at + int(np.searchsorted(rooms[at:], room, "right"))
                before = total[at - 1] if at else 0
                last = at + int(np.searchsorted(total[at:end], before - filled + roll))
                out[at : last + 1] = part
                if last < end:
                    part, filled, at = part + 1, 0, last + 1
                else:
                    filled, at = filled + int(total[end - 1] - before), end
            yield pa.RecordBatch.from_arrays([b.column("room"), b.column("id"), pa.array(out), b.column("bytes")], ["room", "id", "part", "bytes"])

    return each.mapInArrow(fold, "room int, id bigint, part int, bytes bigint")


def part_sizes(parts: DataFrame) -> DataFrame:
    """Records and bytes of each part file: separators and two brackets included."""
    return parts.groupBy("room", "part").agg(F.count("*").alias("records"), (F.sum("bytes") + F.count("*") + 1).alias("bytes"))


def manifest(parts: DataFrame) -> DataFrame:
    """One row: totals of the build."""
    return part_sizes(parts).agg(
        F.sum("records").alias("total_records"),
        F.sum("bytes").alias("total_bytes"),
        F.count("*").alias("total_files"),
        F.countDistinct("room").alias("total_rooms"),
    )


def oversized_files(parts: DataFrame, limit: int = P.PART_WARN_BYTES) -> DataFrame:
    return part_sizes(parts).agg(F.count_if(F.col("bytes") > limit).alias("files"), F.max("bytes").alias("largest"))


def room_info(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("room").agg(F.count("*").alias("records"))


def id_index(catalog: DataFrame) -> DataFrame:
    return catalog.select("id", "room")


def id_index_parts(index: DataFrame, entries: int = P.INDEX_ENTRIES_PER_PART) -> DataFrame:
    """Used and all entries of each part of the dense index."""
    part = F.floor(F.col("id") / entries).cast("bigint")
    return index.groupBy(part.alias("part")).agg(F.count("*").alias("used"), F.max("id").alias("last_id"))


def id_index_stats(index: DataFrame) -> DataFrame:
    """Length of the dense index and how many of its entries are gaps."""
    return index.agg(F.max("id").alias("max_id"), (F.max("id") + 1).alias("entries"), (F.max("id") + 1 - F.count("*")).alias("gaps"))


def dense_index(index: DataFrame, entries: int) -> DataFrame:
    """Every position up to `entries`; a gap holds room 0."""
    return index.sparkSession.range(entries).join(index, "id", "left").select("id", F.coalesce("room", F.lit(0)).alias("room"))


def build_stats(tracks: DataFrame, lyrics: DataFrame) -> DataFrame:
    """One row of counts over the build's inputs and branches."""
    t = dedup_ids(project_tracks(tracks)).select("id", "last_lyrics_id")
    l = lyrics.select(F.col("id").alias("last_lyrics_id")).distinct().withColumn("hit", F.lit(1))
    both = t.join(l, "last_lyrics_id", "left").agg(
        F.count("*").alias("tracks"),
        F.count("hit").alias("matched"),
        F.count_if(F.col("last_lyrics_id").isNull()).alias("null_key"),
        F.count_if(F.col("last_lyrics_id").isNotNull() & F.col("hit").isNull()).alias("unmatched"),
    )
    return both.select("*", l.agg(F.count("*")).scalar().alias("lyrics"))


def agg_topology(catalog: DataFrame, per: int = P.ROOMS_PER_AGGREGATOR) -> DataFrame:
    """Rooms and records that each serving group owns."""
    return catalog.groupBy(F.floor(F.col("room") / per).cast("bigint").alias("aggregator")).agg(
        F.countDistinct("room").alias("rooms"), F.count("*").alias("records")
    )


def api_json(catalog: DataFrame) -> DataFrame:
    """Each served row as JSON, nulls kept."""
    return catalog.select("id", F.to_json(F.struct(*API_COLUMNS), {"ignoreNullFields": "false"}).alias("json"))

