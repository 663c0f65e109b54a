"""The best record of each group of duplicates, field by field.

Each value of a field competes within its group: more complete first, then more
trusted, then more recent, then the smaller id, so that the order is total and any
run gives the same. The order is a window over narrow rows (no texts); Spark limits
each group to its first rows before the shuffle, so a group that holds a third of
all records sends a few rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIELDS = ["plain_lyrics", "synced_lyrics", "instrumental"]
# Notes that stand in for a missing text, letters and digits only.
NOTES = [
    "na", "nan", "none", "null", "nil", "tba", "tbd", "todo", "unknown", "empty", "missing", "instrumental", "instrumentaltrack", "nolyrics",
    "nolyricsfound", "nolyricsavailable", "nolyricsyet", "lyricsnotavailable", "lyricsnotavailableyet", "lyricsnotfound", "lyricsunavailable",
    "lyricscomingsoon", "comingsoon", "notavailable", "notavailableyet", "notyetavailable", "notfound", "notranscribed", "untranscribed", "placeholder", "pending",
]


def is_value(c: Column) -> Column:
    """Whether a text is one: not null, blank, made of signs only, nor a note that stands in for it."""
    letters = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    note = F.length(c) <= 60
    return c.isNotNull() & (letters != "") & ~(note & letters.isin(NOTES))


def _candidates(lyrics: DataFrame, sources: DataFrame) -> DataFrame:
    """(track_id, field, id, size, trust, at), one row per value, and one with the field null per record."""
    trust = sources.groupBy("source").agg(F.max("trust").alias("trust"))
    text = lambda c: F.when(is_value(F.col(c)), F.length(c))
    narrow = (
        lyrics.filter("track_id is not null")
        .select(
            "track_id",
            "id",
            "source",
            F.coalesce(F.unix_micros("updated_at"), F.lit(-(1 << 62))).alias("at"),
            text("plain_lyrics").alias("plain_lyrics"),
            text("synced_lyrics").alias("synced_lyrics"),
            F.when(F.col("instrumental").isNotNull(), F.lit(0)).alias("instrumental"),
        )
        .distinct()
    )
    # The list of sources is small reference data; Spark broadcasts it if it is below its threshold and else joins by key.
    narrow = narrow.join(trust, "source", "left").withColumn("trust", F.coalesce("trust", F.lit(0)))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("size")) for f in FIELDS]))
    return narrow.select("track_id", "id", "at", "trust", each.alias("_f")).select("track_id", "id", "at", "trust", "_f.*").filter("size is not null")


def _first(c: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("track_id", "field").orderBy(F.desc("size"), F.desc("trust"), F.desc("at"), "id")
    return c.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= n)


def survivors(lyrics: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per track: for each field the best value and the id it came from.

    A record whose track_id is null belongs to no group. A field without any value is
    null, and so is its id. Records delivered twice count once; sources that aren't in
    the list, or null, are trusted least, and a null updated_at is the earliest.
    """
    best = _first(_candidates(lyrics, sources), 1).select("track_id", "field", "id")
    ids = best.groupBy("track_id").pivot("field", FIELDS).agg(F.min("id"))
    ids = ids.select("track_id", *[F.col(f).alias(f"{f}_id") for f in FIELDS])
    out = lyrics.filter("track_id is not null").select("track_id").distinct().join(ids, "track_id", "left")
    rows = lyrics.groupBy("id").agg(F.min(F.struct(*FIELDS)).alias("_v")).select("id", "_v.*")
    for f in FIELDS:
        out = out.join(rows.select(F.col("id").alias(f"{f}_id"), f), f"{f}_id", "left")
    return out.select("track_id", *[x for f in FIELDS for x in (f, f"{f}_id")])


def clear_winners(lyrics: DataFrame, sources: DataFrame) -> DataFrame:
    """(track_id, field, id) where one record of several is at least as complete, recent and trusted as all others.

    Only the first two in order can be it: the first must hold all three maxima of its
    group, and the second must fall short of one. The maxima are plain aggregates.
    """
    c = _candidates(lyrics, sources)
    several = lyrics.filter("track_id is not null").groupBy("track_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("track_id")
    top = c.groupBy("track_id", "field").agg(F.max("size").alias("s"), F.max("trust").alias("t"), F.max("at").alias("u"))
    full = _first(c, 2).join(top, ["track_id", "field"]).filter("size = s and trust = t and at = u")
    one = full.groupBy("track_id", "field").agg(F.min("id").alias("id"), F.max("id").alias("last")).filter("id = last")
    return one.join(several, "track_id", "left_semi").select("track_id", "field", "id")
