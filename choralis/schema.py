"""Fixed schemas of the source tables, the catalogue and the requests."""

from pyspark.sql import types as T

TRACKS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("artist_name", T.StringType()),
        T.StructField("album_name", T.StringType()),
        T.StructField("name_lower", T.StringType()),
        T.StructField("artist_name_lower", T.StringType()),
        T.StructField("album_name_lower", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("last_lyrics_id", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

LYRICS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("plain_lyrics", T.StringType()),
        T.StructField("synced_lyrics", T.StringType()),
        T.StructField("lyricsfile", T.StringType()),
        T.StructField("track_id", T.LongType()),
        T.StructField("has_plain_lyrics", T.IntegerType()),
        T.StructField("has_synced_lyrics", T.IntegerType()),
        T.StructField("has_lyricsfile", T.IntegerType()),
        T.StructField("instrumental", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

CATALOG = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("trackName", T.StringType(), False),
        T.StructField("artistName", T.StringType(), False),
        T.StructField("albumName", T.StringType(), False),
        T.StructField("duration", T.DoubleType(), False),
        T.StructField("instrumental", T.BooleanType(), False),
        T.StructField("plainLyrics", T.StringType()),
        T.StructField("syncedLyrics", T.StringType()),
        T.StructField("lyricsfile", T.StringType()),
        T.StructField("nameLower", T.StringType(), False),
        T.StructField("artistNameLower", T.StringType(), False),
        T.StructField("albumNameLower", T.StringType(), False),
    ]
)

#: The served row: the catalogue without its search columns.
API_COLUMNS = [f.name for f in CATALOG if not f.name.endswith("Lower")]
