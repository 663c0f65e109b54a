"""Text and routing functions as Spark column expressions.

All run in the JVM but for NFKC, which Spark lacks: it is one Arrow function
over whole batches, and rows of plain ASCII skip it.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that become a space, and those that vanish.
SPACED = "`~!@#$%^&*()_|+-=?;:\",.<>{}[]\\/\0\n"
DELETED = "'’"
#: Whitespace of both sides of the search: the builder's and the query's.
WHITESPACE = (
    "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+"
)
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
DEFAULT_LIMIT, MAX_LIMIT = 20, 100

INT_PREFIX = r"^[\s\uFEFF\u00A0]*([+-]?[0-9]+)"
FLOAT_PREFIX = r"^[\s\uFEFF\u00A0]*([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?))"


@F.arrow_udf(T.StringType())
def _nfkc(a: pa.Array) -> pa.Array:
    # pyarrow's own utf8_normalize leaves NFKC decomposed in some builds.
    return pa.array([x and unicodedata.normalize("NFKC", x) for x in a.to_pylist()], pa.string())


def nfkc(c: Column) -> Column:
    """Unicode normal form KC; null stays null."""
    return F.coalesce(_nfkc(F.when(c.rlike("[^\\x00-\\x7F]"), c)), c)


def normalize(c: Column) -> Column:
    """The form in which names are compared: NFKC, lower case, punctuation as
    spaces, apostrophes gone, single spaces. Null gives the empty string."""
    s = F.translate(F.lower(nfkc(F.coalesce(c, F.lit("")))), SPACED + DELETED, " " * len(SPACED))
    return F.trim(F.regexp_replace(s, WHITESPACE, " "))


def normalize_py(s: str | None) -> str:
    """normalize() for a single literal, on the driver."""
    s = unicodedata.normalize("NFKC", s or "").lower()
    s = s.translate(str.maketrans(SPACED, " " * len(SPACED), DELETED)).replace("\ufeff", " ")
    return " ".join(s.split())


def tokens(normalized: Column) -> Column:
    """Words of a normalised text; none for an empty one."""
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a bigint. sequence() counts down for
    an empty text, so that has its own branch."""
    b = F.encode(c, "UTF-8")
    byte = lambda i: F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("bigint")
    h = F.aggregate(
        F.sequence(F.lit(1), F.octet_length(c)),
        F.lit(FNV_OFFSET).cast("bigint"),
        lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)),
    )
    return F.when(c == "", F.lit(FNV_OFFSET).cast("bigint")).otherwise(h)


def fnv1a_py(s: str) -> int:
    h = FNV_OFFSET
    for b in s.encode():
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFF
    return h


def room(artist_normalized: Column, track_normalized: Column, rooms: int) -> Column:
    """Hash partition of a track: the artist comes first in the hashed key."""
    return F.pmod(fnv1a(F.concat_ws(" ", artist_normalized, track_normalized)), F.lit(rooms)).cast("int")


def room_py(artist: str | None, track: str | None, rooms: int) -> int:
    return fnv1a_py(f"{normalize_py(artist)} {normalize_py(track)}") % rooms


def super_route(query: Column, supers: int = 10) -> Column:
    """Which root a query goes to: the 32-bit string hash over UTF-16 units."""
    h = F.call_function("java_method", F.lit("java.util.Objects"), F.lit("hashCode"), query)
    return F.concat(F.lit("super-"), F.pmod(F.abs(h.cast("bigint")), F.lit(supers)))


def parse_int(c: Column) -> Column:
    """Leading integer of a raw parameter as a double; null where there is none."""
    return F.nullif(F.regexp_extract(c, INT_PREFIX, 1), F.lit("")).try_cast("double")


def parse_float(c: Column) -> Column:
    """Leading number of a raw parameter. Null or empty: null. No number: NaN."""
    return F.when(
        F.coalesce(c, F.lit("")) != "",
        F.coalesce(F.nullif(F.regexp_extract(c, FLOAT_PREFIX, 1), F.lit("")).try_cast("double"), F.lit(float("nan"))),
    )


def parse_limit(c: Column) -> Column:
    """Result size from a raw parameter: 20 if it has no number or zero, then 1 to 100."""
    n = F.coalesce(F.nullif(parse_int(c), F.lit(0.0)), F.lit(float(DEFAULT_LIMIT)))
    return F.least(F.greatest(n, F.lit(1.0)), F.lit(float(MAX_LIMIT))).cast("int")


def classify_record(ncols: Column, tag: Column) -> Column:
    """Which table a record of so many fields belongs to; tag is the type tag of
    its eighth field: 7 a float, 0, 8 or 9 a null, 0 or 1. Others raise an error
    in a scan; here they are 'error'."""
    return (
        F.when(ncols < 8, F.lit("skip"))
        .when(ncols == 12, F.lit("lyrics"))
        .when(ncols <= 11, F.lit("tracks"))
        .when(tag == 7, F.lit("tracks"))
        .when(tag.isin(0, 8, 9), F.lit("lyrics"))
        .otherwise(F.lit("error"))
    )


def url_encode(c: Column) -> Column:
    """A value as it stands in a query string: form encoding, blanks as '+'."""
    return F.url_encode(c)
