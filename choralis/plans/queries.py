"""The core queries over the test tables, and the same in SQL for another engine."""

from __future__ import annotations

import sys
import unicodedata
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choralis.functions import text as X
from choralis.operators import catalog as C
from choralis.operators import lookup as L
from choralis.operators import search as S
from choralis.plans import topology as P
from choralis.schema import API_COLUMNS, CATALOG
from choralis.sources import tables as T
from choralis.sources.stages import run_folder
from choralis.sources.tables import table

ROOMS = 100
#: Small limits, so that parts roll and files count as oversized in small rooms, too.
ROLL, WARN = 20_000, 21_000
GET = {"track": "Home", "artist": "Assorted Voices"}
ALBUM, DURATION = "The Trisortro Sessions", 232.0
WORDS, FIELDS, LINE = "The silver", {"track": "road to", "artist": "and the"}, "nobody "


def _t(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "tracks")


def _l(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lyrics")


def _r(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "requests")


def _names(s: SparkSession, d: str) -> DataFrame:
    """Catalogue without texts: for what needs names, ids and rooms only, no join is made."""
    t = C.dedup_ids(C.project_tracks(_t(s, d)))
    none = {c: F.lit(None).cast("string") for c in C.NO_LYRICS}
    return C.with_room(C.finish(t.withColumns(none | {"instrumental": F.lit(False)})), ROOMS)


def _c(s: SparkSession, d: str) -> DataFrame:
    return C.with_room(C.build_catalog(_t(s, d), _l(s, d)), ROOMS)


def _index(s: SparkSession, d: str) -> DataFrame:
    return C.id_index(_names(s, d))


def _narrow(s: SparkSession, d: str) -> DataFrame:
    return C.names_only(_t(s, d))


def _written(s: SparkSession, d: str) -> DataFrame:
    """The catalogue after it was written as part files and read again."""
    path = f"{run_folder(s)}/parts-{uuid.uuid4().hex}"
    T.write_parts(_c(s, d), path, ROLL)
    return T.read_parts(s, path)


def _parts(s: SparkSession, d: str) -> DataFrame:
    return C.room_parts(_c(s, d), C.text_bytes(), ROLL)


def _values(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d).select("id", F.explode(F.array("name", "artist_name", "album_name")).alias("value"))


def _distinct_values(s: SparkSession, d: str) -> DataFrame:
    return _values(s, d).select("value").filter("value is not null").distinct()


def _topology(s: SparkSession, d: str) -> DataFrame:
    n = s.range(1, 9).withColumn("source_bytes", F.expr("cast(pow(10, id + 4) as bigint)"))
    # Expressions of the same rule as plan_topology, for a column of sizes.
    raw = F.greatest(F.lit(1), F.floor(F.floor(F.col("source_bytes") * F.lit(P.TEXT_SHARE)) / P.ROOM_BYTES))
    rooms = (F.ceil(raw / 100) * 100).cast("bigint")
    agg = (F.ceil(F.greatest(F.lit(6), F.ceil(rooms / P.ROOMS_PER_AGGREGATOR)) / 6) * 6).cast("bigint")
    return n.select("source_bytes", rooms.alias("rooms"), agg.alias("aggregators"))


QUERIES = {
    "project_tracks": lambda s, d: C.project_tracks(_t(s, d)),
    "project_lyrics": lambda s, d: C.project_lyrics(_l(s, d)),
    "scan_catalog": lambda s, d: _written(s, d).select(*CATALOG.fieldNames()),
    "dedup_ids": lambda s, d: C.dedup_ids(_l(s, d).select("id", "track_id", "plain_lyrics", "source")),
    "catalog": lambda s, d: C.build_catalog(_t(s, d), _l(s, d)),
    "catalog_union": lambda s, d: C.catalog_union(_t(s, d), _l(s, d)),
    "join_inner": lambda s, d: C.matched(_t(s, d), _l(s, d)),
    "null_lyrics": lambda s, d: C.null_lyrics(_t(s, d)),
    "unmatched": lambda s, d: C.unmatched(_t(s, d), _l(s, d)),
    "normalize_text": lambda s, d: _distinct_values(s, d).select("value", X.normalize(F.col("value")).alias("normalized")),
    "tokenize": lambda s, d: _t(s, d).select("id", F.explode(X.tokens(X.normalize(F.col("name")))).alias("token")),
    "fnv1a": lambda s, d: _distinct_values(s, d).select("value", X.fnv1a(F.col("value")).alias("hash")),
    "hash_partition": lambda s, d: _names(s, d).select("id", "room"),
    "super_route": lambda s, d: _r(s, d).filter("q is not null").select("q").distinct().select("q", X.super_route(F.col("q")).alias("super")),
    "limit_parse": lambda s, d: _r(s, d).select("limit_raw").distinct().select("limit_raw", X.parse_limit(F.col("limit_raw")).alias("k")),
    "classify_record": lambda s, d: s.range(160).select("id", X.classify_record((F.col("id") / 10).cast("int"), (F.col("id") % 10).cast("int")).alias("kind")),
    "get_exact": lambda s, d: L.get(_narrow(s, d), **GET, lyrics=_l(s, d)),
    "get_album": lambda s, d: L.get(_narrow(s, d), **GET, album=ALBUM, lyrics=_l(s, d)),
    "get_duration": lambda s, d: L.get(_narrow(s, d), **GET, duration=DURATION, lyrics=_l(s, d)),
    "get_by_id": lambda s, d: L.get_by_id(_narrow(s, d), 120, lyrics=_l(s, d)),
    "get_batch": lambda s, d: L.get_batch(_names(s, d), _r(s, d)),
    "get_by_id_batch": lambda s, d: L.get_by_id_batch(_index(s, d), _r(s, d)),
    "get_by_id_rows": lambda s, d: L.get_by_id_rows(_c(s, d), _index(s, d), _r(s, d)),
    "get_by_id_responses": lambda s, d: L.get_by_id_responses(_c(s, d), _index(s, d), _r(s, d)),
    "limit_zero": lambda s, d: S.search(_narrow(s, d), q=WORDS, limit=0, lyrics=_l(s, d)),
    "url_encode": lambda s, d: _r(s, d).filter("q is not null").select("q").distinct().select("q", X.url_encode(F.col("q")).alias("encoded")),
    "request_status": lambda s, d: L.request_status(_r(s, d)),
    "search_tokens": lambda s, d: S.search(_narrow(s, d), q=WORDS, lyrics=_l(s, d)),
    "search_tokens_empty": lambda s, d: S.search(_narrow(s, d), q="!!!", limit=5, lyrics=_l(s, d)),
    "search_fields": lambda s, d: S.search(_narrow(s, d), **FIELDS, limit=100, lyrics=_l(s, d)),
    "search_batch": lambda s, d: S.search_batch(_names(s, d), _r(s, d)),
    "search_lyrics": lambda s, d: S.search_lyrics(_c(s, d), LINE),
    "search_lyrics_batch": lambda s, d: S.search_lyrics_batch(_c(s, d), _r(s, d)),
    "id_index": _index,
    "id_index_parts": lambda s, d: C.id_index_parts(_index(s, d), 1000),
    "id_index_stats": lambda s, d: C.id_index_stats(_index(s, d)),
    "room_info": lambda s, d: C.room_info(_names(s, d)),
    "room_parts": lambda s, d: _parts(s, d),
    "manifest": lambda s, d: C.manifest(_parts(s, d)),
    "oversized_files": lambda s, d: C.oversized_files(_parts(s, d), WARN),
    "build_stats": lambda s, d: C.build_stats(_t(s, d), _l(s, d)),
    "agg_topology": lambda s, d: C.agg_topology(_names(s, d), 6),
    "topology": _topology,
    "api_json": lambda s, d: C.api_json(_c(s, d)),
}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """A table of exact lookups against the catalogue."""
    return L.get_batch(_c(spark, d), _r(spark, d))


# --- the same in SQL -----------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _nfkc_map() -> str:
    """A SQL map from each character with a compatibility form to that form."""
    pairs = [(ch, n) for i in range(sys.maxunicode) if not 0xD800 <= i < 0xE000 and (n := unicodedata.normalize("NFKC", ch := chr(i))) != ch]
    return "map([" + ",".join(_q(a) for a, _ in pairs) + "],[" + ",".join(_q(b) for _, b in pairs) + "])"


_WS = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"


def _nfkc(c: str) -> str:
    each = f"list_transform(string_split({c}, ''), lambda ch: coalesce(m[ch], ch))"
    return f"CASE WHEN regexp_matches({c}, '[^\\x00-\\x7F]') THEN nfc_normalize(array_to_string({each}, '')) ELSE {c} END"


def _lower(c: str) -> str:
    """Lower case with a capital sigma at the end of a word as the final one."""
    return f"lower(CASE WHEN contains({c}, 'Σ') THEN regexp_replace({c}, '(\\p{{L}})Σ(\\P{{L}}|$)', '\\1ς\\2', 'g') ELSE {c} END)"


def _norm(c: str) -> str:
    spaced = X.SPACED.replace("\0", "")
    table_ = _q(spaced + X.DELETED)
    return f"trim(regexp_replace(translate({_lower(c)}, {table_}, {_q(' ' * len(spaced))}), '{_WS}', ' ', 'g'))"


def _fnv(c: str) -> str:
    each = f"list_transform(range(1, strlen({c}) + 1), lambda i: ('0x' || substr(hex({c}), 2 * i - 1, 2))::UBIGINT)"
    return f"list_reduce(list_prepend(2166136261::UBIGINT, {each}), lambda h, b: (xor(h, b) * 16777619::UBIGINT) & 4294967295::UBIGINT)::BIGINT"


def _prefix(c: str, pattern: str) -> str:
    return f"nullif(regexp_extract({c}, {_q(pattern)}, 1), '')"


_INT = "^\\s*([+-]?[0-9]+)"
_FLOAT = "^\\s*([+-]?(?:Infinity|(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?))"
_LIMIT = f"CAST(least(greatest(coalesce(nullif(TRY_CAST({_prefix('limit_raw', _INT)} AS DOUBLE), 0), 20), 1), 100) AS INT)"
_API = "id, trackName AS name, trackName, artistName, albumName, duration, instrumental, plainLyrics, syncedLyrics, lyricsfile"


def _ctes() -> str:
    values = "SELECT name AS v FROM tracks UNION SELECT artist_name FROM tracks UNION SELECT album_name FROM tracks"
    for c in ("q", "track_name", "artist_name", "album_name"):
        values += f" UNION SELECT {c} FROM requests"
    return f"""WITH nf AS MATERIALIZED (SELECT {_nfkc_map()} AS m),
v0 AS MATERIALIZED (SELECT v FROM ({values}) WHERE v IS NOT NULL),
v1 AS MATERIALIZED (SELECT v, {_nfkc('v')} AS k FROM v0, nf),
nv AS MATERIALIZED (SELECT v, {_norm('k')} AS n FROM v1),
pt AS (SELECT id, coalesce(name, '') AS trackName, coalesce(artist_name, '') AS artistName, coalesce(album_name, '') AS albumName, coalesce(duration, 0.0) AS duration, last_lyrics_id FROM tracks),
pl AS (SELECT DISTINCT id AS lyrics_id, nullif(plain_lyrics, '') AS plainLyrics, nullif(synced_lyrics, '') AS syncedLyrics, nullif(lyricsfile, '') AS lyricsfile, coalesce(instrumental <> 0, false) AS instrumental FROM lyrics),
nt AS MATERIALIZED (SELECT pt.*, coalesce(a.n, '') AS nameLower, coalesce(b.n, '') AS artistNameLower, coalesce(c.n, '') AS albumNameLower FROM pt LEFT JOIN nv a ON a.v = trackName LEFT JOIN nv b ON b.v = artistName LEFT JOIN nv c ON c.v = albumName),
nr AS MATERIALIZED (SELECT id, CAST({_fnv("(artistNameLower || ' ' || nameLower)")} % {ROOMS} AS INT) AS room FROM nt),
cat AS (SELECT nt.id, trackName AS name, trackName, artistName, albumName, duration, coalesce(instrumental, false) AS instrumental, plainLyrics, syncedLyrics, lyricsfile, nameLower, artistNameLower, albumNameLower, lyrics_id, last_lyrics_id FROM nt LEFT JOIN pl ON last_lyrics_id = lyrics_id),
rq AS (SELECT DISTINCT * FROM requests)
"""


_API_OF_CAT = ", ".join(f"cat.{c}" for c in API_COLUMNS)
_ASKED = "(SELECT req_id, CASE WHEN regexp_full_match(id, '[0-9]+') THEN TRY_CAST(id AS BIGINT) END AS id FROM rq WHERE kind = 'get_by_id') r"


def _error(error: tuple[int, str, str]) -> str:
    return _q('{"code":%d,"name":"%s","message":"%s"}' % error)


def _hit(where: str, limit: int) -> str:
    return f"SELECT {_API} FROM cat WHERE {where} ORDER BY id LIMIT {limit}"


def oracle_sql() -> dict[str, str]:
    w = _ctes()
    thirteen = "id, name, trackName, artistName, albumName, duration, instrumental, plainLyrics, syncedLyrics, lyricsfile, nameLower, artistNameLower, albumNameLower"
    exact = f"nameLower = {_q(X.normalize_py(GET['track']))} AND artistNameLower = {_q(X.normalize_py(GET['artist']))}"
    three = "contains(nameLower, {0}) OR contains(artistNameLower, {0}) OR contains(albumNameLower, {0})"
    words = " AND ".join("(" + three.format(_q(t)) + ")" for t in X.normalize_py(WORDS).split())
    bytes_ = " + ".join(f"strlen(coalesce({c}, ''))" for c in ("name", "trackName", "artistName", "albumName", "plainLyrics", "syncedLyrics", "lyricsfile", "nameLower", "artistNameLower", "albumNameLower"))
    fold = f"""sz AS MATERIALIZED (SELECT room, cat.id, {bytes_} AS bytes, row_number() OVER (PARTITION BY room ORDER BY cat.id) AS n FROM cat JOIN nr USING (id)),
"""
    rec = "WITH RECURSIVE " + w[5:].rstrip() + ",\n" + fold + f"""f AS (SELECT room, id, n, bytes, 0 AS part, bytes + 1 AS filled FROM sz WHERE n = 1
UNION ALL SELECT s.room, s.id, s.n, s.bytes, f.part + CAST(f.filled >= {ROLL} AS INT), CASE WHEN f.filled >= {ROLL} THEN 0 ELSE f.filled END + s.bytes + 1 FROM f JOIN sz s ON s.room = f.room AND s.n = f.n + 1),
files AS (SELECT room, part, count(*) AS records, sum(bytes) + count(*) + 1 AS bytes FROM f GROUP BY ALL)
"""
    given = lambda c: f"coalesce({c}, '') <> ''"
    top = "SELECT req_id, id FROM (SELECT req_id, id, k, row_number() OVER (PARTITION BY req_id ORDER BY id) AS n FROM ({0})) WHERE n <= k"
    field = lambda p, c: f"({p} IS NULL OR {p} = '' OR contains({c}, {p}))"
    search = f"""SELECT r.req_id, r.k, t.id FROM (SELECT req_id, {_LIMIT} AS k, q, CASE WHEN {given('q')} THEN list_filter(string_split(nq.n, ' '), lambda x: x <> '') END AS words, nt_.n AS a, na.n AS b, nl.n AS c
FROM rq LEFT JOIN nv nq ON nq.v = q LEFT JOIN nv nt_ ON nt_.v = track_name LEFT JOIN nv na ON na.v = artist_name LEFT JOIN nv nl ON nl.v = album_name
WHERE kind = 'search' AND ({given('q')} OR {given('track_name')})) r JOIN nt t
ON CASE WHEN r.words IS NOT NULL THEN len(list_filter(r.words, lambda x: NOT ({three.format('x')}))) = 0
ELSE {field('r.a', 'nameLower')} AND {field('r.b', 'artistNameLower')} AND {field('r.c', 'albumNameLower')} END"""
    units = "flatten(list_transform(string_split(q, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [55296 + ((unicode(c) - 65536) // 1024), 56320 + (unicode(c) - 65536) % 1024] ELSE [unicode(c)] END))"
    java = f"list_reduce(list_prepend(0::BIGINT, list_transform({units}, lambda u: u::BIGINT)), lambda h, u: (h * 31 + u) % 4294967296)"
    return {
        "scan_catalog": w + f"SELECT {thirteen} FROM cat",
        "limit_zero": w + _hit(words, 20),
        "url_encode": f"SELECT q, array_to_string(list_transform(string_split(q, ''), lambda c: CASE WHEN c = '' THEN '' WHEN regexp_full_match(c, '[A-Za-z0-9*._-]') THEN c WHEN c = ' ' THEN '+' ELSE regexp_replace(hex(c), '(..)', '%\\1', 'g') END), '') AS encoded FROM (SELECT DISTINCT q FROM requests WHERE q IS NOT NULL)",
        "get_by_id_rows": w + f"SELECT req_id, {_API_OF_CAT} FROM {_ASKED} JOIN cat USING (id)",
        "get_by_id_responses": w
        + f"""SELECT req_id, CASE WHEN cat.id IS NOT NULL THEN 200 WHEN zero THEN 400 ELSE 404 END AS code,
CASE WHEN cat.id IS NOT NULL THEN to_json(struct_pack({', '.join(f'{c} := cat.{c}' for c in API_COLUMNS)}))::VARCHAR WHEN zero THEN {_error(L.ID_400)} WHEN NOT digits THEN {_error(L.ROUTE_404)} ELSE {_error(L.TRACK_404)} END AS body
FROM (SELECT req_id, regexp_full_match(coalesce(id, ''), '[0-9]+') AS digits, regexp_full_match(coalesce(id, ''), '0+') AS zero, CASE WHEN regexp_full_match(id, '[0-9]+') THEN TRY_CAST(id AS BIGINT) END AS id FROM rq WHERE kind = 'get_by_id') r LEFT JOIN cat ON cat.id = r.id AND r.id >= 1""",
        "super_route": f"SELECT q, 'super-' || abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 10 AS super FROM (SELECT q, {java} AS h FROM (SELECT DISTINCT q FROM requests WHERE q IS NOT NULL))",
        "api_json": w + f"SELECT id, to_json(struct_pack({', '.join(f'{c} := {c}' for c in API_COLUMNS)}))::VARCHAR AS json FROM cat",
        "project_tracks": w + "SELECT * FROM pt",
        "project_lyrics": "SELECT id AS lyrics_id, nullif(plain_lyrics, '') AS plainLyrics, nullif(synced_lyrics, '') AS syncedLyrics, nullif(lyricsfile, '') AS lyricsfile, coalesce(instrumental <> 0, false) AS instrumental FROM lyrics",
        "dedup_ids": "SELECT DISTINCT id, track_id, plain_lyrics, source FROM lyrics",
        "catalog": w + f"SELECT {thirteen} FROM cat",
        "catalog_union": w + f"SELECT {thirteen} FROM cat",
        "join_inner": w + f"SELECT {thirteen} FROM cat WHERE lyrics_id IS NOT NULL",
        "null_lyrics": w + f"SELECT {thirteen} FROM cat WHERE last_lyrics_id IS NULL",
        "unmatched": w + f"SELECT {thirteen} FROM cat WHERE last_lyrics_id IS NOT NULL AND lyrics_id IS NULL",
        "normalize_text": w + "SELECT v AS value, n AS normalized FROM nv WHERE v IN (SELECT name FROM tracks UNION SELECT artist_name FROM tracks UNION SELECT album_name FROM tracks)",
        "tokenize": w + "SELECT id, unnest(list_filter(string_split(nameLower, ' '), lambda x: x <> '')) AS token FROM nt",
        "fnv1a": f"SELECT v AS value, {_fnv('v')} AS hash FROM (SELECT name AS v FROM tracks UNION SELECT artist_name FROM tracks UNION SELECT album_name FROM tracks) WHERE v IS NOT NULL",
        "hash_partition": w + "SELECT id, room FROM nr",
        "limit_parse": f"SELECT limit_raw, {_LIMIT} AS k FROM (SELECT DISTINCT limit_raw FROM requests)",
        "classify_record": "SELECT id, CASE WHEN id // 10 < 8 THEN 'skip' WHEN id // 10 = 12 THEN 'lyrics' WHEN id // 10 < 12 THEN 'tracks' WHEN id % 10 = 7 THEN 'tracks' WHEN id % 10 IN (0, 8, 9) THEN 'lyrics' ELSE 'error' END AS kind FROM range(160) t(id)",
        "get_exact": w + _hit(exact, 1),
        "get_album": w + _hit(f"{exact} AND albumNameLower = {_q(X.normalize_py(ALBUM))}", 1),
        "get_duration": w + _hit(f"{exact} AND duration BETWEEN {DURATION - 2} AND {DURATION + 2}", 1),
        "get_by_id": w + _hit("id = 120", 1),
        "get_batch": w
        + f"""SELECT req_id, min(t.id) AS id FROM (SELECT req_id, a.n AS qt, b.n AS qa, c.n AS ql, {_prefix('duration', _FLOAT)}::DOUBLE AS qd, {given('album_name')} AS has
FROM rq JOIN nv a ON a.v = track_name JOIN nv b ON b.v = artist_name LEFT JOIN nv c ON c.v = album_name WHERE kind = 'get' AND {given('track_name')} AND {given('artist_name')}) r
LEFT JOIN nt t ON nameLower = qt AND artistNameLower = qa AND (NOT has OR albumNameLower = ql) AND (qd IS NULL OR t.duration BETWEEN qd - 2 AND qd + 2) GROUP BY req_id""",
        "get_by_id_batch": w + "SELECT req_id, r.id, room FROM (SELECT req_id, CASE WHEN regexp_full_match(id, '[0-9]+') THEN TRY_CAST(id AS BIGINT) END AS id FROM rq WHERE kind = 'get_by_id') r LEFT JOIN nr USING (id) WHERE r.id >= 1",
        "request_status": f"""SELECT req_id, kind, CASE WHEN kind = 'get' THEN CASE WHEN {given('track_name')} AND {given('artist_name')} THEN 'ok' ELSE '400' END
WHEN kind = 'get_by_id' THEN CASE WHEN NOT regexp_full_match(coalesce(id, ''), '[0-9]+') THEN '404' WHEN regexp_full_match(id, '0+') THEN '400' ELSE 'ok' END
WHEN kind = 'search' THEN CASE WHEN {given('q')} OR {given('track_name')} THEN 'ok' ELSE 'empty' END
WHEN kind = 'search_lyrics' THEN CASE WHEN {given('q')} THEN 'ok' ELSE '400' END ELSE '404' END AS status FROM (SELECT DISTINCT * FROM requests)""",
        "search_tokens": w + _hit(words, 20),
        "search_tokens_empty": w + _hit("true", 5),
        "search_fields": w + _hit(f"contains(nameLower, {_q(X.normalize_py(FIELDS['track']))}) AND contains(artistNameLower, {_q(X.normalize_py(FIELDS['artist']))})", 100),
        "search_batch": w + top.format(search),
        "search_lyrics": w + _hit(f"contains(lower(plainLyrics), {_q(LINE)}) OR contains(lower(syncedLyrics), {_q(LINE)})", 20),
        "search_lyrics_batch": w
        + top.format(
            f"SELECT req_id, k, c.id FROM (SELECT req_id, {_LIMIT} AS k, {_lower('q')} AS needle FROM rq WHERE kind = 'search_lyrics' AND {given('q')}) r JOIN (SELECT id, {_lower('plainLyrics')} AS p, {_lower('syncedLyrics')} AS s FROM cat) c ON contains(p, needle) OR contains(s, needle)"
        ),
        "id_index": w + "SELECT id, room FROM nr",
        "id_index_parts": "SELECT id // 1000 AS part, count(*) AS used, max(id) AS last_id FROM tracks GROUP BY 1",
        "id_index_stats": "SELECT max(id) AS max_id, max(id) + 1 AS entries, max(id) + 1 - count(*) AS gaps FROM tracks",
        "room_info": w + "SELECT room, count(*) AS records FROM nr GROUP BY room",
        "room_parts": rec + "SELECT room, id, part, CAST(bytes AS BIGINT) AS bytes FROM f",
        "manifest": rec + "SELECT CAST(sum(records) AS BIGINT) AS total_records, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) AS total_files, count(DISTINCT room) AS total_rooms FROM files",
        "oversized_files": rec + f"SELECT count_if(bytes > {WARN})::BIGINT AS files, CAST(max(bytes) AS BIGINT) AS largest FROM files",
        "build_stats": "WITH l AS (SELECT DISTINCT id FROM lyrics) SELECT count(*) AS tracks, count(l.id) AS matched, count_if(last_lyrics_id IS NULL)::BIGINT AS null_key, count_if(last_lyrics_id IS NOT NULL AND l.id IS NULL)::BIGINT AS unmatched, (SELECT count(*) FROM l) AS lyrics FROM tracks LEFT JOIN l ON l.id = last_lyrics_id",
        "agg_topology": w + "SELECT CAST(room // 6 AS BIGINT) AS aggregator, count(DISTINCT room) AS rooms, count(*) AS records FROM nr GROUP BY 1",
        "topology": f"SELECT b AS source_bytes, r AS rooms, CAST(ceil(greatest(6, ceil(r / 72)) / 6) * 6 AS BIGINT) AS aggregators FROM (SELECT b, CAST(ceil(greatest(1, floor(floor(b * {P.TEXT_SHARE}::DOUBLE) / {P.ROOM_BYTES})) / 100) * 100 AS BIGINT) AS r FROM (SELECT CAST(pow(10, i + 4) AS BIGINT) AS b FROM range(1, 9) t(i)))",
    }
