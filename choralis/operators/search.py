"""Substring searches: over the names, and over the texts; single or for a table of requests.

A table of requests is a stated set of questions, so the catalogue is read once
against blocks of them: the distinct needles of a block are compiled into one
Aho-Corasick automaton, which finds all of them in one pass over a text, however
many they are. No pairs of rows and requests are formed but for real matches, and
only the best k of a partition are shuffled.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from operator import and_

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from choralis.functions import text as X
from choralis.operators.lookup import BadRequest, distinct_requests, with_texts

NAMES = ["nameLower", "artistNameLower", "albumNameLower"]
#: Distinct questions of one block, which is what a task keeps in memory.
BLOCK = 50_000


def _top(df: DataFrame, limit: int, lyrics: DataFrame | None = None) -> DataFrame:
    """The first rows by id: none asked for is as the usual number."""
    return with_texts(df.orderBy("id").limit(max(1, min(limit or X.DEFAULT_LIMIT, X.MAX_LIMIT))), lyrics)


def search(catalog: DataFrame, q: str | None = None, track: str | None = None, artist: str | None = None, album: str | None = None, limit: int = X.DEFAULT_LIMIT, lyrics: DataFrame | None = None) -> DataFrame:
    """Rows in whose names every word of q occurs, or, without q, whose fields hold
    the given ones. Neither q nor track: no rows. No word in q: every row. A field
    of which nothing remains when normalised isn't asked for. lyrics as in with_texts()."""
    if not q and not track:
        return _top(catalog.filter(F.lit(False)), limit, lyrics)
    if q:
        found = [reduce(lambda a, b: a | b, [F.col(n).contains(t) for n in NAMES]) for t in X.normalize_py(q).split()]
    else:
        found = [F.col(n).contains(v) for n, x in zip(NAMES, (track, artist, album), strict=True) if x and (v := X.normalize_py(x))]
    return _top(catalog.filter(reduce(and_, found, F.lit(True))), limit, lyrics)


def _lower(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def search_lyrics(catalog: DataFrame, q: str, limit: int = X.DEFAULT_LIMIT) -> DataFrame:
    """Rows whose plain or timed text holds q, but for case."""
    if not q:
        raise BadRequest("q parameter is required")
    needle = F.lower(F.lit(q))
    return _top(catalog.filter(_lower("plainLyrics").contains(needle) | _lower("syncedLyrics").contains(needle)), limit)


def _blocks(asked: DataFrame, size: int = BLOCK) -> Iterator[list]:
    block: list = []
    for row in asked.toLocalIterator(prefetchPartitions=False):
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _automaton(needles: list[str]) -> ahocorasick.Automaton | None:
    a = ahocorasick.Automaton()
    for i, n in enumerate(needles):
        a.add_word(n, i)
    a.make_automaton()
    return a if needles else None


def _matcher(questions: list[tuple[str, list[tuple[int, str]]]], fields: int):
    """questions: (key, [(field or -1 for any, needle)]). Gives a function from a row's
    fields to the keys of all questions that it meets. A question waits under one of
    its needles, the longest, and the rest are looked up when that one is found."""
    needles = sorted({n for _, parts in questions for _, n in parts})
    number = {n: i for i, n in enumerate(needles)}
    auto = _automaton(needles)
    every, waiting = [], defaultdict(list)
    for key, parts in questions:
        if not parts:
            every.append(key)
            continue
        coded = sorted({(f, number[n]) for f, n in parts}, key=lambda p: (-len(needles[p[1]]), p))
        waiting[coded[0][1]].append((key, coded))

    def match(values: list[str]) -> list[str]:
        found: dict[int, int] = {}
        for k, v in enumerate(values):
            if auto is not None and v:
                for _, n in auto.iter(v):
                    found[n] = found.get(n, 0) | 1 << k
        hits = list(every)
        for n in found:
            for key, coded in waiting.get(n, ()):
                if all(found.get(m, 0) & (1 << f if f >= 0 else ~0) for f, m in coded):
                    hits.append(key)
        return hits

    return match


def _run(rows: DataFrame, fields: list[str], asked: DataFrame, parts, size: int) -> DataFrame:
    """The best ids of each distinct question `key`, as (key, id). asked has key, k and what parts() reads."""
    spark, out = rows.sparkSession, None
    for block in _blocks(asked, size):
        packed = spark.sparkContext.broadcast([(r["key"], parts(r)) for r in block])
        most = max(r["k"] for r in block)

        def scan(batches: Iterator[pa.RecordBatch], packed=packed, most=most) -> Iterator[pa.RecordBatch]:
            match = _matcher(packed.value, len(fields))
            for b in batches:
                cols = [b.column(f).to_pylist() for f in fields]
                ids, keys = [], []
                best = defaultdict(list)
                for id_, *values in zip(b.column("id").to_pylist(), *cols, strict=True):
                    for key in match(values):
                        best[key].append(id_)
                for key, found in best.items():
                    ids += (kept := heapq.nsmallest(most, found))
                    keys += [key] * len(kept)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64())], ["key", "id"])

        hits = rows.mapInArrow(scan, "key string, id bigint")
        # The window's group limit runs before the shuffle as well, so each partition sends at most k rows a question.
        best = hits.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("n") <= most)
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], "key string, id bigint, n int")
    return out


def _answers(r: DataFrame, question: list[str], rows: DataFrame, fields: list[str], parts, size: int) -> DataFrame:
    """r: req_id, k and the columns of `question`. Equal questions are asked once, with the largest k of theirs."""
    key = F.sha2(F.to_json(F.struct(*question), {"ignoreNullFields": "false"}), 256)
    asked = r.groupBy(*question).agg(F.max("k").alias("k")).withColumn("key", key)
    best = _run(rows, fields, asked, parts, size)
    keyed = r.withColumn("key", key).select("req_id", "k", "key")
    return keyed.join(best, "key").filter(F.col("n") <= F.col("k")).select("req_id", "id")


def search_batch(catalog: DataFrame, requests: DataFrame, block: int = BLOCK) -> DataFrame:
    """(req_id, id) of the first k rows of each 'search' request."""
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    field = lambda c: F.when(~given("q") & given(c), X.normalize(F.col(c)))
    r = (
        distinct_requests(requests)
        .filter((F.col("kind") == "search") & (given("q") | given("track_name")))
        .select(
            "req_id",
            X.parse_limit(F.col("limit_raw")).alias("k"),
            F.when(given("q"), F.array_sort(F.array_distinct(X.tokens(X.normalize(F.col("q")))))).alias("words"),
            F.nullif(field("track_name"), F.lit("")).alias("t"),
            F.nullif(field("artist_name"), F.lit("")).alias("a"),
            F.nullif(field("album_name"), F.lit("")).alias("l"),
        )
    )

    def parts(row) -> list[tuple[int, str]]:
        if row["words"] is not None:
            return [(-1, w) for w in row["words"]]
        return [(i, row[c]) for i, c in enumerate("tal") if row[c] is not None]

    return _answers(r, ["words", "t", "a", "l"], catalog.select("id", *NAMES), NAMES, parts, block)


def search_lyrics_batch(catalog: DataFrame, requests: DataFrame, block: int = BLOCK) -> DataFrame:
    """(req_id, id) of the first k rows of each 'search_lyrics' request."""
    r = (
        distinct_requests(requests)
        .filter((F.col("kind") == "search_lyrics") & (F.coalesce("q", F.lit("")) != ""))
        .select("req_id", X.parse_limit(F.col("limit_raw")).alias("k"), F.lower("q").alias("needle"))
    )
    rows = catalog.select("id", _lower("plainLyrics").alias("plain"), _lower("syncedLyrics").alias("synced"))
    return _answers(r, ["needle"], rows, ["plain", "synced"], lambda row: [(-1, row["needle"])], block)
