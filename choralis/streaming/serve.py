"""Answer a stream of requests against a built catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from choralis.operators import lookup, search


def answer(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """(req_id, kind, id): one row per answer row of any kind of request."""
    found = [
        lookup.get_batch(catalog, requests).filter("id is not null").withColumn("kind", F.lit("get")),
        lookup.get_by_id_batch(catalog, requests).filter("room is not null").select("req_id", "id", F.lit("get_by_id").alias("kind")),
        search.search_batch(catalog, requests).withColumn("kind", F.lit("search")),
        search.search_lyrics_batch(catalog, requests).withColumn("kind", F.lit("search_lyrics")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("req_id", "kind", "id")


def serve(requests: DataFrame, catalog: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of `requests` is answered as a table of requests and written
    to its own folder, overwritten if the batch is run again: exactly once."""

    def write(batch: DataFrame, n: int) -> None:
        answer(catalog, batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
