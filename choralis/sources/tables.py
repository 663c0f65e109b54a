"""Parquet in and out: the input tables, and a built catalogue on disk."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from choralis.operators import catalog as C
from choralis.operators.lookup import check_id, get_by_id
from choralis.plans.topology import INDEX_ENTRIES_PER_PART, PART_ROLL_BYTES, Topology
from choralis.schema import API_COLUMNS, CATALOG
from choralis.sources.ship import ship


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def read_json_rooms(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rooms as files of JSON arrays, the older format."""
    return spark.read.schema(CATALOG).option("multiLine", True).option("mode", "FAILFAST").json(paths)


def write_catalog(catalog: DataFrame, path: str, topology: Topology, records_per_file: int = 0) -> None:
    """The catalogue by room, sorted by id in each; the id index, sorted by id, so
    that row-group statistics prune a lookup to a few pages; manifest and topology.

    One shuffle by room serves the write; a task holds whole rooms, of some 72 MB
    each. The rest is computed from what was written, not by building it again.
    """
    rooms = C.with_room(catalog, topology.rooms)
    w = rooms.repartition("room").sortWithinPartitions("room", "id").write.mode("overwrite").partitionBy("room").option("compression", "zstd")
    (w.option("maxRecordsPerFile", records_per_file) if records_per_file else w).parquet(f"{path}/catalog")
    spark = catalog.sparkSession
    back = read_catalog(spark, path)
    C.id_index(back).repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/id_index")
    parts = C.room_parts(back, C.record_bytes())
    C.part_sizes(parts).orderBy("room", "part").write.mode("overwrite").parquet(f"{path}/files")
    total = C.manifest(parts).first().asDict()
    stats = C.id_index_stats(read_index(spark, path)).first()
    index_files = -(-(stats["entries"] or 0) // INDEX_ENTRIES_PER_PART)
    one = spark.createDataFrame([(json.dumps(total), topology.to_json(index_files=index_files))], "manifest string, topology string")
    one.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A built catalogue. The schema is given, so no file is opened to infer it."""
    ship(spark)
    return spark.read.schema(T.StructType([*CATALOG.fields, T.StructField("room", T.IntegerType())])).parquet(f"{path}/catalog")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id bigint, room int").parquet(f"{path}/id_index")


def read_manifest(spark: SparkSession, path: str) -> tuple[dict, dict]:
    row = spark.read.json(f"{path}/manifest").first()
    return json.loads(row["manifest"]), json.loads(row["topology"])


def write_parts(catalog: DataFrame, path: str, roll: int = PART_ROLL_BYTES) -> None:
    """The catalogue (with `room`) as one file for each part of a room, parts rolled as room_parts() says."""
    parts = C.room_parts(catalog, C.record_bytes(), roll).select("room", "id", "part")
    both = catalog.join(parts, ["room", "id"]).repartition("room", "part").sortWithinPartitions("room", "part", "id")
    both.write.mode("overwrite").partitionBy("room", "part").option("compression", "zstd").parquet(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return spark.read.schema(T.StructType([*CATALOG.fields, T.StructField("room", T.IntegerType()), T.StructField("part", T.IntegerType())])).parquet(path)


def read_binary_index(spark: SparkSession, paths: str | list[str], entries: int = INDEX_ENTRIES_PER_PART) -> DataFrame:
    """(id, room) of every entry of the dense index in files index-<part>.bin: 16-bit little-endian
    room numbers by id, so many entries a part. A gap holds room 0, as does an id of room 0."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, content in zip(b.column("part").to_pylist(), b.column("content").to_pylist(), strict=True):
                room = np.frombuffer(content, "<u2").astype(np.int32)
                ids = np.arange(len(room), dtype=np.int64) + part * entries
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(room)], ["id", "room"])

    files = spark.read.format("binaryFile").load(paths)
    part = F.regexp_extract("path", r"index-([0-9]+)\.bin$", 1).cast("bigint")
    return files.select(part.alias("part"), "content").filter("part is not null").mapInArrow(scan, "id bigint, room int")


def get_by_id_pruned(spark: SparkSession, path: str, id: int) -> DataFrame:
    """The served row by two hops: the index gives the room, and only that room is read."""
    check_id(id)
    hit = read_index(spark, path).filter(F.col("id") == id).first()
    df = read_catalog(spark, path)
    if hit is None:
        return df.filter(F.lit(False)).select(*API_COLUMNS)
    return get_by_id(df.filter(F.col("room") == hit["room"]), id)
