"""What several operators share: reading fields of tables as one stream of values, writing a stage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choralis.sources.stages import path_of, run_folder
from choralis.sources.tables import table

VALUES = "field string, id bigint, value string"


def values(df: DataFrame, fields: list[str], id_: str = "id") -> DataFrame:
    """(field, id, value) of the given text columns: one scan, each row once per field."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    return df.select(F.col(id_).alias("id"), each.alias("_v")).select("_v.field", "id", "_v.value").filter(F.col("value").isNotNull())


def catalogue_values(spark: SparkSession, d: str) -> DataFrame:
    """The texts that problems 2 and 7 look at."""
    t = values(table(spark, d, "tracks"), ["name", "artist_name"])
    return t.unionByName(values(table(spark, d, "lyrics"), ["plain_lyrics"]))


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: it is computed once, its
    lineage is cut, and the loss of an executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> None:
    """Delete what this application has stored so far, as a long-lived one may do between
    queries. What was computed from stages and not written yet can't be read any more."""
    path, fs = path_of(spark, run_folder(spark))
    fs.delete(path, True)


class Bits:
    """A filter of hashes: tells those that were put in from nearly all others. Its size
    follows their number, up to 2^MOST bits; beyond it, more are let through in vain."""

    PER_KEY, LEAST, MOST, PROBES = 64, 16, 30, 4
    ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.shift = words, np.uint64(64 - (len(words) * 64).bit_length() + 1)

    @staticmethod
    def _cells(h: np.ndarray, shift: np.uint64) -> Iterator[np.ndarray]:
        h = h.astype(np.uint64)
        h = h ^ h >> np.uint64(29)
        return ((h * odd >> shift).astype(np.int64) for odd in Bits.ODD)

    @classmethod
    def of(cls, hashes: DataFrame) -> Bits:
        """The filter of all values of bigint columns. The driver gets its words, not the hashes."""
        log = min(cls.MOST, max(cls.LEAST, (hashes.count() * len(hashes.columns) * cls.PER_KEY).bit_length()))
        shift = np.uint64(64 - log)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells = np.unique(np.concatenate([x for c in b.columns for x in cls._cells(c.to_numpy(zero_copy_only=False), shift)]))
                word, at = np.unique(cells >> 6, return_index=True)
                bits = np.bitwise_or.reduceat(np.left_shift(np.ones(len(cells), np.int64), cells & 63), at) if len(cells) else cells
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(bits, pa.int64())], ["word", "bits"])

        got = hashes.mapInArrow(scan, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(1 << (log - 6), np.int64)
        words[got["word"].to_numpy()] = got["bits"].to_numpy()
        return cls(words)

    def among(self, h: np.ndarray) -> np.ndarray:
        """Positions of the hashes that may have been put in."""
        at = np.arange(len(h))
        for k in range(self.PROBES):
            x = h[at].astype(np.uint64)
            x = x ^ x >> np.uint64(29)
            cell = (x * self.ODD[k] >> self.shift).astype(np.int64)
            at = at[(self.words[cell >> 6] >> (cell & 63)) & 1 == 1]
        return at


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
