"""Records that are the same but for formatting.

Each record is hashed bottom-up: its leaves are normalised and hashed; the digests
of an unordered node are sorted before they are hashed into the node's own; the root
joins the nodes. Records are grouped by root digest, and records of one digest are
then compared in full structure, so a collision of digests can't merge any.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choralis.llm.common import stored

NAMES = ["name_lower", "artist_name_lower", "album_name_lower"]
#: A digest of more rows than HOT, and than a MOST-th of all, has its rows salted.
HOT, MOST, SALTS = 10_000, 10_000, 64


def leaf(c: Column) -> Column:
    """Letters and digits in order, without case: upper and then lower folds letters
    that have several lower forms. Null is as empty."""
    # The optimizer makes one step of upper and lower side by side, so signs are dropped between them.
    s = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")
    return F.translate(F.lower(s), "ς", "σ")


def structure(names: list[str], ordered: list[str]) -> Column:
    """The normalised record: an unordered node of names, sorted, and ordered values after it."""
    # Adding zero makes -0.0 and 0.0 one; null is a value of its own.
    rest = [F.coalesce((F.col(c) + 0).cast("string") if c == "duration" else F.col(c).cast("string"), F.lit("null")) for c in ordered]
    return F.struct(F.array_sort(F.array(*[leaf(F.col(c)) for c in names])).alias("names"), *[r.alias(c) for r, c in zip(rest, ordered, strict=True)])


def root(s: Column, ordered: list[str]) -> Column:
    """Digest of a normalised record from the digests of its parts."""
    node = F.xxhash64(F.lit("names"), F.concat_ws(",", F.transform(F.array_sort(F.transform(s["names"], lambda x: F.xxhash64(x))), lambda h: h.cast("string"))))
    return reduce(lambda h, c: F.xxhash64(h, F.lit(c), F.xxhash64(s[c])), ordered, node)


def _hashed(df: DataFrame, names: list[str], ordered: list[str]) -> DataFrame:
    return df.select("id", structure(names, ordered).alias("s")).withColumn("root", root(F.col("s"), ordered))


def collapse(df: DataFrame, names: list[str] = NAMES, ordered: list[str] = ("duration",)) -> DataFrame:
    """(first_id, copies, root): one row per distinct record, with how many rows had it.

    Counts are combined before the shuffle, so a record with a third of all rows sends
    one row a task. Nulls, empty texts and repeated ids have the meaning given above;
    a row repeated with the same id is one copy.
    """
    h = _hashed(df, names, list(ordered)).groupBy("root", "s", "id").agg(F.lit(1).alias("one"))
    return h.groupBy("root", "s").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).select("first_id", "copies", "root")


def copies(df: DataFrame, names: list[str] = NAMES, ordered: list[str] = ("duration",)) -> DataFrame:
    """(first_id, copy_id) for every copy but the first of each distinct record.

    Groups are aggregates of one row; rows meet them by digest and full structure. A
    hot group's row is repeated once per salt, so that its copies spread over tasks.
    """
    h = _hashed(df, names, list(ordered))
    groups = h.groupBy("root", "s").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n"))
    groups = stored(groups.filter("first_id < last_id"))
    # A hot digest has more than a MOST-th of all rows, so there are fewer than MOST of them: that is what is broadcast.
    least = max(HOT, df.count() // MOST)
    hot = F.broadcast(groups.groupBy("root").agg(F.sum("n").alias("n")).filter(F.col("n") > least).select("root", F.lit(True).alias("hot")))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    groups = groups.join(hot, "root", "left").select("root", "s", "first_id", F.explode(salts).alias("salt"))
    rows = h.join(hot, "root", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    both = rows.join(groups, ["root", "s", "salt"])
    return both.filter("id <> first_id").select("first_id", F.col("id").alias("copy_id")).distinct()
