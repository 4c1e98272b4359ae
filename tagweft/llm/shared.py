"""Shared tables (see :mod:`tagweft.storage`), private column names, and rows that stay of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..storage import new_path, release, remove, shared_folder, stored

__all__ = ["bounded", "first_of_groups", "new_path", "private", "release", "remove", "shared_folder", "ship", "stored"]

#: Rows of a few numbers each that are broadcast at most.
BROADCAST = 1_000_000
#: Rows of an Arrow batch, where the session has Spark's own number: texts are long, and a worker holds a few batches.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, and keep their batches small."""
    storage.ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def private(frame: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``frame`` has, whatever the case of its letters."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def bounded(small: DataFrame, most: int | None = None) -> DataFrame:
    """A stored table that is broadcast, or shuffled if it has more than ``most`` rows (``BROADCAST``)."""
    return F.broadcast(small) if small.count() <= (BROADCAST if most is None else most) else small


#: Places of a bitmap filter are a power of two between these; the most take 64 MB.
LEAST_BITS, MOST_BITS = 18, 29
_CELL = 32_768  # fixed value: places of one of Spark's bitmaps


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits)) + 1


def flagged(frame: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """``frame`` with a column that is true where ``key`` may be in ``keys`` (one stored column): for all that are, and for few others.

    Keys are broadcast as bitmaps over hashed places, so ``frame`` is not shuffled, and
    the broadcast takes 64 MB at most, whatever the number of keys; with very many keys
    more other rows are flagged.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * keys.count()).bit_length()))
    place = _place(keys[keys.columns[0]], bits)
    cell, at, bitmap = private(frame, "filter_cell", "filter_at", "filter_bitmap")
    maps = keys.groupBy(F.bitmap_bucket_number(place).alias(cell)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(bitmap))
    place = _place(key, bits)
    rows = frame.withColumns({cell: F.bitmap_bucket_number(place), at: F.bitmap_bit_position(place)}).join(F.broadcast(stored(maps, "filter")), cell, "left")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, F.pmod(F.col(at), F.lit(8)).cast("int")).bitwiseAND(F.lit(1))
    return rows.select(*frame.columns, F.coalesce(bit == 1, F.lit(False)).alias(name))


def possibly(frame: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Rows of ``frame`` whose ``key`` may be in ``keys``."""
    (name,) = private(frame, "may_be")
    return flagged(frame, key, keys, name).where(F.col(name)).drop(name)


def without(documents: DataFrame, lost: DataFrame, key: Column) -> DataFrame:
    """``documents`` but for the rows whose id and ``key`` are in ``lost`` (doc_id, key); only rows that may be are shuffled."""
    may, own_key, lost_id, lost_key = private(documents, "may_be", "text_key", "lost_id", "lost_key")
    lost = stored(lost.select(F.col("doc_id").alias(lost_id), F.col("key").alias(lost_key), F.xxhash64("doc_id", "key").alias("both")), "lost")
    rows = flagged(documents.withColumn(own_key, key), F.xxhash64("doc_id", own_key), lost.select("both"), may)
    gone = F.col("doc_id").eqNullSafe(F.col(lost_id)) & (F.col(own_key) == F.col(lost_key))
    left = rows.where(F.col(may)).join(lost.drop("both"), gone, "left_anti")
    return rows.where(~F.col(may)).select(documents.columns).union(left.select(documents.columns))


def first_of_groups(documents: DataFrame, named: DataFrame, key: Column) -> DataFrame:
    """``documents`` with one row of each group: that with the smallest id, null last, and of several that with the smallest key.

    ``named`` has (root, doc_id, key) of every row; ``key`` is a number made from the
    text, by which rows are found again. Of rows with the same id and text one stays.
    """
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    rows = named.select("root", own.alias("own"))
    first = rows.groupBy("root").agg(F.min("own").alias("first"))
    lost = rows.join(first, "root").where("own <> first").select("own.doc_id", "own.key").distinct()
    return one_of_each(without(documents, lost, key), named.select("doc_id", "key"), key)


def one_of_each(documents: DataFrame, known: DataFrame, key: Column) -> DataFrame:
    """``documents`` with one of the rows that share id and ``key``; ``known`` has (doc_id, key) of all of them, and more."""
    twins = stored(known.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("doc_id", "key").alias("both")), "twins")
    if twins.isEmpty():
        return documents
    may, own_key = private(documents, "may_be", "text_key")
    rows = flagged(documents.withColumn(own_key, key), F.xxhash64("doc_id", own_key), twins, may)
    once = rows.where(F.col(may)).dropDuplicates(["doc_id", own_key])
    return rows.where(~F.col(may)).select(documents.columns).union(once.select(documents.columns))
