"""Exact dedup by an extendible-hash index on shared files, in DataFrame operations only.

Two texts are equal if their bytes are, once each run of the six ASCII white-space
bytes is one space; null counts as empty. The index is built in four steps, the same
at every size:

1. every row becomes an entry (its id, 64-bit key, SHA-256) in a shared table;
2. texts whose key occurs more than once are compared byte by byte: a bitmap filter of
   those keys, of bounded size, passes their texts and few others, and rows with equal
   bytes meet in one slot, combined on the map side first, so a group of copies of any
   size moves one row a task. Each slot has its bytes' digest, its number of rows and
   its smallest id; a text whose key occurs once is a slot of one row;
3. the directory doubles until no bucket holds more than ``capacity`` slots, or
   its depth is ``max_depth``: counts of all prefixes of the keys, made from one count
   of the longest ones, give each bucket's depth at once. Tasks own ranges of buckets,
   and number the slots that collide on a key into a chain;
4. entries look up their slot in the index by key and digest; it says which id stays.

Of equal rows the one with the smallest id stays; a null id counts as largest, and
of rows with the same id and text just one stays. An empty table gives an empty one.
Texts of any length are compared as a whole. Other columns are not touched and may
have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import one_of_each, possibly, release, stored, without

SPACES = r"[\x20\x09-\x0D]+"
#: Doublings of the directory at most: its cells are counted and broadcast.
DEEPEST = 20
#: Slots that are broadcast at most: no more can have over a ten-thousandth of all rows each.
HOT = 10_000


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def key_of(text: Column, hash_bits: int) -> Column:
    key = F.xxhash64(text)
    return key if hash_bits == 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - hash_bits), 64 - hash_bits)


def _id() -> Column:
    """An id in its order, null last."""
    return F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"))


def entries(documents: DataFrame, hash_bits: int = 64) -> DataFrame:
    """Step 1: a row per document with a number of its own (``row_no``); written, as that number is not stable."""
    own = documents.select("doc_id", F.xxhash64("text").alias("text_key"), normalised(F.col("text")).alias("body"))
    table = own.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "text_key", key_of(F.col("body"), hash_bits).alias("key"), F.sha2("body", 256).alias("sha"))
    return stored(table, "exact-entries")


def slots(documents: DataFrame, table: DataFrame, hash_bits: int = 64) -> DataFrame:
    """Step 2: (key, sha, rows, first, first_row) of each distinct text: its smallest id, and of the rows with that the first."""
    count = table.groupBy("key").agg(F.count("*").alias("n"), F.min("sha").alias("sha"), F.min(_id()).alias("first"), F.min("row_no").alias("first_row"))
    count = stored(count, "exact-keys")
    repeated = stored(count.where("n > 1").select("key"), "exact-repeated")
    texts = documents.select("doc_id", normalised(F.col("text")).alias("body")).withColumn("key", key_of(F.col("body"), hash_bits))
    texts = possibly(texts, F.col("key"), repeated)
    same = texts.groupBy("key", "body").agg(F.count("*").alias("rows"), F.min(_id()).alias("first"))
    same = same.select("key", F.sha2("body", 256).alias("sha"), "rows", "first").join(repeated, "key", "left_semi")
    rows = possibly(table, F.col("key"), repeated).groupBy("key", "sha").agg(F.min(F.struct(_id().alias("id"), "row_no")).alias("least"))
    same = same.join(rows, ["key", "sha"]).select("key", "sha", "rows", "first", F.col("least.row_no").alias("first_row"))
    return count.where("n = 1").select("key", "sha", F.lit(1).cast("long").alias("rows"), "first", "first_row").union(same)


def prefix(key: Column, depth: Column | int) -> Column:
    """The first ``depth`` bits of a key."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", key, 64 - depth))


def directory(table: DataFrame, capacity: int, max_depth: int) -> tuple[DataFrame, int]:
    """(cell, depth) for each of the 2**deepest prefixes that occur: the depth of the bucket that it points to; and deepest.

    A bucket of one key alone does not split.
    """
    slots_, deepest = table.count(), 0
    while deepest < min(max_depth, DEEPEST) and slots_ > capacity << max(0, deepest - 3):
        deepest += 1
    cells = table.groupBy(prefix(F.col("key"), deepest).alias("cell")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    cells = stored(cells, "exact-cells")
    every = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("depth"))
    every = every.withColumn("bucket", F.call_function("shiftright", F.col("cell"), F.lit(deepest) - F.col("depth")))
    fits = every.groupBy("depth", "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    fits = fits.where((F.col("n") <= capacity) | (F.col("low") == F.col("high")) | (F.col("depth") == deepest)).select("depth", "bucket")
    return every.join(fits, ["depth", "bucket"]).groupBy("cell").agg(F.min("depth").alias("depth")), deepest


def index(table: DataFrame, capacity: int = 4096, max_depth: int = DEEPEST) -> DataFrame:
    """Step 3: each slot with its bucket (first key and depth) and its place in the key's chain."""
    table = stored(table, "exact-slots")
    found, deepest = directory(table, capacity, max_depth)
    placed = table.withColumn("cell", prefix(F.col("key"), deepest)).join(F.broadcast(stored(found, "exact-directory")), "cell")
    lowest = F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", prefix(F.col("key"), F.col("depth")), 64 - F.col("depth")))
    owned = placed.withColumn("lowest", lowest).repartitionByRange("lowest", "depth", "key").sortWithinPartitions("lowest", "depth", "key", "sha")
    chain = Window.partitionBy("lowest", "depth", "key").orderBy("sha")
    twice = F.raise_error(F.lit("different texts share a SHA-256")).cast("int")
    place = F.when(F.lag("sha").over(chain) == F.col("sha"), twice).otherwise(F.row_number().over(chain))
    owned = stored(owned.select("key", "sha", "rows", "first", "first_row", "lowest", "depth", place.alias("place")), "exact-index")
    release(table)
    return owned


def looked_up(table: DataFrame, known: DataFrame) -> DataFrame:
    """Step 4: entries with their slots; those of the largest slots, ``HOT`` at most, without a shuffle."""
    least = max(100, table.count() // HOT)
    hot = F.broadcast(known.where(F.col("rows") > least))
    rest = table.join(hot, ["key", "sha"], "left_anti").join(known.where(F.col("rows") <= least), ["key", "sha"])
    return table.join(hot, ["key", "sha"]).unionByName(rest)


def groups(documents: DataFrame, hash_bits: int = 64, capacity: int = 4096) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, row_no, text_key (a hash of the text as it is)."""
    table = entries(documents, hash_bits)
    known = index(slots(documents, table, hash_bits), capacity)
    found = stored(looked_up(table, known.select("key", "sha", "rows", F.col("first.id").alias("keep_id"), "first_row")), "exact-found")
    release(known)
    release(table)
    kept = F.col("row_no") == F.col("first_row")
    return found.select("doc_id", "keep_id", F.col("rows").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"), "row_no", "text_key")


def deduplicated(documents: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns.

    Rows are found again by id and a hash of the text as it is; only those that may go
    are shuffled.
    """
    found = stored(groups(documents), "exact-groups")
    lost = found.groupBy("doc_id", F.col("text_key").alias("key")).agg(F.bool_or("kept").alias("stays")).where(~F.col("stays"))
    left = without(documents, lost.select("doc_id", "key"), F.xxhash64("text"))
    return one_of_each(left, found.select("doc_id", F.col("text_key").alias("key")), F.xxhash64("text"))
