"""FASTQ writing, as gzip or BGZF (SNK6-8)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import fastq_text
from ..storage import new_path, remove, ship

BLOCK = 0xFF00
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Fixed value: the empty block that ends a BGZF file.
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: What each block begins with; two bytes of its size follow.
BLOCK_HEAD = LAST_BLOCK[:16]


def bgzf_block(data: bytes, level: int = 6) -> bytes:
    """One BGZF block: a gzip member whose extra field holds its own size."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def bgzf(chunks: Iterator[bytes], level: int = 6) -> Iterator[bytes]:
    """Text in blocks of at most ``BLOCK`` bytes, and the last, empty block."""
    rest = b""
    for chunk in chunks:
        rest += chunk
        whole = len(rest) - len(rest) % BLOCK
        for at in range(0, whole, BLOCK):
            yield bgzf_block(rest[at : at + BLOCK], level)
        rest = rest[whole:]
    if rest:
        yield bgzf_block(rest, level)
    yield LAST_BLOCK


def part_number(file) -> int:
    """The task that wrote a file of Spark's writers."""
    return int(file.getName().split("-")[1].split(".")[0])


def _line(read: Column) -> Column:
    """A record without its last line end, as the writer ends each row."""
    return F.rtrim(fastq_text(read), F.lit("\n"))


def write_gzip(reads: DataFrame, path: str, column: str = "read") -> None:
    """A column of read structs as gzip FASTQ, a file per task."""
    text = reads.select(_line(reads[column]).alias("value"))
    text.write.mode("overwrite").option("compression", "gzip").option("lineSep", "\n").text(path)


def write_pairs(reads: DataFrame, folder: str, sample: str = "reads") -> None:
    """Mates (structs ``read1`` and ``read2``) as pairs of gzip files that :mod:`tagweft.sources.fastq` finds, one pair a task.

    A task writes both mates' files of its rows side by side, so they have one order and
    no row is stored or made twice. Spark sorts by mate once a task has as many writers
    as it is allowed, so it is allowed three for two. Files get their names through Hadoop's file system.
    """
    spark = reads.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = place(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    both = reads.select(F.inline(F.array(*(F.struct(F.lit(mate).alias("mate"), _line(reads[f"read{mate}"]).alias("value")) for mate in "12"))))
    own, halves = spark.conf.get(WRITERS, None), f"{folder}/_mates"
    spark.conf.set(WRITERS, "3")
    try:
        both.write.partitionBy("mate").mode("overwrite").option("compression", "gzip").option("lineSep", "\n").text(halves)
    finally:
        spark.conf.set(WRITERS, own) if own is not None else spark.conf.unset(WRITERS)
    for mate in "12":
        half = f"{halves}/mate={mate}"
        if not system.exists(place(half)):  # no rows: a pair of empty files
            write_gzip(reads.limit(0), half, f"read{mate}")
        for file in system.listStatus(place(half)):
            if file.getPath().getName().startswith("part-"):
                system.rename(file.getPath(), place(f"{folder}/{sample}_{part_number(file.getPath()):05d}_R{mate}_001.fastq.gz"))
    remove(spark, halves)


def bgzf_parts(reads: DataFrame, column: str = "read") -> DataFrame:
    """(part, block, data): BGZF blocks made task by task; end to end, in order, and with ``LAST_BLOCK``, they are one file."""
    ship(reads.sparkSession)
    text = reads.select(fastq_text(reads[column]).alias("value"))

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for block in bgzf("".join(b.column(0).to_pylist()).encode() for b in batches):
            if block != LAST_BLOCK:
                yield pa.record_batch([pa.array([part]), pa.array([n]), pa.array([block])], names=["part", "block", "data"])
                n += 1

    return text.mapInArrow(pack, "part long, block long, data binary")


def write_bgzf(reads: DataFrame, path: str, column: str = "read") -> None:
    """All reads as one BGZF file, in the order of the rows' parts.

    Tasks compress and write: a row of their text files is a block without its fixed
    head, and that head is the line separator, so it comes before the next block. The
    driver's JVM only puts the files end to end, through Hadoop's file system.
    """
    spark = reads.sparkSession
    jvm, hadoop = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    folder, where = jvm.fs.Path(new_path(spark, "bgzf")), jvm.fs.Path(path)
    tails = bgzf_parts(reads, column).select(F.expr(f"substring(data, {len(BLOCK_HEAD) + 1})").cast("string").alias("value"))
    tails.write.options(lineSep=BLOCK_HEAD.decode("latin-1"), encoding="ISO-8859-1", compression="none").text(folder.toString())
    system = folder.getFileSystem(hadoop)
    files = [f.getPath() for f in system.listStatus(folder) if f.getPath().getName().startswith("part-")]
    out = where.getFileSystem(hadoop).create(where)
    try:
        out.write(BLOCK_HEAD)
        for file in sorted(files, key=part_number):
            part = system.open(file)
            try:
                jvm.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
        out.write(LAST_BLOCK[len(BLOCK_HEAD) :])
    finally:
        out.close()
    remove(spark, folder.toString())
