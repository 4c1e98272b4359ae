"""Gzip FASTQ pairs as a Python data source (SRC1-4, SRC9, SET1, SRT1).

    register(spark)
    reads = spark.read.format("fastq_pairs").load("dir1,dir2")

A task reads one pair of files, so mates pair by position and never through a
shuffle; gzip cannot be split, so repartition before joins. Records of four lines are
taken apart as Arrow arrays, a batch at a time. Options:

* ``mode``: FAILFAST (default: broken files raise) or PERMISSIVE (the ``error``
  column says why a pair of files ends early);
* ``maxrecords``: one task reads the files in order and stops after so many records.

Folders that Python cannot open (``hdfs://`` and the like) are read by
:func:`pairs_of_lines`, through Hadoop's file systems; :func:`read_pairs` picks.
"""

from __future__ import annotations

import gzip
import os
import re
from collections.abc import Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..storage import ship
from .lines import TEXT, line_array

SUFFIXES = ("R1_001.fastq.gz", "R2_001.fastq.gz")
SCHEMA = "file_id INT, ordinal BIGINT, read1 STRING, read2 STRING, name1 STRING, comment1 STRING, qual1 STRING, name2 STRING, comment2 STRING, qual2 STRING, error STRING"
TYPES = {c: pa.int32() if c == "file_id" else pa.int64() if c == "ordinal" else pa.string() for c in re.findall(r"(\w+) (?:INT|BIGINT|STRING)", SCHEMA)}
BATCH = 8192


def paired(directory: str, names: list[str]) -> list[tuple[str, str]]:
    """The files with the two suffixes, each sorted, paired by position."""
    one, two = ([f"{directory.rstrip('/')}/{n}" for n in sorted(names) if n.endswith(s)] for s in SUFFIXES)
    if len(one) != len(two):
        raise ValueError(f"{directory} has {len(one)} first and {len(two)} second read files")
    return list(zip(one, two))


def file_pairs(directories: str) -> list[tuple[str, str]]:
    """Pairs of regular files (no links) of all directories."""
    pairs: list[tuple[str, str]] = []
    for directory in (d for d in directories.split(",") if d):
        with os.scandir(directory) as found:
            pairs += paired(directory, [e.name for e in found if e.is_file(follow_symlinks=False)])
    if not pairs:
        raise ValueError(f"no reads in {directories}")
    return pairs


def records(lines: Iterator[str]) -> Iterator[tuple[str, str, str, str]]:
    """(name, comment, sequence, quality) of FASTQ or FASTA text; sequences may run over lines."""
    line = next(lines, "")
    while line:
        line = line.rstrip("\r\n")
        if not line:
            line = next(lines, "")
            continue
        if line[0] not in ">@":
            raise ValueError(f"not a record: {line[:40]}")
        name, _, comment = line[1:].replace("\t", " ").partition(" ")
        seq: list[str] = []
        line = next(lines, "")
        while line and line[0] not in ">@+":
            seq.append(line.strip())
            line = next(lines, "")
        sequence, quality = "".join(seq), ""
        if not sequence:
            raise ValueError(f"empty sequence: {name}")
        if line.startswith("+"):
            while len(quality) < len(sequence):
                line = next(lines, "")
                if not line:
                    raise ValueError(f"truncated quality: {name}")
                quality += line.strip()
            if len(quality) != len(sequence):
                raise ValueError(f"quality and sequence differ in length: {name}")
            line = next(lines, "")
        yield name, comment, sequence, quality


#: Name, comment, sequence and quality of some records, as four lists.
Columns = tuple[list[str], list[str], list[str], list[str]]


def batches(lines: Iterator[str], size: int = BATCH) -> Iterator[Columns]:
    """The records of ``lines``, ``size`` at a time.

    Lines in fours are sliced; from the first batch on that has any other form, records are read one by one.
    """
    while block := list(islice(lines, 4 * size)):
        heads, seqs, quals = block[0::4], [x.strip() for x in block[1::4]], [x.strip() for x in block[3::4]]
        plain = len(block) % 4 == 0 and all(x[0] == "@" for x in heads) and all(x[0] == "+" for x in block[2::4])
        if not (plain and all(seqs) and list(map(len, seqs)) == list(map(len, quals)) and all(x[0] not in ">@+" for x in seqs)):
            rest = records(chain(block, lines))
            while some := list(islice(rest, size)):
                yield tuple(map(list, zip(*some)))
            return
        parts = [x.rstrip("\r\n")[1:].replace("\t", " ").partition(" ") for x in heads]
        yield [p[0] for p in parts], [p[2] for p in parts], seqs, quals


def plain_columns(block: pa.Array) -> list[pa.Array] | None:
    """Name, comment, sequence and quality of lines in fours of printable ASCII and tabs; None for lines of any other form."""
    n, at = len(block) // 4, block.offset
    bounds = np.frombuffer(block.buffers()[1], np.int32)[at : at + len(block) + 1]
    data = np.frombuffer(block.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    tabs = bool((data < 32).any())
    if len(block) % 4 or (len(data) and data.max() > 126) or (tabs and ((data < 32) & (data != 9)).any()):
        return None
    heads, seqs, marks, quals = (block.take(pa.array(np.arange(k, len(block), 4))) for k in range(4))
    seqs, quals = (pc.ascii_trim(x, " \t") for x in (seqs, quals))
    lengths = pc.binary_length(seqs)
    fit = [pc.starts_with(heads, "@"), pc.starts_with(marks, "+"), pc.greater(lengths, 0), pc.equal(lengths, pc.binary_length(quals))]
    if not all(pc.all(x).as_py() for x in fit) or any(pc.any(pc.starts_with(seqs, x)).as_py() for x in ">@+"):
        return None
    if tabs:
        heads = pc.replace_substring(heads, "\t", " ")
    # a head is its mark, the name, a space and the comment
    bounds = np.frombuffer(heads.buffers()[1], np.int32)[: n + 1]
    space, cuts = pc.find_substring(heads, " ").to_numpy(), np.empty(4 * n + 1, np.int32)
    cuts[0::4], cuts[1::4] = bounds, bounds[:-1] + 1
    cuts[2::4] = np.where(space < 0, bounds[1:], bounds[:-1] + space)
    cuts[3::4] = np.minimum(cuts[2::4] + 1, bounds[1:])
    pieces = pa.StringArray.from_buffers(4 * n, pa.py_buffer(cuts), heads.buffers()[2])
    names, comments = (pieces.take(pa.array(np.arange(k, 4 * n, 4))) for k in (1, 3))
    return [names, comments, seqs, quals]


def array_batches(arrays: Iterator[pa.Array], size: int = BATCH) -> Iterator[list[pa.Array]]:
    """As :func:`batches`, of lines in arrays; from the first batch on that is not plain, lines are read one by one."""

    def one_by_one(first: pa.Array) -> Iterator[list[pa.Array]]:
        lines = (line + "\n" for some in chain([first], arrays) for line in some.to_pylist())
        for columns in batches(lines, size):
            yield [pa.array(c, pa.string()) for c in columns]

    arrays, held, have = iter(arrays), [], 0
    for some in arrays:
        held.append(some)
        have += len(some)
        if have < 4 * size:
            continue
        every, at = pa.concat_arrays(held), 0
        while have - at >= 4 * size:
            if (columns := plain_columns(every[at : at + 4 * size])) is None:
                yield from one_by_one(every[at:])
                return
            yield columns
            at += 4 * size
        held, have = [every[at:]], have - at
    if have:
        every = pa.concat_arrays(held)
        columns = plain_columns(every)
        yield from one_by_one(every) if columns is None else [columns]


def file_arrays(file) -> Iterator[pa.Array]:
    """The lines of a text file; of a broken one, those before the break, and then what is wrong."""
    held, size, problem, more = [], 0, None, True
    while more:
        try:
            text = file.read(1 << 16)
        except (ValueError, OSError, EOFError) as found:
            text, problem = "", found
        held.append(text)
        size, more = size + len(text), bool(text)
        if size >= TEXT or not more:
            whole = "".join(held)
            cut = len(whole) if not more and not problem else whole.rfind("\n") + 1
            if cut:
                yield line_array(whole[:cut].encode())
            held, size = [whole[cut:]], len(whole) - cut
    if problem:
        raise problem


class FilePair(InputPartition):
    """Pairs of files (number, first, second) that one task reads, and how many records at most."""

    def __init__(self, pairs: list[tuple[int, str, str]], most: int | None = None):
        super().__init__((pairs, most))


class PairReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.names
        self.pairs = file_pairs(options["path"])
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.most = int(options["maxrecords"]) if "maxrecords" in options else None

    def partitions(self) -> list[InputPartition]:
        numbered = [(i, a, b) for i, (a, b) in enumerate(self.pairs)]
        return [FilePair([p]) for p in numbered] if self.most is None else [FilePair(numbered, self.most)]

    def _batch(self, n: int, values: dict) -> pa.RecordBatch:
        return pa.record_batch([(x if isinstance(x := values[c], pa.Array) else pa.array(x, TYPES[c])) if c in values else pa.nulls(n, TYPES[c]) for c in self.columns], names=self.columns)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        pairs, most = partition.value
        for file_id, one, two in pairs:
            if most == 0:
                return
            ordinal = 0
            try:
                with gzip.open(one, "rt") as a, gzip.open(two, "rt") as b:
                    size = BATCH if most is None else min(BATCH, most)
                    left, right = array_batches(file_arrays(a), size), array_batches(file_arrays(b), size)
                    while True:
                        x, y = next(left, None), next(right, None)
                        n = min(len(x[0]) if x else 0, len(y[0]) if y else 0)
                        take = n if most is None else min(n, most)
                        if take:
                            values = {"file_id": np.full(take, file_id), "ordinal": np.arange(ordinal, ordinal + take)}
                            for mate, got in (("1", x), ("2", y)):
                                values |= {f"{name}{mate}": got[i][:take] for i, name in enumerate(("name", "comment", "read", "qual"))}
                            yield self._batch(take, values)
                            ordinal += take
                            most = None if most is None else most - take
                            if most == 0:
                                break
                        if (len(x[0]) if x else 0) != (len(y[0]) if y else 0):
                            raise ValueError(f"{one} and {two} differ in their number of records")
                        if x is None:
                            break
            except (ValueError, OSError, EOFError) as problem:
                if not self.permissive:
                    raise ValueError(f"{one}, {two}: {problem}") from problem
                yield self._batch(1, {"file_id": [file_id], "ordinal": [ordinal], "error": [str(problem)]})


class FastqPairs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq_pairs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PairReader(schema, self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(FastqPairs)


def remote_pairs(spark: SparkSession, directories: str) -> list[list[tuple[str, str]]]:
    """As :func:`file_pairs`, folder by folder, through Hadoop's file systems."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    pairs: list[list[tuple[str, str]]] = []
    for directory in (d for d in directories.split(",") if d):
        where = hadoop.Path(directory)
        found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
        own = paired(directory, [f.getPath().getName() for f in found if f.isFile()])
        pairs += [own] if own else []
    if not pairs:
        raise ValueError(f"no reads in {directories}")
    return pairs


#: Columns of a chunk, as arrays of up to BATCH records.
FIELDS = ("name", "comment", "read", "qual")


def _chunks(spark: SparkSession, files: list[str], mate: str) -> DataFrame:
    """(file_id, chunk, and an array of each field) of one folder's files, ``BATCH`` records a row; Spark gives a gzip file to one task, in order."""
    numbers = {name.rsplit("/", 1)[-1]: i for i, name in enumerate(files)}
    columns = ["file_id", "chunk", *(f"{c}{mate}" for c in FIELDS)]

    def by_file(arrived: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
        for batch in arrived:
            files, lines, at = batch.column(0), batch.column(1).cast(pa.string()), 0
            if not len(lines):
                continue
            # a file's lines come together: unless a batch begins and ends in one file, it is looked through
            runs = [(files[0].as_py(), len(lines))] if files[0] == files[-1] else [(k, len(list(g))) for k, g in groupby(files.to_pylist())]
            for name, n in runs:
                yield name, lines[at : at + n]
                at += n

    def cut(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, own in groupby(by_file(arrived), lambda x: x[0]):
            for chunk, values in enumerate(array_batches(x for _, x in own)):
                whole = pa.array([0, len(values[0])], pa.int32())
                yield pa.record_batch([pa.array([numbers[name]], pa.int32()), pa.array([chunk]), *(pa.ListArray.from_arrays(whole, x) for x in values)], names=columns)

    text = spark.read.text(files).select(F.col("_metadata.file_name").alias("file"), "value")
    return text.mapInArrow(cut, ", ".join(("file_id int", "chunk long", *(f"{c}{mate} array<string>" for c in FIELDS))))


def _opened(both: DataFrame, places: Column) -> DataFrame:
    """The records of chunks whose mates have met, as many as the array ``places`` has; only wanted arrays are kept that far."""
    rows = both.select("*", F.posexplode(places).alias("place", "at"))
    fields = [F.get(f"{c}{mate}", F.col("place")).alias(f"{c}{mate}") for mate in "12" for c in FIELDS]
    return rows.select("file_id", (F.col("chunk") * BATCH + F.col("place")).alias("ordinal"), *fields)


def pairs_of_lines(spark: SparkSession, directories: str) -> DataFrame:
    """The columns of ``fastq_pairs`` but ``error``, from any file system that Spark reads.

    Each mate's files are read by Spark's text reader; mates meet by file and chunk of
    ``BATCH`` records in a shuffle, so what is sorted grows with the chunks, and no key
    can skew it. A pair of files of unlike length raises.
    """
    ship(spark)
    lacking = F.raise_error(F.concat(F.lit("files differ in their number of records: "), F.col("file_id").cast("string"))).cast("array<string>")
    every, first = None, 0
    for pairs in remote_pairs(spark, directories):
        one, two = (_chunks(spark, list(files), mate) for files, mate in zip(zip(*pairs), "12"))
        both = one.join(two, ["file_id", "chunk"], "full").withColumn("file_id", F.col("file_id") + first)
        own = _opened(both, F.when(F.size("read1") == F.size("read2"), F.col("read1")).otherwise(lacking))
        every, first = own if every is None else every.union(own), first + len(pairs)
    return every


def local(directories: str) -> bool:
    return not any(re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", d) for d in directories.split(","))


def read_pairs(spark: SparkSession, directories: str, most: int | None = None) -> DataFrame:
    """The pairs of all directories, by path or by address; with ``most``, the first so many in file order."""
    if local(directories):
        register(spark)
        reader = spark.read.format("fastq_pairs")
        return (reader if most is None else reader.option("maxrecords", most)).load(directories)
    if most is None:
        return pairs_of_lines(spark, directories)
    # one pair of files at a time, until there are enough
    got, left = None, most
    for number, (one, two) in enumerate(chain.from_iterable(remote_pairs(spark, directories))):
        sides = [_chunks(spark, [f], mate).limit(-(-left // BATCH)) for f, mate in ((one, "1"), (two, "2"))]
        own = _opened(sides[0].join(sides[1], ["file_id", "chunk"]), F.slice("read1", F.lit(1), F.least(F.size("read1"), F.size("read2")))).where(F.col("ordinal") < left).withColumn("file_id", F.lit(number))
        got, left = own if got is None else got.union(own), left - own.count()
        if left <= 0:
            break
    return got
