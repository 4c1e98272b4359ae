"""Column functions on barcodes and reads. Barcodes stay strings over A, C, G, T, N."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters in the order of their 3-bit codes.
ALPHABET = "ACGTN"
MAX_CODED = 21

#: What 10x matrices call a feature type.
TYPE_LABELS = {"crispr": "CRISPR Guide Capture", "hashing": "Multiplexing Capture", "citeseq": "Antibody Capture", "antibody": "Antibody Capture"}


def strict_substr(text: Column, start: int | Column, length: int | Column) -> Column:
    """PRJ1: ``length`` characters from 0-based ``start``; raises if the text is too short."""
    start, length = (F.lit(x) if isinstance(x, int) else x for x in (start, length))
    short = F.concat(F.lit("read too short: "), F.coalesce(text, F.lit("null")))
    return F.when(F.length(text) >= start + length, F.substring(text, start + 1, length)).otherwise(F.raise_error(short).cast("string"))


def trim_space(text: Column) -> Column:
    """SCL3: without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def encode(barcode: Column) -> Column:
    """SCL1: a BIGINT with three bits per base, the first base lowest; null for other letters or over 21 bases."""
    codes = F.transform(F.split(F.upper(barcode), ""), lambda c: (F.instr(F.lit(ALPHABET), c) - 1).cast("bigint"))
    value = F.aggregate(F.reverse(codes), F.lit(0).cast("bigint"), lambda a, c: F.shiftleft(a, 3).bitwiseOR(c))
    return F.when(barcode.rlike(f"^[ACGTNacgtn]{{1,{MAX_CODED}}}$"), value)


def decode(code: Column, length: int | Column) -> Column:
    """SCL2: the barcode of a code, in upper case."""
    length = F.lit(length) if isinstance(length, int) else length

    def letter(place: Column) -> Column:
        digit = F.call_function("shiftright", code, (place * 3).cast("int")).bitwiseAND(F.lit(7).cast("bigint"))
        return F.substring(F.lit(ALPHABET), (digit + 1).cast("int"), F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), length - 1), letter), "")


def reverse_complement(barcode: Column) -> Column:
    """SCL6."""
    return F.reverse(F.translate(barcode, "ACGTN", "TGCAN"))


def hamming(a: Column, b: Column) -> Column:
    """SCL4: number of places that differ, for strings of one length."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda n, x: n + x)


def wildcard(barcode: Column, place: Column) -> Column:
    """SCL5: the barcode with its 1-based ``place`` starred out."""
    return F.concat(F.substring(barcode, F.lit(1), place - 1), F.lit("*"), F.substring(barcode, place + 1, F.length(barcode)))


def wildcards(barcode: Column, length: int, n: int) -> Column:
    """All strings with ``n`` of ``length`` places starred out; two barcodes share one iff they differ in ``n`` places at most."""
    out = []
    for places in combinations(range(length), n):
        edges = [-1, *places, length]
        parts = [F.substring(barcode, a + 2, b - a - 1) for a, b in zip(edges[:-1], edges[1:])]
        out.append(F.concat_ws("*", *parts))
    return F.array(*out)


def type_label(kind: Column) -> Column:
    """SCL8."""
    out = F.lit("Custom")
    for name, label in TYPE_LABELS.items():
        out = F.when(kind == name, label).otherwise(out)
    return out


def fastq_text(read: Column) -> Column:
    """SCL7: a read struct as FASTQ, or FASTA where it has no qualities."""
    head = F.concat_ws(" ", read["name"], F.nullif(F.coalesce(read["comment"], F.lit("")), F.lit("")))
    quality = F.coalesce(read["qual"], F.lit(""))
    return F.when(quality == "", F.concat(F.lit(">"), head, F.lit("\n"), read["seq"], F.lit("\n"))).otherwise(F.concat(F.lit("@"), head, F.lit("\n"), read["seq"], F.lit("\n+\n"), quality, F.lit("\n")))


def percent(part: Column, whole: Column) -> Column:
    """SCL9: a percentage with two decimals; null if the whole is zero."""
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), 2)
