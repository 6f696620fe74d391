"""Scalar functions over residue strings, as native expressions.

Null sequences give null everywhere; empty ones are sequences of length 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The residue alphabet in the order of its codes 0 to 25.
ALPHABET = "ARNDCQEGHILKMFPSTWYVXUOBZJ"
UNKNOWN = ALPHABET.index("X")


def strip_upper(seq: Column) -> Column:
    """Without surrounding white space, in upper case (ß becomes SS)."""
    return F.upper(F.regexp_replace(seq, r"(?U)^\s+|\s+$", ""))


def header_id(line: Column) -> Column:
    """The first word after '>' of a header line; null if there is none."""
    found = F.regexp_extract(line, r"(?U)^>\s*(\S+)", 1)
    return F.when(found != "", found)


def clean(seq: Column) -> Column:
    """Only the characters of the alphabet; expects upper case."""
    return F.regexp_replace(seq, "[^A-Z]", "")


def is_valid(seq: Column, characters: str = ALPHABET) -> Column:
    """Whether all characters are among ``characters``; true of an empty sequence."""
    return F.translate(seq, characters, "") == ""


def length_between(seq: Column, low: int = 0, high: int | None = None) -> Column:
    size = F.length(seq)
    return size >= low if high is None else size.between(low, high)


def encode(seq: Column, max_len: int | None = None) -> Column:
    """Codes of the residues as array<tinyint>, unknown ones as X; with ``max_len`` cut or padded with X to it."""
    if max_len is not None:
        seq = F.rpad(F.substring(seq, 1, max_len), max_len, "X") if max_len else F.when(seq.isNotNull(), F.lit(""))
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    # a constant table by character code; what is beyond it is unknown too
    table = F.array(*[F.lit(ALPHABET.index(chr(i)) if chr(i) in ALPHABET else UNKNOWN).cast("tinyint") for i in range(128)])
    return F.transform(letters, lambda c: F.coalesce(F.get(table, F.ascii(c)), F.lit(UNKNOWN).cast("tinyint")))


def decode(codes: Column) -> Column:
    """Residues of codes; unknown codes are X, and padding stays."""
    letter = lambda i: F.when(i.between(0, len(ALPHABET) - 1), F.substring(F.lit(ALPHABET), i.cast("int") + 1, F.lit(1))).otherwise("X")
    return F.array_join(F.transform(codes, letter), "")


def wrap(seq: Column, width: int = 80) -> Column:
    """Lines of ``width`` characters."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
