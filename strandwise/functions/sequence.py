"""Column functions on nucleotide strings; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BASES, PAIRED, DIGITS = "ACGT", "TGCA", "0123"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def complement(s: str | Column, keep_case: bool = False) -> Column:
    """Each base's partner; N and, if asked, lower case are kept."""
    return F.translate(col(s), "ACGTacgtNn", "TGCAtgcaNn") if keep_case else F.translate(F.upper(col(s)), BASES, PAIRED)


def revcomp(s: str | Column) -> Column:
    return F.reverse(F.translate(col(s), BASES, PAIRED))


def encode(s: str | Column) -> Column:
    """Bases as the digits 0 to 3."""
    return F.translate(F.upper(col(s)), BASES, DIGITS)


def decode(s: str | Column) -> Column:
    return F.translate(col(s), DIGITS, BASES)


def as_number(s: str | Column) -> Column:
    """The base-4 number that up to 31 bases spell."""
    return F.conv(encode(s), 4, 10).cast("long")


def is_valid(s: str | Column) -> Column:
    return F.coalesce(col(s).rlike("^[ACGTacgt]*$"), F.lit(False))


def base_at(s: str | Column, i: int | Column) -> Column:
    """The base at a place counted from 0."""
    return F.substring(col(s), F.lit(i) + 1 if isinstance(i, int) else i + 1, F.lit(1))


def between(s: str | Column, start: int | Column, stop: int | Column) -> Column:
    """The half-open slice, places counted from 0."""
    a = F.lit(start) if isinstance(start, int) else start
    b = F.lit(stop) if isinstance(stop, int) else stop
    return F.substring(col(s), (a + 1).cast("int"), (b - a).cast("int"))


def prefix(s: str | Column, n: int | Column) -> Column:
    return F.left(col(s), F.lit(n) if isinstance(n, int) else n)


def suffix(s: str | Column, n: int | Column) -> Column:
    return F.right(col(s), F.lit(n) if isinstance(n, int) else n)


def sort_key(s: str | Column) -> Column:
    """Orders like the text, but a longer text before its own prefix."""
    return F.concat(col(s), F.lit("~"))


def contains_at(s: str | Column, part: str | Column, offset: int = 0) -> Column:
    p = col(part)
    return F.substring(col(s), F.lit(offset + 1), F.length(p)) == p


def common_prefix(a: str | Column, b: str | Column) -> Column:
    """How many first bases two texts share."""
    x, y = col(a), col(b)
    n = F.least(F.length(x), F.length(y))
    differs = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(x, i, F.lit(1)) != F.substring(y, i, F.lit(1)))
    return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.get(differs, F.lit(0)) - 1, n))


def homopolymer_compressed(s: str | Column) -> Column:
    """Runs of one character become one."""
    return F.regexp_replace(col(s), r"(.)\1+", "$1")


def toggled(read_id: str | Column) -> Column:
    """The name of the other strand: a leading minus comes or goes."""
    x = col(read_id)
    return F.when(x.startswith("-"), F.expr("substring({0}, 2)".format(read_id)) if isinstance(read_id, str) else F.substring(x, F.lit(2), F.length(x))).otherwise(F.concat(F.lit("-"), x))


def pieces(s: str | Column, delimiter: str) -> Column:
    """The parts between delimiters, without the empty ones."""
    import re

    return F.filter(F.split(col(s), re.escape(delimiter)), lambda x: x != "")


def joined(parts: str | Column, delimiter: str = "") -> Column:
    return F.array_join(col(parts), delimiter)


# --- segments: half-open intervals on a sequence -------------------------------


def overlaps(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    return (l1 < r2) & (l2 < r1)


def overlap_size(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(r1, r2) - F.greatest(l1, l2))


def distance(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    """Bases between two segments; 0 if they touch or overlap."""
    return F.greatest(F.lit(0), F.greatest(l1, l2) - F.least(r1, r2))


def mirrored(left: Column, right: Column, length: Column) -> tuple[Column, Column]:
    """The segment on the other strand."""
    return length - right, length - left


def segment_name(name: Column, left: Column, right: Column) -> Column:
    return F.concat(name, F.lit("["), left.cast("string"), F.lit(":"), right.cast("string"), F.lit("]"))


# --- distances ---------------------------------------------------------------


def edit_distance(a: str | Column, b: str | Column) -> Column:
    return F.levenshtein(col(a), col(b))


def best_prefix(a: str | Column, b: str | Column) -> Column:
    """Length of the prefix of b nearest to a by edits; ties: all of b, then the shortest."""
    x, y = col(a), col(b)
    n = F.length(y)
    tried = F.transform(F.sequence(F.lit(0), n), lambda j: F.struct(F.levenshtein(x, F.left(y, j)).alias("d"), (j != n).alias("part"), j.alias("j")))
    return F.array_min(tried)["j"]
