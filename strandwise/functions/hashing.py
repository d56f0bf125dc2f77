"""The polynomial hash of k-mers modulo 2^128, exact and printed in decimal.

A hash is a column of two unsigned 64-bit halves kept as signed longs; the
decimal text is made only where it is shown.  The hash of 0 (all A) prints as
an empty text, as files in the field expect.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from .sequence import col, encode, revcomp

BASE = 239
MOD = 1 << 128
#: Up to this k no hash wraps, all fit DECIMAL(38), and hash order is text order.
EXACT_K = 15


def power(p: int, base: int = BASE) -> int:
    return pow(base, p, MOD)


def inverse(base: int = BASE) -> int:
    return pow(base, -1, MOD)


def python_hash(text: str, base: int = BASE) -> int:
    h = 0
    for c in text:
        h = (h * base + "ACGT".index(c)) % MOD
    return h


def extend_right(h: int, c: str, base: int = BASE) -> int:
    return (h * base + "ACGT".index(c)) % MOD


def extend_left(h: int, c: str, k: int, base: int = BASE) -> int:
    return (h + "ACGT".index(c) * power(k, base)) % MOD


def shift_right(h: int, gone: str, come: str, k: int, base: int = BASE) -> int:
    return ((h - "ACGT".index(gone) * power(k - 1, base)) * base + "ACGT".index(come)) % MOD


def shift_left(h: int, gone: str, come: str, k: int, base: int = BASE) -> int:
    return ((h - "ACGT".index(gone)) * inverse(base) + "ACGT".index(come) * power(k - 1, base)) % MOD


def decimal_hash(s: str | Column, base: int = BASE) -> Column:
    """DECIMAL(38, 0); for k up to EXACT_K."""
    digits = F.transform(F.split(encode(s), ""), lambda x: x.cast("decimal(38,0)"))
    return F.aggregate(digits, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a * F.lit(base).cast("decimal(5,0)") + x).cast("decimal(38,0)"))


def limb_hash(s: str | Column, base: int = BASE) -> Column:
    """Four 32-bit limbs, least first, by built-in expressions; for any k."""
    zero = F.array(*[F.lit(0).cast("long")] * 4)
    low = F.lit(0xFFFFFFFF).cast("long")

    def step(a: Column, x: Column) -> Column:
        t0 = a[0] * base + x
        t1 = a[1] * base + F.shiftright(t0, 32)
        t2 = a[2] * base + F.shiftright(t1, 32)
        t3 = a[3] * base + F.shiftright(t2, 32)
        return F.array(t0.bitwiseAND(low), t1.bitwiseAND(low), t2.bitwiseAND(low), t3.bitwiseAND(low))

    return F.aggregate(F.transform(F.split(encode(s), ""), lambda x: x.cast("long")), zero, step)


def hash_text(s: str | Column, base: int = BASE) -> Column:
    """The hash as a decimal number; an Arrow batch at a time, for vertices rather than for all k-mers."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        digit = {c: i for i, c in enumerate("ACGT")}
        for texts in parts:
            out = []
            for text in texts:
                h = 0
                for c in text or "":
                    h = h * base + digit[c]
                out.append(None if text is None else str(h % MOD))
            yield pd.Series(out, dtype=object)

    return run(col(s))


def shown(decimal: Column) -> Column:
    return F.when(decimal == "0", "").otherwise(decimal)


def order_key(decimal: Column) -> Column:
    """Decimal texts in numeric order."""
    return F.lpad(decimal, 39, "0")


def canonical(s: str | Column, k: int, base: int = BASE) -> tuple[Column, Column]:
    """(canonical hash as decimal text, whether the text itself is the canonical strand)."""
    a, b = hash_text(s, base), hash_text(revcomp(s), base)
    return F.when(order_key(a) < order_key(b), a).otherwise(b), order_key(a) < order_key(b)
