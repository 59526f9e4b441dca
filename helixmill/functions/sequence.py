"""Column expressions on base strings over A, C, G, T and N.

All are built-in functions, unrolled over the fixed read length, so that they stay
inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base_codes(seq: Column | str) -> Column:
    """Two-bit codes as digits; N packs as A."""
    return F.translate(_c(seq), "ACGTN", "01230")


def complement(seq: Column | str) -> Column:
    return F.translate(_c(seq), "ACGTN", "TGCAN")


def reverse_complement(seq: Column | str) -> Column:
    return complement(F.reverse(_c(seq)))


def canonical(seq: Column | str) -> Column:
    """The smaller of a sequence and its reverse complement."""
    return F.least(_c(seq), reverse_complement(seq))


def kmer(seq: Column | str, at: Column | int, k: int) -> Column:
    """k bases from 0-based position ``at``."""
    at = at if isinstance(at, Column) else F.lit(at)
    return F.substring(_c(seq), at.cast("int") + 1, F.lit(k))


def kmer_code(bases: Column, k: int) -> Column:
    """A k-mer of up to 32 bases as a long, first base in the top bits, N as A."""
    digits = base_codes(bases)
    return F.conv(F.rpad(digits, 32, "0") if k > 31 else digits, 4, -10).cast("long")


def packed_word(seq: Column | str, i: int) -> Column:
    """The i-th word of 32 bases, padded with zero bits at the low end."""
    return F.conv(F.rpad(base_codes(F.substring(_c(seq), 32 * i + 1, 32)), 32, "0"), 4, -10).cast("long")


def packed(seq: Column | str, length: int) -> Column:
    return F.array(*[packed_word(seq, i) for i in range(-(-length // 32))])


def differing_bases(a: Column, b: Column) -> Column:
    """Bases in which two packed words differ."""
    x = a.bitwiseXOR(b)
    low = F.lit(0x5555555555555555)
    return F.bit_count(x.bitwiseAND(low).bitwiseOR(F.shiftrightunsigned(x, 1).bitwiseAND(low)))


def packed_distance(a: Column, b: Column, words: int) -> Column:
    """Hamming distance of packed reads; N equals A."""
    total = F.lit(0)
    for i in range(words):
        total = total + differing_bases(a[i], b[i])
    return total


def distance(a: Column | str, b: Column | str, length: int) -> Column:
    """Hamming distance of base strings of one length; N differs from every base but N."""
    total = F.lit(0)
    for i in range(0, length, 15):
        # one hexadecimal digit with one bit a base, N without any
        w = [F.conv(F.translate(F.substring(_c(x), i + 1, 15), "ACGTN", "12480"), 16, 10).cast("long") for x in (a, b)]
        x = w[0].bitwiseXOR(w[1])
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        total = total + F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def mismatches(ref: Column, read: Column, length: int) -> Column:
    """array<struct<off, ref_base, read_base>> of the differing positions, ascending."""
    # both strings are bound once, as a one-element array, not once a position
    at = lambda x, i: F.struct(i.alias("off"), F.substring(x["a"], i + 1, F.lit(1)).alias("ref_base"), F.substring(x["b"], i + 1, F.lit(1)).alias("read_base"))
    found = F.transform(F.array(F.struct(ref.alias("a"), read.alias("b"))), lambda x: F.filter(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: at(x, i)), lambda m: m["ref_base"] != m["read_base"]))
    return found[0]


def apply_mismatches(ref: Column, found: Column) -> Column:
    """The inverse: the window with each differing base put in."""
    return F.aggregate(found, ref, lambda s, m: F.overlay(s, m["read_base"], m["off"] + 1))


def valid(seq: Column | str, length: int) -> Column:
    """Fixed length and no letter but A, C, G, T, N."""
    return (F.length(_c(seq)) == length) & (F.translate(_c(seq), "ACGTN", "") == "")
