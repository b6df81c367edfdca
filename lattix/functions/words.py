"""Functions on 64-bit words carried by signed BIGINT. Never compare words by order: bit 63 is the sign."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_of(index: Column) -> Column:
    """Number of the 64-wide word that holds ``index``."""
    return F.shiftright(index, 6)


def single_bit(index: Column) -> Column:
    """Word with only the bit of ``index`` set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), index.bitwiseAND(F.lit(63)).cast("int"))


def low_mask(k: Column) -> Column:
    """Word with the lowest k bits set, k from 0 to 63."""
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), k.cast("int")))


def bit_rank(mask: Column, k: Column) -> Column:
    """Set bits below position k."""
    return F.bit_count(mask.bitwiseAND(low_mask(k)))


def andnot(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def trailing_zeros(mask: Column) -> Column:
    """Position of the lowest set bit; 64 for zero."""
    lowest = F.when(mask == F.lit(-(1 << 63)), F.lit(63)).when(mask == 0, F.lit(64)).otherwise(F.bit_count(mask.bitwiseXOR(mask - 1)) - 1)
    return lowest.cast("int")


def bit_positions(mask: Column) -> Column:
    """Array of set positions, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("bit_get", mask, k) == 1)


def bits_of(word: Column, mask: Column) -> Column:
    """Array of the indices that a (word, mask) pair holds, ascending."""
    return F.transform(bit_positions(mask), lambda k: word * 64 + k)
