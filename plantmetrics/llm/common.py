"""Small helpers that several of the operators share."""

from __future__ import annotations

import string
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmetrics.session import materialise

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
BLANKS = " \t\n\v\f\r"

#: Bits of a row filter: so many a row, and at most 4 MB.
BITS_A_ROW, MOST_BITS = 16, 1 << 25

# Byte tables for whole texts in UTF-8; bytes of letters beyond ASCII stay as they are.
LOWER_BYTES = bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in LOWER_BYTES)


def lower_ascii(column: Column) -> Column:
    """A-Z in lower case; every other letter stays."""
    return F.translate(column, UPPER, LOWER)


def crc_of_id(doc_id: Column) -> Column:
    """CRC-32 of the id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    return crc_of_id(doc_id) % folds == fold


def row_filter(rows: DataFrame) -> Callable[..., Column]:
    """A test of columns that holds for the values of every row of ``rows``, and for few others: at most about one in 16.

    It keeps long rows that cannot find a partner out of an exchange; a join has to follow. Each row sets the bit of its hash in
    an array, which enters as a scalar subquery. Beyond 2 million rows the array stays at 4 MB and the test holds more often.
    """
    bits = min(max(64, 1 << (BITS_A_ROW * rows.count()).bit_length()), MOST_BITS)

    def bit_of(*columns: str | Column) -> tuple[Column, Column]:
        place = F.pmod(F.xxhash64(*columns), F.lit(bits))
        return F.shiftright(place, 6), (place % 64).cast("int")

    word, bit = bit_of(*rows.columns)
    held = rows.groupBy(word.alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("held"))
    dense = rows.sparkSession.range(bits // 64).join(held, "id", "left").select("id", F.coalesce("held", F.lit(0)).alias("held"))
    array = materialise(dense.agg(F.sort_array(F.collect_list(F.struct("id", "held")))["held"].alias("words")), "row-filter")

    def holds(*columns: str | Column) -> Column:
        word, bit = bit_of(*columns)
        return F.bit_get(F.get(array.scalar(), word.cast("int")), bit) == 1

    return holds


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers, one to one."""
    x = values.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x
