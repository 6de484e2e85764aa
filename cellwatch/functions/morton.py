"""Z-order codes: numbers whose order keeps neighbours in the plane close together."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """The bits of two whole numbers from 0 to 2**bits - 1 in turn, those of y above those of x."""
    if not 1 <= bits <= 31:
        raise ValueError("bits must be between 1 and 31")

    def spread(value: Column, shift: int) -> list[Column]:
        value = value.cast("bigint")
        return [F.shiftleft(F.shiftright(value, i).bitwiseAND(F.lit(1)), 2 * i + shift) for i in range(bits)]

    return functools.reduce(lambda a, b: a.bitwiseOR(b), spread(x, 0) + spread(y, 1))


def cell_of(value: Column, low: Column, span: Column, bits: int = 16) -> Column:
    """Place of a value in an interval cut into 2**bits pieces; the far end belongs to the last."""
    size = 1 << bits
    share = F.coalesce((value - low) / F.nullif(span, F.lit(0.0)), F.lit(0.0))
    return F.least(F.floor(share * size), F.lit(size - 1)).cast("bigint")
