"""Tumbling windows that end at the next boundary: a time on a boundary belongs to the window that ends there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds from the year 1 to 1970; window boundaries are counted from the year 1.
ZERO_MICROS = 62_135_596_800_000_000


def window_end(micros: Column, width_s: int) -> Column:
    """End in epoch seconds of the window (start, end] that holds a time in microseconds; without a width, the time's own second."""
    if width_s <= 0:
        return F.floor(micros / 1_000_000).cast("bigint")
    w = width_s * 1_000_000
    shifted = micros + ZERO_MICROS + w - 1
    start = shifted - F.pmod(shifted, F.lit(w)) - ZERO_MICROS
    return F.floor(start / 1_000_000).cast("bigint")
