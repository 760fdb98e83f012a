"""Numbers that come out the same in every engine."""

from __future__ import annotations

from pyspark.sql import functions as F


def rounded(value, digits: int):
    """Half up on the binary value; round() differs between engines in the last digit."""
    return F.floor(value * 10**digits + 0.5) / 10**digits
