"""Deterministic draws. A trace's id and a salt give 32 bits; it is kept if they fall below a rate's share of the range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the salt of the deterministic sampler.
SALT = "5VQ8l2jE5aJLPVqk"
TOP = 4294967295


def bits32(text: Column) -> Column:
    """First four bytes of the SHA-1, as an unsigned number."""
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("long")


def keep_one_in(trace_id: Column, rate: Column | int, salt: str = SALT) -> Column:
    """Whether a trace is among the one in ``rate`` kept; rates up to 1 keep all."""
    if isinstance(rate, int):
        return F.lit(True) if rate <= 1 else bits32(F.concat(trace_id, F.lit(salt))) <= F.lit(TOP // rate)
    share = F.floor(F.lit(TOP) / F.greatest(rate, F.lit(1)))
    return (rate <= 1) | (bits32(F.concat(trace_id, F.lit(salt))) <= share)
