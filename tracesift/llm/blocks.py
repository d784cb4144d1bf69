"""Keeping hot keys apart: joins that spread them, and comparing the members of large groups in pairs of bounded blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it has more than one in so many rows. So no more keys than that can be heavy.
HEAVY = 4096


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, total) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has one row a key, so that no key lands in one task with many rows.

    ``weight``: a column of facts, the key's number of rows; ``total``: that of all rows, or more. Facts of heavy keys, HEAVY
    at most whatever the tables' sizes, are broadcast; all other keys have few rows each and meet by a shuffle.
    ``rows`` is planned twice: it should be a stored table, or end in an exchange that Spark reuses. Null keys meet nothing."""
    is_heavy = F.col(weight) * HEAVY > F.lit(total)
    heavy, light = facts.where(is_heavy), facts.where(~is_heavy)
    return rows.join(F.broadcast(heavy), keys).unionByName(rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys))


def pair_blocks(left: DataFrame, right: DataFrame, group: str, key: str, left_blocks: str, right_blocks: str):
    """Both sides keyed by (group, l, r), so that each left block of a group meets each of its right blocks once.

    ``left_blocks`` and ``right_blocks``: columns of both sides with the group's numbers of blocks. Returns two grouped
    frames for ``cogroup``. A task holds two blocks at most, however large the group is."""
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # attributes of their own, as both may stem from one frame
    hashed = F.xxhash64(key, F.lit(5))
    a = left.withColumn("l", F.pmod(hashed, F.col(left_blocks)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), (F.col(right_blocks) - 1).cast("int"))))
    b = right.withColumn("r", F.pmod(hashed, F.col(right_blocks)).cast("int")).withColumn("l", F.explode(F.sequence(F.lit(0), (F.col(left_blocks) - 1).cast("int"))))
    return a.groupBy(group, "l", "r"), b.groupBy(group, "l", "r")
