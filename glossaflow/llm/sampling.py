"""p3: a reproducible sample that stays stable while the data grows.

Every record key is hashed with a fixed salt to the unit interval; keys below the rate are kept. The decision depends on
nothing but the key, so it is the same in every run, partitioning and version of the table, and a larger rate keeps a
superset. It is a map-only filter: no shuffle, no state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that make up the fraction: 13 digits are 52 bits, which a double holds exactly.
UNIT_HEX = 13


def unit_interval(key: Column, salt: str) -> Column:
    """Hash ``salt:key`` to a double in [0, 1); null for a null key."""
    digest = F.sha2(F.concat(F.lit(salt + ":"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, UNIT_HEX), 16, 10).cast("bigint").cast("double") / F.lit(float(16**UNIT_HEX))


def stable_sample(df: DataFrame, key: str, rate: float, salt: str) -> DataFrame:
    """Rows of ``df`` whose key falls below ``rate``; all rows of a key stand or fall together.

    Rows with a null key are left out; an empty string is a key like any other; a rate of 0 keeps nothing, 1 or more
    keeps every row with a key. All columns pass through unchanged, whatever their names.
    """
    if rate >= 1:
        return df.filter(F.col(f"`{key}`").isNotNull())
    return df.filter(unit_interval(F.col(f"`{key}`"), salt) < F.lit(float(rate)))


def sampled_keys(df: DataFrame, key: str, rate: float, salt: str) -> DataFrame:
    """One row per sampled key with its position on the unit interval and its number of rows."""
    kept = stable_sample(df.select(F.col(f"`{key}`").cast("string").alias("id")), "id", rate, salt)
    return kept.groupBy("id").agg(F.count("*").alias("n_rows")).withColumn("unit", unit_interval(F.col("id"), salt))
