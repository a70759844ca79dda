"""Running numbers and first rows that no single task has to hold."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A side is broadcast up to so many rows and bytes; beyond, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, derived: bool = False) -> DataFrame:
    """``df`` with a broadcast hint if a measure that stops early proves it small in rows and bytes, else as it is.

    derived: the side is not a small table but made from a large one; it is kept on disk, so that it is made only once.
    """
    side = df.persist(StorageLevel.DISK_ONLY) if derived else df
    n, size = side.limit(rows + 1).select(F.coalesce(F.length(F.to_json(F.struct("*"))), F.lit(0)).alias("b")).agg(F.count("*"), F.sum("b")).first()
    return F.broadcast(side) if n <= rows and (size or 0) <= BROADCAST_BYTES else side


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in ``order``: a map-side combined minimum, so hot keys shrink before the shuffle."""
    packed = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return packed.select("_row.*")


def running_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "index") -> DataFrame:
    """Adds ``name``: 1, 2, ... within each key in ``order``.

    Rows are range-partitioned by key and order, so a key of any size spreads over many tasks; each task numbers its own
    sorted stretch as it passes by, and the stretches' sizes (one row per key and partition) give the offsets. That is one
    shuffle; select the columns that are needed before. Ties are broken arbitrarily unless ``order`` is unique. The numbered
    rows are kept on disk, as a second sampling could draw other ranges.
    """
    added = "_pid int, _own bigint"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), added])
    numbered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(_numbering(list(keys)), schema).persist(StorageLevel.DISK_ONLY)
    sizes = numbered.groupBy("_pid", *keys).agg(F.max("_own").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").filter("_offset > 0")
    own_keys = ["_pid", *keys]
    renamed = bounded(offsets.select("_offset", *[F.col(c).alias(f"_o_{i}") for i, c in enumerate(own_keys)]), derived=True)
    met = [F.col(c).eqNullSafe(F.col(f"_o_{i}")) for i, c in enumerate(own_keys)]
    joined = numbered.join(renamed, met, "left")
    return joined.select(*[F.col(c) for c in df.columns], (F.col("_own") + F.coalesce("_offset", F.lit(0))).alias(name))


def _numbering(keys: list[str]):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            own = []
            for row in rows:
                held = held + 1 if row == last else 1
                last = row
                own.append(held)
            columns = [*batch.columns, pa.array([pid] * len(own), pa.int32()), pa.array(own, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_pid", "_own"])

    return number


#: A group with more than 1/HOT_GROUPS of all rows is matched map-side; there are fewer than HOT_GROUPS of them.
HOT_GROUPS = 1 << 14


def join_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined with ``groups`` (``key, n, ...``, one row per key, n its number of rows) whatever the size of a group.

    Groups above 1/``HOT_GROUPS`` of all rows are broadcast, which that bound proves to be few; the rest meets in a shuffle.
    Rows with a null key find no group and are not shuffled. ``n`` does not come along.
    """
    groups = groups.persist(StorageLevel.DISK_ONLY)
    hot_from = max(1000, (groups.agg(F.sum("n")).first()[0] or 0) // HOT_GROUPS)
    values = [c for c in groups.columns if c not in (key, "n")]
    hot = groups.filter(F.col("n") > hot_from).select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    tagged = rows.join(F.broadcast(hot), rows[key] == F.col("_hot"), "left")
    done = tagged.filter(F.col("_hot").isNotNull() | F.col(key).isNull()).select(*rows.columns, *[F.col(f"_hot_{c}").alias(c) for c in values])
    cold = tagged.filter(F.col("_hot").isNull() & F.col(key).isNotNull()).select(*rows.columns)
    return done.unionByName(cold.join(groups.filter(F.col("n") <= hot_from).drop("n"), key, "left").select(*rows.columns, *values))
