"""Helpers that keep a hot key from landing in one task.

A window partitioned by a key sorts all rows of that key in one task.  Where a key may
hold a large share of the rows (a corpus, a sequence number, a text, a day), operators
use these forms instead: aggregates that combine before the shuffle, and joins that
adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexispark.session import cut


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"):
    """Join on equal keys where null equals null; keeps the left names only."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    out = left.join(r, cond, how)
    return out.drop(*[f"_r_{k}" for k in keys]) if how not in ("left_semi", "left_anti") else out


def first_per_group(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the smallest `order` per key, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def bucketed_lag(
    df: DataFrame, keys: Sequence[str], value: str, width: int = 1 << 16, name: str = "previous"
) -> DataFrame:
    """Previous distinct integer `value` per key, without one task per key.

    Values are cut into buckets of `width`; inside a bucket a window looks back, and the
    first value of a bucket takes the largest value of the nearest filled bucket before
    it, from one row per bucket.  Returns distinct (keys, value) rows plus `name`.
    """
    cells = df.select(*keys, F.col(value).cast("bigint").alias(value)).distinct()
    cells = cells.withColumn("_b", F.floor(F.col(value) / width))
    inside = F.lag(value).over(W.partitionBy(*keys, "_b").orderBy(value))
    ends = cells.groupBy(*keys, "_b").agg(F.max(value).alias("_top"))
    ends = ends.select(
        *keys, "_b", F.lag("_top").over(W.partitionBy(*keys).orderBy("_b")).alias("_before")
    )
    out = null_safe_join(cells.withColumn("_in", inside), ends, [*keys, "_b"], "left")
    return out.select(*keys, value, F.coalesce("_in", "_before").alias(name))


def spread_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, slices: int | None = None
) -> DataFrame:
    """`row_number` per key that also works when one key holds most rows.

    Rows are range-partitioned by key and order, so a hot key covers many slices.  Each
    slice numbers its own rows and adds the rows of the same key in earlier slices; those
    counts are at most one row per (slice, key) that a slice begins with.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
    # Written once: both uses below must see the same slices.
    keyed = cut(keyed.withColumn("_slice", F.spark_partition_id()))
    counts = keyed.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    # Only keys that continue from an earlier slice need an offset: at most n - 1 rows,
    # since a slice boundary cuts at most one key.
    offsets = (
        counts.withColumn("_off", F.sum("_n").over(w)).where("_off IS NOT NULL").select(*keys, "_slice", "_off")
    )
    local = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order))
    out = null_safe_join(keyed.withColumn("_rn", local), offsets, [*keys, "_slice"], "left")
    return out.withColumn(name, (F.col("_rn") + F.coalesce("_off", F.lit(0))).cast("int")).drop(
        "_slice", "_rn", "_off"
    )
