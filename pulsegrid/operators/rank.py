"""Rankings, percentiles and index reconstruction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored


def ranked(df: DataFrame, score: str, key: str, name: str = "rank") -> DataFrame:
    """Position by score, ties by code."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))))


def _in_ranges(df: DataFrame, *order) -> tuple[DataFrame, DataFrame]:
    """``df`` dealt over tasks by ranges of ``order`` and written with the number of its range, which orders the ranges; and what of it is there to be summed by range.

    Written, since a range that is computed twice need not have the same bounds.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    return rows, rows.groupBy("_range")


def _offsets(sums: DataFrame) -> DataFrame:
    """_range, rows before it, rows of all, from _range, _n: a row a range, as many as shuffle partitions at most."""
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))


def ranked_wide(df: DataFrame, score: str, key: str, name: str = "rank") -> DataFrame:
    """``ranked`` for any number of rows, as a long: ranges of (score, key) are ranked each by a task of its own and shifted by the rows of the ranges before.

    However many rows share a score, their keys divide them. Rows alike in both have places next to each other in any order; null scores come last.
    """
    order = (F.desc(score), F.asc(key))
    rows, ranges = _in_ranges(df, *order)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    out = rows.withColumn("_place", place).join(F.broadcast(_offsets(ranges.agg(F.count(F.lit(1)).alias("_n")))), "_range")
    return out.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_before") + F.col("_place")).alias(name))


def _percentile(before, ties, n):
    return F.when(n <= 1, 50.0).otherwise(F.lit(100.0) * (before + (ties - 1) / F.lit(2.0)) / (n - 1))


def percentile_ties(df: DataFrame, column: str, partition: list[str] | None = None) -> DataFrame:
    """Empirical percentile 0..100 where ties share their middle place; 50 for a single row. Nulls are one value before all others.

    Without ``partition`` no task sees all rows: distinct values are counted, dealt by ranges, summed up in each range and shifted by the ranges before; rows take the
    place of their value by a join, in which adaptive execution divides the rows of a frequent value.
    """
    if partition:
        part = Window.partitionBy(*partition)
        ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, column))
        return df.withColumn("percentile", _percentile(F.rank().over(part.orderBy(column)) - 1, ties, F.count(F.lit(1)).over(part)))
    values, ranges = _in_ranges(df.groupBy(F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_ties")), F.col("_value").asc())
    inside = F.sum("_ties").over(Window.partitionBy("_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1))
    values = values.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(_offsets(ranges.agg(F.sum("_ties").alias("_n")))), "_range")
    values = values.select("_value", _percentile(F.col("_before") + F.col("_inside"), F.col("_ties"), F.col("_all")).alias("percentile"))
    return df.join(values, F.col(column).eqNullSafe(F.col("_value"))).drop("_value")


def zscore_index(df: DataFrame, weights: dict[str, float], partition: list[str]) -> DataFrame:
    """Weighted sum of parts as 50 + z * 100 / 6 within a partition, 0..100; raw where all are equal."""
    w = Window.partitionBy(*partition)
    raw = sum((F.lit(v) * F.col(k) for k, v in weights.items()), F.lit(0.0))
    mean, sd = F.avg("raw").over(w), F.stddev_pop("raw").over(w)
    z = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(50.0) + (F.col("raw") - mean) / sd * F.lit(100.0) / F.lit(6.0)))
    return df.withColumn("raw", raw).withColumn("index", F.when(sd > 1e-12, z).otherwise(F.col("raw")))


def index_error(rebuilt: DataFrame, published: str = "published", column: str = "index") -> DataFrame:
    """One row: countries, and the greatest and mean absolute difference between the rebuilt and the published index."""
    off = F.abs(F.col(published) - F.col(column))
    return rebuilt.agg(F.count(F.lit(1)).alias("countries"), F.max(off).alias("max_error"), F.avg(off).alias("mean_error"))
