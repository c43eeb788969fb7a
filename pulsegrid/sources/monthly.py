"""The published monthly index as CSV, whose header line is repeated inside the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORES = ("Social_Stability_Risk", "Political_Institutional_Risk", "International_Conflict_Risk", "Media_Sentiment_Risk", "General_Risk_Index")
SCHEMA = ", ".join(f"{c} string" for c in ("Month", "Country", *SCORES))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).csv(path)


def one_month(rows: DataFrame, month: int) -> DataFrame:
    """Rows of a month with scores as numbers; header lines go, a country given twice is an error."""
    kept = rows.filter((F.col("Country") != "Country") & (F.col("Month").try_cast("int") == month))
    out = kept.groupBy("Country").agg(F.count(F.lit(1)).alias("n"), *(F.first(F.col(c).try_cast("double")).alias(c) for c in SCORES))
    once = F.when(F.col("n") == 1, F.col("Country")).otherwise(F.raise_error(F.concat(F.lit("given twice: "), "Country")))
    return out.select(F.lit(month).alias("Month"), once.alias("Country"), *SCORES)
