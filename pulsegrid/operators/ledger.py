"""Questions about the ledger of batches: counts, progress, attempts, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import DAY, SLOT


def summary(ledger: DataFrame) -> DataFrame:
    """A row a kind: batches by status, latest done batch, parsed and skipped rows."""
    return ledger.groupBy("kind").agg(
        F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.max(F.when(F.col("status") == "done", F.col("file_ts"))).alias("latest"),
        F.sum("row_count").alias("rows_parsed"), F.sum("skipped_rows").alias("rows_skipped"),
    )


def recent(ledger: DataFrame, status: str, k: int) -> DataFrame:
    return ledger.filter(F.col("status") == status).orderBy(F.desc("file_ts"), "kind").limit(k)


def progress(ledger: DataFrame, start: int, end: int, kinds: int = 2, slot: int = SLOT) -> DataFrame:
    """One row: slots of all ``kinds`` in the range, by what became of them; an empty range is done."""
    some = ledger.filter((F.col("file_ts") >= start) & (F.col("file_ts") < end))
    total = F.lit(max(0, (end - start) // slot * kinds)).cast("long")
    out = some.agg(total.alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("done", "pending", "failed", "exhausted")), F.count(F.lit(1)).alias("seen"))
    out = out.withColumn("unseeded", F.greatest(F.lit(0), F.col("total") - F.col("seen")))
    out = out.withColumn("percent", F.coalesce(F.try_divide(F.lit(100.0) * F.col("done"), F.col("total")), F.lit(100.0))).drop("seen")
    return out.withColumn("finished", (F.col("pending") + F.col("failed") + F.col("unseeded")) == 0)


def attempt_rollup(log: DataFrame, now: int, most: int = 5) -> DataFrame:
    """Attempts by batch, all and those of its last ``round``, whether these are used up, and when the next may start (0: never)."""
    rounds = log.groupBy("kind", "file_ts", "round").agg(F.count(F.lit(1)).alias("n"))
    out = rounds.groupBy("kind", "file_ts").agg(F.sum("n").alias("attempts"), F.max_by("n", "round").alias("round_attempts"))
    wait = F.least(F.lit(21_600.0), F.lit(60.0) * F.pow(F.lit(2.0), F.least(F.col("round_attempts"), F.lit(9)).cast("double")))
    out = out.withColumn("exhausted", F.col("round_attempts") >= most)
    return out.withColumn("next_retry", F.when(F.col("exhausted"), F.lit(0)).otherwise((F.lit(now) + wait)).cast("long"))


def retain(cells: DataFrame, now: int, hour_days: int = 60, day_days: int = 730) -> DataFrame:
    """Cells younger than their grain's limit, cut at midnight; day cells are never rebuilt from hours."""
    cut = now - now % DAY
    return cells.filter(((F.col("granularity") == "hour") & (F.col("bucket") >= cut - hour_days * DAY)) | ((F.col("granularity") == "day") & (F.col("bucket") >= cut - day_days * DAY)))


def expire(ledger: DataFrame, now: int, hour_days: int = 60, day_days: int = 730) -> DataFrame:
    cut = now - now % DAY - max(hour_days, day_days) * DAY
    return ledger.withColumn("status", F.when(F.col("file_ts") < cut, "expired").otherwise(F.col("status")))


def account(rows: DataFrame) -> DataFrame:
    """Rows with a ``row_status`` to batches: a rejected row voids its batch, and so does having no row."""
    out = rows.groupBy("kind", "file_ts").agg(
        F.count_if(F.col("row_status") == "ok").alias("row_count"), F.count_if(F.col("row_status").startswith("skip")).alias("skipped_rows"),
        F.count_if(F.col("row_status").startswith("reject")).alias("rejected"),
    )
    return out.withColumn("status", F.when(F.col("rejected") > 0, "failed").when(F.col("row_count") + F.col("skipped_rows") == 0, "failed").otherwise("done"))


def accepted(rows: DataFrame) -> DataFrame:
    """Good rows of batches without a rejected row."""
    bad = rows.filter(F.col("row_status").startswith("reject")).select("kind", "file_ts").distinct()
    return rows.filter("row_status = 'ok'").join(bad, ["kind", "file_ts"], "left_anti")
