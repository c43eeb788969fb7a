"""Which slots were collected, and series that keep 'not collected' apart from zero."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import DAY, HOUR, SLOT, bucket


@dataclass(frozen=True)
class Span:
    """A time window: up to 7 days by hours, else by days unless ``hourly``."""

    days: int
    now: int
    hourly: bool = False

    @property
    def length(self) -> int:
        return min(1185, max(1, self.days))

    @property
    def grain(self) -> str:
        return "hour" if self.hourly or self.length <= 7 else "day"

    @property
    def step(self) -> int:
        return HOUR if self.grain == "hour" else DAY

    @property
    def end(self) -> int:
        return self.now - self.now % self.step

    @property
    def start(self) -> int:
        return self.end - (self.length * (24 if self.grain == "hour" else 1) - 1) * self.step


def grid(spark: SparkSession, start: int, end: int, step: int, name: str = "bucket") -> DataFrame:
    """start, start + step .. end inclusive."""
    return spark.range(start, end + 1, step).withColumnRenamed("id", name)


def coverage_buckets(slots: DataFrame, kinds: DataFrame, start: int, end: int, step: int, now: int, slot: int = SLOT) -> DataFrame:
    """kind, bucket, expected, done, complete. ``slots``: distinct (kind, file_ts) that are done. Only slots that are over count, up to the horizon before ``now``."""
    horizon = now - now % slot
    last = min(end, horizon)
    done = slots.filter((F.col("file_ts") >= start) & (F.col("file_ts") < last)).groupBy("kind", bucket("file_ts", step).alias("bucket")).agg(F.countDistinct(bucket("file_ts", slot)).alias("done"))
    cells = grid(slots.sparkSession, start - start % step, end - 1, step).crossJoin(F.broadcast(kinds.select("kind").distinct()))  # a calendar and the kinds of files
    out = cells.join(done, ["kind", "bucket"], "left").withColumn("done", F.coalesce("done", F.lit(0)).cast("long"))
    span = F.least(F.col("bucket") + step, F.lit(last)) - F.greatest(F.col("bucket"), F.lit(start))
    out = out.withColumn("expected", F.floor(F.greatest(span, F.lit(0)) / slot).cast("long"))
    return out.withColumn("complete", (F.col("expected") > 0) & (F.col("done") == F.col("expected")) & (F.col("bucket") + step <= horizon)).select("kind", "bucket", "expected", "done", "complete")


def coverage_summary(buckets: DataFrame, slots: DataFrame, now: int, stale: int = 2700) -> DataFrame:
    last = slots.groupBy("kind").agg(F.max("file_ts").alias("last_ts"))
    sums = buckets.groupBy("kind").agg(F.sum("expected").alias("expected"), F.sum("done").alias("done"), F.count_if("complete").alias("complete_buckets"))
    out = sums.join(last, "kind", "left").withColumn("percent", F.coalesce(F.try_divide(F.lit(100.0) * F.col("done"), F.col("expected")), F.lit(0.0)))
    return out.withColumn("stale", F.coalesce(F.lit(now) - F.col("last_ts") > stale, F.lit(True)))


def coverage_by_range(slots: DataFrame, kinds: DataFrame, ranges: tuple[int, ...], now: int) -> DataFrame:
    """The coverage summary of each range of days that ends now, by days however short the range. ``slots`` are those that are done."""
    out = None
    for days in ranges:
        part = coverage_summary(coverage_buckets(slots, kinds, Span(days, now).start, now, DAY, now), slots, now).withColumn("days", F.lit(days))
        out = part if out is None else out.unionByName(part)
    return out


def gap_fill(points: DataFrame, entities: DataFrame, key: str, span: Span, zero: list[str]) -> DataFrame:
    """Every entity at every bucket; what no point has is 0."""
    cells = grid(points.sparkSession, span.start, span.end, span.step).crossJoin(entities.select(key).distinct())
    return cells.join(points, [key, "bucket"], "left").fillna(0, zero)


def mask(series: DataFrame, coverage: DataFrame, columns: list[str]) -> DataFrame:
    """Attach done, expected and complete; buckets without a collected slot have null measures."""
    out = series.join(coverage.select("bucket", F.col("done").alias("collected"), F.col("expected"), "complete"), "bucket", "left")
    out = out.fillna(0, ["collected", "expected"]).fillna(False, ["complete"])
    return out.withColumns({c: F.when(F.col("collected") > 0, F.col(c)) for c in columns})


def momentum(daily: DataFrame, coverage: DataFrame, key: str, today: int, start: int, k: int = 1, sensitivity: float = 25.0) -> DataFrame:
    """Mean of the last k days against the complete days before them; null where a recent day isn't complete."""
    days = coverage.filter((F.col("bucket") >= start) & (F.col("bucket") < today)).withColumn("recent", F.col("bucket") >= today - k * DAY)
    cells = daily.select(key).distinct().crossJoin(F.broadcast(days.select(F.col("bucket").alias("day"), "complete", "recent")))  # a calendar
    rows = cells.join(daily.withColumnRenamed("bucket", "day"), [key, "day"], "left").withColumn("n", F.coalesce("n_events", F.lit(0)).cast("double"))
    sums = rows.groupBy(key).agg(
        F.count_if(F.col("recent") & F.col("complete")).alias("fresh"), F.sum(F.when(F.col("recent"), F.col("n"))).alias("now_n"),
        F.avg(F.when(~F.col("recent") & F.col("complete"), F.col("n"))).alias("base"),
    )
    ratio = F.col("now_n") / F.lit(float(k)) / F.greatest(F.col("base"), F.lit(1.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(50.0) + F.lit(sensitivity) * (ratio - 1)))
    return sums.select(key, F.when((F.col("fresh") == k) & F.col("base").isNotNull(), score).alias("momentum"))


def momentum_series(daily: DataFrame, coverage: DataFrame, key: str, k: int = 1, back: int = 30, sensitivity: float = 25.0) -> DataFrame:
    """Momentum at every day of the calendar, looking ``back`` days; two range frames a key."""
    cells = daily.select(key).distinct().crossJoin(F.broadcast(coverage.select("bucket", "complete")))  # a calendar
    rows = cells.join(daily, [key, "bucket"], "left").withColumn("n", F.coalesce("n_events", F.lit(0)).cast("double"))
    order = Window.partitionBy(key).orderBy("bucket")
    recent, before = order.rangeBetween(-k * DAY, -DAY), order.rangeBetween(-back * DAY, -(k + 1) * DAY)
    fresh = F.sum(F.col("complete").cast("int")).over(recent)
    base = F.avg(F.when(F.col("complete"), F.col("n"))).over(before)
    ratio = F.sum("n").over(recent) / F.lit(float(k)) / F.greatest(base, F.lit(1.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(50.0) + F.lit(sensitivity) * (ratio - 1)))
    return rows.select(key, "bucket", F.when((fresh == k) & base.isNotNull(), score).alias("momentum"))


def missing_slots(slots: DataFrame, kinds: DataFrame, start: int, horizon: int, slot: int = SLOT) -> DataFrame:
    """Slots from ``start`` up to the horizon that no ledger row names."""
    cells = grid(slots.sparkSession, start, horizon - 1, slot, "file_ts").crossJoin(F.broadcast(kinds.select("kind").distinct()))
    return cells.join(slots.select("kind", "file_ts").distinct(), ["kind", "file_ts"], "left_anti").select("kind", "file_ts")
