"""Versioned result snapshots: data first, the manifest row last."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import DAY, SLOT
from ..operators.coverage import Span, coverage_buckets, coverage_summary


def content_hash(df: DataFrame) -> DataFrame:
    """Row count and an order-independent hash of a table: the decimal sum of its rows' hashes."""
    value = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(value.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("hash"))


@dataclass(frozen=True)
class View:
    """How a view is made for a window, the column of its countries, and the kind of files it comes from."""

    make: Callable[[Span], DataFrame]
    key: str | None
    source: str = "events"


def publish(views: dict[tuple[str, int], DataFrame], path: str, version: str, created_at: int, about: dict[tuple[str, int], DataFrame] | None = None, keys: dict[str, str] | None = None, versions: dict[str, object] | None = None) -> DataFrame:
    """Write each (view, days) under the version; then one manifest row a view. Readers start from the manifest.

    ``about`` gives a view's coverage (one row), ``keys`` the column of its countries; ``versions`` of data, parameters and model stand in every row.
    """
    manifest = None
    for (view, days), df in views.items():
        place = f"{path}/version={version}/view={view}/days={days}"
        df.write.mode("overwrite").parquet(place)
        row = content_hash(df.sparkSession.read.schema(df.schema).parquet(place))
        row = row.select(F.lit(version).alias("version"), F.lit(view).alias("view"), F.lit(days).alias("days"), F.lit(created_at).cast("long").alias("created_at"), F.lit((keys or {}).get(view)).cast("string").alias("key"), "rows", "hash")
        if about:
            row = row.crossJoin(about[view, days].select("expected", "done", "percent", "last_ts"))  # one row
        row = row.withColumns({k: F.lit(v) for k, v in (versions or {}).items()})
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    return read_manifest(manifest.sparkSession, path, version)


def newest(spark: SparkSession, path: str) -> dict | None:
    """version, data_version and parameter_version of the newest published version; None before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in system.listStatus(folder)] if system.exists(folder) else []
    versions = sorted(n.split("=", 1)[1] for n in names if n.startswith("version="))
    return read_manifest(spark, path, versions[-1]).first().asDict() if versions else None  # a row a view and range


def publish_changed(spark: SparkSession, views: Callable[[], dict[tuple[str, int], DataFrame]], path: str, created_at: int, data_version: object, parameters: object, **more) -> str | None:
    """Publish a next version where the data or the parameters differ from the newest one's; its name, or None where nothing changed.

    ``data_version`` tells the data's state (a counter, or a hash of the cells), ``parameters`` is any value whose text tells the options; ``views`` is called only for a new version.
    """
    last, data, chosen = newest(spark, path), str(data_version), hashlib.sha256(repr(parameters).encode()).hexdigest()
    if last and (last.get("data_version"), last.get("parameter_version")) == (data, chosen):
        return None
    version = f"v{int(last['version'][1:]) + 1 if last else 1:09d}"
    publish(views(), path, version, created_at, versions={"data_version": data, "parameter_version": chosen}, **more)
    return version


def read_manifest(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest/version={version}").withColumn("version", F.lit(version))


def build(views: dict[str, View], ranges: tuple[int, ...], path: str, version: str, as_of: int, slots: DataFrame, slot: int = SLOT, versions: dict[str, object] | None = None) -> DataFrame:
    """Publish every view over every range, all as of one time, with the coverage of each; the views read cells that were written before."""
    made, about, cover = {}, {}, {}
    for days in ranges:
        span = Span(days, as_of)
        for name, view in views.items():
            made[name, days] = view.make(span)
            if (view.source, days) not in cover:
                own = slots.filter(F.col("kind") == view.source)
                cover[view.source, days] = coverage_summary(coverage_buckets(own, own, span.start, span.end + span.step, DAY, as_of, slot), own, as_of)
            about[name, days] = cover[view.source, days]
    return publish(made, path, version, as_of, about, {k: v.key for k, v in views.items()}, versions)


def read_view(spark: SparkSession, path: str, version: str, view: str, days: int, country: str | None = None, as_of: int | None = None, stale: int = 2700) -> DataFrame:
    """One published view, or its rows of one country; only its own directory is read. With ``as_of``, ``stale`` tells whether its data are old now."""
    out = spark.read.parquet(f"{path}/version={version}/view={view}/days={days}")
    if country is None and as_of is None:
        return out
    about = read_manifest(spark, path, version).filter((F.col("view") == view) & (F.col("days") == days)).first()  # one row
    if about is None:
        raise ValueError("this view and range are not published")
    if country is not None:
        out = out.filter(F.col(about["key"]) == country.upper())
    if as_of is not None:
        last = about.asDict().get("last_ts")
        out = out.withColumn("stale", F.lit(last is None or as_of - last > stale))
    return out


#: The ranges in days that may be published, and the most points of a series.
RANGES, MOST_POINTS = (1, 7, 30, 90, 365, 1095), 10_000


def output_checks(df: DataFrame, view: str, days: int, key: str, required: tuple[str, ...]) -> DataFrame:
    """One row: numbers of violations of a published table, and its series and their longest length."""
    missing, repeated = len(set(required) - set(df.columns)), len(df.columns) - len({c.lower() for c in df.columns})
    series = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    out = series.agg(F.count(F.lit(1)).alias("series"), F.coalesce(F.max("n"), F.lit(0)).alias("points"), F.count_if(F.col("n") > MOST_POINTS).alias("too_long"))
    fixed = {"missing_columns": missing, "repeated_columns": repeated, "unsupported_range": int(days not in RANGES)}
    return out.select(F.lit(view).alias("view"), F.lit(days).alias("days"), *(F.lit(v).alias(c) for c, v in fixed.items()), "series", "points", "too_long")
