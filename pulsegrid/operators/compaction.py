"""Compacted cells in versions that readers follow: merges of the days that changed, pinned reads, and retention as a job.

Beside the partials of a table (a directory a batch) stand its compacted cells (a directory a version, kind, grain and day) and, for each version,
two small tables: the batches that it holds, and for each day the version whose directory has it. A version is there once its table of days
is, which is written last; a reader takes the newest one, or one that it was pinned to. Days that no new batch touches stay where they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import DAY, bucket
from .ledger import expire
from .rollup import merge_partials, write_partials

DAYS = "kind string, granularity string, day long, place int"
BATCHES = "kind string, file_ts long"
PLACE = ("kind", "granularity", "day")


@dataclass(frozen=True)
class Compacted:
    """The cells of one table: ``path`` has its partials, ``keys`` are those of a cell."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]

    def _folder(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        folder, system = self._folder(path)
        return [x.getPath().getName() for x in system.listStatus(folder)] if system.exists(folder) else []

    def _delete(self, path: str) -> None:
        folder, system = self._folder(path)
        system.delete(folder, True)

    def _at(self, what: str, version: int) -> str:
        return f"{self.path}-compact/{what}/version={version}"

    def versions(self) -> list[int]:
        """Whole versions, the oldest first."""
        found = sorted(int(n.split("=")[1]) for n in self._names(f"{self.path}-compact/days") if n.startswith("version="))
        return [v for v in found if "_SUCCESS" in self._names(self._at("days", v))]

    def newest(self) -> int:
        return max(self.versions(), default=0)

    def days(self, version: int) -> DataFrame:
        return self.spark.read.schema(DAYS).parquet(self._at("days", version)) if version else self.spark.createDataFrame([], DAYS)

    def batches(self, version: int) -> DataFrame:
        return self.spark.read.schema(BATCHES).parquet(self._at("batches", version)) if version else self.spark.createDataFrame([], BATCHES)

    def partials(self) -> DataFrame | None:
        """None where all of them have gone into versions."""
        there = any(n.startswith("file_ts=") for k in self._names(self.path) if k.startswith("kind=") for n in self._names(f"{self.path}/{k}"))
        return self.spark.read.parquet(self.path) if there else None

    def fresh(self, version: int) -> DataFrame | None:
        """Partials of the batches that a version doesn't hold; only their directories are read for more than their names."""
        if self.partials() is None:
            return None
        ids = self.partials().select("kind", "file_ts").distinct().join(self.batches(version), ["kind", "file_ts"], "left_anti")
        return self.partials().join(ids, ["kind", "file_ts"], "left_semi")

    def _cells(self, days: list) -> DataFrame | None:
        """The compacted cells of some rows of ``days``."""
        if not days:
            return None
        base = f"{self.path}-compact/cells"
        places = [f"{base}/version={r['place']}/kind={r['kind']}/granularity={r['granularity']}/day={r['day']}" for r in days]
        return self.spark.read.option("basePath", base).parquet(*places).drop("version", "day")

    def read(self, version: int | None = None) -> DataFrame:
        """Cells of the newest version and of the batches since; with ``version`` those of that version alone, whatever is written meanwhile. An error where nothing is left."""
        pinned = self.newest() if version is None else version
        cells = self._cells(self.days(pinned).collect())  # a row a kind, grain and day
        both = [x for x in (cells, self.fresh(pinned) if version is None else None) if x is not None]
        if not both:
            raise ValueError(f"{self.path} has no cells")
        both = [x.drop("file_ts", "part") for x in both]
        return merge_partials(both[0].unionByName(both[1]) if len(both) > 1 else both[0], ("kind", "granularity", *self.keys))

    def _commit(self, days: DataFrame, batches: DataFrame) -> int:
        version = self.newest() + 1
        batches.write.mode("overwrite").parquet(self._at("batches", version))
        days.coalesce(1).write.mode("overwrite").parquet(self._at("days", version))
        return version

    def compact(self) -> int | None:
        """Merge the batches since the newest version into the days that they touch: the new version, or None without such batches."""
        last = self.newest()
        fresh = self.fresh(last)
        if fresh is None:
            return None
        fresh = fresh.withColumn("day", bucket("bucket", DAY)).drop("part")
        touched = [(r["kind"], r["granularity"], r["day"]) for r in fresh.select(*PLACE).distinct().collect()]  # a row a kind, grain and day
        if not touched:
            return None
        ids = fresh.select("kind", "file_ts").distinct()
        before = self.days(last)
        own = self.spark.createDataFrame(touched, "kind string, granularity string, day long")
        old = self._cells(before.join(F.broadcast(own), [*PLACE], "left_semi").collect())
        new = fresh.drop("file_ts", "day")
        whole = merge_partials(new if old is None else old.unionByName(new), ("kind", "granularity", *self.keys)).withColumn("day", bucket("bucket", DAY))
        whole.repartition(*PLACE).write.mode("overwrite").partitionBy(*PLACE).parquet(self._at("cells", last + 1))
        kept = before.join(F.broadcast(own), [*PLACE], "left_anti")
        return self._commit(kept.unionByName(own.withColumn("place", F.lit(last + 1))), self.batches(last).unionByName(ids))

    def retain(self, now: int, hour_days: int = 60, day_days: int = 730) -> int | None:
        """A version without the days beyond their grain's limit and without the batches beyond both, whose partials go first. None where nothing is beyond."""
        last, cut = self.newest(), now - now % DAY
        days, batches = self.days(last), self.batches(last)
        inside = F.col("day") >= F.when(F.col("granularity") == "hour", F.lit(cut - hour_days * DAY)).otherwise(F.lit(cut - day_days * DAY))
        oldest = cut - max(hour_days, day_days) * DAY
        for kind in self._names(self.path):
            for name in self._names(f"{self.path}/{kind}") if kind.startswith("kind=") else ():
                if name.startswith("file_ts=") and int(name.split("=")[1]) < oldest:
                    self._delete(f"{self.path}/{kind}/{name}")
        if days.filter(~inside).isEmpty() and batches.filter(F.col("file_ts") < oldest).isEmpty():
            return None
        return self._commit(days.filter(inside), batches.filter(F.col("file_ts") >= oldest))

    def vacuum(self, keep: int = 2) -> int:
        """Delete what none of the ``keep`` newest versions reads: directories of days, older versions, and partials that all of them hold. Returns how many directories went."""
        versions = self.versions()
        kept, gone = versions[-keep:], []
        live = {f"version={r['place']}/kind={r['kind']}/granularity={r['granularity']}/day={r['day']}" for v in kept for r in self.days(v).collect()}
        base = f"{self.path}-compact/cells"
        for v in self._names(base):
            for kind in self._names(f"{base}/{v}") if v.startswith("version=") else ():
                for grain in self._names(f"{base}/{v}/{kind}") if kind.startswith("kind=") else ():
                    gone += [f"{base}/{v}/{kind}/{grain}/{day}" for day in self._names(f"{base}/{v}/{kind}/{grain}") if f"{v}/{kind}/{grain}/{day}" not in live]
        if kept:
            held = self.batches(kept[0])
            for v in kept[1:]:
                held = held.join(self.batches(v), ["kind", "file_ts"], "left_semi")
            there = {(k, n) for k in self._names(self.path) if k.startswith("kind=") for n in self._names(f"{self.path}/{k}")}
            gone += [f"{self.path}/kind={r['kind']}/file_ts={r['file_ts']}" for r in held.collect() if (f"kind={r['kind']}", f"file_ts={r['file_ts']}") in there]  # names of directories
            gone += [self._at(what, v) for v in versions[:-keep] for what in ("batches", "days")]
        for path in gone:
            self._delete(path)
        return len(gone)


def retention(spark: SparkSession, target: str, tables: dict[str, tuple[str, ...]], now: int, hour_days: int = 60, day_days: int = 730) -> dict[str, int | None]:
    """Drop what is beyond the limits from each table and expire its batches in the ledger, whose new import is accepted then. Again at the same time: nothing."""
    made = {name: Compacted(spark, f"{target}/{name}", keys).retain(now, hour_days, day_days) for name, keys in tables.items()}
    ledger = spark.read.parquet(f"{target}/ledger")
    changed = expire(ledger, now, hour_days, day_days).filter("status = 'expired'").join(ledger.filter("status <> 'expired'").select("kind", "file_ts"), ["kind", "file_ts"], "left_semi")
    if not changed.isEmpty():
        changed.write.mode("overwrite").parquet(f"{target}/expiring")  # a table can't be read and written at once
        write_partials(spark.read.schema(changed.schema).parquet(f"{target}/expiring"), f"{target}/ledger")
    return made
