"""Structured Streaming: batches to partials exactly once, tumbling aggregates, de-duplication."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import COUNTS, SCORES
from ..operators.ledger import account
from ..operators.rollup import ARTICLE_KEYS, GEO_KEYS, RELATION_KEYS, article_flags, both_grains, rollup_flagged, rollup_geo, rollup_relation, write_partials
from ..options import Options
from ..scratch import freed
from ..sources.archives import FILES, HEADS, batch_key, checked_articles, checked_events, lines_of, parts_of, records_of, typed_articles, typed_events


BATCH = ("kind", "file_ts")
#: Columns of events that are numbers.
NUMBERS = (*COUNTS, *SCORES, "quad")
#: Bytes of archives that are taken in at once: what a round keeps and moves is bounded by it, or by its largest batch.
GROUP_BYTES = 1 << 29
LEDGER = "kind string, file_ts long, row_count long, skipped_rows long, rejected long, status string, attempts long, retry_attempts long, round int, error string, done_at long"
#: A copy of a batch: a head in some folder, told by its path and length. Tried ones are done or failed; the others wait, or are spare.
COPIES = "kind string, file_ts long, copy string, path string, length long, round int, row_count long, skipped_rows long, rejected long, status string, error string, tried_at long"
#: Failed copies of a batch after which it rests until it is reopened (a fixed value).
MOST_ATTEMPTS = 5


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of batches; empty before the first round."""
    return _stored(spark, path, LEDGER)


def read_copies(spark: SparkSession, path: str) -> DataFrame:
    """All copies of batches that the stream has met; as a log of attempts, those that are done or failed."""
    return _stored(spark, path, COPIES)


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, per_round: int = 32, then: Callable[[int], None] | None = None) -> None:
    """Read new files of typed event rows (bounded a round) and write geo partials, by hour and by day, for each batch and file.

    A batch may come in any number of files and rounds: its cells are the sums over its files. A file counts once: a rerun, or a file of
    the same name that is sent again, replaces its own partials. ``then`` is called with the round's number after a round that brought rows, to publish anew.
    """

    def step(df: DataFrame, number: int) -> None:
        rows = df.withColumn("part", F.concat(F.lit("f"), F.md5(F.element_at(F.split("file", "/"), -1))))
        write_partials(both_grains(rollup_geo(rows, "hour", *BATCH, "part"), GEO_KEYS, *BATCH, "part"), target, "part")
        if then and not df.isEmpty():
            then(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_round).parquet(source).select("*", F.col("_metadata.file_path").alias("file"))
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _sized(spark: SparkSession, heads: list[str]) -> list[list[str]]:
    """Heads in groups of GROUP_BYTES of archives at most, with all their parts; a larger batch is a group."""
    whole = F.regexp_replace("path", r"(\.\d+\.\d+)?\.zip$", ".zip")
    sizes = dict(parts_of(spark, heads).groupBy(whole).agg(F.sum("length")).collect())  # a row a head
    groups, size = [], 0
    for head in heads:
        size += sizes.get(head, 0)
        if not groups or size > GROUP_BYTES:
            groups, size = [*groups, []], sizes.get(head, 0)
        groups[-1].append(head)
    return groups


def _take_in(spark: SparkSession, heads: list[str], target: str, o: Options) -> list[dict]:
    """Check the rows of one copy each of some batches and write the cells of those without a rejected row; a verdict a batch.

    Archives are read once. What is kept meanwhile is what cells need: numbers, and what is searched in texts in their place.
    """
    named, ok = batch_key(parts_of(spark, heads)), F.col("row_status") == "ok"
    events = checked_events(lines_of(named.filter("kind = 'events'")), o)
    events = typed_events(events.withColumns({c: F.when(ok, F.col(c)) for c in NUMBERS})).select(*BATCH, "row_status", "actor1", "actor2", "geo", "root_code", *NUMBERS).persist()
    articles = typed_articles(checked_articles(records_of(named.filter("kind = 'gkg'")), o)).drop("record", "record_id", "locations", "tones", "valid")
    articles = article_flags(articles, o).persist()
    rows = events.select(*BATCH, "row_status").union(articles.select(*BATCH, "row_status"))
    first = rows.groupBy(*BATCH).agg(F.min(F.when(F.col("row_status").startswith("reject"), F.col("row_status"))).alias("error"))
    out = [r.asDict() for r in account(rows).join(first, [*BATCH]).collect()]  # a row a head
    done = F.broadcast(spark.createDataFrame([(v["kind"], v["file_ts"]) for v in out if v["status"] == "done"], "kind string, file_ts long"))
    good, whole = (df.filter(ok).join(done, [*BATCH], "left_semi") for df in (events, articles))
    pairs = good.repartition(*BATCH, *RELATION_KEYS[1:])  # pairs of actors seldom come twice to a task, so rows move: cells are wider
    for name, hours, keys in (
        ("relation", rollup_relation(pairs, "hour", *BATCH), RELATION_KEYS), ("geo", rollup_geo(good, "hour", *BATCH), GEO_KEYS),
        ("articles", rollup_flagged(whole, "hour", *BATCH), ARTICLE_KEYS),
    ):
        write_partials(both_grains(hours, keys, *BATCH), f"{target}/{name}")
    events.unpersist()
    articles.unpersist()
    return out


def try_copies(spark: SparkSession, copies: list[dict], target: str, o: Options, now: int, most: int = MOST_ATTEMPTS) -> None:
    """Try copies (kind, file_ts, path, length) of batches in turn, by path, until one of a batch is whole; then write them down and the ledger.

    Batches that the ledger holds as done are passed over, and so are copies that were tried before, so a batch counts once and a broken copy changes
    nothing. A batch with ``most`` failed copies since it was last opened is exhausted. What isn't tried is kept in the table of copies: as spare
    beside a done batch, else as waiting, for ``reopen``. A rerun of a round rewrites the same partitions.
    """
    wanted = spark.createDataFrame([(c["kind"], c["file_ts"]) for c in copies], "kind string, file_ts long").distinct()
    known = {(r["kind"], r["file_ts"]): r.asDict() for r in read_ledger(spark, f"{target}/ledger").join(F.broadcast(wanted), [*BATCH]).collect()}  # a row a batch of the round
    past = [r.asDict() for r in read_copies(spark, f"{target}/copies").join(F.broadcast(wanted), [*BATCH]).filter("status in ('done', 'failed')").collect()]  # their copies
    tried, queues, log = {r["copy"] for r in past}, {}, []
    for c in sorted(copies, key=lambda c: (c["path"], c["length"])):
        c = c | {"copy": hashlib.md5(f"{c['path']}:{c['length']}".encode()).hexdigest()}
        queue = queues.setdefault((c["kind"], c["file_ts"]), [])
        if c["copy"] not in tried and all(c["copy"] != x["copy"] for x in queue):
            queue.append(c)
    state = {k: known.get(k) or {"kind": k[0], "file_ts": k[1], "round": 0, "status": "pending"} for k in queues}
    for k, s in state.items():
        own = [r for r in past if (r["kind"], r["file_ts"]) == k]
        s["attempts"], s["retry_attempts"] = len(own), sum(r["round"] == s["round"] for r in own)
    while turn := {k: q.pop(0) for k, q in queues.items() if q and state[k]["status"] != "done" and state[k]["retry_attempts"] < most}:
        verdicts = {(v["kind"], v["file_ts"]): v for heads in _sized(spark, [c["path"] for c in turn.values()]) for v in _take_in(spark, heads, target, o)}
        for k, c in turn.items():
            s = state[k]
            s |= verdicts.get(k) or {"row_count": 0, "skipped_rows": 0, "rejected": 0, "status": "failed", "error": "no rows"}
            log.append(c | {"round": s["round"], "tried_at": now} | {x: s[x] for x in ("row_count", "skipped_rows", "rejected", "status", "error")})
            s["attempts"], s["retry_attempts"] = s["attempts"] + 1, s["retry_attempts"] + 1
            s["done_at"] = now if s["status"] == "done" else None
            if s["status"] != "done" and s["retry_attempts"] >= most:
                s["status"] = "exhausted"
    for k, queue in queues.items():
        rest = "spare" if state[k]["status"] == "done" else "waiting"
        log += [c | {"round": state[k]["round"], "tried_at": None, "row_count": 0, "skipped_rows": 0, "rejected": 0, "status": rest, "error": None} for c in queue]
    if log:
        names = [c.split()[0] for c in COPIES.split(", ")]
        write_partials(spark.createDataFrame([tuple(c[x] for x in names) for c in log], COPIES), f"{target}/copies", "copy")
        _write_ledger(spark, [state[k] for k in {(c["kind"], c["file_ts"]) for c in log if c["tried_at"] is not None}], target)


def _write_ledger(spark: SparkSession, rows: list[dict], target: str) -> None:
    names = [c.split()[0] for c in LEDGER.split(", ")]
    if rows:
        write_partials(spark.createDataFrame([tuple(r.get(x) for x in names) for r in rows], LEDGER), f"{target}/ledger")


def ingest_archives(spark: SparkSession, source: str, target: str, checkpoint: str, per_round: int = 32, o: Options = Options(), now: Callable[[], int] = lambda: int(time.time())) -> None:
    """Read new batches of events and articles (bounded a round), check their rows, and write cells, by hour and by day, copies and the ledger by batch.

    The stream follows the heads; all parts of a copy are read in its head's round. A batch with a rejected row is failed and gives no cells. Any
    number of copies of a batch may come, in one round or in many: see ``try_copies``. The ledger is written after the cells.
    """

    def step(files: DataFrame, number: int) -> None:
        heads = batch_key(files.select("path", "length")).filter("kind is not null and file_ts is not null").collect()  # per_round at most
        if heads:
            with freed(spark):
                try_copies(spark, [r.asDict() for r in heads], target, o, now())

    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", HEADS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_round)
    files.load(source).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def reopen(spark: SparkSession, target: str, o: Options = Options(), per_round: int = 32, now: Callable[[], int] = lambda: int(time.time())) -> int:
    """Open exhausted batches for a new round of attempts, and try the copies of theirs that wait. Returns how many were opened."""
    opened = 0
    while rows := [r.asDict() for r in read_ledger(spark, f"{target}/ledger").filter("status = 'exhausted'").orderBy("file_ts", "kind").limit(per_round).collect()]:
        for r in rows:
            r |= {"status": "failed", "round": r["round"] + 1, "retry_attempts": 0}
        _write_ledger(spark, rows, target)
        opened += len(rows)
        wanted = F.broadcast(spark.createDataFrame([(r["kind"], r["file_ts"]) for r in rows], "kind string, file_ts long"))
        waiting = [r.asDict() for r in read_copies(spark, f"{target}/copies").filter("status = 'waiting'").join(wanted, [*BATCH]).select(*BATCH, "path", "length").collect()]
        if waiting:
            with freed(spark):
                try_copies(spark, waiting, target, o, now())
        if any(r["status"] == "exhausted" for r in read_ledger(spark, f"{target}/ledger").join(wanted, [*BATCH]).collect()):
            break  # again used up: not a second time in one call
    return opened


def deduplicated(events: DataFrame, watermark: str) -> DataFrame:
    """The first row of each event id within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def ingest_distinct(spark: SparkSession, rows: DataFrame, target: str, checkpoint: str, ident: str = "event_id", ts: str = "ts") -> None:
    """Append each event once to ``target``, however late its repeats come: no state is kept but the table itself.

    Rows lie by day of their time and round. A round drops its own repeats, then those that the days it touches already hold (repeats carry the
    time of the first); only these days' ids are read. A rerun leaves its own round aside and rewrites its partitions.
    """

    def step(batch: DataFrame, number: int) -> None:
        timed = batch.withColumn("day", F.to_date(ts)).dropDuplicates([ident, "day"]).persist()
        days = [r["day"] for r in timed.select("day").distinct().collect()]  # the days of a round
        if days:
            held = _stored(spark, target, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in timed.schema)}, round long")
            before = held.filter(F.col("day").isin(days) & (F.col("round") != number)).select(ident, "day")
            fresh = timed.join(before, [ident, "day"], "left_anti").withColumn("round", F.lit(number).cast("long"))
            fresh.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "round").parquet(target)
        timed.unpersist()

    rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


WINDOWS = "window_start long, event_type string, n long, total double"


class Windows:
    """Tumbling windows over a stream, in a folder: ``closed`` ones are written once, ``open`` ones are partial sums by round, ``late`` rows came after their window had closed.

    The watermark is the latest time of all rounds before less ``delay``; a window closes in the round in which the watermark passes its end. State is the sums of
    open windows alone: partial sums of closed windows are deleted with their partitions, a round later, so that a rerun of a round finds what it needs.
    Repeats of an event within a round count once, as they do when ``ingest_distinct`` stands before. Null times are late rows.
    """

    def __init__(self, spark: SparkSession, folder: str, size: int = 3600, delay: int = 7200, ident: str = "event_id", ts: str = "ts"):
        self.spark, self.folder, self.size, self.delay, self.ident, self.ts, self.rows = spark, folder, size, delay, ident, ts, ()

    def _read(self, name: str, schema: str) -> DataFrame:
        return _stored(self.spark, f"{self.folder}/{name}", schema)

    def closed(self) -> DataFrame:
        """Windows that no row changes any more."""
        return self._read("closed", f"{WINDOWS}, round long").drop("round")

    def late(self) -> DataFrame:
        """Rows that came too late, as they came, and their round; of streams that ran through this object."""
        return self._read("late", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.rows) + ", round long")

    def marks(self) -> DataFrame:
        """round, latest: the latest time that a round has met."""
        return self._read("marks", "round long, latest long")

    def open(self, before: int | None = None) -> DataFrame:
        """The live view of windows that aren't closed, from all rounds (or those ``before`` one)."""
        rows = self._read("open", f"{WINDOWS}, window_end long, round long")
        rows = rows if before is None else rows.filter(F.col("round") < before)
        done = self._watermark(before)
        return rows.filter(F.col("window_end") > done).groupBy("window_start", "event_type", "window_end").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    def _watermark(self, before: int | None) -> int:
        marks = self.marks() if before is None else self.marks().filter(F.col("round") < before)
        latest = marks.agg(F.max("latest")).first()[0]
        return -(1 << 62) if latest is None else latest - self.delay

    def _write(self, df: DataFrame, name: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.folder}/{name}")

    def step(self, batch: DataFrame, number: int) -> None:
        mark, round_ = self._watermark(number), F.lit(number).cast("long")
        at = F.unix_timestamp(F.col(self.ts).cast("timestamp"))
        rows = batch.dropDuplicates([self.ident]).withColumn("_at", at).withColumn("_start", F.col("_at") - F.pmod("_at", F.lit(self.size))).persist()
        in_time = F.coalesce(F.col("_start") + self.size > mark, F.lit(False))
        self._write(rows.filter(~in_time).drop("_at", "_start").withColumn("round", round_), "late", "round")
        sums = rows.filter(in_time).groupBy(F.col("_start").alias("window_start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        self._write(sums.withColumn("window_end", F.col("window_start") + self.size).withColumn("round", round_), "open", "window_end", "round")
        latest = rows.agg(F.max("_at")).first()[0]
        rows.unpersist()
        self._write(self.spark.createDataFrame([(number, latest)], "round long, latest long"), "marks", "round")
        passed = self._watermark(number + 1)
        held = self._read("open", f"{WINDOWS}, window_end long, round long").filter((F.col("window_end") > mark) & (F.col("window_end") <= passed) & (F.col("round") <= number))
        closing = held.groupBy("window_start", "event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        self._write(closing.withColumn("round", round_), "closed", "round")
        self._forget(mark)

    def _forget(self, mark: int) -> None:
        """Delete the partitions of windows that closed in a round before."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/open")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if system.exists(path):
            for status in system.listStatus(path):
                name = status.getPath().getName()
                if name.startswith("window_end=") and int(name.split("=")[1]) <= mark:
                    system.delete(status.getPath(), True)

    def run(self, rows: DataFrame, checkpoint: str) -> None:
        self.rows = rows.schema
        rows.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tumbling(events: DataFrame, size: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Tumbling windows (hours or days) of an event stream after de-duplication by id."""
    timed = deduplicated(events, watermark)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
