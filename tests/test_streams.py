"""Copies of batches, attempts and reopening, distinct events, closing windows, and versions that follow changes."""

import zipfile

import pytest

from pulsegrid.operators.ledger import attempt_rollup
from pulsegrid.options import Options
from pulsegrid.plans.snapshot import newest, publish_changed
from pulsegrid.streaming.ingest import Windows, ingest_archives, ingest_distinct, read_copies, read_ledger, reopen

EVENT = {0: "1", 6: "Actor A", 7: "USA", 16: "Actor B", 17: "CHN", 26: "19", 28: "19", 29: "4", 30: "-10", 31: "5", 32: "2", 33: "3", 34: "-2", 53: "US"}
NAME = "20240101000000.export.CSV.zip"
STAMP = 1_704_067_200


def put(folder, rows, broken=False, name=NAME):
    folder.mkdir(parents=True, exist_ok=True)
    fields = {**EVENT, 31: "broken" if broken else "5"}
    with zipfile.ZipFile(folder / name, "w") as z:
        z.writestr("a", "\n".join("\t".join(fields.get(i, "") for i in range(61)) for _ in range(rows)))


def run(spark, tmp_path, check="check", now=100):
    ingest_archives(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/{check}", now=lambda: now)
    (row,) = read_ledger(spark, f"{tmp_path}/out/ledger").collect()
    return row


def cells(spark, tmp_path):
    rows = spark.read.parquet(f"{tmp_path}/out/relation").filter("granularity = 'day'").agg({"n_events": "sum"}).first()
    return rows[0]


def test_a_whole_copy_wins_in_one_round(spark, tmp_path):
    put(tmp_path / "in/a", 3, broken=True)
    put(tmp_path / "in/b", 4)
    put(tmp_path / "in/c", 5)
    for check in ("check", "check", "check-new"):  # a rerun, and one that starts over
        row = run(spark, tmp_path, check)
        assert (row["status"], row["row_count"], row["attempts"], row["error"], row["done_at"]) == ("done", 4, 2, None, 100)
        assert cells(spark, tmp_path) == 4
    copies = {r["path"].split("/")[-2]: (r["status"], r["error"]) for r in read_copies(spark, f"{tmp_path}/out/copies").collect()}
    assert copies == {"a": ("failed", "reject_count"), "b": ("done", None), "c": ("spare", None)}


def test_failed_only_when_all_copies_failed(spark, tmp_path):
    put(tmp_path / "in/a", 3, broken=True)
    (tmp_path / "in/b").mkdir(parents=True)
    (tmp_path / "in/b" / NAME).write_bytes(b"no archive")
    row = run(spark, tmp_path)
    assert (row["status"], row["attempts"], row["retry_attempts"], row["error"], row["done_at"]) == ("failed", 2, 2, "reject_layout", None)
    put(tmp_path / "in/c", 2)
    row = run(spark, tmp_path, now=200)
    assert (row["status"], row["row_count"], row["attempts"], row["done_at"]) == ("done", 2, 3, 200)
    log = read_copies(spark, f"{tmp_path}/out/copies").filter("status in ('done', 'failed')")
    assert attempt_rollup(log, 1000).first()["attempts"] == 3


def test_exhausted_batches_rest_until_reopened(spark, tmp_path):
    for i in range(5):
        put(tmp_path / f"in/a{i}", 1, broken=True)
    assert run(spark, tmp_path)["status"] == "exhausted"
    put(tmp_path / "in/b", 7)
    row = run(spark, tmp_path)
    assert (row["status"], row["attempts"], row["retry_attempts"], row["round"]) == ("exhausted", 5, 5, 0)
    assert read_copies(spark, f"{tmp_path}/out/copies").filter("status = 'waiting'").count() == 1
    assert reopen(spark, f"{tmp_path}/out", Options(), now=lambda: 300) == 1
    (row,) = read_ledger(spark, f"{tmp_path}/out/ledger").collect()
    assert (row["status"], row["row_count"], row["attempts"], row["retry_attempts"], row["round"], row["done_at"]) == ("done", 7, 6, 1, 1, 300)
    assert cells(spark, tmp_path) == 7 and reopen(spark, f"{tmp_path}/out") == 0


EVENTS = "event_id long, event_type string, ts timestamp, value double"


def send(spark, tmp_path, rows):
    spark.createDataFrame(rows, "event_id long, event_type string, at long, value double").selectExpr("event_id", "event_type", "timestamp_seconds(at) as ts", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_distinct_events(spark, tmp_path):
    day = 86_400
    send(spark, tmp_path, [(1, "a", 10, 1.0), (1, "a", 10, 1.0), (2, "b", day, 2.0)])
    stream = send(spark, tmp_path, [(3, "a", 300 * day, 3.0), (1, "a", 10, 1.0), (None, "a", 20, 4.0)])
    ingest_distinct(spark, stream, f"{tmp_path}/out", f"{tmp_path}/check")
    stream = send(spark, tmp_path, [(1, "a", 10, 1.0), (2, "b", day, 2.0), (4, "c", 11, 5.0)])
    ingest_distinct(spark, stream, f"{tmp_path}/out", f"{tmp_path}/check")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("value", "round").collect())
    assert [v for v, _ in got] == [1.0, 2.0, 3.0, 4.0, 5.0] and got[-1] == (5.0, 2)


def test_windows_close_once(spark, tmp_path):
    w = Windows(spark, f"{tmp_path}/out", 3600, 7200)
    rounds = [[(1, "a", 100, 1.0), (2, "a", 3700, 2.0), (2, "a", 3700, 2.0)], [(3, "a", 200, 3.0), (4, "a", 11_000, 4.0)], [(5, "a", 300, 5.0), (6, "a", 3800, 6.0), (7, "b", 40_000, 7.0)], [(8, "a", 52_000, 8.0), (9, "a", 3900, 9.0)]]
    open_windows = []
    for rows in rounds:
        stream = send(spark, tmp_path, rows)
        w.run(stream, f"{tmp_path}/check")
        open_windows.append(w.open().count())
    closed = sorted(tuple(r) for r in w.closed().collect())
    assert closed == [(0, "a", 2, 4.0), (3600, "a", 2, 8.0), (10_800, "a", 1, 4.0), (39_600, "b", 1, 7.0)]
    assert sorted(r["event_id"] for r in w.late().collect()) == [5, 9]
    assert [tuple(r)[:2] for r in w.open().collect()] == [(50_400, "a")]
    assert max(open_windows) <= 2  # the live view, and with it the state, holds no closed window
    kept = [p.name for p in (tmp_path / "out/open").glob("window_end=*")]
    assert "window_end=3600" not in kept and "window_end=7200" not in kept
    w.step(spark.read.schema(EVENTS).parquet(f"{tmp_path}/in").filter("event_id in (8, 9)"), 3)  # a rerun of the last round
    assert sorted(tuple(r) for r in w.closed().collect()) == closed


@pytest.mark.parametrize("change", ["data", "options", "nothing"])
def test_versions_follow_changes(spark, tmp_path, change):
    calls = []

    def views():
        calls.append(1)
        return {("v", 1): spark.range(3).toDF("x")}

    assert newest(spark, str(tmp_path)) is None
    assert publish_changed(spark, views, str(tmp_path), 5, 1, Options()) == "v000000001"
    again = publish_changed(spark, views, str(tmp_path), 6, 2 if change == "data" else 1, Options(prior=21) if change == "options" else Options())
    assert again == (None if change == "nothing" else "v000000002") and len(calls) == (1 if change == "nothing" else 2)
    assert newest(spark, str(tmp_path))["version"] == (again or "v000000001")


def test_compaction_is_followed_and_pinned(spark, tmp_path):
    from pulsegrid.operators.compaction import Compacted, retention
    from pulsegrid.operators.rollup import new_batches, write_partials

    day, keys = 86_400, ("bucket", "geo_country")
    cells = Compacted(spark, f"{tmp_path}/geo", keys)

    def take(*rows):
        write_partials(spark.createDataFrame([("events", ts, g, b, c, n) for ts, g, b, c, n in rows], "kind string, file_ts long, granularity string, bucket long, geo_country string, n_events long"), f"{tmp_path}/geo")

    def read(version=None):
        return sorted(tuple(r)[1:] for r in cells.read(version).select("kind", "granularity", *keys, "n_events").collect())

    take((0, "day", 0, "US", 1), (day, "day", day, "US", 2))
    assert read() == [("day", 0, "US", 1), ("day", day, "US", 2)]
    assert cells.compact() == 1 and cells.compact() is None
    take((900, "day", 0, "US", 5), (900, "hour", 0, "US", 5), (day, "day", day, "US", 2))
    assert read(1) == [("day", 0, "US", 1), ("day", day, "US", 2)]
    want = [("day", 0, "US", 6), ("day", day, "US", 2), ("hour", 0, "US", 5)]
    assert read() == want and cells.compact() == 2 and read() == want and read(2) == want
    assert {(r["day"], r["granularity"]): r["place"] for r in cells.days(2).collect()} == {(0, "day"): 2, (0, "hour"): 2, (day, "day"): 1}
    assert cells.vacuum(1) > 0 and read() == want and cells.versions() == [2] and not [*(tmp_path / "geo").glob("kind=*/file_ts=*")]
    write_partials(spark.createDataFrame([("events", ts, 1, "done") for ts in (0, 900, day)], "kind string, file_ts long, row_count int, status string"), f"{tmp_path}/ledger")
    now = 3 * day + 5
    for made in (3, None):
        assert retention(spark, str(tmp_path), {"geo": keys}, now, 1, 2) == {"geo": made}
        assert read() == [("day", day, "US", 2)]
    ledger = spark.read.parquet(f"{tmp_path}/ledger")
    assert {r["file_ts"]: r["status"] for r in ledger.collect()} == {0: "expired", 900: "expired", day: "done"}
    assert [r["file_ts"] for r in new_batches(ledger.select("kind", "file_ts"), ledger).orderBy("file_ts").collect()] == [0, 900]
    take((0, "day", 0, "US", 7))
    assert read() == [("day", 0, "US", 7), ("day", day, "US", 2)] and cells.compact() == 4


def test_files_of_batches_are_bounded(spark, sf, monkeypatch):
    """Files that the stream is given grow by number: one task that wrote them all would hold the sorters of all its joins."""
    from pulsegrid.plans import catalog

    monkeypatch.setattr(catalog, "MOST_ROWS", 1000, raising=False)
    given = spark.read.parquet(catalog.in_files(spark, sf).removesuffix("/out") + "/in").selectExpr("_metadata.file_path as path")
    assert max(r["count"] for r in given.groupBy("path").count().collect()) <= 1000


def test_batches_are_given_by_bytes(spark, monkeypatch):
    """A batch of many rows is dealt over several tasks: there were as many as batches at most, at any size."""
    from pulsegrid.plans import catalog

    given = []
    monkeypatch.setattr("pulsegrid.streaming.ingest.ingest", lambda s, source, *rest, **more: given.append(source))
    small = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    for name in small:
        spark.conf.set(name, "8k")
    try:
        catalog.ingested(spark, "/root/testdata/sf0.01", late=True)
    except Exception as e:  # nothing was taken in, so there are no cells to read
        assert "PATH_NOT_FOUND" in str(e)
    finally:
        for name in small:
            spark.conf.unset(name)
    rows = spark.read.parquet(given[-1])
    of_batch = max(r["count"] for r in rows.groupBy("file_ts").count().collect())
    of_file = max(r["count"] for r in rows.selectExpr("_metadata.file_path as path").groupBy("path").count().collect())
    assert of_file < of_batch / 2 and rows.count() == spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").count()
