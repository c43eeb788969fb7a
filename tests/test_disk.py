"""What archives and the ingest stream leave on disk, and what they move."""

import zipfile

from pulsegrid.sources.archives import article_records, batch_key, event_rows, read_lines, read_records, write_archives
from pulsegrid.streaming import ingest

LINE = "\t".join({0: "e", 7: "USA", 17: "FRA", 26: "010", 28: "01", 29: "1", 30: "1", 31: "1", 32: "1", 33: "1", 34: "1", 53: "US"}.get(i, "") for i in range(61))


def events(spark, rows=200, batches=3):
    return spark.range(rows * batches).selectExpr("'events' as kind", f"(id % {batches}) * 900 as file_ts", "id as line_no", f"'{LINE}' as line")


def shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def test_archives_are_compressed(spark, tmp_path):
    write_archives(events(spark), f"file://{tmp_path}")
    members = [z.infolist()[0] for z in map(zipfile.ZipFile, tmp_path.glob("*.zip"))]
    assert len(members) >= 3 and all(m.compress_type == zipfile.ZIP_DEFLATED and m.compress_size < m.file_size / 4 for m in members)


def test_no_shuffle_stays(spark, tmp_path):
    before = shuffles(spark)
    write_archives(events(spark), f"file://{tmp_path}/in")
    assert not shuffles(spark) - before
    ingest.ingest_archives(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check")
    assert not shuffles(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_lines_move_once(spark, tmp_path):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("write", "")
    try:
        write_archives(events(spark), f"file://{tmp_path}")
    finally:
        jobs = tracker.getJobIdsForGroup("write")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len({i for j in jobs for i in tracker.getJobInfo(j).stageIds}) <= 3  # the rows, and those that read their one shuffle


def test_a_batch_written_again_replaces_its_parts(spark, tmp_path):
    for part_bytes in (500, 1 << 24):
        write_archives(events(spark, 20), f"file://{tmp_path}", part_bytes)
        assert read_lines(spark, f"{tmp_path}").count() == 60
    write_archives(events(spark, 20).filter("file_ts = 900").limit(5), f"file://{tmp_path}")
    got = batch_key(read_lines(spark, f"{tmp_path}")).groupBy("file_ts").count().collect()
    assert {r["file_ts"]: r["count"] for r in got} == {0: 20, 900: 5, 1800: 20}


def test_records_are_made_where_a_file_is_read(spark, tmp_path):
    head = lambda i: "\t".join([f"2024010100000{i}-1", *[""] * 25, "<PAGE_LINKS>a"])
    files = {"000000": [head(0), "b</PAGE_TITLE>", head(1)], "001500": ["loose", "", head(2), "x" * (1 << 20), "y"], "003000": ["loose"], "004500": [head(3), "b\tc", head(4), head(5), "é"]}
    for stamp, lines in files.items():
        with zipfile.ZipFile(tmp_path / f"20240101{stamp}.gkg.csv.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("a", "\n".join(lines))
    (tmp_path / "20240101010000.gkg.csv.zip").write_bytes(b"no archive")
    cut = tmp_path / "20240101011500.gkg.csv.zip"
    with zipfile.ZipFile(cut, "w") as z:
        z.writestr("a", "\n".join(["loose", *(head(i % 10) for i in range(5000))]))
    cut.write_bytes(cut.read_bytes().replace(b"2024010100000", b"2024010100001", 1))  # its checksum is wrong
    got = read_records(spark, str(tmp_path))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted((r["path"], r["record"], r["line"], r["valid"]) for r in df.collect())
    assert rows(got) == rows(article_records(read_lines(spark, str(tmp_path))))
    by_file = {}
    for path, record, _, valid in rows(got):
        by_file.setdefault(path[-len("000000.gkg.csv.zip"):][:6], []).append((record, valid))
    assert by_file["000000"] == [(1, True), (2, True)] and by_file["001500"] == [(0, False), (1, False)]
    assert by_file["003000"] == by_file["010000"] == [(0, False)] and by_file["004500"] == [(1, False), (2, True), (3, True)]
    assert by_file["011500"][0] == (0, False)


def test_a_round_is_taken_in_by_bytes(spark, tmp_path, monkeypatch):
    write_archives(events(spark), f"file://{tmp_path}/in", 4000)
    taken, take_in = [], ingest._take_in
    monkeypatch.setattr(ingest, "_take_in", lambda s, heads, *rest: (taken.append(heads), take_in(s, heads, *rest))[1])
    size = lambda stamp: sum(p.stat().st_size for p in (tmp_path / "in").glob(f"{stamp}*.zip"))
    monkeypatch.setattr(ingest, "GROUP_BYTES", size("19700101000000") + size("19700101001500"), raising=False)
    ingest.ingest_archives(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check")
    assert sorted(map(len, taken)) == [1, 2]
    assert {(r["file_ts"], r["row_count"], r["status"]) for r in ingest.read_ledger(spark, f"{tmp_path}/out/ledger").collect()} == {(t, 200, "done") for t in (0, 900, 1800)}
    cells = spark.read.parquet(f"{tmp_path}/out/relation").groupBy("granularity").agg({"n_events": "sum"}).collect()
    assert {tuple(r) for r in cells} == {("hour", 600), ("day", 600)}


def test_articles_are_kept_without_their_texts(spark, sf):
    """Their texts were read from the archives and moved once for the rejects and once for the rows."""
    from pathlib import Path

    from pulsegrid import scratch
    from pulsegrid.plans import archived

    folder = Path(scratch.shared(spark).removeprefix("file://"))
    before = set(folder.glob("articles-*"))
    cells = archived.archived_articles(spark, sf)
    assert "BinaryFile" not in cells._jdf.queryExecution().executedPlan().toString()
    (made,) = set(folder.glob("articles-*")) - before
    kept = spark.read.parquet(f"file://{made}")
    assert kept.count() == spark.read.parquet(f"{sf}/documents.parquet").count() and not {"themes", "organizations", "line"} & set(kept.columns)


def test_batches_are_told_once_a_file(spark, tmp_path):
    write_archives(events(spark, 20), f"file://{tmp_path}")
    rows = event_rows(read_lines(spark, str(tmp_path)))
    above, reading = rows._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow", 1)
    assert "regexp_extract" in reading and "regexp_extract" not in above
    assert {(r["kind"], r["file_ts"], r["n"]) for r in rows.groupBy("kind", "file_ts").count().toDF("kind", "file_ts", "n").collect()} == {("events", t, 20) for t in (0, 900, 1800)}
