"""Hand-computed values of scores, momentum, options and archive readers."""

import zipfile

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scores as S
from pulsegrid.functions.fields import theme_categories
from pulsegrid.operators.coverage import coverage_buckets, momentum
from pulsegrid.operators.ledger import attempt_rollup, progress
from pulsegrid.operators.rollup import masses, rollup_geo, rollup_relation, write_partials
from pulsegrid.options import THEMES, Options
from pulsegrid.plans.snapshot import content_hash
from pulsegrid.sources.archives import article_records, batch_key, checked_articles, checked_events, event_rows, parts_of, read_lines, write_archives
from pulsegrid.streaming.ingest import ingest_archives


@pytest.fixture(scope="module")
def hundred(spark):
    row = (0, "USA", "CHN", "US", "19", 4, -10.0, 5, 2, 3, -2.0)
    return spark.createDataFrame([row] * 100, "file_ts long, actor1 string, actor2 string, geo string, root_code string, quad int, goldstein double, mentions int, sources int, articles int, tone double")


def test_golden_scores(hundred):
    rel = S.add_attitude(rollup_relation(hundred)).first()
    assert rel["sum_w"] == pytest.approx(150) and rel["sum_quad_w"] == pytest.approx(-150)
    assert rel["attitude_score"] == pytest.approx(-76.6, abs=0.05)
    geo = rollup_geo(hundred)
    cell = geo.groupBy("geo_country").agg(*(F.sum(c).alias(c) for c in ("n_events", "sum_w", "sum_tone", "n_quad3", "n_quad4")), *masses())
    assert S.add_country_risk(cell).first()["risk_score"] == pytest.approx(77.1, abs=0.05)


@pytest.mark.parametrize(("last", "want"), [(200, 75.0), (None, 25.0)])
def test_golden_momentum(spark, last, want):
    days = [86_400 * i for i in range(3)]
    rows = [("US", d, n) for d, n in zip(days, (100, 100, last)) if n]
    daily = spark.createDataFrame(rows, "geo_country string, bucket long, n_events long")
    cover = spark.createDataFrame([(d, True) for d in days], "bucket long, complete boolean")
    assert momentum(daily, cover, "geo_country", 86_400 * 3, 0).first()["momentum"] == want


def test_filters_stay_behind_the_status(spark):
    """A filter that is moved before the status repeats its whole expression, in which each use of a number casts its text again."""
    from pulsegrid.functions.fields import with_event_status

    text = ("actor1", "actor2", "geo", "event_code", "root_code", "quad", "goldstein", "sources", "articles", "mentions", "tone")
    rows = spark.createDataFrame([("USA", "CHN", "US", "19", "19", "4", "1.5", "2", m, "5", "0") for m in ("3", "x", "")], ", ".join(f"{c} string" for c in text))
    good = with_event_status(rows).filter("row_status = 'ok'")
    assert [r["articles"] for r in good.collect()] == ["3", ""]
    assert good._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 6  # a number each


def test_options_are_checked():
    for bad in ({"attitude": (0.7, 0.2, 0.2)}, {"security_roots": ("14",)}, {"prior": 0}, {"power": 2}, {"momentum_days": 31}, {"min_docs": 0}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_archives(spark, tmp_path):
    def put(name, *members):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for n, text in members:
                z.writestr(n, text)

    fields = [""] * 61
    fields[7], fields[17], fields[28], fields[53] = " usa", "CHN", "19", "us"
    short = [""] * 58
    short[51] = "FR"
    put("20240101001500.export.CSV.zip", ("a", "\n".join("\t".join(f) for f in (fields, short, [""] * 60))))
    put("20240101003000.export.CSV.zip", ("a", "x"), ("b", "y"))
    lines = read_lines(spark, str(tmp_path))
    assert lines.filter("error is not null").count() == 1
    rows = event_rows(lines.filter("error is null")).orderBy("line_no").collect()
    assert [(r["actor1"], r["geo"], r["layout_ok"]) for r in rows] == [("USA", "US", True), ("", "FR", True), ("", "", False)]
    assert rows[0]["kind"] == "events" and rows[0]["file_ts"] == 1_704_068_100
    head = ["20240101000000-1", *[""] * 25, "<PAGE_LINKS>a"]
    text = [(0, "\t".join(head)), (1, "more</PAGE_TITLE>"), (2, "\t".join(["x", *[""] * 26])), (3, "short")]
    got = article_records(spark.createDataFrame([("20240101001500.gkg.csv.zip", n, t) for n, t in text], "path string, line_no long, line string")).orderBy("record").collect()
    assert [r["valid"] for r in got] == [True, False]
    assert batch_key(spark.createDataFrame([("x/bad.zip",)], "path string")).first()["file_ts"] is None


def test_archives_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "20240101001500.export.CSV.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "20240101003000.export.CSV.zip", "w") as z:
        z.writestr("a", "")
    got = checked_events(read_lines(spark, str(tmp_path))).collect()
    assert [r["row_status"] for r in got] == ["reject_layout"] * 2


def test_archive_name_without_a_batch(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "today.zip", "w") as z:
        z.writestr("a", "\t" * 60)
    assert checked_events(read_lines(spark, str(tmp_path))).first()["row_status"] == "reject_name"


@pytest.mark.parametrize(
    ("lines", "valid"),
    [
        (["<PAGE_LINKS>a", "b", "", "c</PAGE_TITLE>"], True),
        (["<PAGE_LINKS>a", "b</PAGE_TITLE>", "c"], False),
        (["<PAGE_LINKS>a</PAGE_TITLE>", "b"], False),
        (["a", "b"], False),
        (["<PAGE_LINKS>a", "b\tc"], False),
        (["<PAGE_LINKS>a", "20240101000000-2"], False),
        (["<PAGE_LINKS>a", "x" * (1 << 20)], True),
        (["<PAGE_LINKS>a", "x" * (1 << 20), "y"], False),
    ],
)
def test_continued_records(spark, lines, valid):
    head = "\t".join(["20240101000000-1", *[""] * 25, lines[0]])
    rows = [("20240101001500.gkg.csv.zip", i, t) for i, t in enumerate([head, *lines[1:]])]
    got = article_records(spark.createDataFrame(rows, "path string, line_no long, line string")).collect()
    assert [r["valid"] for r in got] == [valid]


@pytest.mark.parametrize(
    ("places", "tones", "status"),
    [
        ("1#a#us#x;1#b#US#x;1#c#FR#x;1#d#CH#x", "-2,1,2,3", "ok"), ("1#d#CH#x", "", "skip_country"), ("1#a#US#x", " ,1", "skip_tone"), ("1#a#US#x", "nan,1,2,3", "reject_tone"),
        ("1#a#US#x", "1,1,1,inf", "reject_tone"), ("1#a#US#x", "1.5d", "reject_tone"), ("1#a#US#x", "1.5", "ok"), ("", "x", "skip_country"),
    ],
)
def test_article_rows(spark, places, tones, status):
    line = "\t".join(["1", *[""] * 8, places, *[""] * 5, tones, *[""] * 11])
    row = checked_articles(spark.createDataFrame([("20240101001500.gkg.csv.zip", 1, line, True)], "path string, record long, line string, valid boolean")).first()
    assert row["row_status"] == status
    assert status != "ok" or row["countries"] in (["FR", "US"], ["US"])


EVENT = {0: "1", 6: "Actor A", 7: "USA", 16: "Actor B", 17: "CHN", 26: "19", 28: "19", 29: "4", 30: "-10", 31: "5", 32: "2", 33: "3", 34: "-2", 53: "US"}


@pytest.mark.parametrize(
    ("changes", "status"),
    [
        ({}, "ok"), ({29: "4.0", 31: "5e0"}, "ok"), ({30: ""}, "skip_score"), ({34: ""}, "skip_score"), ({31: ""}, "ok"),
        ({31: "nan"}, "reject_count"), ({31: "inf"}, "reject_count"), ({31: "1.5"}, "reject_count"), ({31: "broken"}, "reject_count"), ({29: "x"}, "reject_count"), ({32: "5d"}, "reject_count"),
        ({26: "---", 28: "--", 30: ""}, "skip_placeholder"), ({26: "---", 28: "---", 30: "x"}, "skip_placeholder"), ({26: "---", 28: "--"}, "reject_enum"), ({26: "--", 28: "--", 30: ""}, "reject_enum"),
        ({28: ""}, "reject_enum"), ({28: "21"}, "reject_enum"), ({29: "5"}, "reject_enum"), ({29: ""}, "reject_enum"), ({30: "broken", 34: ""}, "reject_score"), ({34: "inf"}, "reject_score"),
        ({31: "-1"}, "reject_negative"), ({31: "-1", 30: ""}, "reject_negative"), ({7: "TWN", 31: "broken"}, "skip_region"), ({53: "hk"}, "skip_region"),
    ],
)
def test_event_rows(spark, changes, status):
    fields = {**EVENT, **changes}
    line = "\t".join(fields.get(i, "") for i in range(61))
    rows = checked_events(spark.createDataFrame([("20240101001500.export.CSV.zip", 0, line, None)], "path string, line_no long, line string, error string"))
    assert rows.first()["row_status"] == status


def test_coverage_stops_at_the_horizon(spark):
    day, slots = 86_400, [(900 * i,) for i in range(24)]
    rows = spark.createDataFrame(slots, "file_ts long").selectExpr("'events' as kind", "file_ts")
    now = coverage_buckets(rows, rows, 0, day, day, 24 * 900 + 100).first()
    assert (now["expected"], now["done"], now["complete"]) == (24, 24, False)
    cut = coverage_buckets(rows, rows, 0, 12 * 900, day, 2 * day).first()
    assert (cut["expected"], cut["done"], cut["complete"]) == (12, 12, True)
    assert coverage_buckets(rows, rows, day, 2 * day, day, day).first()["expected"] == 0


def test_progress_and_attempts(spark):
    rows = spark.createDataFrame([("events", 0, "done"), ("gkg", 900, "failed")], "kind string, file_ts long, status string")
    got = progress(rows, 0, 3600).first()
    assert (got["total"], got["percent"], got["pending"] + got["unseeded"], got["finished"]) == (8, 12.5, 6, False)
    assert progress(rows, 0, 0).first()["percent"] == 100.0
    log = spark.createDataFrame([("events", 0, r) for r in (1, 1, 1, 1, 1, 2)] + [("events", 900, 1)] * 5, "kind string, file_ts long, round int")
    by = {r["file_ts"]: r for r in attempt_rollup(log, 1000).collect()}
    assert (by[0]["attempts"], by[0]["round_attempts"], by[0]["exhausted"], by[0]["next_retry"]) == (6, 1, False, 1120)
    assert (by[900]["exhausted"], by[900]["next_retry"]) == (True, 0)


def test_hash_of_many_rows(spark):
    assert int(content_hash(spark.range(100_000).selectExpr("id % 3 as x")).first()["rows"]) == 100_000


def test_cells_must_be_finite(spark, tmp_path):
    rows = spark.createDataFrame([("events", 0, float("nan"))], "kind string, file_ts long, sum_w double")
    with pytest.raises(Exception, match="finite"):
        write_partials(rows, f"{tmp_path}/cells")


@pytest.mark.parametrize("themes", [["TAX_ECON_PRICE"], ["ECON_TRADE", "x"], ["KILL"], ["SKILLS"], ["WB_KILL_X"], ["TRADE"], ["a|KILL|b"], ["econ_x", "Medical"], [], None])
def test_themes(spark, themes):
    plain = []
    for name, markers in THEMES.items():
        if any(f"_{m.rstrip('_')}_" in f"_{t.upper()}_" for t in themes or [] for m in markers):
            plain.append(name)
    got = spark.createDataFrame([(themes,)], "t array<string>").select(theme_categories("t", THEMES).alias("c")).first()["c"]
    assert got == plain


def test_archives_round_trip(spark, tmp_path):
    rows = [(kind, 900 * b, i, f"{kind} {b} {i} \u00e9\t") for kind in ("events", "gkg") for b in range(3) for i in range(5)]
    lines = spark.createDataFrame(rows, "kind string, file_ts long, line_no long, line string")
    for _ in range(2):
        write_archives(lines, str(tmp_path))
    got = batch_key(read_lines(spark, str(tmp_path))).select("kind", "file_ts", "line_no", "line").collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_archives_of_a_large_batch(spark, tmp_path):
    lines = spark.range(200).selectExpr("'gkg' as kind", "900L as file_ts", "id as line_no", "concat(id, ' ', repeat('x', 90), '\n', 'y') as line")
    for _ in range(2):
        write_archives(lines, f"file://{tmp_path}", 2000)
    names = [p.name for p in tmp_path.glob("[0-9]*.zip")]
    assert len(names) > 5 and "19700101001500.gkg.csv.zip" in names
    for name in names:
        with zipfile.ZipFile(tmp_path / name) as z:
            assert z.infolist()[0].file_size <= 2000
    got = batch_key(read_lines(spark, str(tmp_path), 2000))
    assert got.filter("error is not null or kind <> 'gkg' or file_ts <> 900").count() == 0
    assert sorted(r["line"] for r in got.collect()) == sorted(x for r in lines.collect() for x in r["line"].split("\n"))
    assert parts_of(spark, [f"file://{tmp_path}/19700101001500.gkg.csv.zip"]).count() == len(names)


@pytest.mark.parametrize("per_round", [1, 32])
def test_stream_of_a_batch_in_parts(spark, tmp_path, per_round):
    places = {0: "'e'", 7: "'USA'", 17: "'FRA'", 26: "'010'", 28: "'01'", 29: "'1'", 30: "'1'", 31: "if(file_ts = 900 and id = 77, 'broken', '1')", 32: "'1'", 33: "'1'", 34: "'1'", 53: "'US'"}
    line = f"concat_ws('\t', {', '.join(places.get(i, repr('')) for i in range(61))})"
    lines = spark.range(100).selectExpr("id", "explode(array(0L, 900L)) as file_ts").selectExpr("'events' as kind", "file_ts", "id as line_no", f"{line} as line")
    write_archives(lines, f"file://{tmp_path}/in", 1000)
    ingest_archives(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", per_round)
    got = spark.read.parquet(f"{tmp_path}/out/ledger").orderBy("file_ts").collect()
    assert [(r["file_ts"], r["row_count"], r["rejected"], r["status"]) for r in got] == [(0, 100, 0, "done"), (900, 99, 1, "failed")]
    assert [(r["file_ts"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out/relation").filter("granularity = 'day'").groupBy("file_ts").agg({"n_events": "sum"}).toDF("file_ts", "n").collect()] == [(0, 100)]
