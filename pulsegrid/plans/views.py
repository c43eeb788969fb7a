"""Composite views over the cell tables: rankings and series, all countries in one grouped scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import DAY, add_attitude, add_country_risk, add_enterprise_risk
from ..operators.coverage import Span, gap_fill, mask, momentum, momentum_series
from ..operators.rank import ranked
from ..operators.rollup import masses, window_agg
from ..options import CATEGORIES, Options

ATTITUDE = ["n_events", "sum_mentions", "sum_w", "sum_gold_w", "sum_quad_w", "sum_tone_w", "sum_gold", "sum_tone", "n_quad3", "n_quad4"]
ENTERPRISE = ["total_docs", "alias_docs", "modeled_docs", "sum_tone", "sum_polarity", "sum_modeled_tone", "sum_negative_tone", *(f"{c}_{m}" for c in CATEGORIES for m in ("docs", "modeled_docs", "negative"))]
GEO = ["n_events", "sum_w", "sum_tone", "n_quad3", "n_quad4"]


def partners(rel: DataFrame, span: Span, o: Options, *keys: str) -> DataFrame:
    where = (F.col("actor2") == o.home_actor) & (F.col("actor1") != o.home_actor) & ~F.col("actor1").isin(*o.excluded_actors)
    return window_agg(rel, span.start, span.now, keys, ATTITUDE, where)


def attitude(rel: DataFrame, span: Span, o: Options = Options()) -> DataFrame:
    """Partners by attitude towards the home actor; thin ones are marked, not dropped."""
    rows = add_attitude(partners(rel, span, o, "actor1"), o).withColumn("thin", F.col("n_events") < o.min_events)
    return ranked(rows.select("actor1", "n_events", "sum_mentions", "evidence", "attitude_score", "avg_goldstein", "avg_tone", "conflict_share", "thin"), "n_events", "actor1")


def only(cells: DataFrame, key: str, country: str | None, points: DataFrame | None = None) -> DataFrame:
    """Cells of one country, or all; given ``points``, whose keys a series is drawn for: the country even where it has none."""
    if country is None:
        return cells if points is None else points
    return cells.filter(F.col(key) == country) if points is None else cells.sparkSession.range(1).select(F.lit(country).alias(key))


RELATION_SERIES = ["n_events", "sum_mentions", "attitude_score", "avg_goldstein", "avg_tone"]


def trend_attitude(rel: DataFrame, coverage: DataFrame, span: Span, o: Options = Options(), country: str | None = None) -> DataFrame:
    """Counts and scores by bucket; where there are no events, counts are 0 and scores are null."""
    rel = only(rel, "actor1", country)
    points = add_attitude(partners(rel, span, o, "actor1", "bucket"), o).select("actor1", "bucket", *RELATION_SERIES)
    return mask(gap_fill(points, only(rel, "actor1", country, points), "actor1", span, RELATION_SERIES[:2]), coverage, RELATION_SERIES)


def towards_home(o: Options):
    return (F.col("actor2") == o.home_actor) & (F.col("actor1") != o.home_actor)


def trend_global(rel: DataFrame, coverage: DataFrame, span: Span, o: Options = Options(), where=None) -> DataFrame:
    """The series of everyone towards the home actor, or of other pairs."""
    sums = window_agg(rel, span.start, span.now, ["bucket"], ATTITUDE, towards_home(o) if where is None else where)
    points = add_attitude(sums, o).select(F.lit("all").alias("scope"), "bucket", *RELATION_SERIES)
    one = rel.sparkSession.range(1).select(F.lit("all").alias("scope"))
    return mask(gap_fill(points, one, "scope", span, RELATION_SERIES[:2]), coverage, RELATION_SERIES)


def geo_window(geo: DataFrame, span: Span, o: Options, *keys: str) -> DataFrame:
    where = ~F.col("geo_country").isin(o.home_geo, *o.excluded_geo)
    return window_agg(geo, span.start, span.now, keys, [*(F.sum(m).cast("double" if m.startswith("sum_w") or m == "sum_tone" else "long").alias(m) for m in GEO), *masses(o), F.sum(F.when(F.col("root_code").isin(*o.security_roots), F.col("n_events")).otherwise(0)).alias("n_security")], where)


def daily_counts(geo_days: DataFrame, span: Span, o: Options = Options()) -> DataFrame:
    start = span.start - span.start % DAY
    return window_agg(geo_days, start, span.now, ["geo_country", "bucket"], ["n_events"], ~F.col("geo_country").isin(o.home_geo, *o.excluded_geo))


def country_risk(geo: DataFrame, geo_days: DataFrame, coverage_days: DataFrame, span: Span, o: Options = Options()) -> DataFrame:
    """Countries with enough events by risk score; momentum is shown beside it, never in it."""
    rows = add_country_risk(geo_window(geo, span, o, "geo_country"), o).filter(F.col("n_events") >= o.min_events)
    moved = momentum(daily_counts(geo_days, span, o), coverage_days, "geo_country", span.now - span.now % DAY, span.start, o.momentum_days, o.sensitivity)
    rows = rows.join(moved, "geo_country", "left").withColumn("momentum_available", F.col("momentum").isNotNull()).fillna(50.0, ["momentum"])
    rows = rows.withColumn("shown", F.round("risk_score", 1))
    columns = ["geo_country", "n_events", "evidence", "security", "social", "political", "media", "conflict", "avg_tone", "risk_score", "momentum", "momentum_available"]
    return ranked(rows, "shown", "geo_country").select(*columns, "rank")


def trend_country_risk(geo: DataFrame, geo_days: DataFrame, coverage: DataFrame, coverage_days: DataFrame, span: Span, o: Options = Options(), country: str | None = None) -> DataFrame:
    geo, geo_days = only(geo, "geo_country", country), only(geo_days, "geo_country", country)
    points = add_country_risk(geo_window(geo, span, o, "geo_country", "bucket"), o)
    score = F.when(F.col("n_events") >= o.min_events, F.col("risk_score")).alias("risk_score")
    points = points.select("geo_country", "bucket", "n_events", F.col("n_security").alias("security"), (F.col("n_quad3") + F.col("n_quad4")).alias("conflict"), "avg_tone", score, "evidence")
    filled = gap_fill(points, only(geo, "geo_country", country, points), "geo_country", span, ["n_events", "security", "conflict"])
    moved = momentum_series(daily_counts(geo_days, Span(span.length + 31, span.now), o), coverage_days, "geo_country", o.momentum_days, 30, o.sensitivity)
    filled = filled.withColumn("_day", F.col("bucket") - F.pmod("bucket", F.lit(DAY))).join(moved.withColumnRenamed("bucket", "_day"), ["geo_country", "_day"], "left").drop("_day")
    filled = filled.withColumn("momentum_available", F.col("momentum").isNotNull()).drop("momentum")
    return mask(filled, coverage, ["n_events", "risk_score", "evidence", "security", "conflict", "avg_tone", "momentum_available"])


def enterprise_rows(gkg: DataFrame, span: Span, o: Options, *keys: str) -> DataFrame:
    return add_enterprise_risk(window_agg(gkg, span.start, span.now, keys, ENTERPRISE, ~F.col("country").isin(o.home_geo, *o.excluded_geo)), o)


def enterprise_risk(gkg: DataFrame, span: Span, o: Options = Options()) -> DataFrame:
    rows = enterprise_rows(gkg, span, o, "country").filter(F.col("total_docs") >= o.min_docs).withColumn("shown", F.round("risk_score", 1))
    columns = ["country", "total_docs", "alias_docs", "evidence", *(f"{c}_score" for c in (*CATEGORIES, "negativity")), "risk_score", "joint_coverage", "measure", "avg_tone", "avg_polarity"]
    return ranked(rows, "shown", "country").select(*columns, "rank")


def trend_enterprise(gkg: DataFrame, coverage: DataFrame, span: Span, o: Options = Options()) -> DataFrame:
    docs = ["total_docs", "alias_docs", *(f"{c}_docs" for c in CATEGORIES)]
    points = enterprise_rows(gkg, span, o, "country", "bucket")
    score = F.when(F.col("total_docs") >= o.min_docs, F.col("risk_score")).alias("risk_score")
    ev = F.when(F.col("total_docs") >= o.min_docs, F.col("evidence")).alias("evidence")
    points = points.select("country", "bucket", *docs, "avg_tone", score, ev, "joint_coverage")
    return mask(gap_fill(points, points, "country", span, docs), coverage, [*docs, "avg_tone", "risk_score", "evidence", "joint_coverage"])


def series_enterprise(gkg: DataFrame, coverage: DataFrame, span: Span, country: str, o: Options = Options()) -> DataFrame:
    """One country's articles by bucket: all, with an alias, by category, and their mean tone (null where there are none)."""
    docs = ["total_docs", "alias_docs", *(f"{c}_docs" for c in CATEGORIES)]
    rows = only(gkg, "country", country)
    points = window_agg(rows, span.start, span.now, ["country", "bucket"], [*docs, "sum_tone"])
    points = points.withColumn("avg_tone", F.try_divide(F.col("sum_tone"), F.col("total_docs"))).drop("sum_tone")
    return mask(gap_fill(points, only(rows, "country", country, points), "country", span, docs), coverage, [*docs, "avg_tone"])


def history(parts: dict[str, tuple[DataFrame, str, str, str | None]]) -> DataFrame:
    """Trends by name, each with its key, count and score columns, under one shape."""
    out = None
    for view, (df, key, count, score) in parts.items():
        part = df.select(F.lit(view).alias("view"), F.col(key).alias("code"), "bucket", F.col(count).alias("n"), F.col(score).alias("score"), "collected", "expected", "complete")
        out = part if out is None else out.unionByName(part)
    return out


def event_types(rel: DataFrame, span: Span, o: Options = Options(), key: str = "actor1") -> DataFrame:
    """Root codes of each country towards the home actor by count, with their place, impact and mean score."""
    rows = window_agg(rel, span.start, span.now, [key, "root_code"], ["n_events", "sum_absgold_w", "sum_gold"], towards_home(o))
    rows = rows.select(key, "root_code", "n_events", (F.lit(10.0) * F.col("sum_absgold_w")).alias("impact"), (F.lit(10.0) * F.col("sum_gold") / F.greatest("n_events", F.lit(1))).alias("avg_goldstein"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n_events"), "root_code")))


def pair_filter(o: Options, country: str | None):
    """Everyone towards the home actor, or one country towards all others; and the side whose actors are the partners."""
    if country is None:
        return towards_home(o), "actor1"
    return (F.col("actor1") == country) & (F.col("actor2") != country), "actor2"


def overview(rel: DataFrame, span: Span, o: Options = Options(), country: str | None = None) -> DataFrame:
    """One row of totals: everyone towards the home actor, or one country towards all others."""
    where, side = pair_filter(o, country)
    extra = [F.countDistinct(F.when(~F.col(side).isin(*o.excluded_actors), F.col(side))).alias("partners"), (F.lit(10.0) * F.coalesce(F.sum("sum_absgold_w"), F.lit(0.0))).alias("impact")]
    rows = window_agg(rel, span.start, span.now, [], [*ATTITUDE, "sum_sources", "sum_articles", *extra], where)
    return add_attitude(rows, o).select("n_events", "sum_mentions", "sum_sources", "sum_articles", "partners", "impact", "evidence", "attitude_score", "avg_goldstein", "avg_tone", "conflict_share")


def _by(rel: DataFrame, span: Span, o: Options, key: str, where) -> DataFrame:
    shown = ["n_events", "sum_mentions", "avg_goldstein", "avg_tone", "conflict_count", "conflict_share"]
    sums = window_agg(rel, span.start, span.now, [key], ATTITUDE, where)
    return add_attitude(sums, o).withColumn("conflict_count", F.col("n_quad3") + F.col("n_quad4")).select(F.col(key).alias("code"), *shown)


def overview_countries(rel: DataFrame, span: Span, o: Options = Options(), country: str | None = None) -> DataFrame:
    """The partners of an overview by count."""
    where, side = pair_filter(o, country)
    return ranked(_by(rel, span, o, side, where).filter(~F.col("code").isin(*o.excluded_actors)), "n_events", "code")


def overview_parts(rel: DataFrame, coverage: DataFrame, span: Span, o: Options = Options(), country: str | None = None, roots: int = 12) -> dict[str, DataFrame]:
    """What an overview holds beside its totals: partners by count, the first root codes, quad classes, and the series."""
    where, _ = pair_filter(o, country)
    return {
        "countries": overview_countries(rel, span, o, country),
        "event_roots": ranked(_by(rel, span, o, "root_code", where), "n_events", "code").filter(F.col("rank") <= roots),
        "quad_classes": quads(rel, span, where),
        "series": trend_global(rel, coverage, span, o, where),
    }


def stamped(df: DataFrame, summary: DataFrame, versions: dict[str, object]) -> DataFrame:
    """A view with the coverage of its source in the window (one row of ``coverage_summary``) and with its versions."""
    one = summary.select("expected", "done", "percent", F.col("complete_buckets").alias("complete_days"), "last_ts", "stale")
    return df.crossJoin(F.broadcast(one)).withColumns({k: F.lit(v) for k, v in versions.items()})  # one row


def quads(rel: DataFrame, span: Span, where=None) -> DataFrame:
    """Quad classes as rows."""
    row = window_agg(rel, span.start, span.now, [], [f"n_quad{i}" for i in (1, 2, 3, 4)], where)
    return row.unpivot([], [f"n_quad{i}" for i in (1, 2, 3, 4)], "quad", "n_events").withColumn("quad", F.substring("quad", 7, 1).cast("int"))


def brief(att: DataFrame, risk: DataFrame, firm: DataFrame, k: int = 8) -> DataFrame:
    """The first k of three rankings, under one shape."""
    rows = [
        att.select(F.lit("attitude").alias("section"), F.col("actor1").alias("code"), F.col("attitude_score").alias("score"), "rank"),
        risk.select(F.lit("country_risk").alias("section"), F.col("geo_country").alias("code"), F.col("risk_score").alias("score"), "rank"),
        firm.select(F.lit("enterprise_risk").alias("section"), F.col("country").alias("code"), F.col("risk_score").alias("score"), "rank"),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).filter(F.col("rank") <= k)


def focus(att: DataFrame, risk: DataFrame, firm: DataFrame, types: DataFrame, actor: str, geo: str, k: int = 8) -> DataFrame:
    """One country in the three rankings, and its first k root codes, under the brief's shape."""
    whole = brief(att, risk, firm, 1 << 30)
    code = F.when(F.col("section") == "attitude", F.lit(actor)).otherwise(F.lit(geo))
    rows = whole.filter(F.col("code") == code).withColumn("section", F.concat(F.lit("focus_"), "section"))
    mix = types.filter((F.col("actor1") == actor) & (F.col("place") <= k))
    return rows.unionByName(mix.select(F.lit("focus_event_mix").alias("section"), F.col("root_code").alias("code"), F.col("n_events").cast("double").alias("score"), F.col("place").alias("rank")))


def pack_series(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A row a key: arrays of buckets and measures in time order."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bucket", *columns))).alias("p"))
    return rows.select(key, *(F.col("p")[c].alias(c) for c in ("bucket", *columns)))


def expand_series(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.select(key, F.inline(F.arrays_zip("bucket", *columns)))
