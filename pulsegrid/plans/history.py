"""Registered queries of scores, series of one country, long histories and whole snapshots, and their SQL."""

from __future__ import annotations

import functools
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import coverage, rollup
from ..options import CATEGORIES
from . import bindings as B
from . import catalog as C
from . import snapshot, views
from .catalog import DAY, GEO, GKG, HOME, NOW, REL, SQL, WIN, query, r

# scores -------------------------------------------------------------------------------------------------------------
query("attitude_score", f"with {REL} select root_code, n_events, {r(C.EVID('n_events'), 'evidence')}, {r(C.A_SCORE, 'attitude_score')} from (select root_code, {C.A_SUM} from rel where {WIN} and {HOME} group by 1)")(
    lambda s, sf: S.add_attitude(views.partners(B.rel_cells(s, sf), B.SPAN, B.EVENTS, "root_code"), B.EVENTS).select("root_code", "n_events", "evidence", "attitude_score"))
PARTS = ["evidence", "security", "social", "political", "media", "risk_score"]
query("country_risk_components", f"with {GEO} select geo_country, n_events, {r(C.GEV, 'evidence')}, {r(C.SUB('sec'), 'security')}, {r(C.SUB('soc'), 'social')}, {r(C.SUB('pol'), 'political')}, {r(C.MEDIA, 'media')}, {r(C.RISK, 'risk_score')} from (select geo_country, {C.G_SUM} from geo where {WIN} and geo_country not in ('06','24') group by 1)")(
    lambda s, sf: S.add_country_risk(views.geo_window(B.geo_cells(s, sf), B.SPAN, B.EVENTS, "geo_country"), B.EVENTS).select("geo_country", "n_events", *PARTS))

#: Measures that cells of before the joint model lack.
JOINT = ["modeled_docs", *(f"{c}_modeled_docs" for c in CATEGORIES), "sum_modeled_tone", "sum_negative_tone", *(f"{c}_negative" for c in CATEGORIES)]
OLD = f"bucket%{2 * DAY}=0"
MIXED = f"{GKG}, mixed as (select * replace ({', '.join(f'case when {OLD} then 0 else {c} end as {c}' for c in JOINT)}) from gkg), tot as (select country, {C.E_SUM} from mixed where {C.E_WHERE} group by 1), leg as (select *, greatest(0,total_docs-modeled_docs) as old from tot), mean as (select *, case when old>0 then greatest(0,least(1,-((sum_tone-sum_modeled_tone)/old)/10)) else 0 end as u from leg)"
DENSITY = {**{c: f"greatest(0,least(1,({c}_negative+greatest(0,{c}_docs-{c}_modeled_docs)*u)/total_docs))" for c in CATEGORIES}, "negativity": "greatest(0,least(1,(sum_negative_tone+old*u)/total_docs))"}
SCORE = {c: f"100*pow({d},0.5)*{C.E_EV}/100" for c, d in DENSITY.items()}


def mixed_rows(s, sf):
    """Countries over cells of which every other day was stored before the joint model."""
    old = F.pmod("bucket", F.lit(2 * DAY)) == 0
    cells = B.gkg_cells(s, sf)
    return views.enterprise_rows(cells.withColumns({c: F.when(~old, F.col(c)).otherwise(F.lit(0)).cast(dict(cells.dtypes)[c]) for c in JOINT}), B.ART_SPAN, B.ARTICLES, "country")


query("enterprise_density", f"with {MIXED} select country, total_docs, {', '.join(r(d, c + '_density') for c, d in DENSITY.items())} from mean")(
    lambda s, sf: mixed_rows(s, sf).select("country", "total_docs", *(f"{c}_density" for c in DENSITY)))
query("enterprise_score", f"with {MIXED} select country, {', '.join(r(x, c + '_score') for c, x in SCORE.items())}, {r('+'.join(f'{w}*{x}' for w, x in zip(B.ARTICLES.enterprise, SCORE.values())), 'risk_score')} from mean where total_docs>=20")(
    lambda s, sf: mixed_rows(s, sf).filter(F.col("total_docs") >= B.ARTICLES.min_docs).select("country", *(f"{c}_score" for c in SCORE), "risk_score"))
query("joint_coverage", f"with {MIXED} select country, modeled_docs, {r('100.0*modeled_docs/total_docs', 'joint_coverage')}, case when modeled_docs>=total_docs then 'measured' else 'legacy-estimate' end as measure from mean")(
    lambda s, sf: mixed_rows(s, sf).select("country", "modeled_docs", "joint_coverage", "measure"))

# series -------------------------------------------------------------------------------------------------------------
FILL = f"dc as (select geo_country, bucket, cast(sum(n_events) as bigint) as n from geo where {WIN} and geo_country not in ('06','24') group by 1,2)"
FILLED = f"(select * from cov where bucket>={C.START}) c cross join (select distinct geo_country from dc) e left join dc on dc.geo_country=e.geo_country and dc.bucket=c.bucket"


def filled(s, sf):
    points = views.daily_counts(B.geo_cells(s, sf), B.SPAN, B.EVENTS)
    return coverage.gap_fill(points, points, "geo_country", B.SPAN, ["n_events"])


query("gap_fill", f"with {GEO}, {C.COV}, {FILL} select e.geo_country, c.bucket, coalesce(n,0) as n_events from {FILLED}")(filled)
query("coverage_mask", f"with {GEO}, {C.COV}, {FILL} select e.geo_country, c.bucket, case when c.done then coalesce(n,0) end as n_events, cast(c.done as bigint) as collected, c.expected, c.complete from {FILLED}")(
    lambda s, sf: coverage.mask(filled(s, sf), B.day_coverage(s, sf), ["n_events"]))
query("view_attitude_series", f"select * from ({SQL['trend_attitude']}) where actor1='N03'")(
    lambda s, sf: views.trend_attitude(B.rel_cells(s, sf), B.day_coverage(s, sf), B.SPAN, B.EVENTS, "N03"))
query("view_country_risk_series", f"select * from ({SQL['trend_country_risk']}) where geo_country='03'")(
    lambda s, sf: views.trend_country_risk(B.geo_cells(s, sf), B.geo_cells(s, sf), B.day_coverage(s, sf), B.day_coverage(s, sf, 31), B.SPAN, B.EVENTS, "03"))
DOCS = ["total_docs", "alias_docs", *(f"{c}_docs" for c in CATEGORIES)]


query("view_enterprise_series", f"""with {GKG}, p as (select bucket, {C.E_SUM} from gkg where country='EN' and bucket>={C.E_START} and bucket<{C.E_NOW} group by 1)
select c.bucket, 'EN' as country, {', '.join(f'case when done>0 then coalesce({d},0) end as {d}' for d in DOCS)}, case when done>0 then {'round(sum_tone/total_docs,6)+0.0'} end as avg_tone, done as collected, c.expected, c.complete
from {C.cover_sql('art', C.E_START, C.E_END + DAY, DAY, C.E_NOW, 900)} c left join p on p.bucket=c.bucket""")(
    lambda s, sf: views.series_enterprise(B.gkg_cells(s, sf), B.art_coverage(s, sf), B.ART_SPAN, "EN", B.ARTICLES))

# histories ----------------------------------------------------------------------------------------------------------
#: Every bucket with a row is scored, so that the scores of small tables show.
EVENTS, ARTICLES = replace(B.EVENTS, min_events=1), replace(B.ARTICLES, min_docs=1)
LONGEST = min(1185, max(snapshot.RANGES) + 90)
HOURS_NOW = 1_704_067_200 + 10 * DAY


def histories(s, sf, events: coverage.Span, articles: coverage.Span, slot: int):
    ev, art = B.ev(s, sf), B.art(s, sf)
    cover = lambda rows, kind, span, size: coverage.coverage_buckets(x := rows.select(F.lit(kind).alias("kind"), "file_ts").distinct(), x, span.start, span.end + span.step, span.step, span.now, size)
    rel, geo, gkg = rollup.rollup_relation(ev, events.grain), rollup.rollup_geo(ev, events.grain), rollup.rollup_articles(art, articles.grain, ARTICLES)
    own = cover(ev, "events", events, slot)
    risk = views.trend_country_risk(geo, rollup.to_day(geo, rollup.GEO_KEYS), own, B.day_coverage(s, sf, 31), events, EVENTS)
    return views.history({
        "attitude": (views.trend_attitude(rel, own, events, EVENTS), "actor1", "n_events", "attitude_score"),
        "overview_all": (views.trend_global(rel, own, events, EVENTS), "scope", "n_events", "attitude_score"),
        "country_risk": (risk, "geo_country", "n_events", "risk_score"),
        "enterprise_risk": (views.trend_enterprise(gkg, cover(art, "gkg", articles, 900), articles, ARTICLES), "country", "total_docs", "risk_score"),
    })


def history_sql(events: coverage.Span, articles: coverage.Span, slot: int) -> str:
    inside = lambda span: f"bucket >= {span.start} and bucket < {span.now}"

    def part(view: str, key: str, points: str, score: str, cover: str) -> str:
        return f"""select '{view}' as view, e.{key} as code, c.bucket, case when done>0 then coalesce(n,0) end as n, case when done>0 then {score} end as score, done as collected, c.expected, c.complete
from {cover} c cross join (select distinct {key} from {points}) e left join {points} p on p.bucket=c.bucket and p.{key}=e.{key}"""

    as_is = "round(score,6)+0.0"
    own, docs = (C.cover_sql(table, span.start, span.end + span.step, span.step, span.now, size) for table, span, size in (("ev", events, slot), ("art", articles, 900)))
    return f"""with {C.EV}, rel as ({C.rel_sql(events.step)}), geo as ({C.geo_sql(events.step)}), {GKG.replace(f'file_ts%{DAY}', f'file_ts%{articles.step}')},
pa as (select actor1, bucket, n_events as n, {C.A_SCORE} as score from (select actor1, bucket, {C.A_SUM} from rel where {inside(events)} and {HOME} group by 1,2)),
po as (select 'all' as scope, bucket, n_events as n, {C.A_SCORE} as score from (select bucket, {C.A_SUM} from rel where {inside(events)} and {C.TOWARDS} group by 1)),
pr as (select geo_country, bucket, n_events as n, {C.RISK} as score from (select geo_country, bucket, {C.G_SUM} from geo where {inside(events)} and geo_country not in ('06','24') group by 1,2)),
pe as (select country, bucket, total_docs as n, {C.E_RISK} as score from (select country, bucket, {C.E_SUM} from gkg where {inside(articles)} and country not in ('ES','S9') group by 1,2))
{part('attitude', 'actor1', 'pa', as_is, own)} union all {part('overview_all', 'scope', 'po', as_is, own)} union all {part('country_risk', 'geo_country', 'pr', as_is, own)} union all {part('enterprise_risk', 'country', 'pe', as_is, docs)}"""


for name, spans in (("history_daily", (coverage.Span(LONGEST, NOW), coverage.Span(LONGEST, B.ART_AS_OF), DAY)), ("history_hourly", (coverage.Span(9, NOW, True), coverage.Span(9, HOURS_NOW, True), 900))):
    query(name, history_sql(*spans))(lambda s, sf, spans=spans: histories(s, sf, *spans))


# snapshots ----------------------------------------------------------------------------------------------------------
def built(s, sf):
    """All views and series over all ranges from one version of the cells, published and read back: rankings by code, series and event types as sums by code.

    All views of relations look towards the home actor, so of the pairs only those are cells.
    """
    path = f"{C.shared(s)}/build-{uuid.uuid4().hex}"
    ev, art, cells = B.ev(s, sf), B.art(s, sf), {}
    hours = {
        "rel": (rollup.rollup_relation(ev.filter(views.towards_home(B.EVENTS)), "hour"), rollup.RELATION_KEYS), "geo": (rollup.rollup_geo(ev, "hour"), rollup.GEO_KEYS),
        "gkg": (rollup.rollup_articles(art.withColumn("file_ts", F.col("file_ts") - SHIFT), "hour", B.ARTICLES), rollup.ARTICLE_KEYS),
    }
    for name, (made, keys) in hours.items():
        stored = B.stored(made, name)
        cells[name] = {"hour": stored, "day": B.stored(rollup.to_day(stored, keys), name)}
    slots = cells["geo"]["day"].select(F.lit("events").alias("kind"), F.col("bucket").alias("file_ts")).distinct()
    slots = B.stored(slots.union(cells["gkg"]["hour"].select(F.lit("gkg"), "bucket").distinct()), "slots")
    own = {k: slots.filter(F.col("kind") == k) for k in ("events", "gkg")}
    cover = functools.cache(lambda kind, span: coverage.coverage_buckets(own[kind], own[kind], span.start, span.end + span.step, span.step, span.now, span.step))
    grain = lambda name: lambda span: cells[name][span.grain]
    rel, geo, gkg, days = grain("rel"), grain("geo"), grain("gkg"), B.day_coverage(s, sf, cells=cells["geo"]["day"])
    made = {
        "overview": snapshot.View(lambda span: views.overview_countries(rel(span), span, B.EVENTS), "code"),
        "attitude": snapshot.View(lambda span: views.attitude(rel(span), span, B.EVENTS), "actor1"),
        "country_risk": snapshot.View(lambda span: views.country_risk(geo(span), cells["geo"]["day"], days, span, B.EVENTS), "geo_country"),
        "enterprise_risk": snapshot.View(lambda span: views.enterprise_risk(gkg(span), span, B.ARTICLES), "country", "gkg"),
        "attitude_series": snapshot.View(lambda span: views.trend_attitude(rel(span), cover("events", span), span, B.EVENTS), "actor1"),
        "overview_series": snapshot.View(lambda span: views.trend_global(rel(span), cover("events", span), span, B.EVENTS), "scope"),
        "country_risk_series": snapshot.View(lambda span: views.trend_country_risk(geo(span), cells["geo"]["day"], cover("events", span), days, span, B.EVENTS), "geo_country"),
        "enterprise_series": snapshot.View(lambda span: views.trend_enterprise(gkg(span), cover("gkg", span), span, B.ARTICLES), "country", "gkg"),
        "event_types": snapshot.View(lambda span: views.event_types(rel(span), span, B.EVENTS), "actor1"),
    }
    snapshot.build(made, snapshot.RANGES, path, "v1", NOW, slots, DAY, C.VERSIONS)
    out = None
    for view, count, score in SHOWN:
        for d in snapshot.RANGES:
            rows, key = snapshot.read_view(s, path, "v1", view, d), F.col(made[view].key).alias("code")
            if score:
                part = rows.select(key, F.col(score).alias("score"), F.col(count).alias("n"), F.col("rank").cast("long").alias("rank"))
            else:
                part = rows.groupBy(key).agg(F.lit(None).cast("double").alias("score"), F.coalesce(F.sum(count), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("rank"))
            part = part.select(F.lit(view).alias("view"), F.lit(d).alias("days"), "code", "score", "n", "rank")
            out = part if out is None else out.unionByName(part)
    return out


#: Articles are moved back to the days of the events, so that one clock serves both.
SHIFT = B.ART_AS_OF - NOW // DAY * DAY
SHOWN = (
    ("overview", "n_events", "conflict_share"), ("attitude", "n_events", "attitude_score"), ("country_risk", "n_events", "risk_score"), ("enterprise_risk", "total_docs", "risk_score"),
    ("attitude_series", "n_events", None), ("overview_series", "n_events", None), ("country_risk_series", "n_events", None), ("enterprise_series", "total_docs", None), ("event_types", "n_events", None),
)


def built_sql() -> str:
    parts = []
    for d in snapshot.RANGES:
        span = coverage.Span(d, NOW)
        inside, size = f"bucket >= {span.start} and bucket < {NOW}", "h" if span.grain == "hour" else "d"
        points = (span.end - span.start) // span.step + 1
        over = lambda n, by="n desc, code": f"cast(row_number() over (order by {by}) as bigint) as rank"
        risky = "geo_country not in ('06','24')"
        parts += [
            f"select 'overview' as view, {d} as days, code, {r('100.0*q34/n', 'score')}, n, {over('n')} from (select actor1 as code, sum(n_quad3)+sum(n_quad4) as q34, cast(sum(n_events) as bigint) as n from rel_{size} where {inside} and {C.TOWARDS} and actor1<>'N24' group by 1)",
            f"select 'attitude', {d}, code, {r(C.A_SCORE, 'score')}, n_events, {over('n', 'n_events desc, code')} from (select actor1 as code, {C.A_SUM} from rel_{size} where {inside} and {HOME} group by 1)",
            f"select 'country_risk', {d}, geo_country, {r('score', 'score')}, n_events, {over('n', 'round(score,1) desc, geo_country')} from (select geo_country, n_events, {C.RISK} as score from (select geo_country, {C.G_SUM} from geo_{size} where {inside} and {risky} group by 1) where n_events>=20)",
            f"select 'enterprise_risk', {d}, country, {r('score', 'score')}, total_docs, {over('n', 'round(score,1) desc, country')} from (select country, total_docs, {C.E_RISK} as score from (select country, {C.E_SUM} from gkg_{size} where {inside} and country not in ('ES','S9') group by 1) where total_docs>=20)",
            f"select 'event_types', {d}, actor1, null, cast(sum(n_events) as bigint), count(distinct root_code) from rel_{size} where {inside} and {C.TOWARDS} group by 3",
        ]
        cover = lambda source: C.cover_sql(source, span.start, span.end + span.step, span.step, NOW, span.step)  # noqa: B023, E731
        for view, table, key, n, where, source in (
            ("attitude_series", "rel", "actor1", "n_events", HOME, "geo_d_slots"), ("country_risk_series", "geo", "geo_country", "n_events", risky, "geo_d_slots"),
            ("enterprise_series", "gkg", "country", "total_docs", "country not in ('ES','S9')", "gkg_h_slots"),
        ):
            parts.append(f"select '{view}', {d}, {key}, null, cast(coalesce(sum(case when c.done>0 then {n} end), 0) as bigint), cast({points} as bigint) from (select * from {table}_{size} where {inside} and {where}) x left join {cover(source)} c on c.bucket=x.bucket group by 3")
        parts.append(f"select 'overview_series', {d}, 'all', null, cast(coalesce(sum(case when c.done>0 then n_events end), 0) as bigint), cast({points} as bigint) from (select * from rel_{size} where {inside} and {C.TOWARDS}) x left join {cover('geo_d_slots')} c on c.bucket=x.bucket")
    tables = ", ".join(f"{k}_{g} as ({f(n)})" for g, n in (("h", 3600), ("d", DAY)) for k, f in (("rel", C.rel_sql), ("geo", C.geo_sql)))
    gkg = GKG.replace("cast(1704067200+(doc_id%2880)*900 as bigint) as file_ts", f"cast(1704067200+(doc_id%2880)*900-{SHIFT} as bigint) as file_ts")
    hourly = gkg[gkg.index("gkg as ("):].replace("gkg as (", "gkg_h as (").replace(f"file_ts%{DAY}", "file_ts%3600")
    gkg = gkg.replace("gkg as (", "gkg_d as (") + ", " + hourly
    slots = "geo_d_slots as (select distinct bucket as file_ts from geo_d), gkg_h_slots as (select distinct bucket as file_ts from gkg_h)"
    return f"with {C.EV}, {tables}, {gkg}, {slots} " + " union all ".join(parts)


query("snapshot_build", built_sql())(built)
