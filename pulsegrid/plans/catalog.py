"""Registered queries of the event and article operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields
from ..functions import scores as S
from ..operators import coverage, dims, ledger, rank, rollup
from ..options import CATEGORIES
from . import bindings as B
from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY, START, NOW, END = 86_400, B.SPAN.start, B.AS_OF, B.SPAN.end
L_START, L_END = 1_704_067_200, 1_706_659_200


def plain(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that the order of sums doesn't show."""
    return df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf: plain(f(spark, sf))
        if sql:
            SQL[name] = sql
        return f

    return add


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 as {name}"


EV = """ev as (select cast(floor(epoch(o_orderdate)/900)*900 as bigint) as file_ts, concat('N',lpad(cast(c_nationkey as varchar),2,'0')) as actor1,
  concat('N',lpad(cast(s_nationkey as varchar),2,'0')) as actor2, lpad(cast(s_nationkey as varchar),2,'0') as geo,
  lpad(cast(l_partkey%20+1 as varchar),2,'0') as root_code, cast(l_linenumber%4+1 as int) as quad, (cast(l_quantity as double)-25)/2.5 as goldstein,
  cast(l_quantity as int) as mentions, cast(l_linenumber as int) as sources, cast(l_linenumber+1 as int) as articles, (cast(l_tax as double)-0.05)*200 as tone,
  l_orderkey as order_id, l_linenumber as line_id
  from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey join supplier on l_suppkey=s_suppkey),
m as (select *, 1+least(greatest(mentions,0),20)/10.0 as w, greatest(-1,least(1,goldstein/10)) as g, greatest(-1,least(1,tone/10)) as t,
  case quad when 1 then 0.4 when 2 then 1 when 3 then -0.4 else -1 end as q from ev)"""
COUNTS = "count(*) as n_events, cast(sum(mentions) as bigint) as sum_mentions, cast(sum(sources) as bigint) as sum_sources, " + ", ".join(f"count(*) filter (quad={i}) as n_quad{i}" for i in (1, 2, 3, 4))
BOTH = [("sum_w", "sum(cast(w as double))"), ("sum_gold_w", "sum(g*w)"), ("sum_tone_w", "sum(t*w)"), ("sum_gold", "sum(g)"), ("sum_tone", "sum(t)")]
MORE = [("sum_quad_w", "sum(cast(q as double)*w)"), ("sum_absgold_w", "sum(abs(g)*w)")]
as_is = lambda ms: ", ".join(f"{e} as {k}" for k, e in ms)
REL_WHERE = "length(actor1)=3 and length(actor2)=3 and actor1<>actor2"


def rel_sql(step: int = DAY) -> str:
    return f"select file_ts-file_ts%{step} as bucket, actor1, actor2, root_code, {COUNTS}, {as_is(BOTH)}, cast(sum(articles) as bigint) as sum_articles, {as_is(MORE)} from m where {REL_WHERE} group by 1,2,3,4"


def geo_sql(step: int = DAY) -> str:
    return f"select file_ts-file_ts%{step} as bucket, geo as geo_country, root_code, {COUNTS}, {as_is(BOTH)} from m where length(geo)=2 group by 1,2,3"


REL, GEO = f"{EV}, rel as ({rel_sql()})", f"{EV}, geo as ({geo_sql()})"
ROUND = lambda names: ", ".join(f"round({n},6)+0.0 as {n}" for n in names)
D = [k for k, _ in BOTH]
WIN = f"bucket >= {START} and bucket < {NOW}"
EVID = lambda n, p=20: f"round(100.0*{n}/({n}+{p}.0),1)"


def cover_sql(source: str, start: int, end: int, step: int, now: int, slot: int) -> str:
    """bucket, expected, done, complete of the file_ts of a table."""
    horizon = now - now % slot
    last = min(end, horizon)
    return f"""(select *, expected>0 and done=expected and bucket+{step}<={horizon} as complete from (select g as bucket, cast(greatest(0, least(g+{step},{last})-greatest(g,{start}))//{slot} as bigint) as expected, count(distinct a.file_ts-a.file_ts%{slot}) as done
  from (select unnest(generate_series({start - start % step},{end - 1},{step})) as g) left join (select distinct file_ts from {source}) a on a.file_ts>=greatest(g,{start}) and a.file_ts<least(g+{step},{last}) group by 1))"""


# rollups ------------------------------------------------------------------------------------------------------------
query("rollup_relation", f"with {REL} select * replace ({ROUND([*D, 'sum_quad_w', 'sum_absgold_w'])}) from rel")(B.rel_cells)
query("rollup_geo", f"with {GEO} select * replace ({ROUND(D)}) from geo")(B.geo_cells)
query("dual_grain", f"with {GEO} select * replace ({ROUND(D)}) from geo")(lambda s, sf: rollup.to_day(rollup.rollup_geo(B.ev(s, sf), "hour"), rollup.GEO_KEYS))
query("merge_partials", f"with {GEO} select * replace ({ROUND(D)}) from geo")(lambda s, sf: rollup.merge_partials(rollup.rollup_geo(B.ev(s, sf), "day", "file_ts").drop("file_ts"), rollup.GEO_KEYS))

ART = """art as (select doc_id, cast(1704067200+(doc_id%2880)*900 as bigint) as file_ts, list_value(upper(lang), concat('S',right(source,1))) as countries,
  cast(n_chars%41-20 as double)/2 as tone, cast(n_chars%7 as double) as polarity, lower(text) as organizations, upper(lang) as lg,
  list_transform(list_filter(string_split_regex(text,'[^A-Za-z]+'), lambda x: x<>''), lambda x: upper(lang)||'_'||upper(x)) as themes from documents)"""
HAS = {c: f"len(list_filter(themes, lambda x: contains('_'||x||'_', '_{B.MARKERS[c][0]}_')))>0" for c in CATEGORIES}
ALIAS = "regexp_matches(organizations, '(^|[^a-z0-9])(que|that)($|[^a-z0-9])')"
GKG = f"""{ART}, marked as (select *, {', '.join(f'{h} as h_{c}' for c, h in HAS.items())}, {ALIAS} as alias, greatest(0,least(1,-tone/10)) as neg from art),
one as (select *, unnest(list_distinct(countries)) as country from marked),
gkg as (select file_ts-file_ts%{DAY} as bucket, country, count(*) as total_docs, {', '.join(f'count(*) filter (h_{c}) as {c}_docs' for c in CATEGORIES)},
  count(*) filter (alias) as alias_docs, count(*) as modeled_docs, {', '.join(f'count(*) filter (h_{c}) as {c}_modeled_docs' for c in CATEGORIES)},
  sum(tone) as sum_tone, sum(polarity) as sum_polarity, sum(tone) as sum_modeled_tone, sum(neg) as sum_negative_tone,
  {', '.join(f'sum(case when h_{c} then neg else 0 end) as {c}_negative' for c in CATEGORIES)} from one group by 1,2)"""
GD = ["sum_tone", "sum_polarity", "sum_modeled_tone", "sum_negative_tone", *(f"{c}_negative" for c in CATEGORIES)]
query("rollup_articles", f"with {GKG} select * replace ({ROUND(GD)}) from gkg")(B.gkg_cells)

# grouped windows ----------------------------------------------------------------------------------------------------
SUMS = "cast(sum(n_events) as bigint) as n_events, round(sum(sum_w),6)+0.0 as sum_w, round(sum(sum_gold_w),6)+0.0 as sum_gold_w"
M3 = ["n_events", "sum_w", "sum_gold_w"]
query("window_agg", f"with {REL} select {SUMS} from rel where {WIN}")(lambda s, sf: rollup.window_agg(B.rel_cells(s, sf), START, NOW, [], M3))
for name, key in (("by_partner", "actor1"), ("by_bucket", "bucket"), ("by_root", "root_code")):
    query(name, f"with {REL} select {key}, {SUMS} from rel where {WIN} group by 1")(lambda s, sf, key=key: rollup.window_agg(B.rel_cells(s, sf), START, NOW, [key], M3))
query("quad_distribution", f"with {REL} " + " union all ".join(f"select {i} as quad, cast(coalesce(sum(n_quad{i}),0) as bigint) as n_events from rel where {WIN}" for i in (1, 2, 3, 4)))(lambda s, sf: views.quads(B.rel_cells(s, sf), B.SPAN))
GROUPS = {"sec": B.EVENTS.security_roots, "soc": B.EVENTS.social_roots, "pol": B.EVENTS.political_roots}
MASS = ", ".join(f"sum(case when root_code in ({', '.join(repr(x) for x in roots)}) then greatest(0,-sum_gold_w) else 0 end) as w_{k}" for k, roots in GROUPS.items())
query("risk_masses", f"with {GEO} select geo_country, {', '.join(r(p.rsplit(' as ', 1)[0], p.rsplit(' as ', 1)[1]) for p in MASS.split(', sum(') and [('sum(' if i else '') + x for i, x in enumerate(MASS.split(', sum('))])} from geo where {WIN} group by 1")(
    lambda s, sf: rollup.window_agg(B.geo_cells(s, sf), START, NOW, ["geo_country"], rollup.masses(B.EVENTS)))
query("daily_counts", f"with {GEO} select geo_country, bucket, cast(sum(n_events) as bigint) as n_events from geo where {WIN} and geo_country not in ('06','24') group by 1,2")(lambda s, sf: views.daily_counts(B.geo_cells(s, sf), B.SPAN, B.EVENTS))

# views --------------------------------------------------------------------------------------------------------------
A_SUM = "cast(sum(n_events) as bigint) as n_events, cast(sum(sum_mentions) as bigint) as sum_mentions, sum(sum_w) as sw, sum(sum_gold_w) as sg, sum(sum_quad_w) as sq, sum(sum_tone_w) as st, sum(sum_gold) as gold, sum(sum_tone) as tone, sum(n_quad3)+sum(n_quad4) as q34"
A_SCORE = f"coalesce(100*((0.7*sg+0.2*sq+0.1*st)/nullif(sw,0)),0)*{EVID('n_events')}/100"
HOME = "actor2='N06' and actor1<>'N06' and actor1<>'N24'"
ATT = f"att as (select actor1, n_events, sum_mentions, {r(EVID('n_events'), 'evidence')}, {r(A_SCORE, 'attitude_score')}, {r('10*gold/n_events', 'avg_goldstein')}, {r('10*tone/n_events', 'avg_tone')}, {r('100.0*q34/n_events', 'conflict_share')}, n_events<20 as thin, cast(row_number() over (order by n_events desc, actor1) as int) as rank from (select actor1, {A_SUM} from rel where {WIN} and {HOME} group by 1))"
query("view_attitude", f"with {REL}, {ATT} select * from att")(lambda s, sf: views.attitude(B.rel_cells(s, sf), B.SPAN, B.EVENTS))
HORIZON = NOW - NOW % DAY
COV = f"""days as (select distinct file_ts-file_ts%{DAY} as bucket from ev),
cov as (select g as bucket, d.bucket is not null as done, cast(case when g<{HORIZON} then 1 else 0 end as bigint) as expected, d.bucket is not null and g+{DAY} <= {HORIZON} as complete from (select unnest(generate_series({START - 31 * DAY},{END},{DAY})) as g) left join days d on d.bucket=g and d.bucket<{HORIZON})"""
POINT = f"n_events, sum_mentions, {A_SCORE} as attitude_score, 10*gold/n_events as avg_goldstein, 10*tone/n_events as avg_tone"
SHOWN = "case when c.done then coalesce(n_events,0) end as n_events, case when c.done then coalesce(sum_mentions,0) end as sum_mentions, " + ", ".join(f"case when c.done then round({x},6)+0.0 end as {x}" for x in ("attitude_score", "avg_goldstein", "avg_tone")) + ", cast(c.done as bigint) as collected, c.expected, c.complete"
query("trend_attitude", f"""with {REL}, {COV}, p as (select actor1, bucket, {POINT} from (select actor1, bucket, {A_SUM} from rel where {WIN} and {HOME} group by 1,2))
select c.bucket, e.actor1, {SHOWN}
from (select * from cov where bucket>={START}) c cross join (select distinct actor1 from p) e left join p on p.bucket=c.bucket and p.actor1=e.actor1""")(lambda s, sf: views.trend_attitude(B.rel_cells(s, sf), B.day_coverage(s, sf), B.SPAN, B.EVENTS))
TOWARDS = "actor2='N06' and actor1<>'N06'"
query("trend_global", f"""with {REL}, {COV}, p as (select bucket, {POINT} from (select bucket, {A_SUM} from rel where {WIN} and {TOWARDS} group by 1))
select c.bucket, 'all' as scope, {SHOWN}
from (select * from cov where bucket>={START}) c left join p on p.bucket=c.bucket""")(lambda s, sf: views.trend_global(B.rel_cells(s, sf), B.day_coverage(s, sf), B.SPAN, B.EVENTS))

G_SUM = f"cast(sum(n_events) as bigint) as n_events, sum(sum_w) as sw, sum(sum_tone) as tone, sum(n_quad3)+sum(n_quad4) as q34, {MASS}"
DENS = lambda k: f"greatest(0,least(1,w_{k}/(case when coalesce(sw,0)=0 then 1 else sw end)))"
GEV = EVID("n_events")
MEDIA = f"(greatest(0,least(100,greatest(0,-10*tone/n_events)/8*100))*{GEV}/100)"
RISK = f"(0.9*100*pow(greatest(0,least(1,({DENS('sec')}*0.5+{DENS('soc')}*0.25+{DENS('pol')}*0.15)/0.5)),0.5)*{GEV}/100+0.1*{MEDIA})"
SUB = lambda k: f"100*pow({DENS(k)},0.5)*{GEV}/100"
TODAY = NOW - NOW % DAY
MOM = f"""dc as (select geo_country, bucket, sum(n_events) as n from geo where {WIN} and geo_country not in ('06','24') group by 1,2),
mom as (select geo_country, case when count(*) filter (recent and complete)=1 and avg(n) filter (not recent and complete) is not null
  then greatest(0,least(100,50+25*(sum(n) filter (recent)/greatest(avg(n) filter (not recent and complete),1)-1))) end as momentum
  from (select k.geo_country, c.complete, c.bucket >= {TODAY - DAY} as recent, coalesce(dc.n,0) as n from (select distinct geo_country from dc) k cross join (select * from cov where bucket >= {START} and bucket < {TODAY}) c left join dc on dc.geo_country=k.geo_country and dc.bucket=c.bucket) group by 1)"""
query("momentum", f"with {GEO}, {COV}, {MOM} select geo_country, round(momentum,6)+0.0 as momentum from mom")(lambda s, sf: coverage.momentum(views.daily_counts(B.geo_cells(s, sf), B.SPAN, B.EVENTS), B.day_coverage(s, sf), "geo_country", TODAY, START))
CR = f"""cr as (select geo_country, n_events, {GEV} as evidence, {SUB('sec')} as security, {SUB('soc')} as social, {SUB('pol')} as political, {MEDIA} as media, 100.0*q34/n_events as conflict, 10*tone/n_events as avg_tone, {RISK} as risk_score
  from (select geo_country, {G_SUM} from geo where {WIN} and geo_country not in ('06','24') group by 1) where n_events>=20)"""
CR_VIEW = f"""select cr.geo_country, n_events, {ROUND(['evidence', 'security', 'social', 'political', 'media', 'conflict', 'avg_tone', 'risk_score'])}, round(coalesce(momentum,50),6)+0.0 as momentum, momentum is not null as momentum_available,
cast(row_number() over (order by round(risk_score,1) desc, cr.geo_country) as int) as rank from cr left join mom on mom.geo_country=cr.geo_country"""
def stored_geo(s, sf, since=None):
    """Day cells written once; of a view that looks back to ``since``, only those from then on, so that older rows end at the scan."""
    cells = B.geo_cells(s, sf)
    return B.stored(cells if since is None else cells.filter(F.col("bucket") >= since), "geo")


def ranked_risk(s, sf):
    geo = stored_geo(s, sf, START)
    return views.country_risk(geo, geo, B.day_coverage(s, sf, cells=geo), B.SPAN, B.EVENTS)


def risk_trend(s, sf, country=None):
    geo = stored_geo(s, sf, START - 31 * DAY)
    return views.trend_country_risk(geo, geo, B.day_coverage(s, sf, cells=geo), B.day_coverage(s, sf, 31, geo), B.SPAN, B.EVENTS, country)


country_risk = query("view_country_risk", f"with {GEO}, {COV}, {MOM}, {CR} {CR_VIEW}")(ranked_risk)
query("rank_countries", f"with {GEO}, {CR} select geo_country, round(risk_score,6)+0.0 as risk_score, cast(row_number() over (order by round(risk_score,1) desc, geo_country) as int) as rank from cr")(
    lambda s, sf: rank.ranked(S.add_country_risk(views.geo_window(B.geo_cells(s, sf), B.SPAN, B.EVENTS, "geo_country"), B.EVENTS).filter("n_events >= 20").withColumn("shown", F.round("risk_score", 1)), "shown", "geo_country").select("geo_country", "risk_score", "rank"))
SERIES = f"""dcs as (select geo_country, bucket, sum(n_events) as n from geo where bucket >= {START - 31 * DAY} and bucket < {NOW} and geo_country not in ('06','24') group by 1,2),
ms0 as (select k.geo_country, c.bucket, c.complete, coalesce(dcs.n,0) as n from (select distinct geo_country from dcs) k cross join cov c left join dcs on dcs.geo_country=k.geo_country and dcs.bucket=c.bucket),
ms as (select geo_country, bucket, sum(cast(complete as int)) over r as fresh, sum(n) over r as now_n, avg(case when complete then n end) over b as base from ms0
  window r as (partition by geo_country order by bucket range between {DAY} preceding and {DAY} preceding), b as (partition by geo_country order by bucket range between {30 * DAY} preceding and {2 * DAY} preceding)),
mser as (select geo_country, bucket, case when fresh=1 and base is not null then greatest(0,least(100,50+25*(now_n/greatest(base,1)-1))) end as momentum from ms)"""
query("momentum_series", f"with {GEO}, {COV}, {SERIES} select geo_country, bucket, round(momentum,6)+0.0 as momentum from mser")(lambda s, sf: coverage.momentum_series(views.daily_counts(B.geo_cells(s, sf), coverage.Span(396, NOW), B.EVENTS), B.day_coverage(s, sf, 31), "geo_country"))
SECURITY = f"cast(sum(case when root_code in {B.EVENTS.security_roots} then n_events else 0 end) as bigint) as n_sec"
query("trend_country_risk", f"""with {GEO}, {COV}, {SERIES}, p as (select geo_country, bucket, n_events, n_sec as security, cast(q34 as bigint) as conflict, 10*tone/n_events as avg_tone, case when n_events>=20 then {RISK} end as risk_score, {GEV} as evidence from (select geo_country, bucket, {SECURITY}, {G_SUM} from geo where {WIN} and geo_country not in ('06','24') group by 1,2))
select c.bucket, e.geo_country, {', '.join(f'case when c.done then coalesce({x},0) end as {x}' for x in ('n_events', 'security', 'conflict'))}, {', '.join(f'case when c.done then round({x},6)+0.0 end as {x}' for x in ('avg_tone', 'risk_score', 'evidence'))},
case when c.done then mser.momentum is not null end as momentum_available, cast(c.done as bigint) as collected, c.expected, c.complete
from (select * from cov where bucket>={START}) c cross join (select distinct geo_country from p) e left join p on p.bucket=c.bucket and p.geo_country=e.geo_country left join mser on mser.bucket=c.bucket and mser.geo_country=e.geo_country""")(
    risk_trend)

E_START, E_NOW, E_END = B.ART_SPAN.start, B.ART_AS_OF, B.ART_SPAN.end
E_SUM = ", ".join([*(f"cast(sum({c}) as bigint) as {c}" for c in ("total_docs", "alias_docs", "modeled_docs", *(f"{k}_{m}" for k in CATEGORIES for m in ("docs", "modeled_docs")))), *(f"sum({c}) as {c}" for c in GD)])
E_EV = EVID("total_docs")
E_DENS = {**{c: f"greatest(0,least(1,{c}_negative/total_docs))" for c in CATEGORIES}, "negativity": "greatest(0,least(1,sum_negative_tone/total_docs))"}
E_SC = {c: f"100*pow({d},0.5)*{E_EV}/100" for c, d in E_DENS.items()}
E_RISK = "(" + "+".join(f"{w}*{s}" for w, s in zip(B.ARTICLES.enterprise, E_SC.values())) + ")"
E_WHERE = f"bucket >= {E_START} and bucket < {E_NOW} and country not in ('ES','S9')"
ENT = f"""ent as (select country, total_docs, alias_docs, {r(E_EV, 'evidence')}, {', '.join(r(s, c + '_score') for c, s in E_SC.items())}, {r(E_RISK, 'risk_score')}, round(100.0*modeled_docs/total_docs,6)+0.0 as joint_coverage, 'measured' as measure,
{r('sum_tone/total_docs', 'avg_tone')}, {r('sum_polarity/total_docs', 'avg_polarity')}, cast(row_number() over (order by round({E_RISK},1) desc, country) as int) as rank from (select country, {E_SUM} from gkg where {E_WHERE} group by 1) where total_docs>=20)"""
query("view_enterprise_risk", f"with {GKG}, {ENT} select * from ent")(lambda s, sf: views.enterprise_risk(B.gkg_cells(s, sf), B.ART_SPAN, B.ARTICLES))
query("trend_enterprise", f"""with {GKG}, acov as (select * from {cover_sql('art', E_START, E_END + DAY, DAY, E_NOW, 900)}),
p as (select country, bucket, total_docs, alias_docs, {', '.join(f'{c}_docs' for c in CATEGORIES)}, sum_tone/total_docs as avg_tone, case when total_docs>=20 then {E_RISK} end as risk_score, case when total_docs>=20 then {E_EV} end as evidence, 100.0*modeled_docs/total_docs as joint_coverage from (select country, bucket, {E_SUM} from gkg where {E_WHERE} group by 1,2))
select c.bucket, e.country, {', '.join(f'case when done>0 then coalesce({x},0) end as {x}' for x in ('total_docs', 'alias_docs', *(f'{c}_docs' for c in CATEGORIES)))}, {', '.join(f'case when done>0 then round({x},6)+0.0 end as {x}' for x in ('avg_tone', 'risk_score', 'evidence', 'joint_coverage'))},
done as collected, expected, complete
from acov c cross join (select distinct country from p) e left join p on p.bucket=c.bucket and p.country=e.country""")(lambda s, sf: views.trend_enterprise(B.gkg_cells(s, sf), B.art_coverage(s, sf), B.ART_SPAN, B.ARTICLES))
query("view_brief", f"with {REL}, geo as ({geo_sql()}), {COV}, {CR}, {ATT}, {GKG}, {ENT}, crr as (select geo_country, round(risk_score,6)+0.0 as risk_score, cast(row_number() over (order by round(risk_score,1) desc, geo_country) as int) as rank from cr) select * from (select 'attitude' as section, actor1 as code, attitude_score as score, rank from att union all select 'country_risk', geo_country, risk_score, rank from crr union all select 'enterprise_risk', country, risk_score, rank from ent) where rank<=8")(
    lambda s, sf: views.brief(views.attitude(B.rel_cells(s, sf), B.SPAN, B.EVENTS), country_risk(s, sf), views.enterprise_risk(B.gkg_cells(s, sf), B.ART_SPAN, B.ARTICLES)))
OVER = (("home", None, TOWARDS, "actor1"), ("partner", "N03", "actor1='N03' and actor2<>'N03'", "actor2"))
C34 = "cast(q34 as bigint) as conflict_count"
PART = f"n_events, sum_mentions, {r('10*gold/n_events', 'avg_goldstein')}, {r('10*tone/n_events', 'avg_tone')}, {C34}, {r('100.0*q34/n_events', 'conflict_share')}, cast(row_number() over (order by n_events desc, code) as int) as rank"


def over_parts(s, sf, country):
    """Partners, root codes and quad classes of an overview, under one shape."""
    rel = B.rel_cells(s, sf)
    parts = views.overview_parts(rel, B.day_coverage(s, sf), B.SPAN, B.EVENTS, country)
    quads = parts["quad_classes"].select(F.col("quad").cast("string").alias("code"), "n_events")
    out = None
    for k in ("countries", "event_roots"):
        part = parts[k].withColumn("section", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.unionByName(quads.withColumn("section", F.lit("quad_classes")), allowMissingColumns=True)


for name, country, where, partner in OVER:
    query(f"view_overview_{name}", f"with {REL} select n_events, sum_mentions, sum_sources, sum_articles, partners, {r('10*absg', 'impact')}, {r(EVID('n_events'), 'evidence')}, {r(A_SCORE, 'attitude_score')}, {r('10*gold/n_events', 'avg_goldstein')}, {r('10*tone/n_events', 'avg_tone')}, {r('100.0*q34/n_events', 'conflict_share')} from (select {A_SUM}, cast(sum(sum_sources) as bigint) as sum_sources, cast(sum(sum_articles) as bigint) as sum_articles, count(distinct case when {partner}<>'N24' then {partner} end) as partners, sum(sum_absgold_w) as absg from rel where {WIN} and {where})")(
        lambda s, sf, country=country: views.overview(B.rel_cells(s, sf), B.SPAN, B.EVENTS, country))
    query(f"overview_parts_{name}", f"""with {REL} select 'countries' as section, code, {PART} from (select {partner} as code, {A_SUM} from rel where {WIN} and {where} and {partner}<>'N24' group by 1)
union all select * from (select 'event_roots', code, {PART} from (select root_code as code, {A_SUM} from rel where {WIN} and {where} group by 1)) where rank<=12
union all {' union all '.join(f"select 'quad_classes', '{i}', cast(coalesce(sum(n_quad{i}),0) as bigint), null, null, null, null, null, null from rel where {WIN} and {where}" for i in (1, 2, 3, 4))}""")(
        lambda s, sf, country=country: over_parts(s, sf, country))
    query(f"overview_series_{name}", f"""with {REL}, {COV}, p as (select bucket, {POINT} from (select bucket, {A_SUM} from rel where {WIN} and {where} group by 1)) select c.bucket, 'all' as scope, {SHOWN} from (select * from cov where bucket>={START}) c left join p on p.bucket=c.bucket""")(
        lambda s, sf, country=country: views.overview_parts(B.rel_cells(s, sf), B.day_coverage(s, sf), B.SPAN, B.EVENTS, country)["series"])
ET = f"et as (select actor1, root_code, cast(sum(n_events) as bigint) as n_events, {r('10*sum(sum_absgold_w)', 'impact')}, {r('10*sum(sum_gold)/sum(n_events)', 'avg_goldstein')}, cast(row_number() over (partition by actor1 order by sum(n_events) desc, root_code) as int) as place from rel where {WIN} and {TOWARDS} group by 1,2)"
query("event_types_by_country", f"with {REL}, {ET} select * from et")(lambda s, sf: views.event_types(B.rel_cells(s, sf), B.SPAN, B.EVENTS))
query("view_brief_focus", f"with {REL}, geo as ({geo_sql()}), {COV}, {CR}, {ATT}, {GKG}, {ENT}, {ET}, crr as (select geo_country, round(risk_score,6)+0.0 as risk_score, cast(row_number() over (order by round(risk_score,1) desc, geo_country) as int) as rank from cr) select 'focus_attitude' as section, actor1 as code, attitude_score as score, rank from att where actor1='N03' union all select 'focus_country_risk', geo_country, risk_score, rank from crr where geo_country='03' union all select 'focus_enterprise_risk', country, risk_score, rank from ent where country='03' union all select 'focus_event_mix', root_code, cast(n_events as double), place from et where actor1='N03' and place<=8")(
    lambda s, sf: views.focus(views.attitude(B.rel_cells(s, sf), B.SPAN, B.EVENTS), country_risk(s, sf), views.enterprise_risk(B.gkg_cells(s, sf), B.ART_SPAN, B.ARTICLES), views.event_types(B.rel_cells(s, sf), B.SPAN, B.EVENTS), "N03", "03"))
VERSIONS = {"data_version": 7, "parameter_version": 1, "model_version": "cells-1"}
COVSUM = f"select cast(sum(expected) as bigint) as expected, cast(sum(cast(done as int)) as bigint) as done, {r('100.0*sum(cast(done as int))/sum(expected)', 'percent')}, count(*) filter (complete) as complete_days, (select max(file_ts) from ev) as last_ts, {NOW}-(select max(file_ts) from ev)>2700 as stale from cov where bucket>={START}"


def stamped(s, sf):
    days = B.ev(s, sf).select(F.lit("events").alias("kind"), "file_ts").distinct()
    return views.stamped(views.attitude(B.rel_cells(s, sf), B.SPAN, B.EVENTS), coverage.coverage_summary(B.day_coverage(s, sf), days, NOW), VERSIONS)


query("view_stamped", f"with {REL}, {COV}, {ATT} select att.*, x.*, 7 as data_version, 1 as parameter_version, 'cells-1' as model_version from att cross join ({COVSUM}) x")(stamped)
def event_summary(s, sf, cells):
    """Coverage of the event days in the window, from cells that are stored."""
    cov = B.day_coverage(s, sf, cells=cells)
    last = B.ev(s, sf).agg(F.max("file_ts").alias("file_ts")).withColumn("kind", F.lit("events"))
    return coverage.coverage_summary(cov, last, NOW)


def stamped_overview(s, sf, country):
    rel = B.stored(B.rel_cells(s, sf), "rel")
    return views.stamped(views.overview(rel, B.SPAN, B.EVENTS, country), event_summary(s, sf, rel), VERSIONS)


def stamped_risk(s, sf):
    geo = stored_geo(s, sf, START)
    return views.stamped(views.country_risk(geo, geo, B.day_coverage(s, sf, cells=geo), B.SPAN, B.EVENTS), event_summary(s, sf, geo), VERSIONS)


def stamped_enterprise(s, sf):
    slots = B.art(s, sf).select(F.lit("gkg").alias("kind"), "file_ts").distinct()
    return views.stamped(views.enterprise_risk(B.gkg_cells(s, sf), B.ART_SPAN, B.ARTICLES), coverage.coverage_summary(B.art_coverage(s, sf), slots, E_NOW), VERSIONS)


VERSION_SQL = "7 as data_version, 1 as parameter_version, 'cells-1' as model_version"
ACOVSUM = f"select cast(sum(expected) as bigint) as expected, cast(sum(done) as bigint) as done, {r('100.0*sum(done)/sum(expected)', 'percent')}, count(*) filter (complete) as complete_days, (select max(file_ts) from art) as last_ts, {E_NOW}-(select max(file_ts) from art)>2700 as stale from {cover_sql('art', E_START, E_END + DAY, DAY, E_NOW, 900)}"
query("view_country_risk_stamped", f"with {GEO}, {COV}, {MOM}, {CR} select v.*, x.*, {VERSION_SQL} from ({CR_VIEW}) v cross join ({COVSUM}) x")(stamped_risk)
query("view_enterprise_stamped", f"with {GKG}, {ENT} select ent.*, x.*, {VERSION_SQL} from ent cross join ({ACOVSUM}) x")(stamped_enterprise)
for name, country, where, partner in OVER:
    query(f"view_overview_{name}_stamped", f"with {EV}, {COV} select v.*, x.*, {VERSION_SQL} from ({SQL[f'view_overview_{name}']}) v cross join ({COVSUM}) x")(lambda s, sf, country=country: stamped_overview(s, sf, country))
query("top_roots", f"with {REL} select root_code, cast(sum(n_events) as bigint) as n_events from rel where {WIN} group by 1 order by 2 desc, 1 limit 12")(lambda s, sf: rollup.window_agg(B.rel_cells(s, sf), START, NOW, ["root_code"], ["n_events"]).orderBy(F.desc("n_events"), "root_code").limit(12))
query("topk_slim", f"with {REL}, {ATT} select actor1, attitude_score, rank from att where rank<=8")(lambda s, sf: views.attitude(B.rel_cells(s, sf), B.SPAN, B.EVENTS).filter("rank <= 8").select("actor1", "attitude_score", "rank"))
query("expand_series", f"with {GEO} select geo_country, bucket, cast(sum(n_events) as bigint) as n_events from geo where {WIN} and geo_country not in ('06','24') group by 1,2")(lambda s, sf: views.expand_series(views.pack_series(views.daily_counts(B.geo_cells(s, sf), B.SPAN, B.EVENTS), "geo_country", ["n_events"]), "geo_country", ["n_events"]))
PACKED = "string_agg(cast(bucket as varchar), ',' order by bucket) as buckets, string_agg(cast(n_events as varchar), ',' order by bucket) as counts"


def packed(s, sf):
    """A row a country: its packed series, shown as text."""
    rows = views.pack_series(views.daily_counts(B.geo_cells(s, sf), B.SPAN, B.EVENTS), "geo_country", ["n_events"])
    return rows.select("geo_country", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(k) for c, k in (("bucket", "buckets"), ("n_events", "counts"))))


query("pack_series", f"with {GEO} select geo_country, {PACKED} from (select geo_country, bucket, cast(sum(n_events) as bigint) as n_events from geo where {WIN} and geo_country not in ('06','24') group by 1,2) group by 1")(packed)
query("trend_semi", f"with {GEO}, {CR} select g.geo_country, g.bucket, cast(sum(g.n_events) as bigint) as n_events from geo g where {WIN} and geo_country not in ('06','24') and geo_country in (select geo_country from cr) group by 1,2")(
    lambda s, sf: views.daily_counts(B.geo_cells(s, sf), B.SPAN, B.EVENTS).join(country_risk(s, sf).select("geo_country"), "geo_country", "left_semi"))

# ledger and coverage ------------------------------------------------------------------------------------------------
SLOTS = "slots as (select event_type as kind, cast(floor(epoch(ts)/900)*900 as bigint) as file_ts, count(*) as row_count, count(*) filter (value<1) as skipped_rows, case when count(*) filter (value<1)>0 then 'failed' else 'done' end as status from events group by 1,2)"
#: Coverage is asked from within an hour to within another, two days before the end of the table.
C_START, C_NOW = L_START + 1800, L_END - 2 * DAY + 5000
DONE = "(select * from slots x where x.kind=k.kind and x.status='done')"
CB = f"""cb as (select k.kind, c.bucket, c.expected, c.done, c.complete from (select distinct kind from slots) k, lateral {cover_sql(DONE, C_START, L_END, 3600, C_NOW, 900)} c)"""


def done_slots(s, sf):
    return B.slots(s, sf).filter("status = 'done'")


def hours(s, sf):
    return coverage.coverage_buckets(done_slots(s, sf), B.slots(s, sf), C_START, L_END, 3600, C_NOW)


query("coverage_buckets", f"with {SLOTS}, {CB} select * from cb")(hours)
query("coverage_summary", f"with {SLOTS}, {CB}, l as (select kind, max(file_ts) as last_ts from slots where status='done' group by 1) select cb.kind, cast(sum(expected) as bigint) as expected, cast(sum(done) as bigint) as done, count(*) filter (complete) as complete_buckets, any_value(last_ts) as last_ts, {r('100.0*sum(done)/sum(expected)', 'percent')}, coalesce({C_NOW}-any_value(last_ts)>2700, true) as stale from cb left join l on l.kind=cb.kind group by 1")(
    lambda s, sf: coverage.coverage_summary(hours(s, sf), done_slots(s, sf), C_NOW))
query("missing_slots", f"with {SLOTS} select k.kind, g as file_ts from (select unnest(generate_series({L_START},{L_END - 1},900)) as g) cross join (select distinct kind from slots) k where not exists (select 1 from slots s where s.kind=k.kind and s.file_ts=g)")(lambda s, sf: coverage.missing_slots(B.slots(s, sf), B.slots(s, sf), L_START, L_END))
query("ledger_summary", f"with {SLOTS} select kind, count(*) filter (status='done') as done, count(*) filter (status='failed') as failed, max(file_ts) filter (status='done') as latest, cast(sum(row_count) as bigint) as rows_parsed, cast(sum(skipped_rows) as bigint) as rows_skipped from slots group by 1")(lambda s, sf: ledger.summary(B.slots(s, sf)))
for name, status, k in (("recent_failures", "failed", 8), ("recent_batches", "done", 12)):
    query(name, f"with {SLOTS} select * from slots where status='{status}' order by file_ts desc, kind limit {k}")(lambda s, sf, status=status, k=k: ledger.recent(B.slots(s, sf), status, k))
PROGRESS = f"select *, pending+failed+unseeded=0 as finished from (select total, done, pending, failed, exhausted, greatest(0, total-seen) as unseeded, case when total=0 then 100.0 else {'round(100.0*done/total, 6) + 0.0'} end as percent from"
STATES = ", ".join(f"count(*) filter (status='{x}') as {x}" for x in ("done", "pending", "failed", "exhausted"))
STATED = "stated as (select kind, file_ts, case when row_count%7=0 then 'pending' when row_count%5=0 then 'exhausted' else status end as status from slots)"


def stated(s, sf):
    n = F.col("row_count")
    return B.slots(s, sf).withColumn("status", F.when(n % 7 == 0, "pending").when(n % 5 == 0, "exhausted").otherwise(F.col("status")))


query("backfill_progress", f"with {SLOTS}, {STATED} {PROGRESS} (select cast({(L_END - L_START) // 900 * 5} as bigint) as total, {STATES}, count(*) as seen from stated where file_ts>={L_START} and file_ts<{L_END})) union all {PROGRESS} (select cast(0 as bigint) as total, {STATES}, count(*) as seen from stated where false))")(
    lambda s, sf: ledger.progress(stated(s, sf), L_START, L_END, 5).unionByName(ledger.progress(stated(s, sf), L_END, L_END, 5)))
query("attempt_rollup", f"""with a as (select event_type as kind, cast(floor(epoch(ts)/900)*900 as bigint) as file_ts, event_id%2 as round, count(*) as n from events group by 1,2,3),
b as (select kind, file_ts, cast(sum(n) as bigint) as attempts, max_by(n, round) as round_attempts from a group by 1,2) select *, round_attempts>=2 as exhausted, case when round_attempts>=2 then 0 else cast({L_END}+least(21600, 60*pow(2, least(round_attempts,9))) as bigint) end as next_retry from b""")(
    lambda s, sf: ledger.attempt_rollup(B.table(s, sf, "events").select(F.col("event_type").alias("kind"), (F.floor(B.epoch("ts") / 900) * 900).cast("long").alias("file_ts"), (F.col("event_id") % 2).alias("round")), L_END, 2))
query("retention_filter", f"with {GEO}, c as (select 'hour' as granularity, bucket, geo_country, n_events from geo union all select 'day', bucket, geo_country, n_events from geo) select * from c where (granularity='hour' and bucket>={TODAY - 60 * DAY}) or (granularity='day' and bucket>={TODAY - 730 * DAY})")(
    lambda s, sf: ledger.retain(B.geo_cells(s, sf).select(F.explode(F.array(F.lit("hour"), F.lit("day"))).alias("granularity"), "bucket", "geo_country", "n_events"), NOW))
query("ledger_expiry", f"with {SLOTS} select kind, file_ts, row_count, skipped_rows, case when file_ts<{L_END - 20 * DAY} then 'expired' else status end as status from slots")(lambda s, sf: ledger.expire(B.slots(s, sf), L_END, 10, 20))
query("new_batches", f"with {SLOTS} select kind, file_ts from slots where status<>'done'")(lambda s, sf: rollup.new_batches(B.slots(s, sf).select("kind", "file_ts"), B.slots(s, sf)))

# scalar functions over whole tables ---------------------------------------------------------------------------------
ev1 = lambda f: lambda s, sf: B.ev(s, sf).select("order_id", "line_id", *f())
for name, made, sql in (
    ("time_buckets", lambda: [S.bucket("file_ts", 3600).alias("hour"), S.bucket("file_ts", DAY).alias("day")], f"file_ts-file_ts%3600 as hour, file_ts-file_ts%{DAY} as day"),
    ("mention_weight", lambda: [S.mention_weight("mentions").alias("w")], r("cast(1+least(greatest(mentions,0),20)/10.0 as double)", "w")),
    ("unit_clamp", lambda: [S.unit("goldstein").alias("g"), S.unit("tone").alias("t")], f"{r('greatest(-1,least(1,goldstein/10))', 'g')}, {r('greatest(-1,least(1,tone/10))', 't')}"),
    ("quad_direction", lambda: [S.quad_direction("quad").alias("q")], r("cast(case quad when 1 then 0.4 when 2 then 1 when 3 then -0.4 else -1 end as double)", "q")),
    ("doc_negativity", lambda: [S.negativity("tone").alias("neg")], r("greatest(0,least(1,-tone/10))", "neg")),
    ("risk_response", lambda: [S.response(F.col("mentions") / F.lit(40.0), 0.5).alias("response")], r("100*pow(greatest(0,least(1,mentions/40.0)),0.5)", "response")),
    ("saturation", lambda: [S.saturation("goldstein", 5).alias("s")], r("greatest(0,least(100,100*(1-exp(-greatest(0,goldstein)/5))))", "s")),
    ("evidence", lambda: [S.evidence("mentions").alias("ev")], r("cast(round(100.0*mentions/(mentions+20.0),1) as double)", "ev")),
    ("shrink_to_neutral", lambda: [S.shrink("mentions", F.col("sources") * 10).alias("s")], r("greatest(0,least(100,50+(cast(mentions as double)-50)*greatest(0,least(100,sources*10))/100))", "s")),
    ("safe_div", lambda: [S.safe_div("tone", F.col("quad") - 1).alias("d")], r("coalesce(tone/nullif(quad-1,0),0)", "d")),
    ("risk_level", lambda: [S.risk_level(F.col("mentions") * 2).alias("level")], "case when mentions*2>=75 then 'extreme' when mentions*2>=60 then 'high' when mentions*2>=40 then 'elevated' when mentions*2>=20 then 'low' else 'minimal' end as level"),
    ("iso_timestamp", lambda: [S.iso_stamp("file_ts").alias("at")], "strftime(to_timestamp(file_ts) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as at"),
):
    query(name, f"with {EV} select order_id, line_id, {sql} from ev")(ev1(made))
query("theme_categories", f"with {ART} select doc_id, array_to_string(list_filter([{', '.join(f'case when {h} then {c!r} end' for c, h in HAS.items())}], lambda y: y is not null), ',') as cats from art")(lambda s, sf: B.art(s, sf).select("doc_id", F.array_join(fields.theme_categories("themes", B.MARKERS), ",").alias("cats")))
query("alias_mentions", f"with {ART} select doc_id, {ALIAS} as alias from art")(lambda s, sf: B.art(s, sf).select("doc_id", fields.mentions_alias("organizations", B.ARTICLES.aliases).alias("alias")))
query("location_countries", "select doc_id, array_to_string(list_sort(list_filter(list_distinct([upper(lang), 'S'||right(source,1)]), lambda x: x not in ('S9','ES'))), ',') as countries from documents")(
    lambda s, sf: B.table(s, sf, "documents").select("doc_id", F.concat(F.lit("1#a#"), "lang", F.lit("#x;2#b#S"), F.substring("source", -1, 1), F.lit("#y;1#c#"), F.upper("lang"), F.lit(";bad")).alias("l")).select("doc_id", F.array_join(fields.location_countries("l", ("S9", "ES")), ",").alias("countries")))
query("tone_vector", "select doc_id, cast(n_chars%41 as double) as tone, cast(n_chars%7 as double) as polarity from documents")(lambda s, sf: B.table(s, sf, "documents").select("doc_id", F.concat_ws(",", F.col("n_chars") % 41, F.lit("x"), F.lit(""), F.col("n_chars") % 7).alias("v")).select("doc_id", fields.tone_part("v", 0).alias("tone"), F.coalesce(fields.tone_part("v", 3), F.lit(0.0)).alias("polarity")))

# raw rows -----------------------------------------------------------------------------------------------------------
def raw_sql(batch: int = DAY, every: int = 50) -> str:
    return f"""{EV}, spoilt as (select *, case when line_id=1 then (file_ts//{batch})%{every} else -1 end as k, order_id%89=0 as none_ from ev),
  raw as (select 'events' as kind, file_ts, order_id, line_id, actor1, actor2, geo, case when none_ or k=4 then '---' else root_code end as event_code,
  case when none_ then '---' when k=4 then '--' when k=1 then '21' else root_code end as root_code, case when k=0 then 'broken' when k=2 then '-3' else cast(mentions as varchar) end as mentions,
  case when k=3 then 'x' when none_ and k<>4 then '' else cast(goldstein as varchar) end as goldstein, case when order_id%97=0 or k in (2,3) then '' else cast(tone as varchar) end as tone from spoilt),
st as (select *, case when actor1='N24' or actor2='N24' or geo='24' then 'skip_region' when mentions='broken' then 'reject_count' when event_code='---' and root_code in ('---','--') and goldstein in ('','x') then 'skip_placeholder'
  when root_code in ('21','--','---') then 'reject_enum' when goldstein='x' then 'reject_score' when mentions='-3' then 'reject_negative' when tone='' or goldstein='' then 'skip_score' else 'ok' end as row_status from raw)"""


RAW = raw_sql()


def status(s, sf):
    rows = B.raw_events(s, sf).withColumn("actor1", fields.code("actor1"))
    return fields.with_event_status(rows, B.EVENTS)


query("normalize_codes", f"with {EV} select order_id, line_id, actor1 from ev")(lambda s, sf: B.raw_events(s, sf).select("order_id", "line_id", fields.code("actor1").alias("actor1")))
query("strict_counts", f"with {RAW} select order_id, line_id, try_cast(mentions as bigint) as mentions from raw")(lambda s, sf: B.raw_events(s, sf).select("order_id", "line_id", fields.count_value("mentions").alias("mentions")))
query("lenient_scores", f"with {RAW} select order_id, line_id, round(try_cast(goldstein as double),6)+0.0 as goldstein, goldstein='x' as bad from raw")(lambda s, sf: B.raw_events(s, sf).select("order_id", "line_id", fields.score_value("goldstein").alias("goldstein"), fields.score_bad("goldstein").alias("bad")))
query("row_status", f"with {RAW} select order_id, line_id, row_status from st")(lambda s, sf: status(s, sf).select("order_id", "line_id", "row_status"))
for name, value in (("exclude_regions", "skip_region"), ("skip_placeholders", "skip_placeholder"), ("validate_enums", "reject_enum")):
    query(name, f"with {RAW} select order_id, line_id from st where row_status<>'{value}'")(lambda s, sf, value=value: status(s, sf).filter(F.col("row_status") != value).select("order_id", "line_id"))
query("quarantine_batches", f"with {RAW} select order_id, line_id from st where row_status='ok' and file_ts not in (select file_ts from st where row_status like 'reject%')")(lambda s, sf: ledger.accepted(status(s, sf)).select("order_id", "line_id"))
query("batch_accounting", f"with {RAW} select kind, file_ts, count(*) filter (row_status='ok') as row_count, count(*) filter (row_status like 'skip%') as skipped_rows, count(*) filter (row_status like 'reject%') as rejected, case when count(*) filter (row_status like 'reject%')>0 or count(*) filter (row_status='ok' or row_status like 'skip%')=0 then 'failed' else 'done' end as status from st group by 1,2")(lambda s, sf: ledger.account(status(s, sf)))
query("gkg_row_status", "select doc_id, case when lang='es' then 'skip_country' when n_chars%5=0 then 'skip_tone' when n_chars%11=0 then 'reject_tone' else 'ok' end as row_status from documents")(
    lambda s, sf: B.table(s, sf, "documents").select("doc_id", F.concat(F.lit("1#a#"), F.upper("lang")).alias("l"), F.when(F.col("n_chars") % 5 == 0, " ").when(F.col("n_chars") % 11 == 0, "nan").otherwise("1.5").alias("tone")).select("doc_id", fields.article_status(fields.location_countries("l", ("ES",)), "tone").alias("row_status")))

# joins, ranks, checks -----------------------------------------------------------------------------------------------
NAT = "nat as (select lpad(cast(n_nationkey as varchar),2,'0') as code, n_name as label from nation)"
query("dim_lookup", f"with {GEO}, {NAT} select geo_country, bucket, root_code, n_events, coalesce(label, 'unidentified ('||geo_country||')') as label from geo left join nat on code=geo_country")(lambda s, sf: dims.with_label(B.geo_cells(s, sf).select("geo_country", "bucket", "root_code", "n_events"), B.nations(s, sf), "geo_country"))
query("labels_fallback", f"with {NAT}, c as (select lpad(cast(c_nationkey+10 as varchar),2,'0') as code, count(*) as n from customer group by 1) select c.code, n, coalesce(label, 'unidentified ('||c.code||')') as label from c left join nat on nat.code=c.code")(
    lambda s, sf: dims.with_label(B.table(s, sf, "customer").groupBy(F.lpad((F.col("c_nationkey") + 10).cast("string"), 2, "0").alias("code")).agg(F.count(F.lit(1)).alias("n")), B.nations(s, sf), "code"))
ROOTS_SQL = ", ".join(f"('root','{k}','{v}')" for k, v in dims.ROOT_LABELS.items())
query("code_reference", f"with {NAT} select 'country' as kind, code, label from nat where code<>'24' union all select * from (values {ROOTS_SQL}, ('quad','1','verbal cooperation'),('quad','2','material cooperation'),('quad','3','verbal conflict'),('quad','4','material conflict'))")(lambda s, sf: dims.code_reference(s, B.nations(s, sf), ("24",)))


def two_tables(s, sf):
    """Codes N00 .. of three letters, every sixth nation with a second one, and codes of two; every fourth name has two of these, every fifth none."""
    n = B.nations(s, sf)
    a = n.select(F.concat(F.lit("N"), "code").alias("code"), "label").union(n.filter("cast(code as int) % 6 = 0").select(F.concat(F.lit("M"), "code").alias("code"), "label"))
    some = n.filter("cast(code as int) % 5 <> 0")
    b = some.union(some.filter("cast(code as int) % 4 = 0").select(F.concat(F.lit("Z"), F.substring("code", 2, 1)).alias("code"), "label"))
    return a, b, n.filter("code in ('05', '06')").select(F.concat(F.lit("N"), "code").alias("a_code"), F.lit("X0").alias("b_code"))


CROSS = """n as (select lpad(cast(n_nationkey as varchar),2,'0') as code, n_nationkey as k, n_name as label from nation),
a as (select 'N'||code as code, label from n union all select 'M'||code, label from n where k%6=0), most as (select * from n where k%5<>0),
b as (select code, label from most union all select 'Z'||right(code,1), label from most where k%4=0),
known as (select a.code as a_code, f.b_code from a join (select label, min(code) as b_code from b group by 1) f on f.label=a.label),
cw as (select * from known union all select 'N'||code, 'X0' from n where code in ('05','06') and 'N'||code not in (select a_code from known))"""
query("code_crosswalk", f"with {CROSS} select a_code, b_code from cw")(lambda s, sf: dims.crosswalk(*two_tables(s, sf)))
FREE = {0: "' '||lower('N'||code)", 1: "label", 2: "'THE '||label||'!'", 3: "code", 4: "substr(label, 1, 4)", 5: "lower(label)", 6: "'alias of '||code"}
FREE_SQL = "case k%7 " + " ".join(f"when {i} then {x}" for i, x in FREE.items()) + " end"


def resolved(s, sf):
    a, b, more = two_tables(s, sf)
    n = B.nations(s, sf).withColumn("k", F.col("code").cast("int"))
    names = a.groupBy("label").agg(F.min("code").alias("a_code")).withColumn("place", F.col("a_code").substr(2, 2).cast("long"))
    names = names.select("label", "a_code", "place").union(n.select(F.concat(F.lit("alias of "), "code"), F.concat(F.lit("N"), "code"), F.col("k").cast("long") + 100))
    return dims.resolve_countries(n.select(F.col("k").alias("id"), F.expr(FREE_SQL).alias("raw")), "raw", a, b, dims.crosswalk(a, b, more), names, ("N13",), ("03",))


query("resolve_country", f"""with {CROSS}, v as (select k as id, {FREE_SQL} as raw from n), named as (select label, min(code) as a_code, cast(substr(min(code),2,2) as int) as place from a group by 1 union all select 'alias of '||code, 'N'||code, k+100 from n),
x as (select id, raw, trim(raw) as t, upper(trim(raw)) as u from v),
y as (select x.*, (select code from a where code=u and length(u)=3) as a3, (select code from b where code=u and length(u)=2) as b2, (select min(a_code) from cw where b_code=u and u in (select code from b) and length(u)=2) as fromb,
  (select a_code from named where t=label or (length(label)>=2 and (contains(t,label) or contains(label,t))) order by case when t=label then 0 else 1 end, place limit 1) as byname from x),
z as (select id, raw, t, u, b2, case when a3 is not null then a3 when b2 is not null then fromb else byname end as code from y),
w as (select *, coalesce(code='N13', false) or u='03' or coalesce(code, b2) is null as gone from z)
select id, raw, case when not gone then coalesce(code,'') end as a_code, case when not gone then coalesce((select min(b_code) from cw where a_code=w.code), case when code is null then b2 end, '') end as b_code,
  case when not gone then coalesce((select min(label) from a where a.code=w.code), case when code is null then (select min(label) from b where b.code=w.b2) end, t) end as name from w""")(resolved)
query("aggregates_equal", f"with {GEO} select count(*) as n_keys, cast(0 as bigint) as one_sided, cast(0 as bigint) as mismatches from geo")(lambda s, sf: rollup.aggregates_equal(B.geo_cells(s, sf), rollup.to_day(rollup.rollup_geo(B.ev(s, sf), "hour"), rollup.GEO_KEYS), rollup.GEO_KEYS, ["sum_w", "sum_gold_w", "sum_tone"]))
query("percentile_ties", "select c_custkey, c_nationkey, case when n<=1 then 50 else round(100.0*((r-1)+(t-1)/2.0)/(n-1),6)+0.0 end as percentile from (select c_custkey, c_nationkey, c_mktsegment, rank() over (partition by c_nationkey order by c_mktsegment) as r, count(*) over (partition by c_nationkey) as n, count(*) over (partition by c_nationkey, c_mktsegment) as t from customer)")(
    lambda s, sf: rank.percentile_ties(B.table(s, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_mktsegment", ["c_nationkey"]).drop("c_mktsegment"))
# the same without a partition: all customers, by a column of few values and by one of many
PCT = lambda c: f"case when count(*) over ()<=1 then 50 else round(100.0*((rank() over (order by {c})-1)+(count(*) over (partition by {c})-1)/2.0)/(count(*) over ()-1),6)+0.0 end"
query("percentile_all", f"select c_custkey, {PCT('c_mktsegment')} as segment, {PCT('c_acctbal')} as balance from customer")(
    lambda s, sf: rank.percentile_ties(rank.percentile_ties(B.table(s, sf, "customer"), "c_mktsegment").withColumnRenamed("percentile", "segment"), "c_acctbal").select("c_custkey", "segment", F.col("percentile").alias("balance")))
query("rank_all", "select o_orderkey, o_orderpriority, row_number() over (order by o_orderpriority desc, o_orderkey) as rank from orders")(
    lambda s, sf: rank.ranked_wide(B.table(s, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey"))
LOOSE = "case c_custkey%4 when 0 then cast(c_custkey as string) when 1 then concat('Supplier#', lpad(cast(c_custkey as string),9,'0'), ' Ltd') when 2 then concat('Supplier#', lpad(cast(c_custkey as string),9,'0')) else c_mktsegment end"
query("contained_names", f"with v as (select distinct {LOOSE} as value from customer) select value, s_name, s_suppkey from v join supplier on contains(value, s_name) or contains(s_name, value)")(
    lambda s, sf: dims.contained_pairs(B.table(s, sf, "customer").select(F.expr(LOOSE).alias("value")), "value", B.table(s, sf, "supplier").select("s_name", "s_suppkey"), "s_name"))


def planted(s, sf):
    """Day cells against others with cells of either side alone, and values beyond and within the tolerance."""
    day = F.expr(f"bucket div {DAY}")
    cells = B.stored(B.geo_cells(s, sf), "geo")
    other = rollup.to_day(rollup.rollup_geo(B.ev(s, sf), "hour"), rollup.GEO_KEYS).filter(~((F.col("root_code") == "03") & (day % 7 == 0)))
    other = other.unionByName(cells.filter((F.col("root_code") == "01") & (day % 13 == 0)).withColumn("root_code", F.lit("99")))
    other = other.withColumn("sum_w", F.col("sum_w") + F.when((F.col("root_code") == "04") & (day % 11 == 0), 1.0).otherwise(0.0))
    other = other.withColumn("sum_tone", F.col("sum_tone") * F.when(F.col("root_code") == "05", F.lit(1 + 1e-12)).otherwise(F.lit(1.0)))
    return rollup.aggregates_equal(cells, other, rollup.GEO_KEYS, ["sum_w", "sum_gold_w", "sum_tone"])


PLANTED = {"gone": "root_code='03' and (bucket//86400)%7=0", "more": "root_code='01' and (bucket//86400)%13=0", "off": "root_code='04' and (bucket//86400)%11=0"}
query("aggregates_differ", f"with {GEO} select count(*)+count(*) filter ({PLANTED['more']}) as n_keys, count(*) filter ({PLANTED['gone']})+count(*) filter ({PLANTED['more']}) as one_sided, count(*) filter ({PLANTED['off']}) as mismatches from geo")(planted)
W4 = {"social": 0.30, "political": 0.25, "conflict": 0.25, "media": 0.20}
query("zscore_index", """with p as (select c_nationkey as country, 1 as month, greatest(0,least(100,avg(c_acctbal)/100)) as social, greatest(0,least(100,max(c_acctbal)/100)) as political, greatest(0,least(100,count(*)/10.0)) as conflict, greatest(0,least(100,stddev_pop(c_acctbal)/100)) as media from customer group by 1),
x as (select *, 0.3*social+0.25*political+0.25*conflict+0.2*media as v from p), y as (select *, avg(v) over () as mu, stddev_pop(v) over () as sd from x)
select country, month, round(v,6)+0.0 as raw, round(case when sd>1e-12 then greatest(0,least(100,50+(v-mu)/sd*100/6)) else v end,6)+0.0 as index from y""")(
    lambda s, sf: rank.zscore_index(B.table(s, sf, "customer").groupBy(F.col("c_nationkey").alias("country")).agg(F.lit(1).alias("month"), S.clip(F.avg("c_acctbal") / 100, 0, 100).alias("social"), S.clip(F.max("c_acctbal") / 100, 0, 100).alias("political"), S.clip(F.count(F.lit(1)) / F.lit(10.0), 0, 100).alias("conflict"), S.clip(F.stddev_pop("c_acctbal") / 100, 0, 100).alias("media")), W4, ["month"]).select("country", "month", "raw", "index"))
query("index_error", f"""with i as ({SQL['zscore_index']}) select count(*) as countries, {r('max(abs(round(index, 2)-index))', 'max_error')}, {r('avg(abs(round(index, 2)-index))', 'mean_error')} from i""")(
    lambda s, sf: rank.index_error(QUERIES["zscore_index"](s, sf).withColumn("published", F.round("index", 2))))
EVENT_HOURS = "select event_type, cast(floor(epoch(ts)/3600)*3600 as bigint) as hour, count(*) as n, round(sum(value),6)+0.0 as total from events group by 1,2"


def streamed(s, sf, size="1 hour"):
    """The stream of windows over the events table, run to its end; each batch's whole result replaces the table."""
    import uuid

    from ..streaming.ingest import tumbling

    base = shared(s)
    out, check = f"{base}/tumbling-{uuid.uuid4().hex}", f"{base}/checkpoint-{uuid.uuid4().hex}"
    source = s.readStream.schema(B.table(s, sf, "events").schema).option("pathGlobFilter", "*").parquet(f"{sf}/events.parquet*")
    def keep(df, _):
        return df.write.mode("overwrite").parquet(out)

    tumbling(source, size, "3650 days").writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out).select("event_type", F.unix_timestamp("window.start").alias("hour"), "n", "total")


shared = B.shared


query("stream_hourly", EVENT_HOURS)(streamed)
query("stream_daily", EVENT_HOURS.replace("3600", str(DAY)))(lambda s, sf: streamed(s, sf, "1 day"))


def idempotent(s, sf):
    """Partials of all batches written twice; readers see each batch once."""
    import uuid

    path = f"{shared(s)}/partials-{uuid.uuid4().hex}"
    rows = rollup.rollup_geo(B.ev(s, sf).withColumn("kind", F.lit("events")).withColumn("file_ts", S.bucket("file_ts", 366 * DAY)), "day", "kind")
    parts = rows.withColumn("file_ts", S.bucket("bucket", 366 * DAY))
    for _ in range(2):
        rollup.write_partials(parts, path)
    return rollup.window_agg(s.read.parquet(path), 0, 1 << 40, ["geo_country"], ["n_events", "sum_w"])


query("ingest_idempotent", f"with {GEO} select geo_country, cast(sum(n_events) as bigint) as n_events, {r('sum(sum_w)', 'sum_w')} from geo group by 1")(idempotent)


def published(s, sf):
    """Two views over a year, published with the coverage of the window."""
    import uuid

    from .snapshot import View, build

    path = f"{shared(s)}/snapshot-{uuid.uuid4().hex}"
    geo, rel = stored_geo(s, sf), B.stored(B.rel_cells(s, sf).filter(views.towards_home(B.EVENTS)), "rel")  # the view's own pairs
    days = geo.select(F.lit("events").alias("kind"), F.col("bucket").alias("file_ts")).distinct()
    made = {
        "country_risk": View(lambda span: plain(views.country_risk(geo, geo, B.day_coverage(s, sf, cells=geo), span, B.EVENTS)), "geo_country"),
        "attitude": View(lambda span: plain(views.attitude(rel, span, B.EVENTS)), "actor1"),
    }
    return path, build(made, (365,), path, "v1", NOW, days, DAY, VERSIONS)


query("snapshot_manifest", f"""with {GEO}, rel as ({rel_sql()}), {COV}, {MOM}, {CR}, {ATT}, x as ({COVSUM}) select 'v1' as version, view, 365 as days, cast({NOW} as bigint) as created_at, key, rows, expected, done, percent, last_ts, 7 as data_version, 1 as parameter_version, 'cells-1' as model_version
from (select 'country_risk' as view, 'geo_country' as key, count(*) as rows from cr union all select 'attitude', 'actor1', count(*) from att) cross join x""")(lambda s, sf: published(s, sf)[1].drop("hash"))


def snapshot_view(s, sf):
    """A whole ranking, and the rows of one country with their freshness an hour and a day after the data."""
    from .snapshot import read_view

    path = published(s, sf)[0]
    whole = read_view(s, path, "v1", "country_risk", 365).withColumn("stale", F.lit(None).cast("boolean"))
    last = published_last(s, path)
    return whole.unionByName(read_view(s, path, "v1", "country_risk", 365, "03", last + 900)).unionByName(read_view(s, path, "v1", "country_risk", 365, "03", last + DAY))


def published_last(s, path):
    from .snapshot import read_manifest

    return read_manifest(s, path, "v1").agg(F.max("last_ts")).first()[0]


query("snapshot_view", f"with v as ({SQL['view_country_risk']}) select *, cast(null as boolean) as stale from v union all select *, false from v where geo_country='03' union all select *, true from v where geo_country='03'")(snapshot_view)


# streams of batches, schema versions, published files -------------------------------------------------------------------
BATCH = 366 * DAY
#: Rows in a file of a batch that the ingest stream is given.
MOST_ROWS = 4_000_000


def give(rows: DataFrame, path: str) -> None:
    """Add batches to the files of a stream: a batch stays with one task while it is small, and is dealt over as many as its bytes ask for; there may be few batches of many rows."""
    rows.hint("rebalance", F.col("kind"), F.col("file_ts")).write.option("maxRecordsPerFile", MOST_ROWS).mode("append").parquet(path)


def ingested(s, sf, late: bool):
    """Batches through the ingest stream, one file holding whole batches.

    Late: the older half arrives after the newer one was taken in. Else: two runs with one checkpoint, then one that starts over.
    """
    import uuid

    from ..streaming.ingest import ingest

    path = f"{shared(s)}/stream-{uuid.uuid4().hex}"
    rows = B.ev(s, sf).withColumn("kind", F.lit("events")).withColumn("file_ts", S.bucket("file_ts", BATCH))
    older = F.col("file_ts") < S.bucket(F.lit(NOW), BATCH) - 2 * BATCH
    for part in (rows.filter(~older), rows.filter(older)) if late else (rows, None):
        if part is not None:
            give(part, f"{path}/in")
        ingest(s, f"{path}/in", rows.schema, f"{path}/out", f"{path}/check")
    if not late:
        ingest(s, f"{path}/in", rows.schema, f"{path}/out", f"{path}/check-new")
    return rollup.window_agg(s.read.parquet(f"{path}/out").filter("granularity = 'hour'"), 0, 1 << 40, ["geo_country"], ["n_events", "sum_w"])


query("stream_idempotent", SQL["ingest_idempotent"])(lambda s, sf: ingested(s, sf, late=False))
query("stream_late", SQL["ingest_idempotent"])(lambda s, sf: ingested(s, sf, late=True))


def in_files(s, sf) -> str:
    """The folder of cells after batches that come in three runs, in some files each: tasks write by batch and files are bounded in rows, so no task writes a third of all."""
    import uuid

    from ..streaming.ingest import ingest

    path = f"{shared(s)}/files-{uuid.uuid4().hex}"
    rows = B.ev(s, sf).withColumn("kind", F.lit("events")).withColumn("file_ts", S.bucket("file_ts", BATCH))
    for i in range(3):
        give(rows.filter(F.col("order_id") % 3 == i), f"{path}/in")
        ingest(s, f"{path}/in", rows.schema, f"{path}/out", f"{path}/check")
    return f"{path}/out"


query("stream_files", SQL["ingest_idempotent"])(lambda s, sf: rollup.window_agg(s.read.parquet(in_files(s, sf)).filter("granularity = 'day'"), 0, 1 << 40, ["geo_country"], ["n_events", "sum_w"]))


def compacted(s, sf):
    """The same cells after compaction: hours and days by country."""
    path = in_files(s, sf)
    rollup.compact(s.read.parquet(path), f"{path}-compact", rollup.GEO_KEYS)
    return s.read.parquet(f"{path}-compact").groupBy("granularity", "geo_country").agg(F.count(F.lit(1)).alias("cells"), F.sum("n_events").alias("n_events"), F.sum("sum_w").alias("sum_w"))


YEARLY = f"y as (select file_ts-file_ts%{366 * DAY} as bucket, geo as geo_country, root_code, count(*) as n_events, sum(cast(w as double)) as sum_w from m where length(geo)=2 group by 1,2,3)"
query("compact_partials", f"with {EV}, {YEARLY} select granularity, geo_country, count(*) as cells, cast(sum(n_events) as bigint) as n_events, {r('sum(sum_w)', 'sum_w')} from y cross join (values ('hour'), ('day')) g(granularity) group by 1,2")(compacted)
query("finite_guard", f"with {GEO} select count(*) as cells, {', '.join(f'count(*) filter (root_code={chr(39)}07{chr(39)}) as {c}' if c == 'sum_tone' else f'cast(0 as bigint) as {c}' for c in D)} from geo")(
    lambda s, sf: rollup.not_finite(B.geo_cells(s, sf).withColumn("sum_tone", F.when(F.col("root_code") == "07", F.lit(float("nan"))).otherwise(F.col("sum_tone")))))


def deduplicated_stream(s, sf):
    """The events table sent twice; every id comes out once."""
    import uuid

    from ..streaming.ingest import deduplicated

    path = f"{shared(s)}/dedup-{uuid.uuid4().hex}"
    rows = B.table(s, sf, "events").select("event_id", "event_type", "ts", "value")
    for _ in range(2):
        rows.write.mode("append").parquet(f"{path}/in")

    def keep(df, batch):
        df.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

    stream = deduplicated(s.readStream.schema(rows.schema).parquet(f"{path}/in"), "3650 days")
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{path}/out").select("event_id", "event_type", "value")


def distinct_stream(s, sf):
    """The events table in three rounds, then all of it again, months behind: every event is there once, whatever the round. A round's files are as many as the table's tasks."""
    import uuid

    from ..streaming.ingest import ingest_distinct

    path = f"{shared(s)}/distinct-{uuid.uuid4().hex}"
    rows = B.table(s, sf, "events").select("event_id", "event_type", "ts", "value")
    for part in (*(rows.filter((F.col("event_id") % 3 == i) | (F.col("event_id") % 7 == 0)) for i in range(3)), rows):
        part.write.mode("append").parquet(f"{path}/in")
        ingest_distinct(s, s.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/check")
    return s.read.parquet(f"{path}/out").select("event_id", "event_type", "value")


query("stream_distinct", f"select event_id, event_type, {r('value', 'value')} from events")(distinct_stream)


def windowed(s, sf):
    """Hourly windows of the events table, a quarter of its time a round, and at last its first day again: closed windows, open ones, and late rows by type."""
    import uuid

    from ..streaming.ingest import Windows

    path = f"{shared(s)}/windows-{uuid.uuid4().hex}"
    rows = B.table(s, sf, "events").select("event_id", "event_type", "ts", "value")
    quarter = (L_END - L_START) // 4
    for i in range(5):
        part = rows.filter((B.epoch("ts") >= L_START + i * quarter) & (B.epoch("ts") < L_START + (i + 1) * quarter)) if i < 4 else rows.filter(B.epoch("ts") < L_START + DAY)
        part.write.mode("append").parquet(f"{path}/in")
        windows = Windows(s, f"{path}/out")
        windows.run(s.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/check")
    names = ("state", "event_type", "window_start", "n", "total")
    closed = windows.closed().withColumn("state", F.lit("closed")).select(*names)
    late = windows.late().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.lit("late").alias("state"), "event_type", F.lit(None).cast("long").alias("window_start"), "n", "total")
    return closed.unionByName(windows.open().withColumn("state", F.lit("open")).select(*names)).unionByName(late)


WINDOW_OF = "event_type, cast(floor(epoch(ts)/3600)*3600 as bigint)"
query("stream_windows", f"""with m as (select cast(floor(epoch(max(ts))) as bigint)-7200 as mark from events),
w as (select {WINDOW_OF} as window_start, count(*) as n, round(sum(value),6)+0.0 as total from events group by 1,2)
select case when window_start+3600<=mark then 'closed' else 'open' end as state, event_type, window_start, n, total from w, m
union all select 'late', event_type, null, count(*), round(sum(value),6)+0.0 from events where epoch(ts)<{L_START + DAY} group by 2""")(windowed)
query("stream_dedup", f"select event_id, event_type, {r('value', 'value')} from events")(deduplicated_stream)


def evolved(s, sf):
    """Cells of the last year with a measure that older cells, written before it existed, lack."""
    import uuid

    path = f"{shared(s)}/versions-{uuid.uuid4().hex}"
    cells = B.geo_cells(s, sf).select("geo_country", "bucket", "root_code", "n_events", "sum_tone_w")
    cells.filter(F.col("bucket") < START).drop("sum_tone_w").write.parquet(f"{path}/version=1")
    cells.filter(F.col("bucket") >= START).write.parquet(f"{path}/version=2")
    return rollup.read_evolved(s, path, ["sum_tone_w"]).drop("version")


query("schema_evolution", f"with {GEO} select geo_country, bucket, root_code, n_events, {r(f'case when bucket<{START} then 0 else sum_tone_w end', 'sum_tone_w')} from geo")(evolved)


def monthly(s, sf):
    """The index file of balances by nation, with a header line before each month, read back for month 3."""
    import uuid

    from ..sources.monthly import SCORES, one_month, read_index

    path = f"{shared(s)}/index-{uuid.uuid4().hex}"
    rows = B.table(s, sf, "customer").groupBy((F.col("c_custkey") % 12 + 1).alias("Month"), F.col("c_nationkey").alias("Country"))
    values = (F.min("c_acctbal"), F.max("c_acctbal"), F.count(F.lit(1)), F.min("c_custkey"), F.max("c_custkey"))
    rows = rows.agg(*(v.alias(c) for c, v in zip(SCORES, values)))
    text = rows.select(*(F.col(c).cast("string").alias(c) for c in rows.columns))
    heads = rows.select("Month").distinct().select(*(F.lit(c).alias(c) for c in rows.columns))
    text.union(heads).write.csv(path)
    return one_month(read_index(s, path), 3)


query("monthly_index_clean", """select 3 as "Month", cast(c_nationkey as varchar) as "Country", round(cast(min(c_acctbal) as double),6)+0.0 as "Social_Stability_Risk", round(cast(max(c_acctbal) as double),6)+0.0 as "Political_Institutional_Risk",
  cast(count(*) as double) as "International_Conflict_Risk", cast(min(c_custkey) as double) as "Media_Sentiment_Risk", cast(max(c_custkey) as double) as "General_Risk_Index" from customer where c_custkey%12+1=3 group by c_nationkey""")(monthly)


COVERED = (1, 7, 30)
RANGES_SQL = " union all ".join(f"select {d} as days, k.kind, c.* from (select distinct kind from slots) k, lateral {cover_sql(DONE, coverage.Span(d, C_NOW).start, C_NOW, DAY, C_NOW, 900)} c" for d in COVERED)
query("coverage_by_range", f"""with {SLOTS}, b as ({RANGES_SQL}), l as (select kind, max(file_ts) as last_ts from slots where status='done' group by 1)
select days, b.kind, cast(sum(expected) as bigint) as expected, cast(sum(done) as bigint) as done, count(*) filter (complete) as complete_buckets, any_value(last_ts) as last_ts, {r('100.0*sum(done)/sum(expected)', 'percent')}, coalesce({C_NOW}-any_value(last_ts)>2700, true) as stale from b left join l on l.kind=b.kind group by 1,2""")(
    lambda s, sf: coverage.coverage_by_range(done_slots(s, sf), B.slots(s, sf), COVERED, C_NOW))


def checked(s, sf):
    """Checks of a ranking and a series table; the second one is asked for a column that it lacks and a range that is not published."""
    from .snapshot import output_checks

    ranking, series = QUERIES["view_country_risk"](s, sf), QUERIES["trend_country_risk"](s, sf)
    one = output_checks(ranking, "country_risk", 365, "geo_country", ("geo_country", "risk_score"))
    return one.unionByName(output_checks(series, "trend_country_risk", 366, "geo_country", ("bucket", "no_such_column")))


query("snapshot_checks", " union all ".join(
    f"select '{view}' as view, {days} as days, {missing} as missing_columns, 0 as repeated_columns, {bad} as unsupported_range, count(*) as series, coalesce(max(n), 0) as points, count(*) filter (n>10000) as too_long from (select geo_country, count(*) as n from ({SQL[name]}) group by 1)"
    for view, name, days, missing, bad in (("country_risk", "view_country_risk", 365, 0, 0), ("trend_country_risk", "trend_country_risk", 366, 1, 1))))(checked)


def republished(s, sf):
    """Two rounds of batches, each published as a new version when it is in; the newest version's table."""
    import uuid

    from ..streaming.ingest import ingest
    from .snapshot import publish, read_view

    path = f"{shared(s)}/republish-{uuid.uuid4().hex}"
    rows = B.ev(s, sf).withColumn("kind", F.lit("events")).withColumn("file_ts", S.bucket("file_ts", BATCH))
    older = F.col("file_ts") < S.bucket(F.lit(NOW), BATCH) - 2 * BATCH

    def then(number):
        cells = s.read.parquet(f"{path}/out").filter("granularity = 'hour'")
        publish({("events", 1095): rollup.window_agg(cells, 0, 1 << 40, ["geo_country"], ["n_events", "sum_w"])}, f"{path}/views", f"v{number:09d}", NOW)

    for part in (rows.filter(older), rows.filter(~older)):
        give(part, f"{path}/in")
        ingest(s, f"{path}/in", rows.schema, f"{path}/out", f"{path}/check", then=then)
    newest = s.read.parquet(f"{path}/views/manifest").agg(F.max("version")).first()[0]
    return read_view(s, f"{path}/views", newest, "events", 1095)


query("stream_publish", SQL["ingest_idempotent"])(republished)


def republished_on_change(s, sf):
    """Versions that rounds leave: batches, the same batches again, more batches, the same ones, and the same with another country left out."""
    import uuid
    from dataclasses import replace

    from ..streaming.ingest import ingest
    from .snapshot import content_hash, publish_changed, read_view

    path = f"{shared(s)}/changes-{uuid.uuid4().hex}"
    rows = B.ev(s, sf).withColumn("kind", F.lit("events")).withColumn("file_ts", S.bucket("file_ts", BATCH))
    older = F.col("file_ts") < S.bucket(F.lit(NOW), BATCH) - 2 * BATCH
    made, other = [], replace(B.EVENTS, excluded_geo=("03",))
    for part, o in ((rows.filter(older), B.EVENTS), (None, B.EVENTS), (rows.filter(~older), B.EVENTS), (None, B.EVENTS), (None, other), (None, other)):
        if part is not None:
            give(part, f"{path}/in")
        ingest(s, f"{path}/in", rows.schema, f"{path}/out", f"{path}/check")
        cells = s.read.parquet(f"{path}/out").filter("granularity = 'hour'")
        data = content_hash(cells).first()["hash"]

        def views(o=o, cells=cells):
            return {("events", 1095): rollup.window_agg(cells.filter(~F.col("geo_country").isin(*o.excluded_geo)), 0, 1 << 40, ["geo_country"], ["n_events", "sum_w"])}

        made.append(publish_changed(s, views, f"{path}/views", NOW, data, o))
    out = None
    for number, version in enumerate(made):
        if version:
            part = read_view(s, f"{path}/views", version, "events", 1095).select(F.lit(number).alias("round"), F.lit(version).alias("version"), "geo_country", "n_events", "sum_w")
            out = part if out is None else out.unionByName(part)
    return out


OLDER = f"bucket-bucket%{BATCH} < {NOW - NOW % BATCH - 2 * BATCH}"
query("stream_publish_changes", f"with {GEO} " + " union all ".join(
    f"select {number} as round, 'v{version:09d}' as version, geo_country, cast(sum(n_events) as bigint) as n_events, {r('sum(sum_w)', 'sum_w')} from geo where {where} group by geo_country"
    for number, version, where in ((0, 1, f"{OLDER} and geo_country<>'24'"), (2, 2, "geo_country<>'24'"), (4, 3, "geo_country<>'03'"))))(republished_on_change)


def versions_of_cells(s, sf):
    """Half of the batches taken in and compacted, then the rest: the first version as it stays for its readers, the newest one with what isn't compacted, after the second compaction and a vacuum, and after retention."""
    import uuid

    from ..operators.compaction import Compacted, retention
    from ..streaming.ingest import ingest

    path = f"{shared(s)}/compact-{uuid.uuid4().hex}"
    rows = B.ev(s, sf).withColumn("kind", F.lit("events")).withColumn("file_ts", S.bucket("file_ts", BATCH))
    older = F.col("file_ts") < S.bucket(F.lit(NOW), BATCH) - 2 * BATCH
    cells, out = Compacted(s, f"{path}/out/geo", rollup.GEO_KEYS), []

    def told(name, version=None):
        part = cells.read(version).groupBy("granularity", "geo_country").agg(F.count(F.lit(1)).alias("cells"), F.sum("n_events").alias("n_events"), F.sum("sum_w").alias("sum_w"))
        out.append(B.stored(part.select(F.lit(name).alias("state"), "*"), "told"))

    for part in (rows.filter(older), rows.filter(~older)):
        give(part, f"{path}/in")
        ingest(s, f"{path}/in", rows.schema, f"{path}/out/geo", f"{path}/check")
        if not out:
            first = cells.compact()
            told("first")
    told("pinned", first)
    told("followed")
    cells.compact()
    cells.vacuum(1)
    told("compacted")
    batches = s.read.parquet(f"{path}/in").select("kind", "file_ts").distinct().withColumn("status", F.lit("done")).withColumn("part", F.lit("a"))
    rollup.write_partials(batches.drop("part").withColumn("row_count", F.lit(1)), f"{path}/out/ledger")
    for _ in range(2):
        retention(s, f"{path}/out", {"geo": rollup.GEO_KEYS}, NOW, KEPT[0], KEPT[1])
    told("retained")
    ledger = s.read.parquet(f"{path}/out/ledger").groupBy("status").agg(F.count(F.lit(1)).alias("cells")).select(F.lit("ledger").alias("state"), F.col("status").alias("granularity"), F.lit(None).cast("string").alias("geo_country"), "cells", F.lit(None).cast("long").alias("n_events"), F.lit(None).cast("double").alias("sum_w"))
    for part in out:
        ledger = ledger.unionByName(part)
    return ledger


KEPT = (800, 1600)
CUT = NOW - NOW % DAY
query("compaction_versions", f"""with {EV}, {YEARLY}, g as (select * from y cross join (values ('hour'), ('day')) g(granularity)), t as (select bucket as file_ts from y group by 1)
select 'ledger' as state, case when file_ts<{CUT - KEPT[1] * DAY} then 'expired' else 'done' end as granularity, null as geo_country, count(*) as cells, null as n_events, null as sum_w from t group by 2
""" + "".join(f"union all select '{state}', granularity, geo_country, count(*), cast(sum(n_events) as bigint), {r('sum(sum_w)', 'sum_w')} from g where {where} group by 2,3 " for state, where in (
    ("first", f"{OLDER}"), ("pinned", f"{OLDER}"), ("followed", "true"), ("compacted", "true"),
    ("retained", f"bucket>=case granularity when 'hour' then {CUT - KEPT[0] * DAY} else {CUT - KEPT[1] * DAY} end"))))(versions_of_cells)
