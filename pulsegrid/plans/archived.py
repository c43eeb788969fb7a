"""Registered queries over batch archives that Spark writes from the given tables and reads back."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import fields
from ..functions import scores as S
from ..operators import ledger, rollup
from ..sources import archives as A
from . import bindings as B
from . import catalog as C
from .catalog import DAY, GD, ROUND, query, r

#: Columns of a line by place: the geo code stands at 53 of 61 columns, or at 51 of 58.
PLACES = {"event_id": 0, "actor1": 7, "actor2": 17, "event_code": 26, "root_code": 28, "quad": 29, "goldstein": 30, "mentions": 31, "sources": 32, "articles": 33, "tone": 34}
BATCH, EVERY = 90 * DAY, 27


def at_places(places: dict[str, int], n: int):
    """A line of ``n`` fields, empty but for the named columns. The tabs between two of them are one text: code for every field would be more than is compiled."""
    by, pieces, at = sorted((i, c) for c, i in places.items()), [], 0
    for i, c in by:
        pieces += [F.lit("\t" * (i - at)), F.coalesce(F.col(c).cast("string"), F.lit(""))]
        at = i
    return F.concat(*pieces, F.lit("\t" * (n - 1 - at)))


def event_archives(s, sf, path: str | None = None, second: bool = False) -> str:
    """The folder of archives of raw events in batches of 90 days, five of 27 with rows that reject them; both layouts stand in each.

    Second: a copy without these rows, in which odd batches have a broken count in every row.
    """
    path = path or f"{C.shared(s)}/archives-{uuid.uuid4().hex}"

    def render(events):
        rows = B.as_text(events, BATCH, 1 << 40 if second else EVERY, "name").withColumn("event_id", F.concat_ws("-", "order_id", "line_id"))
        if second:
            rows = rows.withColumn("mentions", F.when(F.floor(F.col("file_ts") / BATCH) % 2 == 1, "broken").otherwise(F.col("mentions")))
        line = F.when(F.col("order_id") % 2 == 0, at_places(PLACES | {"geo": 53}, 61)).otherwise(at_places(PLACES | {"geo": 51}, 58))
        return rows.withColumn("line", line)

    events = B.ev(s, sf).withColumns({"kind": F.lit("events"), "file_ts": S.bucket("file_ts", BATCH), "line_no": F.col("order_id") * 8 + F.col("line_id")})
    A.write_archives(events, path, render=render)
    return path


def article_archives(s, sf, spoilt: bool, path: str | None = None) -> str:
    """The folder of archives of articles in batches of a day; the last field of every third goes on after a line end.

    Spoilt: every 13th has an id after which no line may go on, every 17th a page title that is closed before the line end.
    """
    path = path or f"{C.shared(s)}/archives-{uuid.uuid4().hex}"
    doc = F.col("doc_id")
    title = F.when(doc % 17 == 0, "<PAGE_LINKS>a</PAGE_TITLE>").otherwise("<PAGE_LINKS>a") if spoilt else F.lit("<PAGE_LINKS>a")
    stamp = F.when(doc % 13 == 0, "x").otherwise("20240101000000") if spoilt else F.lit("20240101000000")

    def render(documents):
        rows = B.articles(documents, "name").withColumns({
            "id": F.concat_ws("-", stamp, "doc_id"), "listed": F.array_join("themes", ";"),
            "places": F.array_join(F.transform("countries", lambda c: F.concat(F.lit("1#name#"), F.lower(c), F.lit("#x"))), ";"),
            "words": F.regexp_replace("organizations", "[\\t\\r\\n]+", " "), "tones": F.concat_ws(",", "tone", F.lit("1"), F.lit("2"), "polarity"), "extras": title,
        })
        line = at_places({"id": 0, "listed": 7, "places": 9, "words": 13, "tones": 15, "extras": 26}, 27)
        return rows.withColumn("line", F.when(doc % 3 == 0, F.concat(line, F.lit("\nmore</PAGE_TITLE>"))).otherwise(line))

    documents = B.table(s, sf, "documents").withColumns({"kind": F.lit("gkg"), "file_ts": S.bucket(B.article_ts(), DAY), "line_no": doc})
    A.write_archives(documents, path, render=render)  # texts are dealt: their lines are two and a half times as long
    return path


BATCHED = C.raw_sql(BATCH, EVERY).replace("'events' as kind, file_ts,", f"'events' as kind, file_ts-file_ts%{BATCH} as file_ts,")
query("read_event_rows", f"with {BATCHED} select kind, file_ts, order_id||'-'||line_id as event_id, actor1, geo, mentions, row_status from st")(
    lambda s, sf: A.checked_events(A.read_lines(s, event_archives(s, sf)), B.EVENTS).select("kind", "file_ts", "event_id", "actor1", "geo", "mentions", "row_status"))
query("batch_key", "select distinct 'gkg' as kind, cast(1704067200+(doc_id%2880)*900 as bigint) as file_ts from documents union all select null, null")(
    lambda s, sf: A.batch_key(B.art(s, sf).select(F.concat(F.lit("file:/in/"), F.date_format(F.timestamp_seconds("file_ts"), "yyyyMMddHHmmss"), F.lit(".gkg.csv.zip")).alias("path")).distinct().union(s.range(1).select(F.lit("file:/in/notes.zip")))).drop("path"))
query("gkg_records", "select case when doc_id%13=0 then 'x' else '20240101000000' end||'-'||doc_id as record_id, doc_id%3<>0 or (doc_id%13<>0 and doc_id%17<>0) as valid from documents")(
    lambda s, sf: A.read_records(s, article_archives(s, sf, True)).select(F.get(F.split("line", "\t"), F.lit(0)).alias("record_id"), "valid"))


def archived_articles(s, sf):
    rows = A.typed_articles(A.checked_articles(A.read_records(s, article_archives(s, sf, False)), B.ARTICLES))
    flagged = B.stored(rollup.article_flags(rows, B.ARTICLES), "articles")  # both uses of the rows read it, in place of all texts
    return rollup.rollup_flagged(ledger.accepted(flagged))


query("read_article_rows", f"with {C.GKG} select * replace ({ROUND(GD)}) from gkg where country not in ('ES','S9')")(archived_articles)


def streamed(s, sf) -> str:
    """The folder of cells and ledger after both kinds of archives went through the ingest stream, in two runs with one checkpoint."""
    from ..streaming.ingest import ingest_archives

    path = f"{C.shared(s)}/stream-{uuid.uuid4().hex}"
    event_archives(s, sf, f"{path}/in")
    ingest_archives(s, f"{path}/in", f"{path}/out", f"{path}/check", o=OPTIONS)
    article_archives(s, sf, False, f"{path}/in")
    ingest_archives(s, f"{path}/in", f"{path}/out", f"{path}/check", o=OPTIONS)
    return f"{path}/out"


def stream_cells(s, sf):
    """Cells of the three tables by code: rows, and a sum of each."""
    path, out = streamed(s, sf), None
    for name, key, n, total in (("relation", "actor1", "n_events", "sum_w"), ("geo", "geo_country", "n_events", "sum_w"), ("articles", "country", "total_docs", "sum_tone")):
        part = rollup.window_agg(s.read.parquet(f"{path}/{name}").filter("granularity = 'hour'"), 0, 1 << 40, [key], [n, total]).toDF("code", "n", "total").select(F.lit(name).alias("cells"), "code", "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


#: Options of both kinds: homes and exclusions of events and of articles don't meet.
OPTIONS = replace(B.EVENTS, home_geo="ES", excluded_geo=(*B.EVENTS.excluded_geo, *B.ARTICLES.excluded_geo), themes=B.MARKERS, aliases=B.ARTICLES.aliases)
GOOD = "good as (select *, cast(1+least(greatest(cast(mentions as int),0),20)/10.0 as double) as w from st where row_status='ok' and file_ts not in (select file_ts from st where row_status like 'reject%'))"
query("stream_ingest", f"""with {BATCHED}, {GOOD}, {C.GKG} select 'relation' as cells, actor1 as code, count(*) as n, {r('sum(w)', 'total')} from good where actor1<>actor2 group by 2
union all select 'geo', geo, count(*), {r('sum(w)', 'total')} from good group by 2 union all select 'articles', country, cast(sum(total_docs) as bigint), {r('sum(sum_tone)', 'total')} from gkg where country not in ('ES','S9') group by 2""")(stream_cells)
query("stream_ledger", f"""with {BATCHED} select kind, file_ts, count(*) filter (row_status='ok') as row_count, count(*) filter (row_status like 'skip%') as skipped_rows, count(*) filter (row_status like 'reject%') as rejected, case when count(*) filter (row_status like 'reject%')>0 then 'failed' else 'done' end as status from st group by 1,2
union all select 'gkg', cast(1704067200+(doc_id%2880)*900 as bigint)//{DAY}*{DAY}, count(*) filter (lang<>'es' or right(source,1)<>'9'), count(*) filter (lang='es' and right(source,1)='9'), 0, 'done' from documents group by 2""")(
    lambda s, sf: s.read.parquet(f"{streamed(s, sf)}/ledger").select("kind", "file_ts", "row_count", "skipped_rows", "rejected", "status"))


def sent_again(s, sf) -> str:
    """The folder of cells and ledger after every batch of events was sent a second time, in another folder: even ones without a fault, odd ones with a broken count in every row."""
    from ..streaming.ingest import ingest_archives

    path = f"{C.shared(s)}/again-{uuid.uuid4().hex}"
    event_archives(s, sf, f"{path}/in/first")
    ingest_archives(s, f"{path}/in", f"{path}/out", f"{path}/check", o=OPTIONS)
    event_archives(s, sf, f"{path}/in/second", second=True)
    ingest_archives(s, f"{path}/in", f"{path}/out", f"{path}/check", o=OPTIONS)
    return f"{path}/out"


def cells_sent_again(s, sf):
    """Day cells of the relation table by batch, beside the ledger's verdict."""
    path = sent_again(s, sf)
    cells = s.read.parquet(f"{path}/relation").filter("granularity = 'day'").groupBy("file_ts").agg(F.sum("n_events").alias("n"), F.sum("sum_w").alias("total"))
    return s.read.parquet(f"{path}/ledger").join(cells, "file_ts", "left").select("file_ts", "status", "row_count", "n", "total")


#: A batch that was done stays as it was; one that had failed is taken from its second, whole copy.
SECOND = C.raw_sql(BATCH, 1 << 40).replace("'events' as kind, file_ts,", f"'events' as kind, file_ts-file_ts%{BATCH} as file_ts,")
LEDGER_SQL = "(select file_ts, case when count(*) filter (row_status like 'reject%')>0 then 'failed' else 'done' end as status, count(*) filter (row_status='ok') as row_count from st group by 1)"
CELLS_SQL = "(select file_ts, count(*) as n, sum(cast(1+least(greatest(cast(mentions as int),0),20)/10.0 as double)) as total from st where row_status='ok' and actor1<>actor2 group by 1)"
query("stream_resend", f"""select a.file_ts, case when a.status='done' or (a.file_ts//{BATCH})%2=0 then 'done' else 'failed' end as status,
case when a.status='done' then a.row_count when (a.file_ts//{BATCH})%2=0 then b.row_count else c.row_count end as row_count,
case when a.status='done' then x.n when (a.file_ts//{BATCH})%2=0 then y.n end as n, {r(f"case when a.status='done' then x.total when (a.file_ts//{BATCH})%2=0 then y.total end", 'total')}
from (with {BATCHED} select * from {LEDGER_SQL}) a join (with {SECOND} select * from {LEDGER_SQL}) b on a.file_ts=b.file_ts
join (with {BATCHED} select file_ts, cast(0 as bigint) as row_count from st group by 1) c on c.file_ts=a.file_ts
left join (with {BATCHED} select * from {CELLS_SQL}) x on x.file_ts=a.file_ts left join (with {SECOND} select * from {CELLS_SQL}) y on y.file_ts=a.file_ts""")(cells_sent_again)


def copies_in_one_run(s, sf):
    """Two copies of every batch in one run, in folders a and b: a's are spoilt in five of 27 batches, b's odd ones in every row. The ledger's verdict and attempts beside day cells and the log of copies."""
    from ..streaming.ingest import ingest_archives, read_copies

    path = f"{C.shared(s)}/copies-{uuid.uuid4().hex}"
    event_archives(s, sf, f"{path}/in/a")
    event_archives(s, sf, f"{path}/in/b", second=True)
    ingest_archives(s, f"{path}/in", f"{path}/out", f"{path}/check", o=OPTIONS, now=lambda: C.NOW)
    cells = s.read.parquet(f"{path}/out/relation").filter("granularity = 'day'").groupBy("file_ts").agg(F.sum("n_events").alias("n"), F.sum("sum_w").alias("total"))
    copies = read_copies(s, f"{path}/out/copies").groupBy("file_ts").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", F.element_at(F.split("path", "/"), -2), "status"))), ",").alias("copies"))
    return s.read.parquet(f"{path}/out/ledger").join(cells, "file_ts", "left").join(copies, "file_ts").select("file_ts", "status", "row_count", "attempts", "retry_attempts", "done_at", "n", "total", "copies")


EVEN = f"(a.file_ts//{BATCH})%2=0"
query("stream_copies", f"""select a.file_ts, case when a.status='done' or {EVEN} then 'done' else 'failed' end as status, case when a.status='done' then a.row_count when {EVEN} then b.row_count else c.row_count end as row_count,
case when a.status='done' then 1 else 2 end as attempts, case when a.status='done' then 1 else 2 end as retry_attempts, case when a.status='done' or {EVEN} then cast({C.NOW} as bigint) end as done_at,
case when a.status='done' then x.n when {EVEN} then y.n end as n, {r(f"case when a.status='done' then x.total when {EVEN} then y.total end", 'total')},
case when a.status='done' then 'a:done,b:spare' when {EVEN} then 'a:failed,b:done' else 'a:failed,b:failed' end as copies
from (with {BATCHED} select * from {LEDGER_SQL}) a join (with {SECOND} select * from {LEDGER_SQL}) b on a.file_ts=b.file_ts
join (with {BATCHED} select file_ts, cast(0 as bigint) as row_count from st group by 1) c on c.file_ts=a.file_ts
left join (with {BATCHED} select * from {CELLS_SQL}) x on x.file_ts=a.file_ts left join (with {SECOND} select * from {CELLS_SQL}) y on y.file_ts=a.file_ts""")(copies_in_one_run)
