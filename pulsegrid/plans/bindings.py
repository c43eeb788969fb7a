"""The operators' inputs as views of the given tables: events, articles, slots, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import DAY
from ..operators.coverage import Span, coverage_buckets
from ..operators.rollup import rollup_articles, rollup_geo, rollup_relation
from ..options import Options
from ..scratch import shared, stored  # noqa: F401

AS_OF, ART_AS_OF = 996_667_200, 1_706_659_200
SPAN, ART_SPAN = Span(365, AS_OF), Span(30, ART_AS_OF)
EVENTS = Options(home_actor="N06", home_geo="06", excluded_geo=("24",), excluded_actors=("N24",))
MARKERS = {"security": ["THE"], "political": ["DE"], "economic": ["OF"], "infrastructure": ["LA"], "social": ["AND"], "health": ["DER"]}
ARTICLES = Options(home_geo="ES", excluded_geo=("S9",), themes=MARKERS, aliases=("that", "que"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Bytes of its files that a task takes of a table that is dealt, as far as that gives more tasks than cores.
TASK_BYTES = 32 << 20


def spread(df: DataFrame, key: str, source: DataFrame | None = None) -> DataFrame:
    """Rows dealt over all cores by ``key`` where a table has fewer files than there are cores (one file may be one row group, so one task); others stay as read.

    More bytes are dealt over more tasks. ``source`` is the table whose files count, where ``df`` is more than a table.
    """
    spark, files = df.sparkSession, (source or df).inputFiles()
    cores = spark.sparkContext.defaultParallelism
    if len(files) >= cores:
        return df
    paths = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)) for f in files]
    size = sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)
    return df.repartition(max(cores, -(-size // TASK_BYTES)), key)


def epoch(c: str):
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def code(c: str):
    return F.lpad(F.col(c).cast("string"), 2, "0")


def ev(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))  # the fewer rows first: line items are shuffled once
    lines = table(spark, sf, "lineitem")
    supplied = lines.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))  # before they are dealt: rows of other suppliers than a query asks for don't move
    rows = spread(supplied, "l_orderkey", lines).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        (F.floor(epoch("o_orderdate") / 900) * 900).cast("long").alias("file_ts"), F.concat(F.lit("N"), code("c_nationkey")).alias("actor1"),
        F.concat(F.lit("N"), code("s_nationkey")).alias("actor2"), code("s_nationkey").alias("geo"),
        F.lpad((F.col("l_partkey") % 20 + 1).cast("string"), 2, "0").alias("root_code"), (F.col("l_linenumber") % 4 + 1).cast("int").alias("quad"),
        ((F.col("l_quantity").cast("double") - 25) / F.lit(2.5)).alias("goldstein"), F.col("l_quantity").cast("int").alias("mentions"),
        F.col("l_linenumber").cast("int").alias("sources"), (F.col("l_linenumber") + 1).cast("int").alias("articles"),
        ((F.col("l_tax").cast("double") - F.lit(0.05)) * F.lit(200.0)).alias("tone"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_id"),
    )


def raw_events(spark: SparkSession, sf: str, batch: int = DAY, every: int = 50) -> DataFrame:
    return as_text(ev(spark, sf), batch, every)


def as_text(events: DataFrame, batch: int, every: int, *more: str) -> DataFrame:
    """Event rows as text, beside ``more`` of their columns. Some are to be skipped; of every ``every`` batches five hold rows that must reject them: a broken count, another
    root code, a negative count beside an empty score, a broken score, a placeholder with a score."""
    rows = events.withColumn("k", F.when(F.col("line_id") == 1, F.floor(F.col("file_ts") / batch) % every))
    text = {c: F.col(c).cast("string") for c in ("quad", "goldstein", "sources", "articles", "mentions", "tone")}
    none, k = F.col("order_id") % 89 == 0, F.coalesce("k", F.lit(-1))
    return rows.select(
        *more, F.lit("events").alias("kind"), "file_ts", "order_id", "line_id", F.concat(F.lit(" "), F.lower("actor1")).alias("actor1"), "actor2", "geo",
        F.when(none | (k == 4), "---").otherwise(F.col("root_code")).alias("event_code"),
        F.when(none, "---").when(k == 4, "--").when(k == 1, "21").otherwise(F.col("root_code")).alias("root_code"),
        F.when(F.col("order_id") % 5 == 0, F.concat(text["quad"], F.lit(".0"))).otherwise(text["quad"]).alias("quad"),
        F.when(k == 3, "x").when(none & (k != 4), "").otherwise(text["goldstein"]).alias("goldstein"), text["sources"].alias("sources"), text["articles"].alias("articles"),
        F.when(k == 0, "broken").when(k == 2, "-3").otherwise(text["mentions"]).alias("mentions"),
        F.when((F.col("order_id") % 97 == 0) | k.isin(2, 3), "").otherwise(text["tone"]).alias("tone"),
    )


def art(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spread(table(spark, sf, "documents"), "doc_id"))


def article_ts():
    return (F.lit(1704067200) + F.col("doc_id") % 2880 * 900).cast("long")


def articles(documents: DataFrame, *more: str) -> DataFrame:
    """Articles made of each document, beside ``more`` of its columns."""
    lang, words = F.upper("lang"), F.upper(F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")))
    themes = F.split(F.concat(lang, F.lit("_"), F.replace(words, F.lit(" "), F.concat(F.lit(" "), lang, F.lit("_")))), " ")
    return documents.select(
        *more, "doc_id", article_ts().alias("file_ts"),
        F.array(lang, F.concat(F.lit("S"), F.substring("source", -1, 1))).alias("countries"), ((F.col("n_chars") % 41 - 20) / F.lit(2.0)).cast("double").alias("tone"),
        (F.col("n_chars") % 7).cast("double").alias("polarity"), F.lower("text").alias("organizations"), F.when(words == "", F.expr("cast(array() as array<string>)")).otherwise(themes).alias("themes"),
    )


def slots(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").groupBy(F.col("event_type").alias("kind"), (F.floor(epoch("ts") / 900) * 900).cast("long").alias("file_ts"))
    out = rows.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("value") < 1).alias("skipped_rows"))
    return out.withColumn("status", F.when(F.col("skipped_rows") > 0, "failed").otherwise("done"))


def nations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(code("n_nationkey").alias("code"), F.col("n_name").alias("label"))


def rel_cells(spark: SparkSession, sf: str) -> DataFrame:
    return rollup_relation(ev(spark, sf), "day")


def geo_cells(spark: SparkSession, sf: str) -> DataFrame:
    return rollup_geo(ev(spark, sf), "day")


def gkg_cells(spark: SparkSession, sf: str) -> DataFrame:
    return rollup_articles(art(spark, sf), "day", ARTICLES)


def day_coverage(spark: SparkSession, sf: str, back: int = 0, cells: DataFrame | None = None) -> DataFrame:
    """Coverage of the event days, of the rows or of ``cells`` made of them; a day is one slot here."""
    seen = ev(spark, sf).select("file_ts") if cells is None else cells.select(F.col("bucket").alias("file_ts"))
    days = seen.distinct().withColumn("kind", F.lit("events"))
    return coverage_buckets(days, days, SPAN.start - back * DAY, SPAN.end + DAY, DAY, AS_OF, DAY)


def art_coverage(spark: SparkSession, sf: str) -> DataFrame:
    days = art(spark, sf).select(F.lit("gkg").alias("kind"), "file_ts").distinct()
    return coverage_buckets(days, days, ART_SPAN.start, ART_SPAN.end + DAY, DAY, ART_AS_OF)
