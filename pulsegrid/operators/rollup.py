"""Additive statistics: relation, geo and article cells by hour or day, their partials and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import mentions_alias, theme_flags
from ..functions.scores import DAY, HOUR, bucket, mention_weight, negativity, quad_direction, unit
from ..options import CATEGORIES, Options

SIZES = {"hour": HOUR, "day": DAY}
RELATION_KEYS, GEO_KEYS, ARTICLE_KEYS = ("bucket", "actor1", "actor2", "root_code"), ("bucket", "geo_country", "root_code"), ("bucket", "country")


def _event_measures(relation: bool) -> list[Column]:
    w, g, t, q = mention_weight("mentions"), unit("goldstein"), unit("tone"), quad_direction("quad")
    out = [F.count(F.lit(1)).alias("n_events"), F.sum("mentions").cast("long").alias("sum_mentions"), F.sum("sources").cast("long").alias("sum_sources")]
    out += [F.count_if(F.col("quad") == i).alias(f"n_quad{i}") for i in (1, 2, 3, 4)]
    out += [F.sum(w).alias("sum_w"), F.sum(g * w).alias("sum_gold_w"), F.sum(t * w).alias("sum_tone_w"), F.sum(g).alias("sum_gold"), F.sum(t).alias("sum_tone")]
    if relation:
        out += [F.sum("articles").cast("long").alias("sum_articles"), F.sum(q * w).alias("sum_quad_w"), F.sum(F.abs(g) * w).alias("sum_absgold_w")]
    return out


def rollup_relation(ev: DataFrame, grain: str = "day", *extra: str) -> DataFrame:
    """Cells of two different three-letter actors; one shuffle, partial sums before it."""
    some = ev.filter((F.length("actor1") == 3) & (F.length("actor2") == 3) & (F.col("actor1") != F.col("actor2")))
    return some.withColumn("bucket", bucket("file_ts", SIZES[grain])).groupBy(*extra, *RELATION_KEYS).agg(*_event_measures(True))


def rollup_geo(ev: DataFrame, grain: str = "day", *extra: str) -> DataFrame:
    some = ev.filter(F.length("geo") == 2).withColumnRenamed("geo", "geo_country")
    return some.withColumn("bucket", bucket("file_ts", SIZES[grain])).groupBy(*extra, *GEO_KEYS).agg(*_event_measures(False))


def article_flags(art: DataFrame, o: Options = Options()) -> DataFrame:
    """Articles with what is searched in their texts in place of the texts, as ``rollup_flagged`` takes them."""
    flags = {f"_is_{c}": F.coalesce(f, F.lit(False)) for c, f in theme_flags("themes", o.themes).items()}
    return art.select(*(c for c in art.columns if c not in ("themes", "organizations")), *(f.alias(k) for k, f in flags.items()), mentions_alias("organizations", o.aliases).alias("alias"))


def rollup_articles(art: DataFrame, grain: str = "day", o: Options = Options(), *extra: str) -> DataFrame:
    """Each article counts once for each of its distinct countries; what is searched in its texts is searched before it is repeated for them."""
    return rollup_flagged(article_flags(art, o), grain, *extra)


def rollup_flagged(art: DataFrame, grain: str = "day", *extra: str) -> DataFrame:
    rows = art.select(
        *extra, bucket("file_ts", SIZES[grain]).alias("bucket"), F.col("tone").cast("double").alias("tone"), F.col("polarity").cast("double").alias("polarity"),
        *(c for c in art.columns if c.startswith("_is_")), "alias", F.array_distinct("countries").alias("_countries"),
    )
    rows = rows.withColumn("country", F.explode("_countries"))
    neg = negativity("tone")
    has = {c: F.col(f"_is_{c}") if f"_is_{c}" in art.columns else F.lit(False) for c in CATEGORIES}
    measures = [F.count(F.lit(1)).alias("total_docs"), *(F.count_if(h).alias(f"{c}_docs") for c, h in has.items())]
    measures += [F.count_if("alias").alias("alias_docs"), F.count(F.lit(1)).alias("modeled_docs"), *(F.count_if(h).alias(f"{c}_modeled_docs") for c, h in has.items())]
    measures += [F.sum("tone").alias("sum_tone"), F.sum("polarity").alias("sum_polarity"), F.sum("tone").alias("sum_modeled_tone"), F.sum(neg).alias("sum_negative_tone")]
    measures += [F.sum(F.when(h, neg).otherwise(0.0)).alias(f"{c}_negative") for c, h in has.items()]
    return rows.groupBy(*extra, *ARTICLE_KEYS).agg(*measures)


def merge_partials(df: DataFrame, keys) -> DataFrame:
    """Sum every measure; also how hour cells become day cells once the bucket is cut."""
    return df.groupBy(*keys).agg(*(F.sum(c).cast("long" if t == "bigint" else t).alias(c) for c, t in df.dtypes if c not in keys))


def to_day(cells: DataFrame, keys) -> DataFrame:
    return merge_partials(cells.withColumn("bucket", bucket("bucket", DAY)), keys)


def both_grains(hours: DataFrame, keys, *extra: str) -> DataFrame:
    """Hour cells and the day cells made of them, told apart by ``granularity``; the hours are made once for both."""
    grains = F.array(*(F.struct(F.lit(name).alias("granularity"), bucket("bucket", size).alias("bucket")) for name, size in SIZES.items()))
    each = hours.withColumn("_grain", F.explode(grains)).withColumns({"granularity": F.col("_grain.granularity"), "bucket": F.col("_grain.bucket")}).drop("_grain")
    return merge_partials(each, (*extra, *keys, "granularity")).select(*hours.columns, "granularity")


def finite_cells(cells: DataFrame) -> DataFrame:
    """The cells as they are; a measure that is not a finite number is an error, so that no sum is spoilt for ever."""
    odd = lambda c: F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf")))
    return cells.withColumns({c: F.when(odd(c), F.raise_error(F.lit(f"{c} is not a finite number")).cast("double")).otherwise(F.col(c)) for c, t in cells.dtypes if t == "double"})


def not_finite(cells: DataFrame) -> DataFrame:
    """One row: cells, and for each measure how many are no finite numbers."""
    some = [c for c, t in cells.dtypes if t == "double"]
    return cells.agg(F.count(F.lit(1)).alias("cells"), *(F.count_if(F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf")))).alias(c) for c in some))


def write_partials(df: DataFrame, path: str, *parts: str) -> None:
    """Partials by batch (kind, file_ts) and ``parts``: what is written again replaces its own directory, so reruns never double. A batch is one file."""
    by = ("kind", "file_ts", *parts)
    finite_cells(df).repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def compact(cells: DataFrame, path: str, keys) -> None:
    """Partials of all batches merged into a new table, a directory a kind and day of the bucket: few files, the same sums for readers."""
    whole = merge_partials(cells.drop("file_ts", "part"), ("kind", "granularity", *keys)).withColumn("day", bucket("bucket", DAY))
    whole.repartition("kind", "day").write.mode("overwrite").partitionBy("kind", "day").parquet(path)


def new_batches(batches: DataFrame, ledger: DataFrame) -> DataFrame:
    """Batches that the ledger doesn't hold as done; expired ones may come again."""
    return batches.join(ledger.filter("status = 'done'").select("kind", "file_ts"), ["kind", "file_ts"], "left_anti")


def window_agg(cells: DataFrame, start: int, now: int, keys, measures, where: Column | None = None) -> DataFrame:
    """Grouped sums over start <= bucket < now; without keys one row, of zeros where nothing matched."""
    some = cells.filter((F.col("bucket") >= start) & (F.col("bucket") < now))
    some = some.filter(where) if where is not None else some
    types = dict(cells.dtypes)
    sums = [m if isinstance(m, Column) else F.coalesce(F.sum(m), F.lit(0)).cast(types[m]).alias(m) for m in measures]
    return some.groupBy(*keys).agg(*sums) if keys else some.agg(*sums)


def masses(o: Options = Options()) -> list[Column]:
    """Negative strength by root group, clamped cell by cell."""
    neg = F.greatest(F.lit(0.0), -F.col("sum_gold_w"))
    groups = (("sec", o.security_roots), ("soc", o.social_roots), ("pol", o.political_roots))
    return [F.sum(F.when(F.col("root_code").isin(*roots), neg).otherwise(0.0)).alias(f"w_{k}") for k, roots in groups]


def _digests(cells: DataFrame, by: list, keys, measures) -> DataFrame:
    """A row a bucket: how many cells, and two digests of all their values that don't depend on their order."""
    values = [x for c in (*keys, *measures) for x in (F.col(c), F.col(c).isNull())]
    row = F.xxhash64(*values)
    return cells.groupBy(*by).agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), *values)).alias("xor")).alias("d"))


def aggregates_equal(a: DataFrame, b: DataFrame, keys, measures, rel: float = 1e-10, absolute: float = 1e-8, by: str = "bucket") -> DataFrame:
    """One row: keys compared, keys on one side only, values beyond tolerance.

    Cells meet only in the buckets (values of ``by``, one of the keys) whose digests differ; of the others only the number of cells is used. Keys are distinct on each side.
    A null or NaN equals itself alone.
    """
    both = _digests(a, [by], keys, measures).withColumnRenamed("d", "x").join(_digests(b, [by], keys, measures).withColumnRenamed("d", "y"), by, "full_outer")
    same = F.coalesce(F.col("x") == F.col("y"), F.lit(False))
    alike = both.filter(same).agg(F.coalesce(F.sum("x.n"), F.lit(0)).alias("_alike"))
    differ = both.filter(~same).select(by)
    side = lambda df, name: df.join(differ, by, "left_semi").select(*keys, F.struct(*measures).alias(name))
    rows = side(a, "x").join(side(b, "y"), list(keys), "full_outer")
    off = F.lit(0)
    for m in measures:
        x, y = F.col("x")[m], F.col("y")[m]
        odd = (x.isNull() != y.isNull()) | (F.isnan(x) != F.isnan(y))
        far = F.abs(x - y) > F.greatest(F.lit(rel) * F.greatest(F.abs(x), F.abs(y)), F.lit(absolute))
        off += F.coalesce(odd | (far & ~F.isnan(x)), F.lit(False)).cast("int")
    one = F.col("x").isNull() | F.col("y").isNull()
    sums = rows.agg(F.count(F.lit(1)).alias("_rows"), F.count_if(one).alias("one_sided"), F.coalesce(F.sum(F.when(~one, off)), F.lit(0)).cast("long").alias("mismatches"))
    return sums.crossJoin(alike).select((F.col("_rows") + F.col("_alike")).alias("n_keys"), "one_sided", "mismatches")  # one row each


def read_evolved(spark, path: str, measures: list[str]) -> DataFrame:
    """Cells of all schema versions under ``path``; measures that older files lack are 0."""
    return spark.read.option("mergeSchema", "true").parquet(path).fillna(0, measures)
