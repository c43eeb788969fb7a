"""Code dimensions: lookups with a fallback, a crosswalk of two code tables, free-form names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Labels of the four quad classes and of the twenty root codes.
QUADS = {1: "verbal cooperation", 2: "material cooperation", 3: "verbal conflict", 4: "material conflict"}
ROOT_LABELS = {
    "01": "public statement", "02": "appeal", "03": "intent to cooperate", "04": "consultation", "05": "diplomatic cooperation",
    "06": "material cooperation", "07": "aid", "08": "concession", "09": "investigation", "10": "demand",
    "11": "disapproval", "12": "rejection", "13": "threat", "14": "protest", "15": "show of force",
    "16": "reduced relations", "17": "coercion", "18": "assault", "19": "fight", "20": "unconventional violence",
}


def code_reference(spark: SparkSession, countries: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """kind, code, label of countries (code, label) without the excluded, of the root codes and of the quad classes."""
    fixed = [("root", k, v) for k, v in ROOT_LABELS.items()] + [("quad", str(k), v) for k, v in QUADS.items()]
    rows = spark.createDataFrame(fixed, "kind string, code string, label string")
    return countries.filter(~F.col("code").isin(*excluded)).select(F.lit("country").alias("kind"), "code", "label").unionByName(rows)


def with_label(df: DataFrame, dim: DataFrame, key: str, prefix: str = "unidentified") -> DataFrame:
    """Left join of ``dim``(code, label); unknown codes get a label that says so."""
    out = df.join(dim.select(F.col("code").alias(key), "label"), key, "left")
    return out.withColumn("label", F.coalesce("label", F.concat(F.lit(prefix + " ("), F.col(key), F.lit(")"))))


def _first(df: DataFrame, key: str) -> DataFrame:
    """The first code of each value of ``key``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("code"))).filter("_r = 1").drop("_r")


def crosswalk(a: DataFrame, b: DataFrame, supplements: DataFrame) -> DataFrame:
    """a_code, b_code by equal names: every a code, with the first b code of its name; supplements where a code has none."""
    known = a.select("label", F.col("code").alias("a_code")).join(_first(b, "label").select("label", F.col("code").alias("b_code")), "label").select("a_code", "b_code")
    return known.unionByName(supplements.join(known.select("a_code"), "a_code", "left_anti").select("a_code", "b_code"))


def _pieces(text, size):
    """The distinct pieces of a length of a text; none of a shorter text."""
    count = F.length(text) - size + 1
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.substr(text, i, size)))).otherwise(F.expr("cast(array() as array<string>)"))


def _within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer) of distinct texts where the inner one stands in a longer outer one.

    An outer text is cut into all its pieces of those lengths that inner texts have, and the pieces are looked up: pairs that don't match never meet. Cut pieces are many
    more than Spark expects, so neither side is broadcast. The lengths go to the driver, a row a length.
    """
    longest = outer.agg(F.max(F.length("outer"))).first()[0] or 0
    lengths = sorted(r[0] for r in inner.select(F.length("inner").alias("n")).filter(F.col("n") < longest).distinct().collect())
    sized = outer.select("outer", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("_size")).filter(F.length("outer") > F.col("_size"))
    held = sized.select("outer", F.explode(_pieces(F.col("outer"), F.col("_size"))).alias("inner"))
    return held.hint("merge").join(inner, "inner").select("inner", "outer")


def contained_pairs(values: DataFrame, value: str, names: DataFrame, name: str, shortest: int = 2) -> DataFrame:
    """Pairs of distinct ``value`` and rows of ``names`` where they are equal, or where a name of ``shortest`` letters or more contains the value or is contained in it.

    All three cases are joins on equal keys (the texts, or pieces of them), so no value meets a name that it doesn't match. Empty texts and nulls match nothing; repeated rows of names stay.
    """
    v = values.select(F.col(value).alias("v")).filter("v <> ''").distinct()
    n = names.select(F.col(name).alias("n")).filter(F.length("n") >= max(shortest, 1)).distinct()
    inside = _within(v.toDF("inner"), n.toDF("outer")).select(F.col("inner").alias(value), F.col("outer").alias(name))
    around = _within(n.toDF("inner"), v.toDF("outer")).select(F.col("outer").alias(value), F.col("inner").alias(name))
    equal = v.withColumnRenamed("v", value).hint("merge").join(names, F.col(value) == F.col(name))
    return inside.unionByName(around).hint("merge").join(names, name).unionByName(equal)


def resolve_countries(df: DataFrame, column: str, a: DataFrame, b: DataFrame, cross: DataFrame, names: DataFrame, excluded_a: tuple[str, ...] = (), excluded_b: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with a_code, b_code and name of a free-form value; null where there is no match, or an excluded one.

    A three-letter value that is a code of ``a``, else a two-letter one that is a code of ``b``, else an exact name of ``names``(label, a_code, place: table
    first, then aliases), else the first of them in that order, of two letters or more, that contains the value or is contained in it. A code of ``b``
    without one of ``a`` stands alone. Codes match in any case, names as they are.
    """
    raw = F.trim(F.col(column).cast("string"))
    keys = df.select(column).distinct().withColumns({"_raw": raw, "_key": F.upper(raw)}).filter("_raw <> ''")
    first_a = cross.groupBy("b_code").agg(F.min("a_code").alias("_from_b"))
    own = a.select(F.col("code").alias("_key"), F.col("code").alias("_a3")).filter(F.length("_key") == 3)
    two = b.filter(F.length("code") == 2).select(F.col("code").alias("_key"), F.col("code").alias("_b2"), F.col("label").alias("_b_label"))
    keys = keys.join(own, "_key", "left").join(two, "_key", "left").join(first_a.withColumnRenamed("b_code", "_b2"), "_b2", "left")
    open_ = keys.filter("_a3 is null and _b2 is null").select("_raw")
    pairs = contained_pairs(open_, "_raw", names, "label")
    best = pairs.groupBy("_raw").agg(F.min_by("a_code", F.struct(F.col("_raw") != F.col("label"), "place")).alias("_named"))
    keys = keys.join(best, "_raw", "left").withColumn("a_code", F.coalesce("_a3", "_from_b", "_named"))
    labels = a.select(F.col("code").alias("a_code"), F.col("label").alias("_a_label"))
    keys = keys.join(labels, "a_code", "left").join(cross.groupBy("a_code").agg(F.min("b_code").alias("_b")), "a_code", "left")
    out = F.coalesce(F.col("a_code").isin(*excluded_a) | F.col("_key").isin(*excluded_b), F.lit(False)) | F.coalesce("a_code", "_b2").isNull()
    shown = {"a_code": F.coalesce("a_code", F.lit("")), "b_code": F.coalesce("_b", F.when(F.col("a_code").isNull(), F.col("_b2")), F.lit("")), "name": F.coalesce("_a_label", F.when(F.col("a_code").isNull(), F.col("_b_label")), "_raw")}
    return df.join(keys.select(column, *(F.when(~out, c).alias(k) for k, c in shown.items())), column, "left")
