"""Fields of raw rows: codes, numbers, lists, themes, aliases."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import ROOTS, Options


def code(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def number(c: str) -> Column:
    """A text as a double, or null. What Java alone takes for a number (1.5d, 0x1p3, Infinity) is none; NaN is one."""
    text = F.col(c).cast("string")
    return F.when(~text.rlike("[dDfFxXpP]"), text.try_cast("double"))


def finite(x: Column) -> Column:
    """A number, or null where it is none that is finite."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def whole(x: Column) -> Column:
    """A number that is a long, or null."""
    return F.when(x == F.floor(x), F.floor(x))


def blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def count_value(c: str) -> Column:
    """Empty is 0; else a finite whole number, or null for what is none."""
    return F.when(blank(c), F.lit(0).cast("long")).otherwise(whole(number(c)))


def score_value(c: str) -> Column:
    """A finite number, or null."""
    return finite(number(c))


def score_bad(c: str) -> Column:
    return ~blank(c) & score_value(c).isNull()


COUNTS, SCORES = ("mentions", "sources", "articles"), ("goldstein", "tone")


def with_numbers(rows: DataFrame, counts: dict[str, str], scores: dict[str, str]) -> DataFrame:
    """``rows`` with new columns of count_value and score_value by name, from the text columns named.

    Each text becomes a double once, in a projection of its own: within one expression, its uses would each cast it again, and their code outgrows what Spark compiles.
    """
    made = rows.withColumns({f"_d_{k}": number(c) for k, c in (counts | scores).items()})
    values = {k: F.when(blank(c), F.lit(0).cast("long")).otherwise(whole(F.col(f"_d_{k}"))) for k, c in counts.items()}
    return made.withColumns(values | {k: finite(F.col(f"_d_{k}")) for k in scores}).drop(*(f"_d_{k}" for k in counts | scores))


def with_event_status(rows: DataFrame, o: Options = Options()) -> DataFrame:
    """``rows`` with row_status, the first rule that a raw row meets in the order of the checks: 'ok', 'skip_*' or 'reject_*'.

    Texts become numbers once, in a projection of their own; the checks then look at numbers. The status is a row made of each row: filters on it are not
    moved before it, where they would repeat its whole expression.
    """
    texts = (*COUNTS, *SCORES, "quad")
    made = with_numbers(rows, {f"_x_{c}": c for c in (*COUNTS, "quad")}, {f"_x_{c}": c for c in SCORES})
    x = {c: F.col(f"_x_{c}") for c in texts}
    any_of = lambda tests: functools.reduce(lambda a, b: a | b, tests)
    region = F.col("actor1").isin(*o.excluded_actors) | F.col("actor2").isin(*o.excluded_actors) | F.col("geo").isin(*o.excluded_geo)
    placeholder = F.col("root_code").isin("---", "--") & (F.col("event_code") == "---") & x["goldstein"].isNull()
    status = (
        F.when(F.coalesce(region, F.lit(False)), "skip_region")
        .when(any_of(x[c].isNull() for c in (*COUNTS, "quad")), "reject_count")
        .when(F.coalesce(placeholder, F.lit(False)), "skip_placeholder")
        .when(~F.coalesce(F.col("root_code").isin(*ROOTS), F.lit(False)) | ~x["quad"].isin(1, 2, 3, 4), "reject_enum")
        .when(any_of(~blank(c) & x[c].isNull() for c in SCORES), "reject_score")
        .when(any_of(x[c] < 0 for c in COUNTS), "reject_negative")
        .when(any_of(x[c].isNull() for c in SCORES), "skip_score")
        .otherwise("ok")
    )
    return made.select(*rows.columns, F.explode(F.array(status)).alias("row_status"))


def article_status(countries, tone: str, polarity: str | None = None) -> Column:
    """The first rule that an article meets; a tone or polarity that is given must be a number."""
    bad = score_value(tone).isNull() | (score_bad(polarity) if polarity else F.lit(False))
    return (
        F.when(F.size(countries) == 0, "skip_country")
        .when(F.trim(F.coalesce(F.col(tone), F.lit(""))) == "", "skip_tone")
        .when(bad, "reject_tone")
        .otherwise("ok")
    )


def location_countries(c: str, excluded: tuple[str, ...]) -> Column:
    """Distinct two-character country codes of a ';' list of '#' records, without the excluded."""
    parts = F.transform(F.split(F.col(c), ";"), lambda x: F.upper(F.coalesce(F.get(F.split(x, "#"), F.lit(2)), F.lit(""))))
    return F.array_sort(F.array_except(F.array_distinct(F.filter(parts, lambda x: F.length(x) == 2)), F.array(*map(F.lit, excluded))))


def tone_part(c: str, i: int) -> Column:
    return F.expr(f"try_cast(get(split({c}, ','), {i}) as double)")


def theme_flags(themes, markers: dict[str, list[str]]) -> dict[str, Column]:
    """For each category whether a marker stands in a theme between underscores or at its ends.

    The themes are joined once, between bars, and each marker is one plain search of that text; null without themes.
    """
    themes = F.col(themes) if isinstance(themes, str) else themes
    text = F.concat(F.lit("_"), F.upper(F.array_join(themes, "_|_")), F.lit("_"))
    found = lambda names: [F.contains(text, F.lit(f"_{m.rstrip('_')}_")) for m in names]
    return {k: functools.reduce(lambda a, b: a | b, found(names), F.lit(False)) for k, names in markers.items()}


def theme_categories(themes, markers: dict[str, list[str]]) -> Column:
    """The categories of ``theme_flags`` that hold, in order; none without themes."""
    flags = theme_flags(themes, markers)
    return F.array_except(F.array(*(F.when(f, F.lit(k)) for k, f in flags.items())), F.array(F.lit(None).cast("string")))


def mentions_alias(c: str, aliases: tuple[str, ...]) -> Column:
    words = "|".join(map(re.escape, sorted(aliases)))
    return F.lower(F.col(c)).rlike(f"(?<![a-z0-9])(?:{words})(?![a-z0-9])")
