"""Quality rules by weak supervision, in DataFrame functions only.

Eight rules look at a text's counts and vote good (1), bad (-1) or abstain (0). Expectation-maximisation over the
distinct vote patterns (3^8 at most, with their row counts) estimates each rule's accuracy on good and on bad documents, and the share of good documents; a
document's posterior probability of being good replaces the demand that all rules pass. Only that bounded table
is visited again in the iterations.

Words are runs without space, tab, line feed, vertical tab, form feed and return. Null text has no words and fails the
base check, as does any text of less than 50 words. Repeated rows are judged alike; a posterior at the threshold keeps. No text leaves its
task; a text is one row whatever its length, and its counts take memory in proportion to it. Columns of any name pass through untouched.
An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BREAK, written

SYMBOLS = "[#*$%&|<>]"
RULES = ("length", "repetition", "symbols", "lines", "word_size", "capitals", "letters", "sentences")


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_q_*`` columns: what the rules look at. ``docs`` has none of such names."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    spelt = docs.select(
        "*",
        F.array_remove(F.split(t, BREAK + "+"), "").alias("_q_words"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_q_lines"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("_q_symbols"),
        F.regexp_count(t, F.lit("[.!?]")).cast("long").alias("_q_stops"),
        F.length(F.regexp_replace(t, "[^\\p{Lu}]+", "")).cast("long").alias("_q_capitals"),
        F.length(F.regexp_replace(t, "[^\\p{L}]+", "")).cast("long").alias("_q_letters"),
    )
    words, n = F.col("_q_words"), F.size("_q_words")
    none = F.expr("cast(array() as array<struct<k:string,i:int>>)")
    three = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("k"), i.alias("i")))
    spelt = spelt.select(
        *(c for c in spelt.columns if c not in ("_q_words", "_q_lines")),
        n.cast("long").alias("_q_n"),
        F.length(F.array_join(words, "")).cast("long").alias("_q_chars"),
        F.size("_q_lines").cast("long").alias("_q_n_lines"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("_q_dup_lines"),
        F.sort_array(F.when(n >= 3, three).otherwise(none)).alias("_q_three"),
    )
    s = F.col("_q_three")
    again = F.filter(s, lambda x, j: (F.get(s, j - 1)["k"] == x["k"]) | (F.get(s, j + 1)["k"] == x["k"]))
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    spelt = spelt.select(*(c for c in spelt.columns if c != "_q_three"), places.alias("_q_places"))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at"))
    covered = F.aggregate("_q_places", start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at")), lambda a: a["n"])
    return spelt.select(*(c for c in spelt.columns if c != "_q_places"), covered.cast("long").alias("_q_repeat"))


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes() -> dict[str, Column]:
    n = F.greatest(F.col("_q_n"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("_q_chars"), F.lit(1)).cast("double")
    letters = F.greatest(F.col("_q_letters"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("_q_n_lines"), F.lit(1)).cast("double")
    size, some = F.col("_q_chars") / n, F.col("_q_n") >= 50
    return {
        "length": vote(n >= 80, n < 50),
        "repetition": vote(F.col("_q_repeat") <= 0.2 * n, F.col("_q_repeat") > 0.5 * n),
        "symbols": vote(F.col("_q_symbols") <= 0.02 * n, F.col("_q_symbols") > 0.1 * n),
        "lines": vote(F.col("_q_dup_lines") == 0, F.col("_q_dup_lines") > 0.3 * lines),
        "word_size": vote((size >= 3) & (size <= 9), (size < 2.5) | (size > 12)),
        "capitals": vote(F.col("_q_capitals") <= 0.15 * letters, F.col("_q_capitals") > 0.4 * letters),
        "letters": vote(F.col("_q_letters") >= 0.92 * chars, F.col("_q_letters") < 0.88 * chars),
        "sentences": vote((F.col("_q_stops") >= 0.02 * n) & (F.col("_q_stops") <= 0.5 * n), some & (F.col("_q_stops") < 0.005 * n)),
    }


@dataclass(frozen=True)
class Fit:
    """Share of good documents; of each rule, P(votes good | good, votes) and P(votes bad | bad, votes)."""

    good: float
    on_good: dict[str, float]
    on_bad: dict[str, float]


START = Fit(0.8, dict.fromkeys(RULES, 0.9), dict.fromkeys(RULES, 0.4))


def posterior(fit: Fit) -> Column:
    """P(good) of a row of ``_v_*`` votes."""
    logit = F.lit(math.log(fit.good / (1 - fit.good)))
    for rule in RULES:
        a, b = fit.on_good[rule], fit.on_bad[rule]
        v = F.col(f"_v_{rule}")
        logit = logit + F.when(v == 1, F.lit(math.log(a / (1 - b)))).when(v == -1, F.lit(math.log((1 - a) / b))).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def estimate(patterns: DataFrame, rounds: int = 20) -> Fit:
    """EM from equal accuracies, which count as two votes of each kind. A vote never counts against its name: on_good + on_bad stays at 1 or more.

    Accuracies stay within 0.5 .. 0.99 on good documents and below 0.99 on bad ones, so that no vote decides alone for ever.
    """
    fit, p, n = START, F.col("_p"), F.col("_n")
    for _ in range(rounds):
        sums = [F.sum(n).alias("n"), F.sum(n * p).alias("good")]
        for r in RULES:
            v = F.col(f"_v_{r}")
            for name, mass, some in (("gg", n * p, v == 1), ("g", n * p, v != 0), ("bb", n * (1 - p), v == -1), ("b", n * (1 - p), v != 0)):
                sums.append(F.sum(F.when(some, mass).otherwise(0.0)).alias(f"{name}_{r}"))
        row = patterns.withColumn("_p", posterior(fit)).agg(*sums).first()
        if not row["n"]:
            return fit
        a = {r: min(0.99, max(0.5, (row[f"gg_{r}"] + 2 * START.on_good[r]) / (row[f"g_{r}"] + 2))) for r in RULES}
        b = {r: min(0.99, max(1 - a[r], 0.01, (row[f"bb_{r}"] + 2 * START.on_bad[r]) / (row[f"b_{r}"] + 2))) for r in RULES}
        new = Fit(min(0.98, max(0.02, (row["good"] + 1) / (row["n"] + 2))), a, b)
        moved = max([abs(new.good - fit.good), *(abs(a[r] - fit.on_good[r]) + abs(b[r] - fit.on_bad[r]) for r in RULES)])
        fit = new
        if moved < 1e-4:
            break
    return fit


def judged(docs: DataFrame, columns: list[str], text: str = "text", threshold: float = 0.5, rounds: int = 20) -> DataFrame:
    """``columns`` of ``docs`` with counts, votes, ``_q_failed``, ``_q_posterior`` and ``_q_kept``. Counts are made once and written."""
    rows = counts(docs, text)
    made = [c for c in rows.columns if c.startswith("_q_")]
    rows = written(rows.select(*columns, *made).select("*", *(c.alias(f"_v_{r}") for r, c in votes().items())), "quality")
    patterns = written(rows.groupBy(*(f"_v_{r}" for r in RULES)).agg(F.count(F.lit(1)).alias("_n")), "quality-patterns")
    fit = estimate(patterns, rounds)
    n = F.col("_q_n")
    rows = rows.withColumn("_q_failed", (n < 50) | (100 * F.col("_q_repeat") > 50 * n)).withColumn("_q_posterior", posterior(fit))
    return rows.withColumn("_q_kept", ~F.col("_q_failed") & (F.col("_q_posterior") >= threshold))


def quality(docs: DataFrame, threshold: float = 0.5, rounds: int = 20) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the posterior."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return judged(base, ["doc_id"], "text", threshold, rounds).select(
        "doc_id", F.col("_q_n").alias("n_words"), F.col("_q_chars").alias("word_chars"), F.col("_q_symbols").alias("n_symbols"),
        F.col("_q_dup_lines").alias("n_dup_lines"), F.col("_q_repeat").alias("n_repeat_words"), F.col("_q_failed").alias("base_failed"),
        F.col("_q_kept").alias("kept"), F.col("_q_posterior").alias("posterior"),
    )


def passing(docs: DataFrame, threshold: float = 0.5, rounds: int = 20) -> DataFrame:
    """Rows of ``docs`` that are kept, with their columns as they are."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # its columns' names meet none of ours
    return judged(whole, ["row"], "row.text", threshold, rounds).filter("_q_kept").select("row.*")
