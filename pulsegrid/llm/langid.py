"""Language identification by rank-order profiles.

A profile ranks a language's most frequent letter n-grams (one to three letters, words joined by one
space). A document's own most frequent n-grams are compared to each profile by the out-of-place distance:
the sum over its n-grams of the difference in rank, or of the profile's size where the profile lacks it.

Profiles are fitted on a sample of labelled rows: about ``max_docs`` of each language, chosen by a hash of doc_id, so that rare languages
have a profile whatever the size of the others. Languages are a closed set: their counts go to the driver, and more than ``LANGUAGES`` are an error.
Null text, and text without a letter, is ``und`` with score 0. Equal distances go to the language that
sorts first; equal counts of n-grams to the n-gram that sorts first. Without labelled rows every document is ``und``. Repeated rows are
predicted alike. A text is one row of one task; its n-grams take memory in proportion to it. Other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_whole, rows_map, small_batches

UND = "und"
LANGUAGES = 10_000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for what is no letter."""
    table = np.full(0x110000, 32, dtype=np.int64)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as integers, and their counts."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    x = letters()[points]
    x = np.concatenate(([32], x, [32]))
    x = x[(x != 32) | np.concatenate(([True], x[:-1] != 32))]
    if x.size < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = x[:-1] << 21 | x[1:]
    three = two[:-1] << 21 | x[2:]
    return np.unique(np.concatenate((x[x != 32], two, three)), return_counts=True)


def ranked(text: str, size: int) -> np.ndarray:
    """The text's most frequent n-grams, ties by n-gram."""
    keys, counts = grams(text)
    if keys.size > size:
        least = -np.partition(-counts, size - 1)[size - 1]
        some = counts >= least
        keys, counts = keys[some], counts[some]
    return keys[np.argsort(-counts, kind="stable")][:size]


def fit(docs: DataFrame, size: int = 300, max_docs: int = 5_000) -> dict[str, list[int]]:
    """Profiles of the values of ``lang``, from a sample of the rows of ``docs`` that have one."""
    known = docs.select(F.col("doc_id"), F.col("text").cast("string"), F.col("lang").cast("string")).filter("lang is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(LANGUAGES + 1).collect()}  # a row a language
    if len(counts) > LANGUAGES:
        raise ValueError("too many values of lang")
    if not counts:
        return {}
    shares = docs.sparkSession.createDataFrame([(k, int(min(1.0, max_docs / n) * 1_000_000) or 1) for k, n in counts.items()], "lang string, share long")
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("profile")), F.lit(1_000_000))
    sample = known.join(F.broadcast(shares), "lang").filter((place < F.col("share")) & F.col("text").isNotNull())
    small_batches(docs.sparkSession)

    def make():
        def each(rows: dict) -> dict:
            by: dict = {}
            for text, lang in zip(rows["text"], rows["lang"]):
                by.setdefault(lang, []).append(grams(text))
            out: dict = {"lang": [], "gram": [], "n": []}
            for lang, pairs in by.items():
                keys, where = np.unique(np.concatenate([k for k, _ in pairs]), return_inverse=True)
                n = np.bincount(where, weights=np.concatenate([c for _, c in pairs])).astype(np.int64)
                out["lang"] += [lang] * keys.size
                out["gram"] += keys.tolist()
                out["n"] += n.tolist()
            return out

        return each

    counts = rows_map(sample.select("text", "lang"), make, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Judge:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, list[int]], size: int, sharpness: float):
        self.langs, self.size, self.sharpness = sorted(profiles), size, sharpness
        self.known = np.unique(np.concatenate([np.array(p, np.int64) for p in profiles.values()])) if profiles else np.empty(0, np.int64)
        self.rank = np.full((self.known.size + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.known, np.array(profiles[lang], np.int64)), j] = np.arange(len(profiles[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        return self.nearest(text)[:2]

    def nearest(self, text: str | None) -> tuple[str, float, float]:
        """The nearest profile, its score, and its distance as a share of the greatest one."""
        own = ranked(text, self.size) if text else np.empty(0, np.int64)
        if not own.size or not self.langs:
            return UND, 0.0, 1.0
        i = np.searchsorted(self.known, own)
        i[(i < self.known.size) & (self.known[np.minimum(i, self.known.size - 1)] != own)] = self.known.size
        there = self.rank[i]
        away = np.where(there < 0, self.size, np.abs(there - np.arange(own.size)[:, None])).sum(axis=0) / (own.size * self.size)
        p = np.exp(-self.sharpness * (away - away.min()))
        best = int(np.argmin(away))
        return self.langs[best], float(p[best] / p.sum()), float(away[best])


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = 300, sharpness: float = 20.0) -> DataFrame:
    """doc_id, lang_pred, score: the nearest profile, and its share when distances are weighed exponentially."""
    small_batches(docs.sparkSession)

    def make():
        judge = Judge(profiles, size, sharpness)

        def each(rows: dict) -> dict:
            found = [judge(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

        return each

    return rows_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, profiles: dict[str, list[int]], most_away: float = 1.0, size: int = 300) -> DataFrame:
    """Rows of ``docs`` with a letter at least whose nearest profile is no farther than ``most_away``. Columns stay as they are.

    The distance is a share of the greatest one, and depends on the nearest profile alone, not on how many others there are.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        judge = Judge(profiles, size, 0.0)
        for batch in batches:
            found = [judge.nearest(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != UND and away <= most_away for lang, _, away in found], pa.bool_()))

    return map_whole(docs, run)
