"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton on folded text.

Folding lower-cases, maps letters that look alike (Cyrillic, Greek, full width) to Latin ones, and digits and signs beside letters
to the letters they stand for. A lexicon entry is a whole word, or a stem that begins a word. An occurrence
counts with its entry's weight, the best entry of a word only; those inside an exception phrase do not. The sum is
normalised by the text's length and a logistic curve turns it into a score.

Entries, weights, exception phrases and the curve are fitted on a sample of labelled rows: about ``max_docs`` of them, by a
hash of doc_id; all entries that the sample supports are taken, so the sample alone bounds the lexicon. Scores see the text alone. Null and empty
texts score as texts without an occurrence. Rows that repeat a label count once (toxic if any says so). Without both labels in the
sample the lexicon is empty and each score is the base rate. Of entries that begin at the same letter the heaviest counts, and of equals the first.
A text is one row of one task, matched in one pass whatever its length. Only doc_id and text are read of the table.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_map, small_batches, written

#: Letters that look like Latin ones, and digits and signs that stand for letters (fixed values).
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i"}
STEMS = (4, 5, 6, 7, 8)
_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def tables():
    """Code point -> folded code point; is it a letter; what a digit or sign stands for."""
    fold, letter, stands = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool), np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            letter[c] = True
            low = x.lower()
            fold[c] = ord(low) if len(low) == 1 else c
    for c in range(0xFF21, 0xFF5B):
        fold[c] = ord(chr(c - 0xFEE0).lower())
    for a, b in LOOK_ALIKES.items():
        fold[ord(a)] = fold[ord(a.upper()) if len(a.upper()) == 1 else ord(a)] = ord(b)
    for a, b in (DIGITS | SIGNS).items():
        stands[ord(a)] = ord(b)
    return fold, letter, stands


def folded(text: str) -> str:
    """Code point by code point, so that places stay. A sign needs a letter behind it, a digit one on either side."""
    fold, letter, stands = tables()
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out, is_letter = fold[x], letter[x]
    i = np.flatnonzero(stands[x])
    if i.size:
        after = is_letter[np.minimum(i + 1, x.size - 1)] & (i + 1 < x.size)
        before = is_letter[np.maximum(i - 1, 0)] & (i > 0)
        i = i[after | before & (x[i] >= 48) & (x[i] < 58)]
        out[i] = stands[x[i]]
    return out.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


@dataclass
class Lexicon:
    """word -> weight, stem -> weight, phrases without harm, and (intercept, slopes) of the curve."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.automaton = lexicon, ahocorasick.Automaton()
        for kind, entries in (("word", lexicon.words), ("stem", lexicon.stems)):
            for entry, weight in entries.items():
                known = self.automaton.get(entry, ())
                self.automaton.add_word(entry, (*known, (kind, len(entry), weight)))
        for phrase in lexicon.exceptions:
            known = self.automaton.get(phrase, ())
            self.automaton.add_word(phrase, (*known, ("safe", len(phrase), 0.0)))
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, low: str) -> dict[int, tuple[float, int]]:
        """Start of each word with an occurrence -> its weight and the entry's end."""
        if not len(self.automaton):
            return {}
        best: dict[int, tuple[float, int]] = {}
        safe = []
        for last, entries in self.automaton.iter(low):
            for kind, size, weight in entries:
                start, end = last - size + 1, last + 1
                if start and low[start - 1].isalpha():
                    continue
                if kind != "stem" and end < len(low) and low[end].isalpha():
                    continue
                if kind == "safe":
                    safe.append((start, end))
                elif weight > best.get(start, (0.0, 0))[0]:
                    best[start] = (weight, end)
        if not safe:
            return best
        safe.sort()
        starts, ends = [a for a, _ in safe], [*accumulate((b for _, b in safe), max)]  # the furthest end of the phrases that begin so far
        return {s: w for s, w in best.items() if not (at := bisect_right(starts, s)) or ends[at - 1] < w[1]}

    def features(self, text: str | None) -> tuple[float, float]:
        """log(1 + summed weight) and summed weight a hundred words."""
        if not text:
            return 0.0, 0.0
        total = sum(w for w, _ in self.found(folded(text)).values())
        return (math.log1p(total), min(10.0, 100.0 * total / max(20, len(text.split())))) if total else (0.0, 0.0)

    def score(self, text: str | None) -> float:
        a, *b = self.lexicon.curve
        z = a + sum(k * x for k, x in zip(b, self.features(text)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def entries_of(low: str) -> tuple[set[str], set[str]]:
    """Distinct words of a folded text; distinct 'entries' (words with '.' behind, stems) and two-word phrases."""
    words = _WORD.findall(low)
    own = set(words)
    entries = {w + "." for w in own}
    for n in STEMS:
        entries.update(w[:n] for w in own if len(w) >= n)
    return entries, {f"{a} {b}" for a, b in zip(words, words[1:])}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[float, ...]:
    """Newton's method for a small ridge logistic regression; slopes stay at 0 or above."""
    a = np.hstack((np.ones((len(x), 1)), x))
    w = np.zeros(a.shape[1])
    keep = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (p - y) + keep @ w)
        w[1:] = np.maximum(w[1:], 0)
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 20_000, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from labelled rows (``labels``: doc_id, toxic), at most about ``max_docs`` of them."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    total = known.count()
    if not total:
        return Lexicon()
    share = int(min(1.0, max_docs / total) * 1_000_000) or 1
    some = known.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("lexicon")), F.lit(1_000_000)) < share).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(texts.join(F.broadcast(some), "doc_id").select("text", "toxic"), "labelled")  # about max_docs rows of two numbers

    def count():
        def each(batch: dict) -> dict:
            by: dict = {}
            for text, toxic in zip(batch["text"], batch["toxic"]):
                for entry in entries_of(folded(text or ""))[0]:
                    n = by.setdefault(entry, [0, 0])
                    n[toxic > 0] += 1
            return {"entry": list(by), "n0": [n[0] for n in by.values()], "n1": [n[1] for n in by.values()]}

        return each

    size = rows.groupBy().agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("n1"), F.count(F.lit(1)).alias("n")).first()
    n1, n = int(size["n1"] or 0), int(size["n"] or 0)
    if not n1 or n1 == n:
        return Lexicon(curve=(math.log((n1 + 0.5) / (n - n1 + 0.5)), 0.0, 0.0))
    base = n1 / n
    counted = rows_map(rows, count, "entry string, n0 long, n1 long").groupBy("entry").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    m, k = F.col("n0") + F.col("n1"), F.col("n1")
    gain = 2 * (k * F.log(k / (m * base)) + F.when(F.col("n0") > 0, F.col("n0") * F.log(F.col("n0") / (m * (1 - base)))).otherwise(0.0))
    top = counted.filter((k >= 4) & (k >= 0.7 * m)).withColumn("gain", gain).filter("gain >= 24").orderBy(F.desc("gain"), "entry").collect()  # of the sample
    lexicon = Lexicon(exceptions=list(exceptions))
    for r in top:
        weight = math.log((r["n1"] + 0.5) / (r["n0"] + 0.5)) - math.log(base / (1 - base))
        (lexicon.words if r["entry"].endswith(".") else lexicon.stems)[r["entry"].rstrip(".")] = weight

    def phrases():
        matcher = Matcher(lexicon)

        def each(batch: dict) -> dict:
            by: dict = {}
            for text, toxic in zip(batch["text"], batch["toxic"]):
                low = folded(text or "")
                if matcher.found(low):
                    for phrase in entries_of(low)[1]:
                        if matcher.found(phrase):
                            n = by.setdefault(phrase, [0, 0])
                            n[toxic > 0] += 1
            return {"entry": list(by), "n0": [n[0] for n in by.values()], "n1": [n[1] for n in by.values()]}

        return each

    harmless = rows_map(rows, phrases, "entry string, n0 long, n1 long").groupBy("entry").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    lexicon.exceptions += [r["entry"] for r in harmless.filter("n0 >= 5 and n1 = 0").orderBy(F.desc("n0"), "entry").collect()]  # of the sample

    def measure():
        matcher = Matcher(lexicon)

        def each(batch: dict) -> dict:
            x = [matcher.features(t) for t in batch["text"]]
            return {"x1": [a for a, _ in x], "x2": [b for _, b in x], "toxic": batch["toxic"]}

        return each

    seen = rows_map(rows, measure, "x1 double, x2 double, toxic int").collect()  # about max_docs rows of three numbers
    seen.sort()
    lexicon.curve = logistic(np.array([[r["x1"], r["x2"]] for r in seen]), np.array([float(r["toxic"] > 0) for r in seen]))
    return lexicon


def scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score of every whole text."""
    small_batches(docs.sparkSession)

    def make():
        matcher = Matcher(lexicon)
        return lambda rows: {"doc_id": rows["doc_id"], "score": [matcher.score(t) for t in rows["text"]]}

    return rows_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, score double")
