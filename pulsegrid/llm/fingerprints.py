"""Document fingerprints by consistent weighted sampling.

A text is a set of words weighted by their counts. For each of K samples every word draws r and c from
Gamma(2, 1) and b from [0, 1), seeded by the word and the sample alone; with t = floor(ln w / r + b) the word with the
least ln c - r (t - b) - r wins, and (word, t) is the sample. Two texts share a sample with a probability equal to
their generalised Jaccard similarity (sum of least weights over sum of greatest).

Draws are made anew for each word and sample, from 64-bit hashes; a worker keeps those of the words it met last. Samples are shown in 16 bits, so
two that differ look alike once in 65,536 times.

Null text counts as empty. Empty texts (no word) have the fingerprint '' and likeness 1 to each other, 0 to
others. Equal texts have equal fingerprints. Long texts are sampled in blocks of words. Repeated doc_ids are in the order of their
texts; rows without doc_id come last. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

BLOCK = 4096


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gamma_quantiles(n: int) -> np.ndarray:
    """The middles of ``n`` equal shares of Gamma(2, 1), by bisection."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 50.0)
    for _ in range(60):
        x = (low + high) / 2
        under = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(under, x, low), np.where(under, high, x)
    return (low + high) / 2


class Sampler:
    """Signatures of K 16-bit samples. The draws of ``room`` words are kept: 2 KB each at 128 samples.

    For each word and sample a 64-bit hash gives 16 bits each to r, c and b; r and ln c are looked up in tables of the distribution's quantiles.
    """

    def __init__(self, samples: int = 128, room: int = 1 << 16):
        import xxhash

        self.hash, self.k, self.room = xxhash.xxh3_64_intdigest, samples, room
        self.place: dict[int, int] = {}
        self.r, self.b, self.c, self.once = (np.empty((room, samples), np.float32) for _ in range(4))
        self.seed = np.arange(1, 1 + samples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        gamma = gamma_quantiles(1 << 16)
        self.gamma, self.log_gamma = gamma.astype(np.float32), np.log(gamma).astype(np.float32)

    def _draw(self, words: np.ndarray, at: slice) -> None:
        """r, b and ln c of new words. A word that occurs once has ln w = 0 and t = 0: its cost is kept, too."""
        with np.errstate(over="ignore"):
            bits = _mixed(words[:, None] + self.seed).view(np.uint16).reshape(words.size, self.k, 4)
        r, c = self.gamma.take(bits[..., 0]), self.log_gamma.take(bits[..., 1])
        b = (bits[..., 2].astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-16)
        self.r[at], self.b[at], self.c[at], self.once[at] = r, b, c, c - r * (np.float32(1) - b)

    def _places(self, words: np.ndarray) -> np.ndarray:
        """Where the draws of distinct words are kept."""
        if len(self.place) + words.size > self.room:
            self.place.clear()
        at = np.fromiter(map(self.place.get, words.tolist(), repeat(-1)), np.int64, words.size)
        new = np.flatnonzero(at < 0)
        if new.size:
            start = len(self.place)
            for i in range(0, new.size, 256):
                self._draw(words[new[i : i + 256]], slice(start + i, start + min(i + 256, new.size)))
            at[new] = np.arange(start, start + new.size)
            self.place.update(zip(words[new].tolist(), at[new].tolist()))
        return at

    def __call__(self, text: str | None) -> np.ndarray | None:
        count = Counter((text or "").encode("utf-8", "surrogatepass").split())
        if not count:
            return None
        words = np.fromiter(map(self.hash, count), np.uint64, len(count))
        weight = np.fromiter(count.values(), np.int64, len(count))
        cost, out = np.full(self.k, np.inf, np.float32), np.zeros(self.k, np.uint16)
        for a in range(0, words.size, BLOCK):
            some, n = words[a : a + BLOCK], weight[a : a + BLOCK]
            at = self._places(some)
            one = n == 1
            for single, pick in ((True, one), (False, ~one)):
                if pick.any():
                    cost, out = self._least(some[pick], at[pick], None if single else np.log(n[pick].astype(np.float64)).astype(np.float32), cost, out)
        return out

    def _least(self, words: np.ndarray, at: np.ndarray, log_weight: np.ndarray | None, cost: np.ndarray, out: np.ndarray):
        if log_weight is None:
            mine = self.once[at]
        else:
            r, b = self.r[at], self.b[at]
            t = np.floor(log_weight[:, None] / r + b)
            mine = self.c[at] - r * (t - b + np.float32(1))
        each = np.arange(self.k)
        first = mine.argmin(axis=0)
        least = mine[first, each]
        times = np.uint64(0) if log_weight is None else t[first, each].astype(np.int64).astype(np.uint64)
        with np.errstate(over="ignore"):
            value = (_mixed(words[first] + times * np.uint64(0xD6E8FEB86659FD93) + each.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
        better = least < cost
        return np.where(better, least, cost), np.where(better, value, out)


_kept: dict = {}


def sampler_of(samples: int) -> Sampler:
    """One sampler a worker process."""
    if samples not in _kept:
        _kept[samples] = Sampler(samples)
    return _kept[samples]


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def packed(signature: np.ndarray | None) -> bytes:
    return b"" if signature is None else signature.astype(">u2").tobytes()


def shown(signature: np.ndarray | None) -> str:
    """A fingerprint as text: four hexadecimal digits a sample."""
    return packed(signature).hex()


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the beginning of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_ROWS = f"part int, kind string, text string, {_FIELDS}"


def _row(sampler: Sampler, text: str, following: str, own, then) -> tuple:
    new = edited(text, following)
    changed = own if new == text else sampler(new)
    return len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).digest(), packed(own), packed(changed), likeness(own, changed), likeness(own, then)


def with_edits(docs: DataFrame, samples: int = 128) -> DataFrame:
    """Fingerprint of every document, of its edited text, and their likeness to it and to the next document.

    Next means the next lower doc_id (repeated ids: by text); the last document's next is the first. Texts are
    dealt out once, by ranges of doc_id. The first and last text of each range meet in a second, small join.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def pairs(batches):
        part = TaskContext.get().partitionId()
        sampler, last = sampler_of(samples), None
        names = [f.split()[0] for f in _ROWS.split(", ")]

        def batch_of(rows: list[tuple]):
            return pa.RecordBatch.from_pydict({n: pa.array([r[j] for r in rows], _ARROW[j]) for j, n in enumerate(names)})

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                own = sampler(text)
                if last is None:
                    rows.append((part, "head", text, doc_id, *[None] * 6))
                else:
                    rows.append((part, "row", None, last[0], *_row(sampler, last[1], text, last[2], own)))
                last = doc_id, text, own
            if rows:
                yield batch_of(rows)
        if last is not None:
            yield batch_of([(part, "tail", last[1], last[0], *[None] * 6)])

    order = [F.desc_nulls_last("doc_id"), F.desc_nulls_last("text")]
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = written(texts.repartitionByRange(F.desc_nulls_last("doc_id")).sortWithinPartitions(*order).mapInArrow(pairs, _ROWS), "fingerprints")
    ends = rows.filter("kind = 'head'").select("part")
    every = Window.orderBy("part")  # a row a range
    follows = ends.select("part", F.lead("part").over(every).alias("_next"), F.min("part").over(every).alias("_first")).select("part", F.coalesce("_next", "_first").alias("_next"))
    heads = rows.filter("kind = 'head'").select(F.col("part").alias("_next"), F.col("text").alias("_then"))
    tails = rows.filter("kind = 'tail'").select("part", "doc_id", "text").join(follows, "part").join(heads, "_next").select("doc_id", "text", "_then")

    def finish(batches):
        sampler = sampler_of(samples)
        names = [f.split()[0] for f in _FIELDS.split(", ")]
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for doc_id, text, then in zip(*(batch.column(j).to_pylist() for j in range(3))):
                own = sampler(text)
                out.append((doc_id, *_row(sampler, text, then, own, sampler(then))))
            yield pa.RecordBatch.from_pydict({n: pa.array([r[j] for r in out], _ARROW[j + 3]) for j, n in enumerate(names)})

    columns = [f.split()[0] for f in _FIELDS.split(", ")]
    out = rows.filter("kind = 'row'").select(*columns).unionByName(tails.mapInArrow(finish, _FIELDS))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


_ARROW = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
