"""Cross-tokenizer alignment: groups of tokens between places where two tokenizers' tokens both end.

Tokenizer A is a byte-level BPE file, B a sentencepiece model; both encode a space and the text. A text's words are independent for
both: no token goes over from a character that isn't white space to a space, tab or line feed behind it (B's pieces are checked for that), so
each word with the white space before it is aligned alone, once for as long as a worker remembers it. Ends are intersected by galloping: each end of the
shorter list is looked for in the longer one from where the last stood, by doubling steps and then by halves. Common ends cut both lists
into groups; the differences of their ranks are the groups' ranges. All pairs of an A and a B token of one group are links.

A pair of ids counts the documents that hold it linked. The ``most_pairs`` commonest pairs at most (a bound that the caller sets) go to the
tasks as sorted arrays; links of all other pairs find their counts by a join, so results don't depend on the bound.

Null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have no tokens: zeros and an empty group string. Strings of special tokens
are plain text. Repeated rows count as documents of their own. A text is one row of one task; the distinct id pairs of a text must fit
its memory. Only doc_id and text are read. An empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from bisect import bisect_left
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .tokens import ALPHABET, checked, split_bytes

#: White space that begins a word, and the word behind it. Other white space within (a return, say) doesn't begin one.
WORDS = re.compile(r"(?:\s+\S*|\S+)(?:[^\S \n\t]\s*\S*)*")
B_BITS = 15
#: Characters of texts that are aligned at a time, and bytes of words kept by a worker, twice.
BLOCK_CHARS = 1 << 20
KEPT_BYTES = 100 << 20
LONGEST_KEPT = 64
#: Links of a group from which its distinct pairs are counted instead of listed.
MANY = 4096
MOST_PAIRS = 1 << 19


def common_ends(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Ranks (in a, in b) of the ends that both ascending lists have, by galloping."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    out, at, n = [], 0, len(long)
    for i, end in enumerate(short):
        low, high, step = at, at, 1
        while high < n and long[high] < end:
            low, high, step = high + 1, high + step, 2 * step
        at = bisect_left(long, end, low, min(high, n))
        if at == n:
            break
        if long[at] == end:
            out.append((i, at))
            at += 1
    return out if short is a else [(j, i) for i, j in out]


def groups_of(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """(from, to) in a and (from, to) in b of each group, for the ends a and b of the same bytes."""
    i = j = 0
    out = []
    for x, y in common_ends(a, b):
        out.append((i, x + 1, j, y + 1))
        i, j = x + 1, y + 1
    return out


class Word:
    """A word's groups as text, and its links: ids of pairs, each as often as it occurs (``heavy``: pairs and times of large groups)."""

    __slots__ = ("shown", "links", "sizes", "heavy")

    def __init__(self, shown: str, links: bytes, sizes: tuple[int, int, int], heavy):
        self.shown, self.links, self.sizes, self.heavy = shown, links, sizes, heavy


class Aligner:
    """``word(text)``: a Word, or None if a tokenizer doesn't give its bytes back."""

    def __init__(self, a_path: str, b_path: str, room: int = KEPT_BYTES):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        byte = {shown: value for value, shown in ALPHABET.items()}
        special, model = checked(a_path, "byte")["added_tokens"], checked(a_path, "byte")["model"]
        entries = {i: bytes(byte[c] for c in entry) for entry, i in model["vocab"].items() if entry not in {t["content"] for t in special}}
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if [model["vocab"][m] for m in merges] != sorted(entries)[len(entries) - len(merges) :]:
            raise ValueError(f"{a_path} doesn't number its entries in the order of its merges")
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        #: The BPE of one part of a text, by ids as ranks; parts are split as for other operators.
        self.part_ids = Encoding("parts", pat_str=r"\S+", mergeable_ranks={data: i for i, data in entries.items()}, special_tokens={})._encode_single_piece
        self.b = SentencePieceProcessor(model_file=b_path)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)) and re.search(r"[^\s▁][▁ \n\t]|\n", piece):
                raise ValueError(f"{b_path} has a piece that goes over from one word to the next")
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_sizes, self.b_sizes = [*map(len, self.a_bytes)], [*map(len, self.b_bytes)]
        self.shown = [*map(str, range(max(len(self.a_sizes), len(self.b_sizes))))]
        if len(self.b_bytes) > 1 << B_BITS or len(self.a_bytes) > 1 << 32 - B_BITS:
            raise ValueError("pairs of ids must fit 32 bits")
        self.ahead = self.b.encode("\n")  # the space that B adds, and a line feed, which joins nothing
        if b"".join(self.b_bytes[i] for i in self.ahead) != b" \n":
            raise ValueError(f"{b_path} doesn't keep line feeds")
        self.room = self.free = room
        self.young: dict[str, Word | None] = {}
        self.old: dict[str, Word | None] = {}

    def encode(self, words: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids by A and by B of words as they stand in texts."""
        n, one = len(self.ahead), self.part_ids
        a = [[i for part in split_bytes(w) for i in one(part)] for w in words]
        return [(x, y[n:] if y[:n] == self.ahead else []) for x, y in zip(a, self.b.encode(["\n" + w for w in words], num_threads=1))]

    def aligned(self, word: str, a: list[int], b: list[int]) -> Word | None:
        data = word.encode("utf-8", "surrogatepass")
        if b"".join([self.b_bytes[i] for i in b]) != data or b"".join([self.a_bytes[i] for i in a]) != data:
            return None
        shown, links, heavy, names = [], [], None, self.shown
        for i, j, k, m in groups_of([*accumulate([self.a_sizes[i] for i in a])], [*accumulate([self.b_sizes[i] for i in b])]):
            x, y = a[i:j], b[k:m]
            shown.append(f"{','.join([names[p] for p in x])}|{','.join([names[q] for q in y])}")
            if len(x) * len(y) <= MANY:
                links += [p << B_BITS | q for p in x for q in y]
            else:
                (p, n), (q, m) = (np.unique(np.array(v, np.int64), return_counts=True) for v in (x, y))
                heavy = heavy or []
                heavy.append(((p[:, None] << B_BITS | q).ravel(), np.outer(n, m).ravel()))
        return Word(";".join(shown), array("I", links).tobytes(), (len(a), len(b), len(shown)), heavy)

    def words(self, wanted: set[str]) -> dict[str, Word | None]:
        """All of ``wanted``; those not remembered are encoded together."""
        found, new = {}, []
        for w in wanted:
            if w in self.young:
                found[w] = self.young[w]
            elif w in self.old:
                found[w] = self._keep(w, self.old[w])
            else:
                new.append(w)
        for w, (a, b) in zip(new, self.encode(new) if new else []):
            found[w] = self._keep(w, self.aligned(w, a, b))
        return found

    def _keep(self, word: str, value: Word | None) -> Word | None:
        if len(word) <= LONGEST_KEPT:
            self.free -= 420 + len(word) + (len(value.shown) + len(value.links) if value else 0)
            if self.free < 0:
                self.old, self.young, self.free = self.young, {}, self.room
            self.young[word] = value
        return value


_kept: dict = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner a worker process."""
    if (a_path, b_path) not in _kept:
        _kept[a_path, b_path] = Aligner(a_path, b_path)
    return _kept[a_path, b_path]


def summed(pairs: list[np.ndarray], times: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, and how often each occurs."""
    every = np.concatenate(pairs)
    if all(t is None for t in times):
        return np.unique(every, return_counts=True)
    weights = np.concatenate([np.ones(p.size, np.int64) if t is None else t for p, t in zip(pairs, times)])
    found, place = np.unique(every, return_inverse=True)
    total = np.zeros(found.size, np.int64)
    np.add.at(total, place, weights)
    return found, total


def text_groups(words: list[Word]) -> tuple[str, int, int, int, np.ndarray, np.ndarray]:
    """Group string, n_a, n_b, n_groups, distinct pairs and their times of the words of a text."""
    n_a, n_b, n_groups = map(sum, zip(*[w.sizes for w in words]))
    pairs, times = [np.frombuffer(b"".join([w.links for w in words]), "<u4")], [None]
    for w in words:
        for p, t in w.heavy or ():
            pairs.append(p.astype("<u4"))
            times.append(t)
    return ";".join([w.shown for w in words]), n_a, n_b, n_groups, *summed(pairs, times)


ALIGNED = "part int, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"


def aligned(docs: DataFrame, a_path: str, b_path: str, digest: bool = False) -> DataFrame:
    """A row a document: sizes, its groups (``a1,a2|b1;a3|b2,b3``; with ``digest`` their SHA-256), its distinct linked pairs (unsigned 32 bits: A's id, then 15 bits of B's) and their times."""
    small_batches(docs.sparkSession, 128)
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    kinds = (pa.int32(), *[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary())

    def blocks(batch):
        """Rows of the batch, BLOCK_CHARS of texts at a time."""
        waiting, size = [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            waiting.append((doc_id, WORDS.findall(" " + text) if text else []))
            size += len(text or "")
            if size >= BLOCK_CHARS:
                yield waiting
                waiting, size = [], 0
        if waiting:
            yield waiting

    def run(batches):
        gc.disable()  # the words kept are many objects without cycles, and searching them for some takes half the time
        try:
            yield from rows(batches)
        finally:
            gc.enable()

    def rows(batches):
        align, part, row = aligner(a_path, b_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for block in blocks(batch):
                known = align.words(set(chain.from_iterable(words for _, words in block)))
                columns: list = [[] for _ in names]
                for doc_id, words in block:
                    found = [known[w] for w in words]
                    if not found or None in found:
                        values = (0, 0, 0, 0, "", b"", b"")
                    else:
                        groups, n_a, n_b, n_groups, pairs, times = text_groups(found)
                        shown = hashlib.sha256(groups.encode()).hexdigest() if digest else groups
                        values = (n_a, n_b, n_groups, int(times.sum()), shown, pairs.tobytes(), times.astype("<u4" if times.max() < 1 << 32 else "<i8").tobytes())
                    for column, v in zip(columns, (part, row, doc_id, *values)):
                        column.append(v)
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ALIGNED), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (whether no pair of its A id has more)."""

    def count(batches):
        held, size = [], 0

        def flush():
            pairs, n = summed([p for p, _ in held], [t for _, t in held])
            return pairs, n.astype(np.int64)

        def out():
            pairs, n = flush()
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4")
            held.append((own, None))
            size += own.size
            if size >= 1 << 22:
                held = [flush()]
                size = held[0][0].size
                if size >= 1 << 21:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    by = rows.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    by = written(by.select("pair", "n", F.shiftright("pair", B_BITS).alias("a")), "pairs")
    most = by.groupBy("a").agg(F.max("n").alias("most"))
    return written(by.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def commonest(counts: DataFrame, most_pairs: int) -> int:
    """The least count such that ``most_pairs`` pairs at most have it or more."""
    level = F.floor(F.log2("n") * 16).cast("int")
    by = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("n")).orderBy(F.desc("level")).collect()  # 64 levels of 16 at most
    least, total = (1 << 62), 0
    for r in by:
        total += r["m"]
        if total > most_pairs:
            break
        least = r["n"]
    return least


def scored(rows: DataFrame, counts: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``rows`` with n_best and count_sum; without pairs and times."""
    spark, least = rows.sparkSession, commonest(counts, most_pairs)
    hot = counts.filter(F.col("n") >= least).orderBy("pair").toArrow()  # most_pairs at most
    known = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))
    own = [c for c in rows.columns if c not in ("pairs", "times")]

    def split(pairs: bytes, times: bytes):
        """Pairs and times, places among the commonest, and which of them are there."""
        p = np.frombuffer(pairs, "<u4").astype(np.int64)
        t = np.frombuffer(times, "<u4" if len(times) == len(pairs) else "<i8").astype(np.int64)
        at = np.searchsorted(known.value[0], p)
        return p, t, at, (at < known.value[0].size) & (known.value[0][np.minimum(at, max(0, known.value[0].size - 1))] == p) if known.value[0].size else np.zeros(p.size, bool)

    def near(batches):
        _, n, best = known.value
        for batch in batches:
            many, sums = [], []
            for pairs, times in zip(*(batch.column(c).to_pylist() for c in ("pairs", "times"))):
                _, t, at, there = split(pairs, times)
                at, t = at[there], t[there]
                many.append(int(t[best[at]].sum()))
                sums.append(int((t * n[at]).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(many, pa.int64()), pa.array(sums, pa.int64())], names=[*own, "n_best", "count_sum"])

    def far(batches):
        for batch in batches:
            for part, row, pairs, times in zip(*(c.to_pylist() for c in batch.columns)):
                p, t, _, there = split(pairs, times)
                rest = np.flatnonzero(~there)
                if rest.size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(rest.size, part, np.int32)), pa.array(np.full(rest.size, row, np.int64)), pa.array(p[rest]), pa.array(t[rest])], names=["part", "row", "pair", "t"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(own).schema)
    out = rows.mapInArrow(near, f"{fields}, n_best long, count_sum long")
    rare = counts.filter(F.col("n") < least)
    if rare.isEmpty():
        return out
    links = rows.select("part", "row", "pairs", "times").mapInArrow(far, "part int, row long, pair long, t long").join(rare, "pair")
    more = links.groupBy("part", "row").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("_best"), F.sum(F.col("t") * F.col("n")).alias("_sum"))
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return out.join(more, ["part", "row"], "left").select(*own, plus("n_best", "_best"), plus("count_sum", "_sum"))


def align(docs: DataFrame, a_path: str, b_path: str, most_pairs: int = MOST_PAIRS, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum of every whole text."""
    rows = aligned(docs, a_path, b_path, digest)
    return scored(rows, pair_counts(rows), most_pairs).drop("part", "row")
