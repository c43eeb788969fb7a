"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Every window of ``size`` tokens serves every lane by its share. After w windows a lane has been credited
size * w * share tokens and served the whole tokens of that credit; the rest is its deficit and carries over to the next
window, whichever task makes it. Served totals are therefore known for each w without visiting the windows before,
and each document finds its own pieces. When a lane runs dry, a new phase begins among the others.
What is left when all have run dry (less than a window's share each) is packed plainly, and the last window is cut
into powers of two, so that no padding is needed.

Every source whose target is a token a window or more has a lane to itself: there are ``size`` at most. Those below it, however many, share one lane
of their joint target, and each is served in it by its own: their documents are cut into quanta of an eighth of a window at most, and
a quantum's turn is the tokens of its source before it over the source's target. So a source that earns less than a token a window is
served a quantum in every so many windows. Quanta are sorted by their turns, by ranges, as rows without ids. With a ``mixture``, sources that
it doesn't name are a lane that begins when all the others have run dry. Nothing about the small sources goes to the driver.

All tokens are packed. Null source is a queue of its own; null text is an empty text, which has the end id only. Repeated rows are packed as
often as they occur; ties go by a hash of the source. A document is one row of one task, whatever its length. Only doc_id,
text and the source are read of the table. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written
from .tokens import encoder

NULL = "\x00null"
GRID_BITS = 20
#: A quantum of the sources without a lane is a window's tokens over this.
PARTS = 8


@dataclass(frozen=True)
class Phase:
    """Windows ``first`` .. ``first + windows``; ``edges`` are cumulative shares in grid units, ``base`` the tokens served before."""

    first: int
    windows: int
    edges: list[int]
    base: list[int]


def shares(weights: list[float], active: list[int], size: int) -> list[int]:
    """Grid units of each lane: at least those of a token a window for an active one, 0 for others."""
    unit = (1 << GRID_BITS) // size
    total = sum(weights[i] for i in active)
    out = [0] * len(weights)
    for i in active:
        out[i] = max(unit, int((weights[i] / total if total else 1 / len(active)) * (1 << GRID_BITS)))
    spare = (1 << GRID_BITS) - sum(out)
    for i in sorted(active, key=lambda i: -out[i]):  # the largest lanes take what rounding left or took
        step = max(spare, unit - out[i]) if spare < 0 else spare
        out[i] += step
        spare -= step
        if not spare:
            break
    return out


def served(w: int, edges: list[int], i: int, shift: int) -> int:
    """Tokens of lane ``i`` after ``w`` windows of a phase."""
    return (w * edges[i + 1] >> shift) - (w * edges[i] >> shift)


def plan(totals: list[int], weights: list[float], size: int) -> tuple[list[Phase], list[int], int]:
    """Phases, tokens that each lane has served in them, and the number of their windows; lanes without weight come after the others."""
    shift = GRID_BITS - size.bit_length() + 1
    left, base = list(totals), [0] * len(totals)
    phases, first = [], 0
    active, waiting = ([i for i, n in enumerate(totals) if n and (weights[i] > 0) == some] for some in (True, False))
    while active or waiting:
        if not active:
            active, waiting = waiting, []
        units = shares(weights, active, size)
        edges = [0]
        for u in units:
            edges.append(edges[-1] + u)
        windows = None
        for i in active:
            low, high = 0, left[i] * (1 << shift) // units[i] + 2
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if served(mid, edges, i, shift) <= left[i] else (low, mid - 1)
            windows = low if windows is None else min(windows, low)
        if windows:
            phases.append(Phase(first, windows, edges, list(base)))
            first += windows
        for i in active:
            n = served(windows, edges, i, shift)
            base[i] += n
            left[i] -= n
        active = [i for i in active if base[i] - phases[-1].base[i] + left[i] >= served(windows + 1, edges, i, shift)] if windows else [i for i in active if left[i] >= served(1, edges, i, shift)]
    return phases, base, first


def tail_sequences(n: int, size: int) -> list[int]:
    """Lengths of the last sequences: whole windows, then powers of two."""
    out = [size] * (n // size)
    rest = n % size
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Layout:
    """Where each token of each lane goes."""

    def __init__(self, totals: list[int], weights: list[float], size: int):
        self.size, self.shift = size, GRID_BITS - size.bit_length() + 1
        self.phases, self.done, self.windows = plan(totals, weights, size)
        rest = [n - d for n, d in zip(totals, self.done)]
        self.tail_at = np.concatenate(([0], np.cumsum(rest)))[:-1]
        self.cuts = np.concatenate(([0], np.cumsum(tail_sequences(sum(rest), size)))).astype(np.int64)

    def _window(self, p: Phase, lane: int, a: np.ndarray) -> np.ndarray:
        """The window of a phase that serves the lane's token ``a``; a lane in service gets a token a window at least, so the guess is three too high at most."""
        lo, hi = p.edges[lane], p.edges[lane + 1]
        w = (a << self.shift) // (hi - lo) + 1
        for _ in range(3):
            w = w - ((w * hi >> self.shift) - (w * lo >> self.shift) > a)
        return w

    def pieces(self, lane: int, x: np.ndarray, n: np.ndarray):
        """(run, start in the run, length, sequence, offset) of runs of a lane, from x to x + n each, as arrays."""
        out: list = [[], [], [], [], []]

        def put(*values) -> None:
            for v, some in zip(values, out):
                v is not None and some.append(v)

        def spread(runs, first, last):
            many = last - first + 1
            return np.repeat(runs, many), np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())

        for p in self.phases:
            lo, hi, base = p.edges[lane], p.edges[lane + 1], p.base[lane]
            a, b = np.maximum(x, base) - base, np.minimum(x + n - base, served(p.windows, p.edges, lane, self.shift))
            some = np.flatnonzero(a < b)
            if hi == lo or not some.size:
                continue
            run, w = spread(some, self._window(p, lane, a[some]), self._window(p, lane, b[some] - 1))
            before, after = w * lo >> self.shift, (w + 1) * lo >> self.shift
            at, end = (w * hi >> self.shift) - before, ((w + 1) * hi >> self.shift) - after
            start = np.maximum(at, a[run])
            put(run, start + base - x[run], np.minimum(end, b[run]) - start, p.first + w, after - before + start - at)
        a, b = np.maximum(x, self.done[lane]), x + n
        some = np.flatnonzero(a < b)
        if some.size:
            shift = int(self.tail_at[lane]) - self.done[lane]
            run, k = spread(some, *(np.searchsorted(self.cuts, v[some] + shift - end, side="right") - 1 for end, v in enumerate((a, b))))
            start = np.maximum(self.cuts[k], a[run] + shift)
            put(run, start - shift - x[run], np.minimum(self.cuts[k + 1], b[run] + shift) - start, self.windows + k, start - self.cuts[k])
        return tuple(np.concatenate(v) if v else np.empty(0, np.int64) for v in out)


_TOKENS = "part int, row long, queue string, doc_id long, at long, n long, ids binary"


def tokenised(docs: DataFrame, queue, path: str, kind: str, end_id: int) -> DataFrame:
    """A row a document: ids, and its place among the tokens of its queue in this part. Written once."""
    small_batches(docs.sparkSession)

    def run(batches):
        ids_of, part, at, row = encoder(path, kind).ids, TaskContext.get().partitionId(), {}, 0
        end = int(end_id).to_bytes(2, "little")
        for batch in batches:
            queues, ids = batch.column(2).to_pylist(), [ids_of(t) + end for t in batch.column(1).to_pylist()]
            n, places = [len(i) // 2 for i in ids], []
            for q, m in zip(queues, n):
                places.append(x := at.get(q, 0))
                at[q] = x + m
            columns = ([part] * len(n), range(row, row + len(n)), queues, batch.column(0), places, n, ids)
            row += len(n)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, _ARROW)], names=_NAMES)

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), queue.alias("queue")).mapInArrow(run, _TOKENS), "tokens")


_NAMES = [c.split()[0] for c in _TOKENS.split(", ")]
_ARROW = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())


def interleaved(rows: DataFrame, quantum: int) -> DataFrame:
    """Runs of tokens of small sources in the order of their turns: part, row, first (their place in the document), n, lane and x, their place in the lane.

    ``rows`` have y, their place in their source, the source's weight, and the lane, of which one comes wholly before the next.
    """
    spark = rows.sparkSession
    cuts = rows.select("part", "row", "n", "y", "weight", "lane", F.xxhash64("queue").alias("tie"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(quantum).cast("long"))).alias("first"))
    cuts = cuts.withColumn("n", F.least(F.lit(quantum), F.col("n") - F.col("first"))).withColumn("y", F.col("y") + F.col("first"))
    # a source's first turn lies within its first quantum, by a hash, so that sources of one document spread out
    turn = (F.col("y") + F.pmod("tie", F.lit(1 << 20)) / F.lit(float(1 << 20)) * F.col("n")) / F.col("weight")
    order = ("lane", "turn", "tie", "y")
    cuts = cuts.withColumn("turn", turn).select(*order, "part", "row", "first", "n").repartitionByRange(*order).sortWithinPartitions(*order)

    def runs(batches):
        """Quanta that follow each other in one document become one run."""
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lane, part, row, first, n = (batch.column(j).to_numpy() for j in range(5))
            new = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (row[1:] != row[:-1]) | (first[1:] != first[:-1] + n[:-1]))))
            n = np.add.reduceat(n, new)
            ends = at + np.cumsum(n)
            at = int(ends[-1])
            columns = (np.full(n.size, task, np.int32), lane[new], ends - n, part[new], row[new], first[new], n)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["task", "lane", "at", "part", "row", "first", "n"])

    done = written(cuts.select("lane", "part", "row", "first", "n").mapInArrow(runs, "task int, lane int, at long, part int, row long, first long, n long"), "turns")
    ahead, total, start = [], 0, {}
    for task, lane, n in done.groupBy("task", "lane").agg(F.sum("n")).orderBy("task", "lane").collect():  # two rows a task at most
        start.setdefault(lane, total)
        if not ahead or ahead[-1][0] != task:
            before = total
        ahead.append((task, lane, before - start[lane]))
        total += n
    ahead = spark.createDataFrame(ahead, "task int, lane int, ahead long")
    return done.join(F.broadcast(ahead), ["task", "lane"]).select("part", "row", "first", "n", "lane", (F.col("ahead") + F.col("at")).alias("x"))


def pack(docs: DataFrame, path: str, kind: str = "byte", end_id: int = 1, size: int = 2048, by: str = "source", mixture: dict | None = None, with_ids: bool = True) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids (unsigned 32-bit) unless ``with_ids`` is off.

    ``mixture`` gives target proportions by source (default: each queue's share of all tokens, so that all run dry
    together). ``size`` is a power of two.
    """
    if size & (size - 1) or size > 1 << 16:
        raise ValueError("size must be a power of two of at most 65536")
    source = F.coalesce(F.col(by).cast("string"), F.lit(NULL)) if by in docs.columns else F.lit("")
    rows, spark = tokenised(docs, source, path, kind, end_id), docs.sparkSession

    sums = written(rows.groupBy("queue", "part").agg(F.sum("n").alias("tokens")), "sums")
    total = sums.groupBy("queue").agg(F.sum("tokens").alias("t"))
    if mixture:
        target = spark.createDataFrame([(NULL if q is None else q, float(w)) for q, w in mixture.items() if w], "queue string, target double")
        total = total.join(target, "queue", "left").select("queue", "t", F.coalesce("target", F.lit(0.0)).alias("w"))
    else:
        total = total.select("queue", "t", F.col("t").cast("double").alias("w"))
    total = written(total, "queues")
    whole = total.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    own = total.filter((F.col("w") > 0) & (F.col("w") * size >= F.lit(whole))).orderBy("queue").collect()  # size at most
    mine = spark.createDataFrame([(r["queue"], i) for i, r in enumerate(own)], "queue string, lane int")
    lanes = total.join(F.broadcast(mine), "queue", "left").withColumn("lane", F.coalesce("lane", F.when(F.col("w") > 0, len(own)).otherwise(len(own) + 1)))
    sizes = {r["lane"]: r for r in lanes.groupBy("lane").agg(F.sum("t").alias("t"), F.sum("w").alias("w")).collect()}  # size + 2 at most
    layout = Layout(*([sizes[i][c] if i in sizes else 0 for i in range(len(own) + 2)] for c in "tw"), size)

    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select("queue", "part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("ahead"))
    weight = F.when(F.col("w") > 0, F.col("w")).otherwise(F.col("t").cast("double")).alias("weight")
    firsts = firsts.join(lanes.select("queue", weight, "lane"), "queue")
    put = rows.select("part", "row", "queue", "at", "n").join(firsts, ["queue", "part"]).withColumn("y", F.col("ahead") + F.col("at"))
    runs = put.filter(F.col("lane") < len(own)).select("part", "row", F.lit(0).cast("long").alias("first"), "n", "lane", F.col("y").alias("x"))
    if any(i >= len(own) for i in sizes):
        runs = runs.union(interleaved(put.filter(F.col("lane") >= len(own)), size // PARTS or 1))
    placed = rows.join(runs.groupBy("part", "row").agg(F.collect_list(F.struct("first", "n", "lane", "x")).alias("runs")), ["part", "row"])
    placed = placed.select("doc_id", "n", *(F.col(f"runs.{c}").alias(f"run_{c}") for c in ("first", "n", "lane", "x")), "ids")

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            wide = [memoryview(np.frombuffer(ids, "<u2").astype("<u4").tobytes()) for ids in batch.column(6).to_pylist()]
            many = np.diff(batch.column(2).offsets.to_numpy())
            doc = np.repeat(np.arange(batch.num_rows), many)
            first, n, lane, x = (batch.column(j).flatten().to_numpy() for j in (2, 3, 4, 5))
            found: list = [[], [], [], [], []]
            for k in np.unique(lane).tolist():
                own = np.flatnonzero(lane == k)
                run, start, *rest = layout.pieces(k, x[own], n[own])
                for some, v in zip(found, (doc[own[run]], start + first[own[run]], *rest)):
                    some.append(v)
            doc, start, length, seq, offset = (np.concatenate(v) if v else np.empty(0, np.int64) for v in found)
            cut = [wide[d][4 * a : 4 * (a + m)] for d, a, m in zip(doc.tolist(), start.tolist(), length.tolist())]
            at = pa.array(doc)
            columns = [batch.column(0).take(at), pa.array(start), pa.array(length), pa.array(map(zlib.crc32, cut), pa.int64()), batch.column(1).take(at), pa.array(seq), pa.array(offset)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(map(bytes, cut), pa.binary())] if with_ids else columns, names=[*names, "ids"] if with_ids else names)

    small_batches(spark, 128)
    return placed.mapInArrow(run, ", ".join(f"{c} long" for c in names) + (", ids binary" if with_ids else ""))
