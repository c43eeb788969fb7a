"""Line dedup: repeated lines go, except in the first document that holds them.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys become hashes of 128 bits, partitioned by ranges of
(hash, document, position) and sorted likewise, so that a key's first row in a partition is its first occurrence there, and a hot key
spreads over as many partitions as it fills. Each task streams its rows once: a row of another document than its key's first one is
dropped. A task whose first key began in an earlier task learns from two rows a task where that was. What comes back is
a compressed bitmap a document (a bit a line, set where it stays), for documents that lose a line; texts stay where they are until they are asked for.

Null and empty texts are one empty line. Rows without doc_id are one document behind all others (doc_id 2^63 - 1). Rows that share a
doc_id are one document: their lines are dropped for smaller ids alone, so repeated rows lose the same lines. Repeats within a document stay.
A text is one row, whatever its length; extra columns are not read by ``keep_bitmaps``. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_map, small_batches, written

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LAST = (1 << 63) - 1
#: Kinds of rows that a task returns: a dropped line, a line of its first key, the first and the last key's first occurrence.
DROPPED, EDGE, FIRST, FINAL = range(4)


def line_key(line):
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def _named(docs: DataFrame) -> DataFrame:
    """doc, th (a hash of the text, to tell rows of one doc_id apart), doc_id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("th"), doc_id.alias("doc_id"), text.alias("text"))


def line_hashes(docs: DataFrame, least: int) -> DataFrame:
    """A row a line whose key has ``least`` code points: h1, h2, doc, pos, th, n_lines."""
    lines = F.split("text", "\n", -1)
    rows = _named(docs).select("doc", "th", F.size(lines).alias("n_lines"), F.posexplode(lines).alias("pos", "line"))
    rows = rows.select("doc", "th", "n_lines", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= least)
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc", "pos", "th", "n_lines")


def _streamed(batches):
    """Kinds of rows as above, of batches in the order of (h1, h2, doc, pos)."""
    task, last, edge = TaskContext.get().partitionId(), None, True

    def out(kind, *columns):
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, task, np.int32)), pa.array(np.full(n, kind, np.int32)), *map(pa.array, columns)], names=["task", "kind", "h1", "h2", "doc", "pos", "th", "n_lines"])

    def one(kind, h1, h2, doc):
        return out(kind, *(np.array([v], np.int64) for v in (h1, h2, doc)), np.array([-1], np.int32), np.array([0], np.int64), np.array([0], np.int32))

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        h1, h2, doc = columns[:3]
        begins = np.concatenate(([last is None or (h1[0], h2[0]) != last[:2]], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        at = np.flatnonzero(begins)
        if last is None:
            yield one(FIRST, h1[0], h2[0], doc[0])
        first = np.concatenate(([0 if last is None else last[2]], doc[at]))[np.cumsum(begins)]
        in_edge = np.zeros(doc.size, bool)
        if edge:  # rows of the task's first key
            ends = at[at > 0] if last is None else at
            in_edge[: ends[0] if ends.size else doc.size] = True
            edge = not ends.size
        gone = np.flatnonzero((doc != first) & ~in_edge)
        if in_edge.any():
            yield out(EDGE, *(c[in_edge] for c in columns))
        if gone.size:
            yield out(DROPPED, *(c[gone] for c in columns))
        last = (h1[-1], h2[-1], first[-1])
    if last:
        yield one(FINAL, *last)


def dropped_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc, th, pos, n_lines of each line that goes."""
    spark, order = docs.sparkSession, ("h1", "h2", "doc", "pos")
    rows = written(line_hashes(docs, least), "lines").repartitionByRange(*order).sortWithinPartitions(*order)
    told = written(rows.mapInArrow(_streamed, "task int, kind int, h1 long, h2 long, doc long, pos int, th long, n_lines int"), "line-drops")
    begins, last = [], None
    ends = told.filter(F.col("kind") >= FIRST).select("task", "kind", "h1", "h2", "doc").orderBy("task", "kind").collect()  # two rows a task
    for a, b in zip(ends[::2], ends[1::2]):
        doc = last[2] if last and last[:2] == (a["h1"], a["h2"]) else a["doc"]
        begins.append((a["task"], doc))
        last = (b["h1"], b["h2"], doc if (a["h1"], a["h2"]) == (b["h1"], b["h2"]) else b["doc"])
    edges = told.filter(F.col("kind") == EDGE).join(F.broadcast(spark.createDataFrame(begins, "task int, begin long")), "task").filter("doc <> begin")
    names = ("doc", "th", "pos", "n_lines")
    return told.filter(F.col("kind") == DROPPED).select(*names).union(edges.select(*names))


def keep_bitmaps(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc, th, n_dropped, keep of documents that lose a line; keep is a zlib stream of a bit a line, the first one highest."""

    def make():
        def bits(places, n):
            keep = np.ones(n, bool)
            keep[places] = False
            return zlib.compress(np.packbits(keep).tobytes()), int(n - keep.sum())

        def each(rows: dict) -> dict:
            made = [bits(*x) for x in zip(rows["places"], rows["n_lines"])]
            return {"doc": rows["doc"], "th": rows["th"], "n_dropped": [n for _, n in made], "keep": [b for b, _ in made]}

        return each

    by = dropped_lines(docs, least).groupBy("doc", "th").agg(F.collect_list("pos").alias("places"), F.max("n_lines").alias("n_lines"))
    return rows_map(by, make, "doc long, th long, n_dropped long, keep binary")


def kept_lines(text: str, keep: bytes | None) -> list[str]:
    """The lines of a text that its bitmap keeps."""
    lines = text.split("\n")
    return lines if keep is None else [*compress(lines, np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines)))]


def without_repeats(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, and the text of the lines that stay."""
    small_batches(docs.sparkSession)

    def make():
        def each(rows: dict) -> dict:
            kept = [kept_lines(t, k) for t, k in zip(rows["text"], rows["keep"])]
            return {"doc_id": rows["doc_id"], "n_lines": [t.count("\n") + 1 for t in rows["text"]], "n_dropped": [n or 0 for n in rows["n_dropped"]], "text": ["\n".join(x) for x in kept]}

        return each

    both = _named(docs).join(keep_bitmaps(docs, least), ["doc", "th"], "left").select("doc_id", "text", "n_dropped", "keep")
    return rows_map(both, make, "doc_id long, n_lines long, n_dropped long, text string")


def digests(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""

    def make():
        return lambda rows: {c: rows[c] for c in ("doc_id", "n_lines", "n_dropped")} | {"kept_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in rows["text"]]}

    return rows_map(without_repeats(docs, least), make, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
