"""Token ids as files: canonical length-limited Huffman codes in independent blocks.

Code lengths (16 bits at most, by package-merge) come from the counts of all ids. A file holds blocks of whole documents in
ascending doc_id order; files are numbered in that order too. A block can be read alone: it lists its documents, and the
bit offset of every 64th id. Decoding looks up 16 bits at a time in a table, for all of these offsets at once.

A folder can be read by any later session: ``read_ids(spark, folder)``. Its ``index`` table lists the blocks. Each file begins with the
code: 'HUFC', little-endian u32 bytes, and the code lengths of the ids 0 .. 65535, a byte each, compressed by zlib.

Block: 'HUF1', then little-endian u32 documents, ids, payload words; per document i64 doc_id and u32 ids;
a u32 bit offset for each 64 ids; payload in big-endian u32 words and one empty word.
Null text counts as empty: a document of the end id alone. Repeated doc_ids stay in the order of their ids; null doc_ids come first.
A document is one row, of one block, whatever its length. Other columns are not read. An empty table gives a folder without files.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dealt, scratch_path, small_batches, written
from .files import Output, read_at
from .tokens import encoder

LONGEST = 16
EVERY = 64
BLOCK_IDS = 1 << 16
NO_ID = -(1 << 63)


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bits of each symbol's code by package-merge; 0 for symbols that don't occur."""
    order = np.argsort(counts, kind="stable")
    order = order[counts[order] > 0]
    lengths = np.zeros(counts.size, np.uint8)
    n = order.size
    if n > 1 << longest:
        raise ValueError("more symbols than codes")
    if n <= 1:
        lengths[order] = 1
        return lengths
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(longest):
        merged = np.concatenate((leaves, packages))
        by = np.argsort(merged, kind="stable")
        levels.append(by < n)
        merged = merged[by]
        packages = merged[: merged.size // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * n - 2
    own = np.zeros(n, np.uint8)
    for leaf in reversed(levels):
        k = int(leaf[:take].sum())
        own[:k] += 1
        take = 2 * (take - k)
    lengths[order] = own
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, symbol)."""
    codes = np.zeros(lengths.size, np.uint32)
    code = last = 0
    order = np.lexsort((np.arange(lengths.size), lengths))
    for s in order[lengths[order] > 0].tolist():
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def packed(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Payload words of a block, and the bit offset of every 64th id."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    at = ends - bits
    words = np.zeros(int(ends[-1] if ids.size else 0) // 32 + 2, np.uint64)
    word = at >> 5
    value = codes[ids].astype(np.uint64) << (64 - bits - (at & 31)).astype(np.uint64)
    if ids.size:
        first = np.flatnonzero(np.diff(word, prepend=-1))  # codes that begin in one word don't overlap: sums are ors
        np.add.at(words, word[first], np.add.reduceat(value >> np.uint64(32), first))
        np.add.at(words, word[first] + 1, np.add.reduceat(value & np.uint64(0xFFFFFFFF), first))
    return words.astype(">u4"), at[::EVERY].astype("<u4")


def block(docs: list[tuple[int, np.ndarray]], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    ids = np.concatenate([i for _, i in docs])
    words, offsets = packed(ids, lengths, codes)
    head = struct.pack("<4sIII", b"HUF1", len(docs), ids.size, words.size)
    doc_ids = np.array([NO_ID if d is None else d for d, _ in docs], "<i8")
    sizes = np.array([i.size for _, i in docs], "<u4")
    return b"".join((head, doc_ids.tobytes(), sizes.tobytes(), offsets.tobytes(), words.tobytes()))


class Decoder:
    def __init__(self, lengths: np.ndarray):
        codes = canonical(lengths)
        self.symbol, self.bits = np.zeros(1 << LONGEST, np.uint16), np.ones(1 << LONGEST, np.int64)
        used = np.flatnonzero(lengths)
        used = used[np.argsort(codes[used].astype(np.int64) << (LONGEST - lengths[used].astype(np.int64)))]
        spans = 1 << (LONGEST - lengths[used].astype(np.int64))
        self.symbol[: spans.sum()] = np.repeat(used, spans)
        self.bits[: spans.sum()] = np.repeat(lengths[used], spans)

    def __call__(self, data: bytes) -> list[tuple[int | None, np.ndarray]]:
        magic, n_docs, n_ids, n_words = struct.unpack_from("<4sIII", data)
        if magic != b"HUF1":
            raise ValueError("not a block of ids")
        at = 16
        doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        sizes = np.frombuffer(data, "<u4", n_docs, at + 8 * n_docs)
        at += 12 * n_docs
        lanes = -(-n_ids // EVERY)
        bit = np.frombuffer(data, "<u4", lanes, at).astype(np.int64)
        words = np.frombuffer(data, ">u4", n_words, at + 4 * lanes).astype(np.uint64)
        pairs = words[:-1] << np.uint64(32) | words[1:]
        out = np.zeros((EVERY, lanes), np.uint16)
        for k in range(EVERY):
            live = lanes if n_ids - (lanes - 1) * EVERY > k else lanes - 1
            b = bit[:live]
            top = (pairs[b >> 5] >> (48 - (b & 31)).astype(np.uint64) & np.uint64(0xFFFF)).astype(np.int64)
            out[k, :live] = self.symbol[top]
            b += self.bits[top]
        ids = out.T.ravel()[:n_ids]
        cuts = np.cumsum(sizes)[:-1].astype(np.int64)
        return [(None if d == NO_ID else d, i) for d, i in zip(doc_ids.tolist(), np.split(ids, cuts))] if n_docs else []


def code_head(lengths: np.ndarray) -> bytes:
    data = zlib.compress(lengths.tobytes(), 9)
    return struct.pack("<4sI", b"HUFC", len(data)) + data


def code_of(f) -> Decoder:
    """The decoder of a file."""
    magic, size = struct.unpack("<4sI", f.read_at(8, 0))
    if magic != b"HUFC":
        raise ValueError("not a file of ids")
    return decoder(f.read_at(size, 8))


@lru_cache(maxsize=4)
def decoder(data: bytes) -> Decoder:
    return Decoder(np.frombuffer(zlib.decompress(data), np.uint8))


def write_ids(docs: DataFrame, path: str, folder: str, kind: str = "word", end_id: int = 1) -> None:
    """Encode all texts, count ids, write files and their index (a row a block) into ``folder``."""
    spark = docs.sparkSession
    small_batches(spark)

    def encode(batches):
        ids_of, end = encoder(path, kind).ids, int(end_id).to_bytes(2, "little")
        for batch in batches:
            ids = [ids_of(t) + end for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, ids binary"), "ids")

    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2")
            total += np.bincount(ids, minlength=1 << 16)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["id", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for r in rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # the vocabulary at most
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    codes, head = canonical(lengths), code_head(lengths)

    def write(batches):
        part, file, waiting, size, first, index = TaskContext.get().partitionId(), None, [], 0, 0, []

        def flush():
            nonlocal waiting, size, first
            data = block(waiting, lengths, codes)
            index.append((part, file.name, file.write(data), len(data), first, size))
            waiting, size, first = [], 0, first + size

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file is None:
                    file = Output(folder, f"part-{part:05d}", ".ids")
                    file.write(head)
                waiting.append((doc_id, np.frombuffer(ids, "<u2")))
                size += len(ids) // 2
                if size >= BLOCK_IDS:
                    flush()
        if waiting:
            flush()
        if file:
            file.close()
        names = ("part", "file", "offset", "bytes", "first", "n_ids")
        yield pa.RecordBatch.from_pydict({k: pa.array([r[j] for r in index], pa.string() if k == "file" else pa.int64()) for j, k in enumerate(names)})

    ordered = rows.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids")
    ordered.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")


INDEX = "part long, file string, offset long, bytes long, first long, n_ids long"


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """A row a document: doc_id, start, n_tokens, ids_crc32, ids, from the folder alone; blocks are dealt over tasks by their bytes."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    blocks = index.join(parts, "part").select("file", "offset", "bytes", (F.col("ahead") + F.col("first")).alias("start"))

    def read(batches):
        code: dict = {}
        for batch in batches:
            for file, offset, size, start in zip(*(batch.column(j).to_pylist() for j in range(4))):
                with read_at(f"{folder}/{file}") as f:
                    code[file] = code.get(file) or code_of(f)
                    found = code[file](f.read_at(size, offset))
                n = [i.size for _, i in found]
                starts = (start + np.concatenate(([0], np.cumsum(n)))[:-1]).tolist()
                wide = [i.astype("<u4").tobytes() for _, i in found]
                columns = [pa.array([d for d, _ in found], pa.int64()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(map(zlib.crc32, wide), pa.int64()), pa.array(wide, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return dealt(blocks, "bytes").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def write_and_read(docs: DataFrame, path: str, kind: str = "word", end_id: int = 1) -> DataFrame:
    folder = scratch_path(docs.sparkSession, "id-files")
    write_ids(docs, path, folder, kind, end_id)
    return read_ids(docs.sparkSession, folder)
