"""Near duplicates by min-max hashing.

A document's set holds its word shingles as 64-bit hashes. Each of ``perms`` hash functions is evaluated once per shingle and gives two
signature values, its minimum and its maximum; bands of ``rows`` values are bucket keys. Documents with equal sets are one class
from the start, and only its smallest doc_id goes on.

Buckets of any size are searched without their square: first each member is compared to the bucket's first, and links make
components; then only pairs from different components are left, with at least one side outside the
bucket's largest component. Those pairs pass a size and a signature filter (512 values for large buckets, five and a half standard
deviations wide: it leaves out a true pair with a probability of 2e-8) and all links are confirmed on the full sets. In large buckets
that happens within blocks, to which signatures go first and then the sets of members with a fitting partner; they return a spanning forest of the links between components. Components are contracted by joins;
nothing is collected. Keys with many rows (a bucket, a bucket's first, a large component) are dealt over several tasks.

There are as many bands as leave a pair at the threshold without a common bucket with a probability of ``miss``: 16 at 0.85, 22 at 0.8.

Words are lower-cased in A-Z only and split at space, tab, line feed, vertical tab, form feed and return. Fewer words than a shingle
make one shingle of all of them; null texts and texts without words have empty sets and link to nothing.
Repeated rows give a row each. Rows that share a doc_id are one document in several texts: what one text links to, all do.
A row without doc_id is its own component (null). A text is one row of one task, whatever its length; its shingles are hashed in
pieces. Other columns are not read. Ties between equal documents go to the smallest doc_id.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_map, small_batches, spread_join, written

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
SMALL = 64
LONG_PERMS = 256
#: Standard deviations below the threshold at which a signature still lets a pair through.
WIDTH = 5.5
#: A block takes two parts of about BLOCK members and BLOCK_VALUES shingles (16 MB) each.
BLOCK = 1000
BLOCK_VALUES = 2_000_000


class Words(dict):
    """Word -> 64-bit hash; emptied when it holds ``most``."""

    def __init__(self, most: int = 500_000):
        import xxhash

        super().__init__()
        self.hash, self.most = xxhash.xxh3_64_intdigest, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = self.hash(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int, words: Words) -> np.ndarray:
    """The sorted distinct shingles of a text."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
        n = min(size, len(own))
        x = np.full(len(own) - n + 1, n, np.uint64)
        for k in range(n):
            x = _mixed(x * _A + h[k : k + x.size] + _B)
    return np.unique(x)


class MinMax:
    """Signatures: ``perms`` minima and as many maxima."""

    def __init__(self, perms: int):
        with np.errstate(over="ignore"):
            self.a = (_mixed(np.arange(1, perms + 1, dtype=np.uint64) * _B) | np.uint64(1))[:, None]
            self.b = _mixed(np.arange(1, perms + 1, dtype=np.uint64) * _C)[:, None]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        low = high = None
        with np.errstate(over="ignore"):
            for i in range(0, x.size, 8192):
                v = ((x[None, i : i + 8192] * self.a + self.b) >> np.uint64(32)).astype(np.uint32)
                lo, hi = v.min(axis=1), v.max(axis=1)
                low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
        return np.stack((low, high), axis=1).ravel()


def sketches(docs: DataFrame, size: int, perms: int) -> DataFrame:
    small_batches(docs.sparkSession)

    def make():
        words, minmax = Words(), MinMax(perms)

        def each(rows: dict) -> dict:
            sets = [shingles(t, size, words) for t in rows["text"]]
            return {
                "doc_id": rows["doc_id"], "n": [s.size for s in sets],
                "class": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if s.size else None for s in sets],
                "sig": [minmax(s).astype("<u4").tobytes() if s.size else None for s in sets],
            }

        return each

    return rows_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, n long, class binary, sig binary")


def margin(share: float, values: int) -> float:
    """How far the share of equal signature values of a pair at the threshold may lie below it."""
    return WIDTH * math.sqrt(share * (1 - share) / values)


def _both(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with both sides' columns; ``a`` may have any number of pairs."""
    side = lambda x: table.select(F.col("rep").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    return spread_join(pairs.join(side("b"), "b"), side("a").join(counts.select("a"), "a", "left_semi"), "a", "_n", pairs.count(), ("b",), counts=counts)


def _alike(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow the similarity."""
    both = _both(pairs, classes, ["n", "sig"]).filter(F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(j).to_pylist()), "<u4").reshape(batch.num_rows, -1) for j in (2, 3))
                near = pa.array((x == y).mean(axis=1) >= least - margin(least, x.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long").distinct()


def _sets(members: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, set) of the documents that share a bucket with another; made once, from the whole texts.

    The hint keeps one plan at every size: texts are dealt out by doc_id, where ids of a large corpus could not be broadcast.
    """
    ids = members.select(F.col("rep").alias("doc_id")).distinct().hint("merge")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(ids, "doc_id", "left_semi")

    def make():
        words = Words()
        return lambda rows: {"doc_id": rows["doc_id"], "set": [shingles(t, size, words).tobytes() for t in rows["text"]]}

    return written(rows_map(texts, make, "doc_id long, set binary"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    both = _both(pairs, sets.withColumnRenamed("doc_id", "rep"), ["set"])

    def run(batches):
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = np.intersect1d(x, y, assume_unique=True).size
                near.append(100 * common >= percent * (x.size + y.size - common))
            yield pa.RecordBatch.from_arrays([batch.column(j).filter(pa.array(near, pa.bool_())) for j in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _long_signatures(large: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, mark, sig) of members of large buckets alone; sig is the low bytes of LONG_PERMS minima and as many maxima, mark tells the set of a rep with several."""
    some = sets.join(large.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").withColumn("mark", F.xxhash64("set")).dropDuplicates(["doc_id", "mark"])

    def make():
        minmax = MinMax(LONG_PERMS)
        return lambda rows: {"rep": rows["doc_id"], "mark": rows["mark"], "sig": [(minmax(np.frombuffer(x, np.uint64)) & np.uint32(255)).astype(np.uint8).tobytes() for x in rows["set"]]}

    return written(rows_map(some, make, "rep long, mark long, sig binary"), "long-signatures")


def _mapped(rows: DataFrame, column: str, parent: DataFrame, by: str) -> DataFrame:
    """``rows`` (a written table) with the parents of ``column``, where there are any, in its place; a node may stand in any number of rows."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    table = parent.select(F.col("v").alias(column), F.col("p").alias("_p"))
    return spread_join(rows, table, column, "_n", rows.count(), (by,), "left", counts).withColumn(column, F.coalesce("_p", column)).drop("_p")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links``(a, b); component is the smallest id that can be reached.

    Each round hooks every node to its smallest neighbour, jumps from parents to their parents until all are roots, then contracts the
    links; links within a component go. A round leaves half of the nodes that had links at most, and a tree of depth d takes log d jumps.
    """
    flat = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    links, labels = written(flat(links), "links"), None
    while labels is None or not links.isEmpty():
        ends = links.union(links.select("b", "a")).toDF("v", "w")
        parent = written(ends.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("p")), "parents")
        moved = True
        while moved:
            jumped = written(_mapped(parent.withColumn("q", F.col("p")), "p", parent, "v"), "parents")
            parent, moved = jumped.select("v", "p"), not jumped.filter("p <> q").isEmpty()
        labels = parent.toDF("id", "component") if labels is None else written(_mapped(labels, "component", parent, "id"), "labels")
        links = written(flat(_mapped(written(_mapped(links, "a", parent, "b"), "links"), "b", parent, "a")), "links")
    return labels


class _Block:
    """Members of two parts of a bucket; ``own`` tells the part, ``i`` and ``j`` the two parts of the block."""

    def __init__(self, t: pa.Table, least: float):
        self.own, self.rep, self.n, self.comp, self.outside = (t.column(c).to_numpy() for c in ("own", "rep", "n", "component", "outside"))
        self.sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        self.least, self.enough = least, least - margin(least, self.sig.shape[1])
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        self.left, self.right, self.same = np.flatnonzero(self.own == i), np.flatnonzero(self.own == j), i == j

    def fitting(self, r: int, comp: np.ndarray) -> np.ndarray:
        """The rows that row ``r`` may be linked to by component, size and signature; pairs within the bucket's largest component are never looked at."""
        some = self.right[self.right > r] if self.same else self.right
        n = self.n[some]
        some = some[(comp[some] != comp[r]) & (self.outside[some] | self.outside[r]) & (np.minimum(n, self.n[r]) >= self.least * np.maximum(n, self.n[r]))]
        return some[(self.sig[some] == self.sig[r]).mean(axis=1) >= self.enough] if some.size else some


def _block_members(t: pa.Table, least: float) -> pa.Table:
    """The members of a block that may be linked to another one there: they alone need their sets."""
    block, near = _Block(t, least), np.zeros(t.num_rows, bool)
    for r in block.left:
        some = block.fitting(r, block.comp)
        near[some] = True
        near[r] |= some.size > 0
    return t.filter(pa.array(near))


def _block_links(t: pa.Table, least: float, percent: int) -> pa.Table:
    """Links between members of two parts of a bucket that join components not joined before in this block, confirmed on full sets."""
    block = _Block(t, least)
    rep, n, comp = block.rep, block.n, block.comp.copy()
    sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([x.size for x in sets])
    codes, mark = np.split(codes, ends[:-1]), np.zeros(codes.size, bool)
    a, b = [], []
    for r in block.left:
        mark[codes[r]] = True
        for c in block.fitting(r, comp):
            if comp[c] != comp[r]:
                common = np.count_nonzero(mark[codes[c]])
                if 100 * common >= percent * (n[r] + n[c] - common):
                    comp[comp == comp[c]] = comp[r]
                    a.append(min(rep[r], rep[c]))
                    b.append(max(rep[r], rep[c]))
        mark[codes[r]] = False
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _cross(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """What a bucket's members in different components give, at least one of a pair outside its largest.

    Small buckets give pairs that are still to be confirmed. Large ones are cut into parts by rows and bytes; every two parts are one
    task, which sees sizes and signatures and names the members that may be linked there. Sets go to these alone, and a second task
    a block confirms on them and returns only links that join components there: fewer than it has rows.
    """
    least = percent / 100
    rows = written(members.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component")), "members")
    sizes = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("values"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("k", "component")).alias("top"), F.sum("k").alias("total"), F.sum("values").alias("values"), F.count(F.lit(1)).alias("parts")).filter("parts > 1 and total > 2")
    mixed = written(mixed.select("key", "total", "values", F.col("top.component").alias("main"), F.col("total").alias("_n")), "mixed-buckets")
    rows = written(spread_join(rows, mixed, "key", "_n", rows.count(), ("rep",)).withColumn("outside", F.col("component") != F.col("main")), "mixed")
    little, large = rows.filter(F.col("total") <= SMALL), rows.filter(F.col("total") > SMALL)
    x = little.filter("outside").select("key", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
    y = little.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    pairs = x.join(y, "key").filter((F.col("ca") != F.col("cb")) & (F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb")))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    blocks = F.greatest(F.ceil(F.col("total") / BLOCK), F.ceil(F.col("values") / BLOCK_VALUES)).cast("int")
    side = large.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    side = side.join(_long_signatures(large, sets), "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = side.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "mark", "n", "component", "outside", "sig")
    near = side.groupBy("key", "i", "j").applyInArrow(lambda t: _block_members(t, least), side.schema)
    full = near.join(sets.select(F.col("doc_id").alias("rep"), F.xxhash64("set").alias("mark"), "set").dropDuplicates(["rep", "mark"]), ["rep", "mark"])
    return pairs, full.groupBy("key", "i", "j").applyInArrow(lambda t: _block_links(t, least, percent), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = 4, miss: float = 1e-5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, links at ``percent`` per cent similarity of sets."""
    least = percent / 100
    bands = math.ceil(math.log(miss) / math.log(1 - least**rows) / 2) * 2 if percent < 100 else 2
    own = written(sketches(docs, size, bands * rows // 2), "sketches")
    some = own.filter("n > 0 and doc_id is not null")
    classes = written(some.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies")), "classes")
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("sig", 1 + 4 * rows * i, 4 * rows)) for i in range(bands)))
    band = classes.select("rep", "n", F.explode(keys).alias("key"))
    buckets = written(band.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "shared-buckets")
    members = written(spread_join(band, buckets, "key", "_n", bands * classes.count(), ("rep",)), "buckets")
    first = written(members.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "first-pairs")
    sets = _sets(members, docs, size)
    links = written(_confirmed(written(_alike(first, classes, least), "alike"), sets, percent), "links")
    pairs, joined = _cross(members.select("key", "rep", "n"), components(links), sets, percent)
    cross = written(pairs.join(first, ["a", "b"], "left_anti"), "cross-pairs")
    more = written(_confirmed(written(_alike(cross, classes, least), "alike"), sets, percent), "links")
    several = some.groupBy("doc_id").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x <> y").select("doc_id")
    twins = some.select("doc_id", "class").join(several, "doc_id", "left_semi").join(classes, "class").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = components(links.union(more).union(written(joined, "links")).union(twins))
    named = classes.join(labels, F.col("rep") == F.col("id"), "left").select("class", F.coalesce("component", "rep").alias("component"), "copies")
    out = spread_join(own.select("doc_id", "n", "class"), written(named, "named"), "class", "copies", own.count(), ("doc_id",), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest doc_id, with all its texts; rows that repeat its id and text are one.

    Of rows that differ in other columns alone the one whose columns sort first as JSON stays, wherever rows stand. Rows without doc_id all stay.
    """
    kept = near_duplicates(docs, size, percent).filter("kept").select("doc_id").distinct()
    known = docs.join(kept, "doc_id", "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    if others:
        row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
        one = known.groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias("_row"))
        known = one.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"_row.c{others.index(c)}").alias(c) for c in docs.columns))
    else:
        known = known.distinct()
    return known.select(*(F.col(f"`{c}`") for c in docs.columns)).union(docs.filter(F.col("doc_id").isNull()))
