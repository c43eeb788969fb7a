"""Conversation structure repair: the cheapest edits that give ``(s?(ua)+)?``, by a Viterbi search in parallel.

Rows of a conversation stand in the order of turn (nulls first), then role, then a hash of the text; equal rows are one row with a number. A row
is blank, a duplicate (role and text seen earlier in the conversation), truncated, or without fault. Edits: keep (0), rerole (2), delete (3; blank
rows and duplicates must go), insert (2); a truncated row that stays costs 1 more. States of the search: nothing yet, behind s, behind u, behind a.

All conversations are sorted by ranges and cut into chunks of ``size`` rows. A chunk doesn't know the costs behind it, so it starts from four
speculative cost vectors, the extreme ones that lie within what edits can make of each other, and every other vector is a minimum of these plus constants.
Fix-up passes take the four through the chunks behind, twice as many each pass, until they differ by constants only (rank one: whatever stands behind doesn't
matter) or the conversation ends. So each chunk gets its backward costs, up to a constant, in log2(chunks) passes at most, whatever its rows. With them the
least audit is traced forward: of the edits that keep the cost least, the first of D, I, K, R. States at chunks' starts are found by the same passes.

Null roles and texts count as one space, as do null conv_ids and turns where they are part of a text; rows without conv_id are one conversation. Repeated rows
are duplicates. A conversation may have any number of rows: only its digest and its audit, one string each by contract, are made in one task, row by row.
Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = ("su", "ua", "au")
TERMINAL = (0, 4, 2, 0)
#: The most that the cost of one state (row) can lie above that of another (column); the columns are the speculative vectors.
REACH = ((0, 0, 2, 0), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))
LATE, GONE = 4, 8
KEYS = ("cn", "c", "tn", "t", "role", "digest")
CONV = ("cn", "c")
CHUNK = 1024


def keeps(state: int, kind: int) -> int | None:
    """The state behind a kept row, if it may be kept; kind: 0 s, 1 u, 2 a, 3 another."""
    if kind == 0:
        return SYSTEM if state == START else None
    if kind == 1:
        return USER if state != USER else None
    return ASSISTANT if kind == 2 and state == USER else None


def given(state: int) -> int:
    """The state behind a row that is made what is due: assistant behind user, else user."""
    return ASSISTANT if state == USER else USER


def before(b: tuple[int, ...], code: int) -> tuple[int, ...]:
    """Costs of the states before a row, from those behind it. Rows that must go add as much to all."""
    if code & GONE:
        return b
    late, kind = (code & LATE) > 0, code & 3
    out = []
    for q in range(4):
        cost = min(3 + b[q], 2 + late + b[given(q)])
        to = keeps(q, kind)
        out.append(cost if to is None else min(cost, late + b[to]))
    user, assistant = min(out[2], 2 + out[3]), min(out[3], 2 + out[2])
    return min(out[0], 2 + user), min(out[1], 2 + user), user, assistant


_steps: dict = {}


def back(b: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    """``before`` without the least cost, and that cost; vectors without it are few, so they are remembered."""
    key = (b, code)
    if key not in _steps:
        new = before(b, code)
        _steps[key] = tuple(x - min(new) for x in new), min(new)
    return _steps[key]


def transfer(codes: bytes) -> list[int]:
    """Costs at the chunk's start for each speculative vector (columns), by rows; constants between columns are kept."""
    columns = []
    for j in range(4):
        vector, total = tuple(row[j] for row in REACH), 0
        for code in reversed(codes):
            vector, more = back(vector, code)
            total += more
        columns.append([x + total for x in vector])
    least = min(map(min, columns))
    return [columns[j][k] - least for k in range(4) for j in range(4)]


def trace(codes: bytes, end: tuple[int, ...], state: int, last: bool) -> tuple[list[str], list[int], int, int]:
    """Edits and the state before each row, the state behind the chunk and the cost; the last chunk inserts what is missing behind it."""
    vectors = [tuple(x - min(end) for x in end)]
    for code in reversed(codes):
        vectors.append(back(vectors[-1], code)[0])
    vectors.reverse()
    edits, states, total = [], [], 0
    for i, code in enumerate(codes):
        states.append(state)
        if code & GONE:
            edits.append("D")
            total += 3
            continue
        late, kind, done = (code & LATE) > 0, code & 3, ""
        here, behind = before(vectors[i + 1], code), vectors[i + 1]
        while True:
            want, kept = here[state], keeps(state, kind)
            if 3 + behind[state] == want:
                edits.append(done + "D")
                total += 3
                break
            if 2 + here[given(state)] == want:
                done += "I"
                total += 2
                state = given(state)
                continue
            if kept is not None and late + behind[kept] == want:
                edits.append(done + "K")
                total += late
                state = kept
                break
            edits.append(done + "R")
            total += 2 + late
            state = given(state)
            break
    tail = "I" * (state == USER) + "II" * (state == SYSTEM) if last else ""
    if tail:
        edits[-1] += tail
        total += 2 * len(tail)
        state = ASSISTANT
    return edits, states, state, total


def rows_of(turns: DataFrame) -> DataFrame:
    """Distinct rows, their number n, and keys that sort and join without nulls. Copies are counted before they move."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    rows = turns.select(conv.isNull().alias("cn"), F.coalesce(conv, F.lit(0)).alias("c"), turn.isNotNull().alias("tn"), F.coalesce(turn, F.lit(0)).alias("t"), role.alias("role"), text.alias("text"))
    rows = rows.groupBy("cn", "c", "tn", "t", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    return written(rows.withColumn("digest", F.unhex(F.sha2("text", 256))), "turns")


def coded(rows: DataFrame) -> DataFrame:
    """Keys, n, code and blank of each row; a code is the kind, LATE if truncated, GONE if the row must go."""
    shown = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    blank, whole = shown == "", F.substring(shown, -1, 1).isin(".", "!", "?")
    first = rows.groupBy(*CONV, "role", "digest").agg(F.min(F.struct("tn", "t")).alias("at")).select(*CONV, F.col("at.tn").alias("tn"), F.col("at.t").alias("t"), "role", "digest", F.lit(True).alias("first"))
    kind = F.when(F.substring("role", 1, 1) == "s", 0).when(F.substring("role", 1, 1) == "u", 1).when(F.substring("role", 1, 1) == "a", 2).otherwise(3)
    slim = rows.select(*KEYS, "n", blank.alias("blank"), kind.alias("kind"), whole.alias("whole")).join(first, [*KEYS], "left")
    code = F.when(F.col("blank") | F.col("first").isNull(), F.col("kind") + GONE).when(F.col("whole"), F.col("kind")).otherwise(F.col("kind") + LATE)
    return slim.select(*KEYS, "n", code.cast("int").alias("code"), "blank")


def legal(a: str, b: str) -> bool:
    return a + b in LEGAL


_CHUNK = "cn boolean, c long, pid int, cid long, tn array<boolean>, t array<long>, role array<string>, digest array<binary>, n array<long>, codes binary, blank long, duplicate long, truncated long, illegal long, head string, tail string, m array<int>"


def chunks_of(rows: DataFrame, size: int) -> DataFrame:
    """Rows in order, cut into chunks of ``size`` rows of one conversation; ranges may cut a conversation too."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_CHUNK))

    def chunk(pid: int, cid: int, part: list[tuple]) -> dict:
        codes = bytes(r[7] for r in part)
        heads = [r[4][:1] for r in part]
        gone = [bool(x & GONE) for x in codes]
        out = {"cn": part[0][0], "c": part[0][1], "pid": pid, "cid": cid, "codes": codes, "head": heads[0], "tail": heads[-1]}
        out |= {k: [r[j] for r in part] for j, k in ((2, "tn"), (3, "t"), (4, "role"), (5, "digest"), (6, "n"))}
        out["blank"] = sum(r[6] for r in part if r[8])
        out["duplicate"] = sum(r[6] - (not g) for r, g in zip(part, gone) if not r[8])
        out["truncated"] = sum(x & LATE > 0 for x in codes)
        out["illegal"] = sum(r[6] - 1 for r in part) + sum(not legal(a, b) for a, b in zip(heads, heads[1:]))
        return out | {"m": transfer(codes)}

    def run(batches):
        pid, cid, part, ready = TaskContext.get().partitionId(), 0, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                other = part and row[:2] != part[0][:2]
                if other or len(part) == size:
                    ready.append(chunk(pid, cid, part))
                    part, cid = [], 0 if other else cid + 1
                part.append(row)
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema)
                ready = []
        if part:
            yield pa.RecordBatch.from_pylist([chunk(pid, cid, part)], schema)

    ordered = rows.select(*KEYS, "n", "code", "blank").repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
    found = written(ordered.mapInArrow(run, _CHUNK), "chunks")
    by = found.groupBy(*CONV, "pid").agg(F.count(F.lit(1)).alias("parts"))
    whole, earlier = Window.partitionBy(*CONV), Window.partitionBy(*CONV).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    by = by.select(*CONV, "pid", (F.sum("parts").over(whole) - 1).alias("last"), F.coalesce(F.sum("parts").over(earlier), F.lit(0)).alias("ahead"))  # a row a range at most
    return written(found.join(by, [*CONV, "pid"]).withColumn("no", F.col("ahead") + F.col("cid")).drop("pid", "cid", "ahead"), "numbered-chunks")


def stretched(spans: DataFrame, product: str, settled: str, beyond: str) -> DataFrame:
    """Lengthen ``value`` of each span by that of the span at ``to``, twice as far each pass, until it is settled or ``to`` is beyond the conversation."""
    spans = written(spans.withColumn("open", ~F.expr(f"({beyond}) or ({settled})")), "stretches")
    while not spans.filter("open").isEmpty():
        far = spans.select(*CONV, F.col("no").alias("to"), F.col("value").alias("next"), F.col("to").alias("then"))
        more = spans.filter("open").join(far, [*CONV, "to"]).select(*CONV, "no", "last", F.expr(product).alias("value"), F.col("then").alias("to"))
        more = more.withColumn("open", ~F.expr(f"({beyond}) or ({settled})"))
        spans = written(spans.filter("not open").unionByName(more), "stretches")
    return spans


#: Products of cost tables (least sums, the least taken off) and of maps of states, as Spark SQL; what makes further steps needless.
_SUMS = "transform(sequence(0, 15), x -> array_min(transform(sequence(0, 3), i -> next[i * 4 + x % 4] + value[int(x div 4) * 4 + i])))"
COSTS = f"transform({_SUMS}, y -> y - array_min({_SUMS}))"
PARALLEL = "forall(sequence(0, 15), x -> value[x] - value[int(x div 4) * 4] = value[x % 4] - value[0])"
STATES = "transform(next, q -> value[q])"
CONSTANT = "array_min(value) = array_max(value)"


def behind_chunks(chunks: DataFrame) -> DataFrame:
    """The cost vector behind each chunk that another one follows: cn, c, no, costs."""
    spans = stretched(chunks.select(*CONV, "no", "last", F.col("m").alias("value"), (F.col("no") + 1).alias("to")), COSTS, PARALLEL, "to > last")
    end = ", ".join(map(str, TERMINAL))
    costs = F.expr(f"transform(sequence(0, 3), k -> array_min(transform(sequence(0, 3), j -> value[k * 4 + j] + array({end})[j])))")
    return spans.filter("no > 0").select(*CONV, (F.col("no") - 1).alias("no"), costs.alias("costs"))


def traced(chunks: DataFrame) -> DataFrame:
    """Chunks with edits and states of each row, audit and cost."""
    spark = chunks.sparkSession
    columns = [c for c in chunks.columns if c != "m"]
    many = chunks.filter("last > 0")
    if many.isEmpty():
        ready = chunks.select(*columns, F.lit(None).cast("array<int>").alias("costs"), F.lit(START).alias("state"))
    else:
        costs = behind_chunks(many)
        known = written(chunks.select(*columns).join(costs, [*CONV, "no"], "left"), "chunks-with-costs")

        def ends(batches):
            for batch in batches:
                out = []
                for codes, vector, no, last in zip(*(batch.column(j).to_pylist() for j in (2, 3, 4, 5))):
                    out.append([trace(codes, tuple(vector or TERMINAL), q, no == last)[2] for q in range(4)])
                yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in (0, 1, 4, 5)), pa.array(out, pa.list_(pa.int32()))], names=[*CONV, "no", "last", "value"])

        maps = known.filter("last > 0 and no < last").select(*CONV, "codes", "costs", "no", "last").mapInArrow(ends, "cn boolean, c long, no long, last long, value array<int>")
        first = many.filter("no = 0").select(*CONV, "no", "last", F.array(*map(F.lit, range(4))).alias("value"), F.lit(0).cast("long").alias("to"))
        spans = maps.select(*CONV, (F.col("no") + 1).alias("no"), "last", "value", F.col("no").alias("to")).unionByName(first)
        states = stretched(spans, STATES, CONSTANT, "to = 0").select(*CONV, "no", F.col("value")[START].alias("state"))
        ready = known.join(states, [*CONV, "no"], "left").select(*columns, "costs", F.coalesce("state", F.lit(START)).alias("state"))

    places = [ready.columns.index(c) for c in ("codes", "costs", "state", "no", "last", "n")]

    def run(batches):
        for batch in batches:
            found: list = [[], [], [], []]
            for codes, vector, state, no, last, n in zip(*(batch.column(j).to_pylist() for j in places)):
                edits, states, _, cost = trace(codes, tuple(vector or TERMINAL), state, no == last)
                for i, copies in enumerate(n):
                    if copies > 1:  # copies of a row go; what is inserted behind the last row stays last
                        body = edits[i].rstrip("I") if i == len(n) - 1 else edits[i]
                        edits[i] = body + "D" * (copies - 1) + edits[i][len(body) :]
                        cost += 3 * (copies - 1)
                for column, v in zip(found, (edits, states, "".join(edits), cost)):
                    column.append(v)
            kinds = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, k) for v, k in zip(found, kinds))], names=[*batch.schema.names, "edits", "states", "audit", "cost"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ready.schema)
    return written(ready.mapInArrow(run, f"{fields}, edits array<string>, states array<int>, audit string, cost long"), "traced-chunks")


def repaired(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row a turn of the repaired conversations: cn, c, no, at, k (their order), role, text, edit."""
    small_batches(rows.sparkSession)
    one = chunks.select(*CONV, "no", F.posexplode(F.arrays_zip("tn", "t", "role", "digest", "edits", "states")).alias("at", "x"))
    one = one.select(*CONV, "no", "at", *(F.col(f"x.{c}").alias(c) for c in ("tn", "t", "role", "digest", "edits", "states"))).filter("edits rlike '[IKR]'")
    both = one.join(rows.select(*KEYS, "text"), [*KEYS]).select(*CONV, "no", "at", "role", "text", "edits", "states")
    names, kinds = ["cn", "c", "no", "at", "k", "role", "text", "edit"], (pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())

    def run(batches):
        for batch in batches:
            out: list = [[] for _ in names]
            for cn, c, no, at, role, text, edits, state in zip(*(col.to_pylist() for col in batch.columns)):
                for k, edit in enumerate(edits):
                    if edit == "D":
                        continue
                    if edit == "K":
                        state, shown = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]], (role, text)
                    else:
                        state = given(state)
                        shown = ("assistant" if state == ASSISTANT else "user", text if edit == "R" else "")
                    for column, v in zip(out, (cn, c, no, at, k, *shown, edit)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out, kinds)], names=names)

    return both.mapInArrow(run, "cn boolean, c long, no long, at int, k int, role string, text string, edit string")


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of each repaired conversation's ``role:text`` lines; a conversation's bytes run through one hash, row by row."""

    def run(batches):
        now, sha = None, None

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["cn", "c", "repaired_sha256"])

        for batch in batches:
            ready = []
            for cn, c, role, text in zip(*(batch.column(j).to_pylist() for j in (0, 1, 5, 6))):
                if now == (cn, c):
                    sha.update(b"\n")
                else:
                    if now:
                        ready.append((*now, sha.hexdigest()))
                    now, sha = (cn, c), hashlib.sha256()
                sha.update(f"{role}:{text}".encode())
            if ready:
                yield out(ready)
        if now:
            yield out([(*now, sha.hexdigest())])

    ordered = turns.repartition(*CONV).sortWithinPartitions(*CONV, "no", "at", "k")
    return ordered.mapInArrow(run, "cn boolean, c long, repaired_sha256 string")


def repair(turns: DataFrame, size: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conversations, chunks, turns): figures of each conversation that has rows, edits of each chunk, and the repaired turns."""
    rows = rows_of(turns)
    chunks = traced(chunks_of(coded(rows), size))
    fine = repaired(rows, chunks)
    figures = ("blank", "duplicate", "truncated", "illegal", "cost")
    audit = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("no", "audit"))), lambda x: x["audit"]))
    by = chunks.groupBy(*CONV).agg(*(F.sum(c).alias(c) for c in figures), audit.alias("audit"))
    meets = chunks.filter("no < last").select(*CONV, (F.col("no") + 1).alias("no"), F.col("tail").alias("ahead")).join(chunks.filter("no > 0").select(*CONV, "no", "head"), [*CONV, "no"])
    meets = meets.groupBy(*CONV).agg(F.sum((~F.concat("ahead", "head").isin(*LEGAL)).cast("long")).alias("meets"))
    places = rows.filter("tn").groupBy(*CONV, "t").agg(F.lit(1).alias("one")).groupBy(*CONV).agg((F.max("t") - F.min("t") + 1 - F.count("one")).alias("gaps"))
    out = by.join(meets, [*CONV], "left").join(places, [*CONV], "left").withColumn("illegal", F.col("illegal") + F.coalesce("meets", F.lit(0)))
    return out.select(*CONV, F.coalesce("gaps", F.lit(0)).alias("gaps"), *figures, "audit"), chunks, fine


def report(turns: DataFrame, everything: DataFrame, size: int = CHUNK) -> DataFrame:
    """A row for each conv_id of ``everything``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of its rows in ``turns``."""
    figures, _, fine = repair(turns, size)
    conv = F.col("conv_id").cast("long")
    ids = everything.select(conv.isNull().alias("cn"), F.coalesce(conv, F.lit(0)).alias("c")).distinct()
    out = ids.join(figures, [*CONV], "left").join(digests(fine), [*CONV], "left")
    long = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(F.when(~F.col("cn"), F.col("c")).alias("conv_id"), *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in long), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
