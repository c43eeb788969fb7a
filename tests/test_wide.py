"""Ranks without one task, containment without all pairs, equality by digests, and the scratch folder; each against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from pulsegrid import scratch
from pulsegrid.operators.dims import contained_pairs
from pulsegrid.operators.rank import percentile_ties, ranked_wide
from pulsegrid.operators.rollup import aggregates_equal

VALUES = {
    "ties": [random.Random(1).choice([None, 1.0, 1.0, 1.0, 2.5, -3.0]) for _ in range(300)],
    "different": [float(x) for x in random.Random(2).sample(range(10_000), 400)],
    "one": [4.0],
    "empty": [],
    "odd": [float("nan"), float("inf"), 0.0, -0.0, None, float("nan")],
}


def place(v):
    """Nulls first, NaN last, zeros alike."""
    return (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v + 0.0)


@pytest.mark.parametrize("case", VALUES)
def test_percentile_of_all_rows(spark, case):
    values = VALUES[case]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, x double")
    got = {r["id"]: r["percentile"] for r in percentile_ties(rows, "x").collect()}
    keys = [place(v) for v in values]
    want = {i: 50.0 if len(keys) == 1 else 100 * (sum(o < k for o in keys) + (keys.count(k) - 1) / 2) / (len(keys) - 1) for i, k in enumerate(keys)}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("case", VALUES)
def test_rank_of_all_rows(spark, case):
    values = VALUES[case]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, x double")
    got = [r["id"] for r in sorted(ranked_wide(rows, "x", "id").collect(), key=lambda r: r["rank"])]
    down = lambda v: (2, 0.0) if v is None else (0, 0.0) if v != v else (1, -v + 0.0)
    assert got == sorted(range(len(values)), key=lambda i: (down(values[i]), i))
    assert sorted(r["rank"] for r in ranked_wide(rows, "x", "id").collect()) == list(range(1, len(values) + 1))


@pytest.mark.parametrize("shortest", [1, 2])
def test_contained_pairs(spark, shortest):
    draw = random.Random(3)
    text = lambda: "".join(draw.choice("aab É") for _ in range(draw.randrange(0, 7)))
    values, names = [text() for _ in range(120)] + [None], [(text(), i) for i in range(60)] + [(None, 99), ("ab", 100), ("ab", 101)]
    left, right = spark.createDataFrame([(v,) for v in values], "v string"), spark.createDataFrame(names, "name string, code long")
    pairs = contained_pairs(left, "v", right, "name", shortest)
    got = sorted((r["v"], r["name"], r["code"]) for r in pairs.collect())
    want = sorted((v, n, c) for v in {v for v in values if v} for n, c in names if n is not None and (v == n or (len(n) >= shortest and (n in v or v in n))))
    assert got == want
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_contained_pairs_are_not_broadcast(spark):
    """What a text is cut into is many times what Spark expects of it, so a broadcast would fill the driver; nor does a number meet names that only share three of its digits."""
    names = spark.range(2000).select(F.format_string("Supplier#%09d", "id").alias("name"))
    pairs = contained_pairs(spark.range(10_000, 12_000).select(F.col("id").cast("string").alias("v")), "v", names, "name")
    assert pairs.count() == 0 and "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_aggregates_differ(spark):
    cell = "bucket long, code string, n double, m long"
    a = spark.createDataFrame([(0, "x", 1.0, 1), (0, "y", 2.0, 1), (1, "x", None, 1), (1, "y", float("nan"), 1), (2, "x", 5.0, 1), (3, "x", 1e6, 1), (4, "x", None, 7)], cell)
    b = spark.createDataFrame([(0, "y", 2.0, 1), (0, "x", 1.0, 1), (1, "x", 0.0, 1), (1, "y", 1.0, 2), (2, "z", 5.0, 1), (3, "x", 1e6 + 1e-6, 1), (4, "x", None, 7)], cell)
    compare = lambda x, y: tuple(aggregates_equal(x, y, ["bucket", "code"], ["n", "m"]).first())
    # keys: six shared, two of one side; values: null and a number, NaN and a number, 1 and 2
    assert compare(a, b) == (8, 2, 3)
    assert compare(a, a) == (7, 0, 0)
    assert compare(a.limit(0), b) == (7, 7, 0)
    assert compare(a.limit(0), a.limit(0)) == (0, 0, 0)


def test_scratch_is_cleared(spark):
    rows = scratch.stored(spark.range(3).withColumn("x", F.lit("a")), "some")
    assert rows.count() == 3
    jvm = spark._jvm.org.apache.hadoop.fs.Path(scratch.shared(spark))
    files = jvm.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(jvm)
    scratch.clear(spark)
    assert not files.exists(jvm)


def test_lines_are_dealt_by_bytes(spark, monkeypatch):
    """A task takes a bounded part of a table of few files; their number was that of the cores at any size."""
    from pulsegrid.plans import bindings

    lines = bindings.table(spark, "/root/testdata/sf0.01", "lineitem")
    monkeypatch.setattr(bindings, "TASK_BYTES", 50_000, raising=False)
    assert bindings.spread(lines, "l_orderkey").rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(bindings, "TASK_BYTES", 1 << 30)
    assert bindings.spread(lines, "l_orderkey").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def made_cells(spark, query, name):
    """Tables of cells that a query writes for itself."""
    from pathlib import Path

    folder = Path(scratch.shared(spark).removeprefix("file://"))
    before = set(folder.glob(f"{name}-*"))
    query(spark, "/root/testdata/sf0.01")
    return [spark.read.parquet(f"file://{p}") for p in set(folder.glob(f"{name}-*")) - before]


def test_snapshot_view_keeps_the_pairs_it_shows(spark):
    """The pairs of all countries grow with the rows up to the product of their codes and days; the view is about those towards home."""
    from pulsegrid.plans import catalog

    made = made_cells(spark, catalog.published, "rel")
    assert len(made) == 1 and {r[0] for r in made[0].select("actor2").distinct().collect()} == {"N06"}


def test_snapshot_build_keeps_the_pairs_it_shows(spark, monkeypatch):
    from pulsegrid.plans import history

    monkeypatch.setattr(history.snapshot, "build", lambda *a: None)
    monkeypatch.setattr(history, "SHOWN", ())
    made = made_cells(spark, history.built, "rel")
    assert len(made) == 2 and all({r[0] for r in cells.select("actor2").distinct().collect()} == {"N06"} for cells in made)
