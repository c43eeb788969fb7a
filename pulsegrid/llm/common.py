"""What the operators of this folder share: scratch tables, Arrow maps, hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's name for a words' separator: space, tab, line feed, vertical tab, form feed, return.
BREAK = "[\\x20\\x09-\\x0D]"
#: A key with at least this share of all rows is hot; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 0.001


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, local sessions get a temporary one."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.pulsegrid.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
        spark.conf.set("spark.pulsegrid.scratch", base)
    return base.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's tables and files in the shared folder."""
    return f"{scratch_dir(spark)}/pulsegrid-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote there. Its owner calls this once the results are stored; the operators never do, as their results read from it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later steps read it, whatever executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Let the session hand Python at most ``rows`` rows a batch, so that a batch of long texts stays small.

    Spark reads the setting when a plan runs, so it stays in the session; a smaller value of the user or of another operator is left.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))


def rows_map(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """Arrow batches through ``make()(columns)``, columns as lists; ``make`` runs once a task.

    The columns that come back are named as in ``schema``.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                out = each(batch.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def map_whole(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``df`` through Arrow with all its columns, which ``run`` finds by place: Spark's own map takes no names with dots."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def id_residue(n: int, doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo ``n``."""
    return F.crc32(F.col(doc_id).cast("string")) % n


def spread_join(df: DataFrame, table: DataFrame, key: str, n: str, total: int, by: tuple[str, ...], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Join ``table`` by ``key``, which is unique in it; the column ``n`` of ``counts`` (or of ``table``) is the number of rows of ``df`` with the key, ``total`` all of them.

    A key with a thousandth of all rows or more is hot: there are a thousand at most, and they alone go to the driver. Rows of hot keys are dealt
    over several parts by a hash of ``by``, and the key's row in ``table`` is given to each of them; rows without a key are dealt out likewise.
    """
    most = max(2, int(total * HOT_SHARE))
    found = table if counts is None else counts
    hot: dict[int, list] = {}
    for k, m in found.filter((F.col(n) >= most) & F.col(key).isNotNull()).select(key, n).collect():  # a thousand at most
        hot.setdefault((int(m) // most).bit_length(), []).append(k)
    ways = F.lit(1)
    for bits, keys in sorted(hot.items()):
        ways = F.when(F.col(key).isin(keys), F.lit(1 << bits)).otherwise(ways)
    left = df.withColumn("_part", F.pmod(F.xxhash64(*by), F.when(F.col(key).isNull(), F.lit(1_000_003)).otherwise(ways)).cast("int"))
    right = table.withColumn("_part", F.explode(F.sequence(F.lit(0), ways - 1))).drop(*([n] if counts is None else []))
    return left.join(right, [key, "_part"], how).drop("_part")


def dealt(rows: DataFrame, size: str, each: int = 32 << 20) -> DataFrame:
    """``rows`` (places in files) over as many tasks as their bytes need, ``each`` a task; fewer only where there are fewer rows than cores.

    The number is fixed, so that adaptive execution, which sees the small rows alone, doesn't put them together.
    """
    n, whole = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows.repartition(max(1, min(n, max(-(-int(whole) // each), 2 * rows.sparkSession.sparkContext.defaultParallelism))))
