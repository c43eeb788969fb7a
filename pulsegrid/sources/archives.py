"""Batch archives: one zipped, tab-separated member each; the batch key comes from the file's name.

A batch is an archive of the batch's name, its head, and as many numbered parts (20240101000000.gkg.csv.1.0.zip) as its size asks for.
"""

from __future__ import annotations

import io
import itertools
import re
import uuid
import zipfile
import zlib
from collections.abc import Callable
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import COUNTS, SCORES, article_status, code, location_countries, score_value, with_event_status, with_numbers
from ..options import Options
from ..scratch import freed

MOST_BYTES = 1 << 30
#: Bytes of lines in an archive that is written; a longer line has an archive to itself.
PART_BYTES = 1 << 24
#: Bytes of lines that are compressed at once.
WRITE_BYTES = 1 << 20
#: How far lines are compressed: the next levels take twice the time or more and save a tenth of the bytes of texts, a fifth of those of events.
LEVEL = 3
#: Names of heads, without the numbered parts.
HEADS = "*[!0-9].zip"
#: The most characters that may follow an article record on lines of their own.
MOST_TAIL = 1 << 20
#: Names of batch files by kind, and the schema of files as Spark reads them.
SUFFIXES = {"events": ".export.CSV.zip", "gkg": ".gkg.csv.zip"}
FILES = "path string, modificationTime timestamp, length long, content binary"
RECORD_ID = r"^\d{14}-\d+"
_RECORD_ID = re.compile(RECORD_ID, re.ASCII)


def batch_key(df: DataFrame, column: str = "path") -> DataFrame:
    """kind and file_ts (UTC seconds) of names like 20240101001500.export.CSV.zip."""
    name = F.element_at(F.split(F.col(column), "/"), -1)
    stamp = F.regexp_extract(name, r"^(\d{14})\.", 1)
    kind = F.when(F.lower(name).contains(".export."), "events").when(F.lower(name).contains(".gkg."), "gkg")
    return df.withColumn("kind", kind).withColumn("file_ts", F.unix_timestamp(F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss"))))


def read_lines(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    return lines_of(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path), most_bytes)


def lines_of(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, kind, file_ts, line_no, line, error: lines of each archive's only member; archives that aren't so end with a row with an error.

    The batch is read from a file's name once, not in every row.
    """

    def run(batches):
        for *file, content in _files(batches):
            yield from _tables(file, _lines(content, most_bytes), LINE)

    return batch_key(files).select("path", "kind", "file_ts", "content").mapInArrow(run, LINE)


def records_of(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``article_records`` of the lines of archives: the task that reads a file makes its records, so no text moves."""

    def run(batches):
        for *file, content in _files(batches):
            yield from _tables(file, _gathered(line for _, line, _ in _lines(content, most_bytes)), GATHERED)

    return _records(files.select("path", "content").mapInArrow(run, GATHERED))


def read_records(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    return records_of(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path), most_bytes)


#: Rows as tasks make them: lines, and lines gathered to records by number. Those of a file have its columns first.
LINE, GATHERED = "path string, kind string, file_ts long, line_no long, line string, error string", "path string, record long, l array<string>, good boolean"
_TYPES = {LINE: (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), GATHERED: (pa.string(), pa.int64(), pa.list_(pa.string()), pa.bool_())}


def _files(batches):
    """Rows of files; contents, the last column, are taken one at a time."""
    for batch in batches:
        yield from zip(*(batch.column(j).to_pylist() for j in range(batch.num_columns - 1)), batch.column(batch.num_columns - 1))


def _tables(file: list, rows, schema: str):
    """Rows of a file as tables, bounded in rows and in characters of the texts, or lists of texts, that stand second in a row."""
    names, types = [c.split()[0] for c in schema.split(", ")], _TYPES[schema]
    some, size = [], 0
    for row in itertools.chain(rows, [None]):
        if row:
            some.append(row)
            text = row[1]
            size += len(text) if isinstance(text, str) else sum(len(x or "") for x in text or ())
        if some and (row is None or len(some) >= 10_000 or size >= PART_BYTES):
            columns = [pa.repeat(pa.scalar(v, t), len(some)) for v, t in zip(file, types)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, t) for c, t in zip(zip(*some), types[len(file):]))], names=names)
            some, size = [], 0


def _lines(content, most_bytes: int):
    """Number, line and error of an archive's lines; one with a fault ends with a row of number -1."""
    try:
        with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
            members = [m for m in z.infolist() if not m.is_dir()]
            if len(members) != 1 or not 0 < members[0].file_size <= most_bytes:
                raise ValueError("one member of an allowed size is needed")
            with z.open(members[0]) as f:
                for no, raw in enumerate(f):
                    yield no, raw.decode("utf-8", "replace").rstrip("\r\n"), None
    except (ValueError, NotImplementedError, zipfile.BadZipFile, zlib.error, EOFError) as e:
        yield -1, None, str(e)


def _gathered(lines):
    """The lines of a file, in order, as records: number, lines that are kept, and whether all are whole and may follow the first.

    A line of 27 fields or more starts a record. Number 0 holds what stands before the first, and the mark (None) of a file with a fault, and comes last.
    """
    number, kept, good, tail, some, loose, fault = 0, [], True, 0, False, None, False
    for line in lines:
        if line is None:
            fault = True
            continue
        if line.count("\t") >= 26:
            if number:
                yield number, kept, good
            elif some:
                loose = kept
            number, kept, good, tail, some = number + 1, [line], True, 0, True
            continue
        tail, some = tail + len(line), True
        good = good and tail <= MOST_TAIL and "\t" not in line and not _RECORD_ID.match(line)
        if tail <= MOST_TAIL:
            kept.append(line)
    if number:
        yield number, kept, good
    elif some:
        loose = kept
    if fault or loose is not None:
        yield 0, [*([None] if fault else []), *(loose or [])], False


def parts_of(spark: SparkSession, heads: list[str]) -> DataFrame:
    """The files of whole batches: their ``heads``, and all numbered parts beside them."""
    plain = (re.sub(r"([*?{}\[\]\\,])", r"\\\1", h.removesuffix(".zip")) for h in heads)
    return spark.read.format("binaryFile").load([f"{x}{{.zip,.*.zip}}" for x in plain])


def write_archives(rows: DataFrame, folder: str, part_bytes: int = PART_BYTES, render: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Archives of at most ``part_bytes`` of lines for each (kind, file_ts) in the shared ``folder``; each has its lines in the order of line_no.

    A row's line is a whole record and isn't cut. ``render`` gives rows their line once they are dealt, where that is more bytes than what it is made of;
    without it the rows have one. Rows move once: a batch stays with one task while it is small, and is dealt over as many as its bytes ask for; each task
    writes its own parts, and goes on in a further file where one grows too large.
    Lines are streamed into a file with a name of its own, which then takes the part's name: a repeated attempt of a task leaves the same archives.
    A batch that is written again replaces its parts. Heads take their name last, so that a batch whose head is there is whole.
    """
    stem = F.create_map(*(F.lit(x) for kind, suffix in SUFFIXES.items() for x in (kind, suffix.removesuffix(".zip"))))[F.col("kind")]
    named = rows.withColumn("name", F.concat(F.date_format(F.timestamp_seconds("file_ts"), "yyyyMMddHHmmss"), stem))
    dealt = named.hint("rebalance", F.col("name")).sortWithinPartitions("name", "line_no")
    spread = (render(dealt) if render else dealt).select("name", F.spark_partition_id().cast("long").alias("part"), "line")

    def base_of():
        from pyarrow import fs

        return fs.FileSystem.from_uri(folder) if urlparse(folder).scheme else (fs.LocalFileSystem(), folder)

    def run(batches):
        system, base = base_of()
        system.create_dir(base, recursive=True)
        now = temporary = stream = archive = member = None
        size = roll = kept = 0
        firsts: dict[tuple, list] = {}
        lines: list[bytes] = []

        def close():
            member.write(b"".join(lines))
            lines.clear()
            member.close()
            archive.close()
            stream.close()
            if roll:
                system.move(temporary, f"{base}/{now[0]}.{now[1]}.{roll}.zip")
                firsts[now][1] = roll
            else:
                firsts[now] = [temporary, 0]

        for batch in batches:
            for name, part, line in zip(*(batch.column(j).to_pylist() for j in range(3))):
                raw = line.encode("utf-8", "replace") + b"\n"
                if (name, part) != now or size + len(raw) > part_bytes:
                    if now:
                        close()
                    roll = roll + 1 if (name, part) == now else 0
                    now, temporary, size, kept = (name, part), f"{base}/_{uuid.uuid4().hex}", 0, 0
                    stream = system.open_output_stream(temporary, compression=None)
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=LEVEL)
                    member = archive.open(name, "w", force_zip64=True)  # by name: a ZipInfo of its own would be stored as it is
                lines.append(raw)
                size, kept = size + len(raw), kept + len(raw)
                if kept >= WRITE_BYTES:
                    member.write(b"".join(lines))
                    lines.clear()
                    kept = 0
        if now:
            close()
        columns = zip(*((name, part, *last) for (name, part), last in firsts.items())) if firsts else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["name", "part", "temporary", "roll"])

    with freed(rows.sparkSession):
        made = spread.mapInArrow(run, "name string, part long, temporary string, roll long").collect()  # a row for each task of a batch
    system, base = base_of()
    heads: dict[str, str] = {}
    kept = {f"{r['name']}.{r['part']}.{i}.zip" for r in made for i in range(1, r["roll"] + 1)}
    for r in sorted(made, key=lambda r: (r["name"], r["part"])):
        if r["name"] in heads:
            kept.add(part := f"{r['name']}.{r['part']}.0.zip")
            system.move(r["temporary"], f"{base}/{part}")
        else:
            heads[r["name"]] = r["temporary"]
    for f in _parts_in(system, base) if heads else ():
        if f.base_name not in kept and re.sub(r"\.\d+\.\d+\.zip$", "", f.base_name) in heads:
            system.delete_file(f.path)
    for name, temporary in heads.items():
        system.move(temporary, f"{base}/{name}.zip")


def _parts_in(system, base: str) -> list:
    """The files of numbered parts in a folder."""
    from pyarrow import fs

    return [f for f in system.get_file_info(fs.FileSelector(base)) if f.is_file and re.search(r"\.\d+\.\d+\.zip$", f.base_name)]


def event_rows(lines: DataFrame) -> DataFrame:
    """Fields of event lines of 58 or 61 columns; others have layout_ok = false."""
    f = F.split("line", "\t")
    at = lambda i: F.coalesce(F.trim(F.get(f, F.lit(i))), F.lit(""))
    geo = F.when(F.size(f) >= 61, at(53)).otherwise(at(51))
    codes = {"actor1": at(7), "actor2": at(17), "event_code": at(26), "root_code": at(28), "geo": geo}
    rest = {"quad": at(29), "goldstein": at(30), "mentions": at(31), "sources": at(32), "articles": at(33), "tone": at(34)}
    ok = F.coalesce(F.size(f).isin(58, 61), F.lit(False))
    named = lines if {"kind", "file_ts"} <= {*lines.columns} else batch_key(lines)
    return named.select("kind", "file_ts", "line_no", at(0).alias("event_id"), ok.alias("layout_ok"), *(code(c).alias(k) for k, c in codes.items()), *(c.alias(k) for k, c in rest.items()))


def checked_events(lines: DataFrame, o: Options = Options()) -> DataFrame:
    """Event rows with their ``row_status``; a line of another layout, an archive that can't be read or one whose name gives no batch is a reject."""
    rows = with_event_status(event_rows(lines), o)
    named = F.col("kind").isNotNull() & F.col("file_ts").isNotNull()
    return rows.withColumn("row_status", F.when(~named, "reject_name").when(~F.col("layout_ok"), "reject_layout").otherwise(F.col("row_status")))


def typed_events(rows: DataFrame) -> DataFrame:
    """Checked rows with numbers as numbers, as the rollups take them."""
    return with_numbers(rows, {c: c for c in (*COUNTS, "quad")}, {c: c for c in SCORES}).withColumn("quad", F.col("quad").cast("int"))


def article_records(lines: DataFrame) -> DataFrame:
    """Logical article records: a short line continues the last field of the record before it while its page title is open.

    Lines of a file go to one task, as files are bounded in size; of longer tails than MOST_TAIL no more than that is kept. ``records_of`` moves no lines.
    """

    def run(batches):
        rows = (row for batch in batches for row in zip(*(batch.column(j).to_pylist() for j in range(2))))
        for path, some in itertools.groupby(rows, lambda r: r[0]):
            yield from _tables([path], _gathered(line for _, line in some), GATHERED)

    return _records(lines.repartition("path").sortWithinPartitions("path", "line_no").select("path", "line").mapInArrow(run, GATHERED))


def _records(gathered: DataFrame) -> DataFrame:
    """path, record, line, valid: what may follow its first line makes a record where the title is open."""
    parts = F.col("l")
    first, before = F.split(F.get(parts, F.lit(0)), "\t"), F.array_join(F.slice(parts, 1, F.greatest(F.size("l") - 1, F.lit(0))), "\n")
    extras = F.array_join(F.slice(F.split(before, "\t"), 27, 1 << 20), "\t")
    open_ = F.get(first, F.lit(0)).rlike(RECORD_ID + "$") & F.contains(extras, F.lit("<PAGE_LINKS>")) & ~F.contains(extras, F.lit("</PAGE_TITLE>"))
    valid = (F.col("record") > 0) & F.col("good") & ((F.size("l") == 1) | open_)
    return gathered.select("path", "record", F.array_join(parts, "\n").alias("line"), F.coalesce(valid, F.lit(False)).alias("valid"))


def checked_articles(records: DataFrame, o: Options = Options()) -> DataFrame:
    """Article fields with their ``row_status``; a record that isn't whole is a reject."""
    f = F.split("line", "\t")
    at = lambda i: F.coalesce(F.trim(F.get(f, F.lit(i))), F.lit(""))
    rows = batch_key(records).select("kind", "file_ts", "record", "valid", at(0).alias("record_id"), at(7).alias("themes"), at(9).alias("locations"), at(13).alias("organizations"), at(15).alias("tones"))
    rows = rows.withColumn("countries", location_countries("locations", (*o.excluded_geo, o.home_geo)))
    rows = rows.withColumns({"tone": F.coalesce(F.get(F.split("tones", ","), F.lit(0)), F.lit("")), "polarity": F.coalesce(F.get(F.split("tones", ","), F.lit(3)), F.lit(""))})
    status = F.when(F.col("kind").isNull() | F.col("file_ts").isNull(), "reject_name").when(~F.col("valid"), "reject_layout").otherwise(article_status(F.col("countries"), "tone", "polarity"))
    return rows.select("kind", "file_ts", "record", "record_id", "countries", F.split("themes", ";").alias("themes"), "organizations", "tone", "polarity", status.alias("row_status"))


def typed_articles(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"tone": score_value("tone"), "polarity": F.coalesce(score_value("polarity"), F.lit(0.0))})
