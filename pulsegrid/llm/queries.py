"""The registered queries of this folder: each operator over its whole table, as columns that can be compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, conversations, fingerprints, idfiles, langid, line_dedup, near_dup, packing, quality, secrets, toxicity, warc
from .common import id_residue


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels")
    lexicon = toxicity.fit(docs, labels.filter(id_residue(3) != 1))
    out = toxicity.scores(docs, lexicon)
    return out.select("doc_id", F.coalesce(id_residue(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), with_ids=False)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(_table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf_dir, "pages")).drop("html")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs.filter(id_residue(5) != 0)))
    return out.select("doc_id", F.coalesce(id_residue(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.write_and_read(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")).drop("ids")


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` rows after the damage that a hash of conv_id and turn tells; nulls are one space."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    rows = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(F.concat(conv, F.lit(":"), turn)) % 20).alias("_hit"))
    text = F.when(F.col("_hit") == 1, F.lit("")).when(F.col("_hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_hit") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("_hit <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversations.report(damaged(rows), rows)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.align(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), digest=True)
    return out.withColumnRenamed("groups", "groups_sha256")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_rules, op2_toxicity, op3_packing, op4_fingerprints, op5_near_duplicates, op6_warc, op7_secret_scan, op8_language_id, op9_bpe, op10_id_files, op11_conversation_repair, op12_alignment, op13_line_dedup, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL, where SQL can express the operator."""
    return {"op6_warc": WARC_SQL, "op13_line_dedup": LINES_SQL}


WARC_SQL = r"""
with p as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as payload_bytes,
         sha256(coalesce(html, '')) as payload_digest
  from pages),
f as (select payload_digest, min(page_id) as first_id from p where payload_bytes >= 100 group by 1)
select p.page_id, cast(p.payload_bytes as bigint) as payload_bytes, p.payload_digest,
       case when f.first_id is not null and (p.page_id > f.first_id or p.page_id is null) then 'revisit' else 'response' end as record_type,
       case when f.first_id is not null and (p.page_id > f.first_id or p.page_id is null) then f.first_id end as refers_to
from p left join f on p.payload_digest = f.payload_digest and p.payload_bytes >= 100
"""

LINES_SQL = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from l),
f as (select key, min(doc_id) as first_id from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
d as (select k.*, f.key is not null and k.doc_id > f.first_id as gone from k left join f on k.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from d group by doc_id
"""
