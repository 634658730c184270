"""The ten queries of this subpackage, each over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, decontaminate, line_dedup, line_frequency, near_dup, packing, pseudonyms, sstable, toxicity, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.learned(documents, _table(spark, sf_dir, "labels")))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(_table(spark, sf_dir, "documents"), pseudonyms.key_of(spark))


def op4_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(_table(spark, sf_dir, "pages"), common.new_path(spark, "warc")))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.clustered(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.run(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op8_sorted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 0, common.new_path(spark, "sst"))
    return sstable.read(manifest)


def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.judge(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup(_table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontaminate, op2_toxicity, op3_pseudonyms, op4_warc_segments, op5_near_duplicates, op6_packing, op7_url_filter, op8_sorted_tables, op9_line_frequency, op10_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.ORACLE_SQL, "op4_warc_segments": warc.ORACLE_SQL, "op5_near_duplicates": near_dup.ORACLE_SQL, "op7_url_filter": url_filter.ORACLE_SQL, "op9_line_frequency": line_frequency.ORACLE_SQL, "op10_line_dedup": line_dedup.ORACLE_SQL}
