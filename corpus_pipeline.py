"""From raw documents to packed training sequences, one operator a stage.

Every stage reads doc_id (integers, or null), text and, where there is one, n_chars; other
columns go through unread, whatever their names, except names that begin with two
underscores, which the operators use. Repeated rows fare alike and an empty table stays
empty; what a stage does with null and empty texts is said at it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aerolith.llm import common, decontaminate, near_dup, packing, pseudonyms, queries, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that compress better with the toxic dictionary go. Null and empty texts
    are scored like others and stay; without labels of both kinds every document stays."""
    return toxicity.reject(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id: five-word shingles,
    similarity of 0.8 or more. Texts without a word and rows without an id are like no
    other; rows of one id stay or go together."""
    return near_dup.keep_first(docs, k=5, least=(80, 100))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document of nothing else goes. Null and word-less
    texts stay; an empty benchmark changes nothing."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates, addresses and secrets become pseudonyms, keyed by the
    session's `spark.aerolith.pseudonym.secret`. Null and empty texts stay as they are."""
    return pseudonyms.replace(docs, pseudonyms.key_of(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, each with its sequence and place. A null or empty text is the end id
    alone; a null id stays null."""
    return packing.run(docs, queries.vocabulary("word_bpe_49k.json"), 1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("pseudonyms", pseudonymise),
    ("packing", pack),
]

#: Toxicity, near-duplicate sketches and packing are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = common.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
