"""A corpus pipeline of five stages: each calls one operator of ``cellwise.llm``.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame that is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``:

1. language_id: rows whose language can't be told (no letter) go;
2. exact_dedup: of equal texts the row with the least ``doc_id`` stays;
3. simhash_near_dedup: one row of each class of near copies stays;
4. benchmark_decontamination: rows into which a benchmark item leaks go;
5. sentencepiece: ``doc_id, lang, source, n_tokens, ids, round_trip`` of what is left.

Clean rows pass every stage. Null or empty texts have no letter and go in the first
stage. An empty table gives an empty result. Columns of ``docs`` beyond those of
``documents`` pass the filtering stages unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.llm import decontam, exact_dedup, langid, sentencepiece, simhash
from cellwise.llm.common import discard, materialize, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = sentencepiece.encode(docs, sentencepiece.Model.load(), keep=("doc_id", "lang", "source"))
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_leaks),
    ("sentencepiece", token_ids),
]

#: Hashing, classifier and automaton have no SQL counterpart; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        made = materialize(stage(spark, docs, sf_dir), name)
        if i:
            discard(docs)
        docs = made
    return docs
