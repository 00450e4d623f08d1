"""A training-data pipeline over ``documents``: language ID, line dedup, near
duplicates, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read back as the next stage's ``docs``. All stages but
the last return the columns they were given. Nulls, empty texts, repeated
rows and empty tables are judged as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from captionmill.llm import chunks, decontaminate, langid, linededup, neardup
from captionmill.llm.common import stored, table
from captionmill.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (nulls and empty texts too) or without a clear
    language go. Repeated rows are judged alike; an empty table stays empty."""
    return langid.keep_known(docs, langid.train(langid.training_rows(docs)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier one go; a document goes when no word is left. Null and
    empty texts and rows without a doc_id stay as they are; repeated rows come
    out alike; texts that share a doc_id are documents of their own."""
    return linededup.without_repeated_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id, stays;
    of rows alike in id and text one. Texts without a word and rows without a
    doc_id all stay."""
    return neardup.without_near_duplicates(docs, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, each row judged by its
    text. Null and empty texts stay; an empty benchmark drops nothing."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids and the digests of ids and decoded text of every
    row; null and empty texts have no ids."""
    done = chunks.encode_documents(docs, tokenizer_path(), outputs=("ids_le",))
    return done.select("doc_id", "n_tokens", "ids_le", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("lines", lines), ("near", near), ("benchmark", benchmark), ("encode", encode)]

#: SQL has no byte-pair encoding; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
