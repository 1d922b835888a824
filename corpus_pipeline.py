"""Documents to token ids in five stages: quality, near duplicates, repeated passages, benchmark leaks, BPE.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over all rows that its predecessor kept, written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setwright.llm.bpe import bpe_ids
from setwright.llm.jaccard import one_of_each
from setwright.llm.quality import accepted
from setwright.llm.queries import table, tokenizer_file
from setwright.llm.spans import dedup_spans
from setwright.llm.wumanber import decontaminated
from setwright.session import staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more."""
    return one_of_each(docs.select(*COLUMNS), width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentence runs that occur earlier; a document left without a word goes."""
    out = dedup_spans(docs.select(*COLUMNS), keep=("lang", "source"))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.filter(~emptied).select("doc_id", "text", "lang", "source", F.char_length("text").cast("bigint").alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every text."""
    return bpe_ids(docs.select(*COLUMNS), tokenizer_file())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("token_ids", token_ids),
]

#: The classifier is no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
