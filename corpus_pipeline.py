"""Corpus pipeline: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents. run() writes each stage's rows to the shared folder and reads them again for the next, so
a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import packing, quality, setsketch, suffix_dedup, surrogates
from heddle.llm._common import reachable, staged
from heddle.llm.queries import tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the per-host limit go from the others. Copies count once there: the next stage keeps one."""
    reachable(spark)
    return quality.apply_quality(docs, fold_copies=True)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity of 0.8 or more."""
    reachable(spark)
    return setsketch.drop_near_duplicates(docs, k=5, percent=80)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 that occur more than once are cut; documents of which nothing is left go."""
    reachable(spark)
    out = suffix_dedup.remove_repeats(docs).where("n_removed = 0 or length(trim(text)) > 0")
    cols = {"n_chars": F.length("text").cast("long").alias("n_chars")}
    return out.select(*[cols.get(c, F.col(c)) for c in docs.columns])


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by keyed surrogates."""
    reachable(spark)
    return surrogates.replace_entities(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into sequences of 1024 to 8192 tokens."""
    reachable(spark)
    return packing.best_fit_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: Sketches, suffix sorts, keyed draws and tokenizers have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; rows of the packing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
