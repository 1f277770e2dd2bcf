"""A corpus pipeline over `documents`: quality rules, languages, near-duplicates, benchmark passages, token ids.

Each stage takes all rows its predecessor kept. The first removes failing lines and rejects documents, the second
rejects documents without a clear language, the third keeps one document of every group of near copies, the
fourth cuts benchmark passages out and rejects documents that are mostly such passages, the last encodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import bpe, decontaminate, langid, minhash, quality
from tabulon.llm.text import held_out
from tabulon.plans.stage import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SHARE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: kept documents without their failing lines; n_chars follows a changed text."""
    found = quality.assess(docs.select(*COLUMNS)).where("quality.kept")
    changed = F.col("quality.n_lines_removed") > 0
    return found.select(
        "doc_id",
        F.when(changed, F.col("quality.clean_text")).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(changed, F.length("quality.clean_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents of which one learned language has at least LEAST_SHARE."""
    model = langid.train(docs.where(~held_out("doc_id", 4, 2)))
    found = langid.predict(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of every group of near copies one row, that with the least id; one of a repeated row; documents without
    words stay."""
    return minhash.representatives(docs.select(*COLUMNS), similarity=0.85)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: without benchmark passages; mostly such passages goes. n_chars follows a changed text."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    before = docs.select(*COLUMNS, F.length("text").alias("had"))
    clean = decontaminate.decontaminate(before, items, window=10, max_coverage=0.5)
    now = F.length("text")
    return clean.select(
        "doc_id", "text", "lang", "source", F.when(now != F.col("had"), now.cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    )


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token ids, their number, and digests of the ids and of the text that they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark passages", benchmark_stage),
    ("token ids", encode_stage),
]

#: SQL can't express the stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs)
    return docs
