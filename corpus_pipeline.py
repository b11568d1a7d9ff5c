"""From raw documents to packed training sequences, in five stages.

Each stage takes all its predecessor kept, written as Parquet and read again.
Stages need doc_id to name a document. All but the last return the columns of
`documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workmill.llm import best_fit_packing, fm_decontamination, language_backoff, ngram_jaccard, sketch_dedup
from workmill.llm.queries import tokenizer_path
from workmill.session import configure, cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(df: DataFrame) -> DataFrame:
    """The kept text in the place of the text."""
    return df.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and those of no language with half the score."""
    model = language_backoff.fit(docs.where(~language_backoff.held_out(F.col("doc_id"))))
    found = language_backoff.identify(docs, model)
    return found.where("lang_pred != 'und' AND score >= 0.5").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies.

    Five-word shingles, Jaccard 0.8. Rows that repeat id and text are one; of
    rows that repeat an id with other texts each is judged by its own. Rows
    without an id and rows without a word stay, all of them.
    """
    groups = cut(ngram_jaccard.near_duplicates(docs, width=5, percent=80, text_hash=True))
    row = ["doc_id", "text_hash"]
    losers = groups.where("component_id < doc_id").select(*row).distinct()
    repeated = cut(groups.where("doc_id IS NOT NULL").groupBy(*row).count().where("count > 1").select(*row))
    left = docs.withColumn("text_hash", F.xxhash64("text")).join(losers, row, "left_anti")
    if not repeated.isEmpty():
        once = left.join(repeated, row, "left_semi").dropDuplicates(["doc_id", "text"])
        left = left.join(repeated, row, "left_anti").unionByName(once)
    return left.select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out passages of 13 words or more that an earlier document has."""
    found = sketch_dedup.remove_repeats(docs, width=13)
    return _with_text(found.where("n_removed = 0 OR n_removed < n_words"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out benchmark passages; documents of nothing else go."""
    found = fm_decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)
    return _with_text(found.where("n_hit = 0 OR n_hit < n_words"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens."""
    return best_fit_packing.pack(docs, tokenizer_path(), capacity=1024, end=2)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Tokens and language models are beyond SQL; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
