"""A pipeline over documents: filter, dedup lines, drop near copies, mix, tokenize.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the shared folder and
reads it again for the next. All but the last return the columns of documents. A null or empty text passes every
stage by the rules of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.bpe import encoded
from sylva.llm.classifier import fit, kept
from sylva.llm.common import documents, give_back, written
from sylva.llm.line_dedup import deduped
from sylva.llm.mixing import mixed_documents
from sylva.llm.ngram_join import one_of_each


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go, equal ones alike; a null text is judged as an empty one."""
    return kept(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; so do documents of which no word is left. n_chars follows the text.

    A null text stays, equal rows lose the same lines, and columns of any names are carried along.
    """
    out = deduped(docs, "_sylva_counts")
    touched = F.col("_sylva_counts.n_removed_lines") > 0
    out = out.where(~touched | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(touched, length).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays. Five words and 80 %, as stages on word shingles have it.

    Of equal rows one stays. A null text, or one without words, is a copy of nothing and stays.
    """
    return one_of_each(docs, n=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass of the mix over a document; equal rows are taken alike.

    A document without a word, or with a null text, isn't in the mix; null sources are a source of their own.
    """
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids (the tokens of the whole text) and n_tokens, for every row; a null text has no tokens."""
    import public_tokenizers

    give_back(spark)  # the stage's memory is that of Python, and the stages before have filled the executors' heaps
    ids = encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("doc_id", "source"))
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_join", near_duplicates),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: The classifier and the tokenizer aren't SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
