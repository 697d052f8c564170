"""Corpus pipeline over documents: toxicity, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes what its predecessor kept. A document leaves if its toxicity score reaches the threshold, if
a near-duplicate (five-word shingles, similarity 0.8 or more) has a smaller id, or if it holds ten consecutive
words of a benchmark item; personal data in the rest is replaced by its kind in brackets; at last texts become
token ids. All stages but the last return the columns of documents. As an application of its own the pipeline sets its session's Arrow batches
to BATCH_ROWS rows, so that a batch of texts stays small beside the sorts and joins of the stages before. Null texts stay null up to the last stage,
which gives them no tokens; null ids stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caselight.llm import bpe, decontaminate, near_dup, pii, toxicity
from caselight.llm.shared import Scratch


#: Rows in an Arrow batch of the stages that run Python over whole texts.
BATCH_ROWS = 500


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (9): the documents whose score is below the threshold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (10): one document of each group stays."""
    return near_dup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (8): the documents without item windows."""
    _small_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data (1): spans replaced by their kinds."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE (4): doc_id, n_tokens, ids and the text that they decode to."""
    _small_batches(spark)
    return bpe.encode(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("benchmark", drop_benchmark), ("personal_data", redact), ("tokens", tokens)]

#: The stages' models, sketches and merges are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; what each returns is written, as Parquet in the shared folder, and read again."""
    with Scratch(spark) as scratch:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for _, stage in STAGES[:-1]:
            docs = scratch.write(stage(spark, docs, sf_dir))
            scratch.keep_only(docs)
        return STAGES[-1][1](spark, docs, sf_dir)
