"""A corpus pipeline over the llm operators: each stage reads all that its predecessor kept.

Run with ``run(spark, sf_dir)`` or stage by stage from ``STAGES``. All stages but the last return the columns of
documents; the last adds what the mix decided.

In every stage null and empty texts stay as they are, texts of any length are read whole, an empty table gives an empty
one, and columns of any name pass through. What rows that share an id or are equal come to is said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.llm._shared import forget, written
from filmloom.llm.decontamination import decontaminate
from filmloom.llm.line_dedup import without_repeated_runs
from filmloom.llm.mixing import mixed, training_order
from filmloom.llm.ngram_join import jaccard_components
from filmloom.llm.toxicity import learn, with_scores

REJECT, MIN_WORDS, SHINGLE, PERCENT, WINDOW = 0.7, 50, 5, 80, 10
#: Most bytes of texts sent to a Python worker at once: buffers on both sides are a few times as large, for every task.
BATCH_BYTES = 4 << 20


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below REJECT.

    The score is that of a row's text, so equal texts stay or go together; a null text is scored as an empty one. Without
    labels of both kinds all stay.
    """
    scorer = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clash = "toxicity_score" + "_" * max(len(c) for c in docs.columns)
    return with_scores(docs, scorer, out_col=clash).where(F.col(clash) < REJECT).drop(clash)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs of MIN_WORDS words or more; n_chars follows the text.

    The copy of the smallest id stays, null last. Equal rows are one document and have one result; rows that share an id
    but not the text are documents of their own. A document with nothing left goes; one that had no words before stays.
    """
    out = without_repeated_runs(docs, MIN_WORDS)
    return _counted(out, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Documents without an id or without words stay. Rows that share an id stay or go together.
    """
    later = jaccard_components(docs, SHINGLE, PERCENT).where(F.col("_id") > F.col("component_id")).select(F.col("_id").alias("doc_id")).distinct()
    return docs.join(later, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without spans of benchmark items; those that are mostly benchmark go. Each row is judged for itself; without items all stay as they are."""
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), WINDOW)
    return _counted(out, docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy of every document with its due time in the mix, in training order; documents that are not taken come last, once.

    Equal rows count one by one; a null source is a source; texts without words are not taken. Columns of documents that
    are named like the new ones are replaced.
    """
    new = {"mix_size": "size", "mix_source_size": "source_size", "mix_target": "target", "mix_copies": "copies", "mix_taken": "taken", "mix_position": "position"}
    m = training_order(mixed(docs.drop(*new)), each_copy=True)
    return m.select("_key.*", *[F.col(x).alias(name) for name, x in new.items()])


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("mixing", mixing),
]

#: Learned scores and repeated line runs have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force,
#: the first against its scorer applied row by row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, str(BATCH_BYTES))
    try:
        for k, (name, stage) in enumerate(STAGES[:-1]):
            last, docs = docs, written(stage(spark, docs, sf_dir), name)
            if k:
                forget(last)
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    return STAGES[-1][1](spark, docs, sf_dir)
