"""Documents to a training mix: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import decontam, lines, minhash, mixing, toxicity
from chronolith.llm.common import free_name, stage


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network finds toxic go; it learns from the labelled documents not held out.

    Null, empty and wordless texts stay, also without any label; long texts are read window by window; repeated
    rows are judged alike; an empty table stays empty; other columns, whatever their names, pass.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, ~toxicity.held_out(F.col("doc_id"), 5, 0))
    return toxicity.reject(docs, model)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines spread over many sources are taken out of all texts that have other lines; every document stays.

    Null and empty texts stay as they are, as do blank lines; a null source is no source; repeated rows are
    treated alike; an empty table stays empty; other columns pass, and ``n_chars``, where it is there, follows
    the text. Columns named as the operator's counts keep the values that they had.
    """
    kept = [c for c in lines.OUTPUT if c in docs.columns]
    hidden = {c: free_name(docs, f"_own_{c}") for c in kept}
    cleaned = lines.clean(docs.withColumnsRenamed(hidden))
    if "n_chars" in docs.columns:
        size = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", size)
    return cleaned.select(*(F.col(hidden.get(c, c)).alias(c) for c in docs.columns))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id.

    Null and blank texts and rows without id are no one's duplicates and stay; rows that repeat the kept id stay
    with it; an empty table stays empty; other columns, whatever their names, pass.
    """
    return minhash.deduplicate(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; rows that share an id are judged together, rows without id too; an
    empty table or benchmark removes nothing; other columns, whatever their names, pass.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the copies to take of each and their words.

    A null or empty text has no words, its copies none either; a null source is one of its own; identical rows are
    drawn together, ties thus too; an empty table stays empty; other columns pass but for those named as outputs.
    """
    return mixing.mix(docs).where("copies > 0")


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", remove_lines),
    ("MinHash near-dedup", remove_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("mixing", mix_sources),
]

#: The first stage is a trained network, which SQL cannot express; tests compare line dedup, near-dedup and
#: decontamination with brute force, toxicity with planted documents, mixing with its targets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
