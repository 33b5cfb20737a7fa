"""Corpus pipeline: each stage works on all rows that the one before it kept, written as Parquet in between.

Toxic documents go, repeated chunks of lines go from the texts, one document of each near-duplicate class stays, documents
that hold passages of the benchmark go, and what is left is encoded.
"""

from pyspark.sql import DataFrame, functions as F

from granulith.llm import line_chunks, prefix_viterbi, superminhash, toxicity, wu_manber
from granulith.llm.queries import TOKENIZER
from granulith.session import scratch_path

def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic. It learns from the labelled rows of its input."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the chunks of lines that stand earlier; n_chars follows the text."""
    return line_chunks.apply(docs).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(docs.columns)


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest id; of repeated rows of that id all."""
    gone = superminhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window."""
    return wu_manber.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of each document."""
    return prefix_viterbi.encode(docs, TOKENIZER, check=True)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("near duplicates", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("encoding", encode)]

#: Signatures, training and merges can't be said in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages from the table of documents on; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
