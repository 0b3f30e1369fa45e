"""From raw documents to packed training sequences.

STAGES lists the stages in order: each takes (spark, docs, sf_dir), with docs what its predecessor kept, and returns
a DataFrame, which run() writes as Parquet to the shared folder and reads again for the next. All but the last return
the columns of documents.

1. toxicity: an ordinal model fitted to the labels of documents scores every text; toxic documents go.
2. near_duplicates: of the documents that 5-word shingles at a similarity of 0.8 or more connect, the one with the
   smallest id stays. Rows that share an id don't count against one another, and of several texts under one id each is
   judged for itself; rows without an id stay.
3. decontamination: documents in which a window of a benchmark item occurs go.
4. pii: personal data in the texts is masked, and n_chars counted anew.
5. packing: the texts become token sequences of at most 4096; one row for each piece.

A null text stays through the first four stages and is packed as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, near_duplicates, packing, pii, toxicity
from marginalia.llm.shared import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(source, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

# The model's decisions, components of any length and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        after = scratch.write(stage(spark, docs, sf_dir), f"stage-{name}")
        scratch.drop(docs)  # what its successor has read
        docs = after
    return docs
