"""A corpus in five stages: toxic documents go, exact copies go, near copies go, repeated passages go, the rest is packed.

Every stage takes the columns of documents (doc_id, text) and further ones of any name, which the first four return as they
are; an empty table gives no rows in each. Null texts count as empty ones; rows that repeat an id are treated as each docstring says.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import exact, nearcopies, packing, substring, toxicity
from pulsegrid.llm.common import hidden, prepare, read, shared_dir
from pulsegrid.llm.queries import WORDS, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator accepts. Rows are scored one by one, by their text alone: null and wordless texts
    score as clean ones, repeated rows alike. Where no row has a label, none is rejected."""
    prepare(spark)
    model = toxicity_model(spark, docs, sf_dir)
    return toxicity.score(docs, model, [F.col(c) for c in docs.columns]).where("predicted = 0").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for A-Z in capitals), the row with the largest id; null and empty texts are equal, null ids come last,
    and of rows that repeat id and text one stays."""
    prepare(spark)
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id. Rows that share an id are one document and stay or go
    together, rows without an id stay; texts without words are alike only if they are equal."""
    prepare(spark)
    return nearcopies.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document has; those of which nothing is left go. Null and empty texts stay,
    null ids come before all others, rows that repeat id and text are cut alike. n_chars is set to the new length."""
    prepare(spark)
    removed = hidden(docs, "removed")
    out = substring.substring_dedup(docs).where((F.size(removed) == 0) | (F.length("text") > 0))
    return out.select(*docs.columns).withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens; null and empty texts are their end id, repeated rows are packed each."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path(WORDS))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("substring_dedup", cut_repeats), ("packing", pack)]

#: Learnt scores and content-defined chunks are beyond SQL. A test holds each stage, on the real output of the one before,
#: against a plain version: toxicity given the model's scores, near copies by all pairs, packing by the tokenizers library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
