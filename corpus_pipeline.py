"""A training corpus from ``documents``: quality, near duplicates, mixture, packing.

Each stage works on all rows that the one before kept, and its result is stored before the next begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.llm import mixing, ngram_join, packing, quality
from lexlake.llm.common import materialize, table
from lexlake.llm.queries import vocabulary

#: Target shares of tokens; the clean domain keeps its natural total, so that its documents stay.
WEIGHTS = {"clean": 0.98, "toxic": 0.02}
#: How often a row may stand in the mixture. Near duplicates have just been taken out, so nothing is repeated: what is over its target is thinned, and a target that
#: there is too little text for stays unmet.
MOST_COPIES = 1.0


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted rates keep, none more often than MOST_COPIES."""
    toxic = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").alias("domain"))
    return mixing.resampled(docs, toxic, WEIGHTS, budget="largest", most_rate=MOST_COPIES)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Compression, hashing and tokenizers are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(spark, docs, f"stage-{name}")
    return docs
