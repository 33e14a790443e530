"""Training-data pipeline: from the documents to sharded, mixed, clean and distinct ones.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again
before the next stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm import dart_minhash, mixing, sharding, spaced_seeds, toxicity
from fieldledger.llm.common import label_fold, stored, table

SHARDS = 40
#: Shares of the tokens that are kept, by language, and the share of all tokens to keep at most. Less
#: is kept where the scarcest language has too little, so that no document is repeated and the shares hold.
TARGETS = {"en": 0.56, "de": 0.165, "fr": 0.165, "es": 0.11}
BUDGET = 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; labels of fold 0 are never read."""
    labels = table(spark, sf_dir, "labels")
    patterns, _, classifier = toxicity.fit(docs, labels, label_fold(F.col("doc_id")) != 0)
    scored = docs.withColumn("__score", toxicity.score_column(docs, patterns, classifier))
    return scored.filter("__score < 0.5").drop("__score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near copies."""
    return dart_minhash.keep_one_per_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return spaced_seeds.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens by language match the targets."""
    labelled = mixing.choose_labelled(docs, table(spark, sf_dir, "labels"), F.col("lang"))
    mixture, _ = mixing.fit_mixture(docs, labelled, TARGETS, BUDGET, max_rate=1.0)
    return mixing.sampled(docs, mixture)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard."""
    return sharding.with_shards(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_languages),
    ("sharding", assign_shards),
]

#: The learned stages have no SQL form; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
