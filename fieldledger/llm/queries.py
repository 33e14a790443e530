"""The operators' queries and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm import (
    dart_minhash,
    exact_dedup,
    feistel,
    licences,
    mixing,
    oracles,
    periodic_runs,
    sharding,
    simhash_index,
    spaced_seeds,
    toxicity,
    url_filter,
    vector_codes,
    warc,
)
from fieldledger.llm.common import label_fold, table

SHARDS = 40
#: Key of the pseudonyms; a run that must keep them secret passes its own to the operator.
PSEUDONYM_KEY = "public example key"
#: Target shares of the tokens by language.
MIX_TARGETS = {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14}
#: The rules of the URL filter.
URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.build_derivatives(warc.page_responses(table(spark, sf_dir, "pages")))
    return records.withColumnRenamed("doc_id", "page_id")


def op4_spaced_seed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    patterns, _, classifier = toxicity.fit(docs, labels, label_fold(F.col("doc_id")) != 0)
    score = toxicity.score_column(docs, patterns, classifier)
    return docs.select(
        "doc_id", F.coalesce(label_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), score.alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = mixing.choose_labelled(docs, table(spark, sf_dir, "labels"), F.col("lang"))
    mixture, members = mixing.fit_mixture(docs, labelled, MIX_TARGETS)
    rate = mixture.rate(F.col("p"))
    return members.select(
        "doc_id",
        "tokens",
        *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(mixture.model.domains)),
        rate.alias("rate"),
        (rate * F.col("tokens")).alias("expected_tokens"),
        mixing.copies_column(rate, F.col("chance")).alias("copies"),
    )


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = feistel.pseudonymise(docs, PSEUDONYM_KEY)
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind))
    return out.select(
        "doc_id", "text", F.size("found").alias("replaced"), *(count(k).alias(f"{k}_items") for k in feistel.LAYOUTS)
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.default_labelled(spark))
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, model)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.repeat_tail(table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_digest(codebooks)).alias("codebooks_sha256")
    )


def op13_simhash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_index.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licence_scan": op1_licence_scan,
    "op2_rendezvous_shards": op2_rendezvous_shards,
    "op3_warc_derivatives": op3_warc_derivatives,
    "op4_spaced_seed_overlaps": op4_spaced_seed_overlaps,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_dart_minhash": op6_dart_minhash,
    "op7_toxicity": op7_toxicity,
    "op8_soft_mixing": op8_soft_mixing,
    "op9_feistel_pseudonyms": op9_feistel_pseudonyms,
    "op10_url_filter": op10_url_filter,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_vector_codes": op12_vector_codes,
    "op13_simhash_index": op13_simhash_index,
}

ORACLES: dict[str, str] = dict(oracles.STATEMENTS)
