"""Files as documents, filing bundles, and staged feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldledger.functions.text import pad_cik
from fieldledger.operators.filings import FACTS_TYPE

SIDECAR_TYPE = (
    "ticker string, cik10 string, company_name string, form string, accession string, "
    "filing_date string, reporting_period_end string, primary_doc string, source_url string, "
    "text_bytes bigint, has_companyfacts boolean, exchange string, "
    "state_of_incorporation string, state_of_incorporation_desc string"
)
SUBMISSIONS_TYPE = (
    "cik10 string, name string, exchanges array<string>, stateOfIncorporation string, "
    "stateOfIncorporationDescription string, filings struct<recent: struct<"
    "form:array<string>, accessionNumber:array<string>, filingDate:array<string>, "
    "reportDate:array<string>, primaryDocument:array<string>>>"
)
_SUFFIX = r"(_10k)(\.txt|\.meta\.json|\.facts\.json)$"


def read_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, filename, length, content. Metadata filters leave the content unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "content"
    )


def _stem() -> Column:
    return F.regexp_replace(F.col("_metadata.file_name"), _SUFFIX, "$1").alias("stem")


def read_bundles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, sidecars, facts) of a folder of filings, each keyed by ``stem``."""

    def pick(glob: str):
        return spark.read.option("pathGlobFilter", glob)

    texts = pick("*_10k.txt").text(path, wholetext=True).select(_stem(), F.col("value").alias("text"))
    sidecars = pick("*_10k.meta.json").schema(SIDECAR_TYPE).json(path, multiLine=True)
    facts = pick("*_10k.facts.json").text(path, wholetext=True)
    parsed = facts.select(
        _stem(), F.from_json("value", FACTS_TYPE, {"mode": "PERMISSIVE"}).alias("facts")
    )
    return texts, sidecars.select(_stem(), "*"), parsed


def read_ticker_file(spark: SparkSession, path: str) -> DataFrame:
    """Staged ticker list (an object of rows) -> ticker, cik10."""
    rows = spark.read.text(path, wholetext=True).select(
        F.explode(
            F.map_values(F.from_json("value", "map<string, struct<ticker:string,cik_str:string>>"))
        ).alias("r")
    )
    return rows.select(F.upper("r.ticker").alias("ticker"), pad_cik(F.col("r.cik_str")).alias("cik10"))


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Staged issuer feeds, one file per issuer."""
    feed = spark.read.schema(SUBMISSIONS_TYPE).json(path, multiLine=True)
    from_name = F.regexp_extract(F.col("_metadata.file_name"), r"CIK([0-9]+)", 1)
    return feed.withColumn("cik10", pad_cik(F.coalesce("cik10", from_name)))
