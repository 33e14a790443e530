"""Filing ground truth: reported facts, the latest filing of an issuer, cover fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldledger.functions.labels import archive_url, filing_id
from fieldledger.functions.text import blank_to_null, pad_cik
from fieldledger.schemas import FILING, struct_type

# Candidate concepts of each figure, best first. The concepts of ``total_debt``
# are added up instead.
FIGURES = {
    "revenue": [
        "Revenues",
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "RevenueFromContractWithCustomerIncludingAssessedTax",
        "SalesRevenueNet",
        "SalesRevenueGoodsNet",
    ],
    "cost_of_revenue": ["CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold"],
    "gross_profit": ["GrossProfit"],
    "operating_income": ["OperatingIncomeLoss", "IncomeLossFromContinuingOperations"],
    "net_income": ["NetIncomeLoss", "ProfitLoss", "NetIncomeLossAttributableToParent"],
    "eps_basic": ["EarningsPerShareBasic", "IncomeLossFromContinuingOperationsPerBasicShare"],
    "eps_diluted": [
        "EarningsPerShareDiluted",
        "IncomeLossFromContinuingOperationsPerDilutedShare",
    ],
    "cash_and_equivalents": [
        "CashAndCashEquivalentsAtCarryingValue",
        "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents",
        "CashCashEquivalentsAndShortTermInvestments",
    ],
    "total_assets": ["Assets"],
    "total_equity": [
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
        "StockholdersEquity",
    ],
    "total_debt": [
        "LongTermDebt",
        "LongTermDebtNoncurrent",
        "LongTermDebtCurrent",
        "LongTermBorrowings",
        "ShortTermBorrowings",
        "CommercialPaper",
        "DebtCurrent",
        "DebtLongtermAndShorttermCombinedAmount",
        "Deposits",
    ],
    "operating_cash_flow": [
        "NetCashProvidedByUsedInOperatingActivities",
        "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations",
    ],
}
ADDED_UP = ("total_debt",)
ANNUAL_FORM, ANNUAL_PERIOD = "10-K", "FY"

ENTRY = "struct<end:string,form:string,fp:string,val:string>"
FACTS_TYPE = f"struct<facts:map<string,map<string,struct<units:map<string,array<{ENTRY}>>>>>>"


def explode_facts(df: DataFrame, key: str, facts: str = "facts") -> DataFrame:
    """Nested company facts -> key, concept, unit_pos, entry_pos, end, form, fp, val.

    Each level is unfolded by its own generator, so nothing is gathered.
    """
    gaap = F.try_element_at(F.col(facts)["facts"], F.lit("us-gaap"))
    concepts = df.select(key, F.explode(gaap).alias("concept", "body"))
    units = concepts.select(
        key, "concept", F.posexplode(F.col("body.units")).alias("unit_pos", "unit", "entries")
    )
    return units.select(
        key, "concept", "unit_pos", F.posexplode("entries").alias("entry_pos", "e")
    ).select(key, "concept", "unit_pos", "entry_pos", "e.*")


def _figure_map() -> Column:
    pairs: list[Column] = []
    for name, concepts in FIGURES.items():
        for rank, concept in enumerate(concepts):
            entry = F.struct(F.lit(name).alias("figure"), F.lit(rank).alias("rank"))
            pairs += [F.lit(concept), entry]
    return F.create_map(*pairs)


def annual_values(facts: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """First usable annual value of each mapped concept: key, end, figure, rank, val.

    "First" is by unit, then by position in the file, or by ``order``. Filter, lookup and the
    aggregation all happen before any join, and combine map-side whatever the key sizes are.
    """
    place = F.struct("unit_pos", "entry_pos") if order is None else order
    mapped = (
        facts.where(F.col("form").startswith(ANNUAL_FORM) & (F.col("fp") == ANNUAL_PERIOD))
        .withColumn("val", F.col("val").try_cast("double"))
        .where(F.col("val").isNotNull())
        .withColumn("m", F.try_element_at(_figure_map(), F.col("concept")))
        .where(F.col("m").isNotNull())
    )
    return mapped.groupBy(
        key, "end", F.col("m.figure").alias("figure"), F.col("m.rank").alias("rank")
    ).agg(F.min_by("val", place).alias("val"))


def financials(values: DataFrame, periods: DataFrame, key: str) -> DataFrame:
    """One row per (key, fy_end) of ``periods`` with every figure; figures not found are null.

    The best-ranked concept wins, debt adds up all of its concepts in rank order.
    """
    wanted = periods.select(key, "fy_end").distinct()
    hits = wanted.join(
        values, (wanted[key] == values[key]) & (wanted["fy_end"] == values["end"]), "left"
    ).select(wanted[key], "fy_end", "figure", "rank", "val")
    columns = []
    for name in FIGURES:
        mine = F.col("figure") == name
        if name in ADDED_UP:
            found = F.array_sort(F.collect_set(F.when(mine, F.struct("rank", "val"))))
            total = F.aggregate(found, F.lit(0.0), lambda acc, x: acc + x["val"])
            columns.append(F.when(F.size(found) > 0, total).alias(name))
        else:
            best = F.min_by(F.when(mine, F.col("val")), F.when(mine, F.col("rank")))
            columns.append(best.alias(name))
    return (
        hits.groupBy(key, "fy_end")
        .agg(*columns)
        .withColumn("currency", F.lit("USD"))
        .withColumn("fiscal_year", F.substring("fy_end", 1, 4).cast("int"))
    )


# --- feeds --------------------------------------------------------------------------------------


def ticker_index(entries: DataFrame) -> DataFrame:
    """ticker, cik_str -> upper-case ticker and ten-digit key."""
    return entries.select(
        F.upper("ticker").alias("ticker"), pad_cik(F.col("cik_str").cast("string")).alias("cik10")
    )


def resolve_tickers(requested: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ticker, cik10) for the known tickers, and the unknown ones."""
    wanted = requested.select(F.upper("ticker").alias("ticker"))
    return wanted.join(index, "ticker"), wanted.join(index, "ticker", "left_anti")


def explode_submissions(feed: DataFrame, key: str = "cik10") -> DataFrame:
    """Parallel arrays of recent filings -> one row per filing, with its position in the feed."""
    recent = "filings.recent."
    names = {
        "form": "form",
        "accession": "accessionNumber",
        "filing_date": "filingDate",
        "reporting_period_end": "reportDate",
        "primary_doc": "primaryDocument",
    }
    zipped = F.arrays_zip(*[F.col(recent + src).alias(dst) for dst, src in names.items()])
    return feed.select(
        key,
        F.coalesce("name", F.lit("")).alias("company_name"),
        F.get("exchanges", F.lit(0)).alias("exchange"),
        blank_to_null(F.col("stateOfIncorporation")).alias("state_of_incorporation"),
        blank_to_null(F.col("stateOfIncorporationDescription")).alias(
            "state_of_incorporation_desc"
        ),
        F.posexplode(zipped).alias("pos", "filing"),
    ).select("*", "filing.*").drop("filing")


def latest_annual(filings: DataFrame, key: str, place: Column | None = None) -> DataFrame:
    """The first exact 10-K of each issuer in feed order; amended forms do not count."""
    rest = [c for c in filings.columns if c not in (key, "pos")]
    best = F.min_by(F.struct(*rest), F.col("pos") if place is None else place)
    return (
        filings.where(F.col("form") == ANNUAL_FORM)
        .groupBy(key)
        .agg(best.alias("best"))
        .select(key, "best.*")
    )


def sidecar(latest: DataFrame, texts: DataFrame) -> DataFrame:
    """Descriptive record kept beside each filing text.

    ``latest``: ticker and the columns of ``latest_annual``; ``texts``: cik10, text,
    has_companyfacts.
    """
    # Lengths first, so that the join moves no text.
    lengths = texts.select("cik10", F.length("text").alias("text_bytes"), "has_companyfacts")
    return latest.join(lengths, "cik10").select(
        F.upper("ticker").alias("ticker"),
        "cik10",
        "company_name",
        "form",
        "accession",
        "filing_date",
        "reporting_period_end",
        "primary_doc",
        archive_url(F.col("cik10"), F.col("accession"), F.col("primary_doc")).alias("source_url"),
        "text_bytes",
        "has_companyfacts",
        "exchange",
        "state_of_incorporation",
        "state_of_incorporation_desc",
    )


def filing_truth(
    texts: DataFrame, sidecars: DataFrame, figures: DataFrame, key: str = "stem"
) -> DataFrame:
    """id, source, text, ground_truth. Texts without a sidecar are left out.

    ``figures`` has one row per ``key`` and ``fy_end``; those of the sidecar's period are taken.
    """
    types = struct_type(FILING, raw=True)
    of_period = figures.withColumnsRenamed({"currency": "fin_currency", "fy_end": "reporting_period_end"})
    # The narrow tables first; the texts join them once.
    joined = texts.join(sidecars.join(of_period, [key, "reporting_period_end"], "left"), key)

    def group(name: str, values: dict[str, Column]) -> Column:
        fields = types[name].dataType.fields
        return F.struct(
            *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
        )

    period = F.col("reporting_period_end")
    cover = group(
        "cover",
        {
            "company_name": F.col("company_name"),
            "cik": F.col("cik10"),
            "ticker": F.col("ticker"),
            "exchange": blank_to_null(F.col("exchange")),
            "form_type": F.col("form"),
            "fiscal_year_end": period,
            "filing_date": F.col("filing_date"),
            "state_of_incorporation": F.coalesce(
                blank_to_null(F.col("state_of_incorporation")),
                blank_to_null(F.col("state_of_incorporation_desc")),
            ),
        },
    )
    money = group(
        "financials",
        {
            "currency": F.lit("USD"),
            "fiscal_year": F.substring(period, 1, 4).cast("int"),
            **{name: F.col(name) for name in FIGURES},
        },
    )
    return joined.select(
        filing_id(F.col("ticker"), period).alias("id"),
        F.lit("sec_edgar").alias("source"),
        "text",
        F.struct(
            cover.alias("cover"),
            money.alias("financials"),
            F.array().cast(types["top_risk_factors"].dataType).alias("top_risk_factors"),
        ).alias("ground_truth"),
    )
