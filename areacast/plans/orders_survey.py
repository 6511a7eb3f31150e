"""Order tables read as a survey.

A respondent is an order, its area the customer's nation, the division the region.
The outcome is 1 for a filled and 0 for an open order; a partly filled one is a
missing answer.  The area covariate is the mean balance of the nation's suppliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areacast.functions.recode import recode
from areacast.operators.filters import complete_cases
from areacast.operators.frames import psframe
from areacast.operators.joins import area_join, lookup_join
from areacast.sources.shared import settle
from areacast.sources.tables import read_table

OUTCOME_CODES = {"F": 1.0, "O": 0.0}
PREDICTORS = ("priority", "segment")


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder.rstrip('/')}/{name}.parquet")


def covariate(spark: SparkSession, folder: str) -> DataFrame:
    """Mean supplier balance by nation key."""
    suppliers = source(spark, folder, "supplier")
    return suppliers.groupBy(F.col("s_nationkey").alias("nationkey")).agg(
        F.avg("s_acctbal").alias("covariate")
    )


def areas(spark: SparkSession, folder: str, with_covariate: bool = False) -> DataFrame:
    """One row per nation: key, name, division and optionally the covariate."""
    nation = source(spark, folder, "nation").select(
        F.col("n_nationkey").alias("nationkey"),
        F.col("n_name").alias("abb"),
        F.col("n_regionkey").alias("regionkey"),
    )
    region = source(spark, folder, "region").select(
        F.col("r_regionkey").alias("regionkey"), F.col("r_name").alias("division")
    )
    out = nation.join(region, "regionkey").drop("regionkey")
    if not with_covariate:
        return out
    # Written once: 25 rows that took a pass over all suppliers.
    return settle(area_join(out, covariate(spark, folder), "nationkey"), "areas")


def _people(spark: SparkSession, folder: str) -> DataFrame:
    return source(spark, folder, "customer").select(
        "c_custkey",
        F.col("c_nationkey").alias("nationkey"),
        F.col("c_mktsegment").alias("segment"),
        (F.col("c_acctbal") / 1000).alias("balance"),
    )


def _with_area(df: DataFrame, spark: SparkSession, folder: str, with_covariate: bool) -> DataFrame:
    """Area, division and covariate by nation key, a lookup in each table as it is.

    Tables of known size need no measuring, and nothing moves for them.
    """
    nation = source(spark, folder, "nation").select(
        F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("abb"), F.col("n_regionkey").alias("regionkey")
    )
    region = source(spark, folder, "region").select(
        F.col("r_regionkey").alias("regionkey"), F.col("r_name").alias("division")
    )
    df = lookup_join(lookup_join(df, nation, "nationkey", how="inner"), region, "regionkey", how="inner")
    if with_covariate:
        df = lookup_join(df, covariate(spark, folder), "nationkey")
    return df.drop("nationkey", "regionkey")


def customers(spark: SparkSession, folder: str, with_covariate: bool = False) -> DataFrame:
    return _with_area(_people(spark, folder), spark, folder, with_covariate)


def respondents(
    spark: SparkSession, folder: str, with_covariate: bool = False, answered: bool = False
) -> DataFrame:
    """One row per order, outcome missing for partly filled orders.

    ``answered`` drops those before the join.
    """
    orders = source(spark, folder, "orders").select(
        F.col("o_orderkey").alias("caseid"),
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderpriority").alias("priority"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderstatus").alias("status"),
        recode("o_orderstatus", OUTCOME_CODES).alias("y"),
    )
    if answered:
        orders = orders.filter(F.col("status").isin(*OUTCOME_CODES))
    joined = lookup_join(orders, _people(spark, folder), "c_custkey", how="inner").drop("c_custkey")
    return _with_area(joined, spark, folder, with_covariate)


def complete(spark: SparkSession, folder: str, with_covariate: bool = False) -> DataFrame:
    """Respondents with an answer (and a covariate, when asked for)."""
    survey = respondents(spark, folder, with_covariate, answered=True)
    return complete_cases(survey, ["covariate"]) if with_covariate else survey


def tally(
    spark: SparkSession, folder: str, keys=PREDICTORS, attributes=(), extra=None
) -> DataFrame:
    """All complete respondents as weighted cells (``n``), written once.

    Fits, frames, marginals and known values all come from it, so a study costs
    one pass over the respondents.  ``extra`` adds computed keys.
    """
    survey = complete(spark, folder, with_covariate="covariate" in attributes)
    extra = extra or {}
    survey = survey.withColumns(extra) if extra else survey
    return settle(
        psframe(survey, "abb", [*keys, *extra, "y"], attributes=attributes), "tally"
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line; the outcome is a returned line.

    Orders are a large table themselves, so the two sides meet on their shared
    key unless Spark finds one small once it has been shuffled.
    """
    items = source(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("caseid"),
        F.col("l_linestatus").alias("line_status"),
        (F.col("l_returnflag") == "R").cast("double").alias("returned"),
        "l_quantity",
    )
    people = respondents(spark, folder).select("caseid", "abb", "priority", "segment")
    return lookup_join(items, people, "caseid", how="inner", small=False)
