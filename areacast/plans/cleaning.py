"""Raw survey to tidy survey: recode, add geography and covariates, filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areacast.functions import recode as rc
from areacast.operators.covariates import attach_covariates, pivot_wider, two_party_share
from areacast.operators.filters import complete_cases, keep_large_areas
from areacast.operators.sampling import sample_weighted
from areacast.sources import codebook as cb
from areacast.sources.shared import settle
from areacast.sources.tables import read_csv, write_table


def recode_survey(raw: DataFrame) -> DataFrame:
    """All individual recodes as one projection; the area code becomes ``fips``."""
    age = rc.age_in(cb.SURVEY_YEAR, "birthyr")
    return raw.select(
        "caseid",
        rc.binary(F.col("gender") == cb.GENDER_YES_CODE, *cb.GENDER_LABELS).alias("gender"),
        rc.recode("educ", cb.EDUCATION).alias("educ"),
        rc.recode("race", cb.RACE, cb.RACE_DEFAULT).alias("race"),
        age.alias("age"),
        rc.band(age, cb.AGE_CUTS, cb.AGE_LABELS).alias("age_cat"),
        F.col("inputstate").alias("fips"),
        rc.recode("pew_religimp", cb.RELIGION_IMPORTANCE).alias("pew_religimp"),
        rc.indicator(F.col("ownhome") == 1).alias("homeowner"),
        rc.recode("urbancity", cb.URBAN).alias("urban"),
        rc.indicator(F.col("child18") == 1).alias("parent"),
        rc.any_of(cb.MILITARY_ITEMS, 1).alias("military_household"),
        rc.flip_outcome("cc20_334d").alias("defund_police"),
    )


def area_dimension(states: DataFrame) -> DataFrame:
    """Distinct ``fips, abb, division``."""
    return states.select("fips", "abb", F.col("division").cast("string").alias("division")).distinct()


def homicide_rates(table: DataFrame, year: int = 2019) -> DataFrame:
    return table.filter(F.col("year") == year).select(
        F.col("state").alias("abb"), F.col("rate").alias("homicide_rate")
    )


def vote_shares(table: DataFrame, year: int = 2020) -> DataFrame:
    """Two-party percentage of the first listed party, one row per area."""
    votes = table.filter((F.col("year") == year) & F.col("party_simplified").isin(*cb.PARTIES))
    votes = votes.select(F.col("state_po").alias("abb"), "party_simplified", "candidatevotes")
    wide = pivot_wider(votes, "abb", "party_simplified", "candidatevotes", cb.PARTIES)
    share = two_party_share(*[F.col(p) for p in cb.PARTIES])
    return wide.select("abb", share.alias("biden_vote_share"))


def tidy_survey(
    raw: DataFrame, states: DataFrame, homicide: DataFrame, election: DataFrame
) -> DataFrame:
    """The 16-column survey before any row is dropped."""
    df = attach_covariates(recode_survey(raw), "fips", area_dimension(states))
    df = attach_covariates(df, "abb", homicide_rates(homicide), vote_shares(election))
    return df.select(*cb.TIDY_COLUMNS)


@dataclass(frozen=True)
class CleanSurvey:
    """``national`` has every area; ``large`` only those with enough respondents."""

    national: DataFrame
    large: DataFrame


def clean_survey(tidy: DataFrame, min_exclusive: int = cb.MIN_RESPONDENTS) -> CleanSurvey:
    """Complete cases, nationally and for large areas.

    Areas are judged on their respondents *before* incomplete rows are dropped.
    """
    national = complete_cases(tidy)
    large = keep_large_areas(national, "abb", min_exclusive, counts_from=tidy)
    return CleanSurvey(national, large)


def biased_weight(age: str = "age_cat", share: str = "biden_vote_share") -> Column:
    """Sampling weight that favours the young and high-share areas.

    The published analysis compares the *numeric* age with the band labels, so
    that only the share counts; pass ``age=None`` to reproduce it.
    """
    weight = 0.2 * F.col(share)
    if age is None:
        return weight
    # Extra weight of each age band.
    bonus = {"18-29": 8.0, "30-39": 6.0, "40-49": 4.0, "50-59": 2.0, "60-69": 1.0, "70+": 0.5}
    return weight + rc.recode(age, bonus, 0.0)


def draw_biased_sample(
    survey: DataFrame, n: int = 5000, seed: int = 42, age: str | None = None
) -> DataFrame:
    return sample_weighted(survey, n, "caseid", biased_weight(age), seed)


def run_cleaning(
    spark: SparkSession, survey_csv: str, states: DataFrame, homicide_csv: str, election_csv: str,
    out: str, min_exclusive: int = cb.MIN_RESPONDENTS, sample_size: int = 5000, seed: int = 42,
    mode: str = "errorifexists",
) -> dict[str, str]:
    """Read the raw files and write the large-area, national and biased tables.

    The tidy rows are written once and everything else reads that table.
    """
    tidy = settle(
        tidy_survey(
            read_csv(spark, survey_csv, cb.SURVEY_RAW),
            states,
            read_csv(spark, homicide_csv, cb.HOMICIDE),
            read_csv(spark, election_csv, cb.ELECTION),
        ),
        "tidy",
    )
    clean = clean_survey(tidy, min_exclusive)
    paths = {k: f"{out.rstrip('/')}/{k}" for k in ("large", "national", "biased")}
    write_table(clean.large, paths["large"], mode)
    write_table(clean.national, paths["national"], mode)
    write_table(draw_biased_sample(clean.national, sample_size, seed), paths["biased"], mode)
    return paths
