"""Answer codes, labels and schemas of the survey and its covariate tables."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# They must equal the published codebook for results to match.
SURVEY_YEAR = 2020

GENDER_YES_CODE = 1
GENDER_LABELS = ("Male", "Female")

EDUCATION = {
    1: "No_HS",
    2: "High_school",
    3: "Some_college",
    4: "2_year",
    5: "4_year",
    6: "Post_grad",
}

RACE = {1: "White", 2: "Black", 3: "Hispanic", 4: "Asian"}
RACE_DEFAULT = "Other"

AGE_CUTS = (30, 40, 50, 60, 70)
AGE_LABELS = ("18-29", "30-39", "40-49", "50-59", "60-69", "70+")

RELIGION_IMPORTANCE = {
    1: "Very_important",
    2: "Somewhat_important",
    3: "Not_too_important",
    4: "Not_at_all_important",
}

URBAN = {1: "Urban", (2, 3, 5): "Suburban", 4: "Rural"}

MILITARY_ITEMS = ("milstat_1", "milstat_2", "milstat_3", "milstat_4")

PARTIES = ("DEMOCRAT", "REPUBLICAN")

MIN_RESPONDENTS = 500  # areas need more than this many

TIDY_COLUMNS = (
    "caseid",
    "gender",
    "educ",
    "race",
    "age",
    "age_cat",
    "abb",
    "division",
    "pew_religimp",
    "homeowner",
    "urban",
    "parent",
    "military_household",
    "defund_police",
    "homicide_rate",
    "biden_vote_share",
)
# ---------------------------------------------------------------------------


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_INT, _LONG, _STR, _DBL = T.IntegerType(), T.LongType(), T.StringType(), T.DoubleType()

SURVEY_RAW = _schema(
    caseid=_LONG,
    gender=_INT,
    educ=_INT,
    race=_INT,
    birthyr=_INT,
    pew_religimp=_INT,
    ownhome=_INT,
    urbancity=_INT,
    child18=_INT,
    milstat_1=_INT,
    milstat_2=_INT,
    milstat_3=_INT,
    milstat_4=_INT,
    cc20_334d=_INT,
    inputstate=_INT,
)

AREA_DIMENSION = _schema(fips=_INT, abb=_STR, division=_STR)
HOMICIDE = _schema(year=_INT, state=_STR, rate=_DBL)
ELECTION = _schema(year=_INT, state_po=_STR, party_simplified=_STR, candidatevotes=_LONG)
ROSTER = _schema(name=_STR, gender=_STR, age=_DBL)
