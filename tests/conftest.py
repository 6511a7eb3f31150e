"""Session and a seeded synthetic survey with known coefficients."""

from __future__ import annotations

import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("areacast-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def raw_survey(n: int = 12_000, areas: int = 24, seed: int = 7) -> dict[str, pd.DataFrame]:
    """Raw survey codes plus the area tables, with a known opinion model."""
    rng = np.random.default_rng(seed)
    size = rng.dirichlet(np.full(areas, 3.0))
    state = rng.choice(areas, n, p=size)
    share = rng.normal(50, 9, areas).round(2)
    division = np.arange(areas) % 9 + 1
    effect = rng.normal(0, 0.25, 10)
    gender = rng.integers(1, 3, n)
    educ = rng.integers(1, 7, n)
    race = rng.choice([1, 2, 3, 4, 5], n, p=[0.6, 0.15, 0.12, 0.08, 0.05])
    birthyr = rng.integers(1935, 2003, n)
    religion = rng.integers(1, 5, n)
    own = rng.integers(1, 4, n)
    urban = rng.integers(1, 6, n)
    child = rng.integers(1, 3, n)
    age = 2020 - birthyr
    eta = (
        0.4
        - 0.25 * (gender == 1)
        + 0.12 * (educ - 3)
        + 0.7 * (race == 2)
        - 0.02 * (age - 40)
        - 0.35 * (religion == 1)
        + effect[division[state]]
        + 0.05 * (share[state] - 50)
    )
    support = rng.random(n) < 1 / (1 + np.exp(-eta))
    survey = pd.DataFrame(
        {
            "caseid": np.arange(1, n + 1),
            "gender": gender,
            "educ": educ,
            "race": race,
            "birthyr": birthyr,
            "pew_religimp": religion,
            "ownhome": own,
            "urbancity": urban,
            "child18": child,
            **{f"milstat_{k}": rng.choice([1, 2], n, p=[0.1, 0.9]) for k in range(1, 5)},
            "CC20_334d": np.where(support, 1, 2),
            "inputstate": state + 1,
        }
    ).astype("Int64")
    blank = rng.random(n) < 0.02
    survey.loc[blank, "pew_religimp"] = pd.NA
    abb = [f"A{k:02d}" for k in range(areas)]
    states = pd.DataFrame(
        {"fips": np.arange(1, areas + 1), "abb": abb, "division": division.astype(str)}
    )
    # Repeated rows, as in a table of map polygons.
    states = pd.concat([states, states.iloc[:5]], ignore_index=True)
    homicide = pd.DataFrame(
        {
            "YEAR": np.repeat([2018, 2019], areas),
            "STATE": abb * 2,
            "RATE": rng.uniform(1, 12, 2 * areas).round(1),
        }
    )
    votes = rng.integers(400_000, 5_000_000, areas)
    rows = []
    for k in range(areas):
        dem = int(votes[k] * share[k] / 100)
        rows += [
            (2016, abb[k], "DEMOCRAT", 1),
            (2020, abb[k], "DEMOCRAT", dem),
            (2020, abb[k], "REPUBLICAN", int(votes[k]) - dem),
            (2020, abb[k], "OTHER", 999),
            (2020, abb[k], "LIBERTARIAN", 500),
        ]
    election = pd.DataFrame(
        rows, columns=["year", "state_po", "party_simplified", "candidatevotes"]
    )
    return {"survey": survey, "states": states, "homicide": homicide, "election": election}


@pytest.fixture(scope="session")
def raw():
    return raw_survey()


@pytest.fixture(scope="session")
def raw_files(raw, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    paths = {}
    for name, frame in raw.items():
        paths[name] = str(folder / f"{name}.csv")
        extra = frame.assign(**{"unused column": "x,y", "Other%": 1.5}) if name == "survey" else frame
        extra.to_csv(paths[name], index=False, na_rep="NA")
    return paths


@pytest.fixture(scope="session")
def tidy(spark, raw_files):
    """The tidy survey before rows are dropped, as a settled table."""
    from areacast.plans.cleaning import tidy_survey
    from areacast.sources import codebook as cb
    from areacast.sources.shared import settle
    from areacast.sources.tables import read_csv

    return settle(
        tidy_survey(
            read_csv(spark, raw_files["survey"], cb.SURVEY_RAW),
            read_csv(spark, raw_files["states"], cb.AREA_DIMENSION),
            read_csv(spark, raw_files["homicide"], cb.HOMICIDE),
            read_csv(spark, raw_files["election"], cb.ELECTION),
        )
    )


@pytest.fixture(scope="session")
def population(tidy):
    from areacast.operators.filters import complete_cases
    from areacast.sources.shared import settle

    return settle(complete_cases(tidy))


@pytest.fixture(scope="session")
def sample(population):
    from areacast.plans.studies import draw
    from areacast.sources.shared import settle

    return settle(draw(population, 3000))


def collect(df, *order):
    rows = [r.asDict() for r in df.collect()]
    return sorted(rows, key=lambda r: tuple((r[c] is None, r[c] if r[c] is not None else 0) for c in order))
