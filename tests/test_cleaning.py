import numpy as np
import pandas as pd
from conftest import collect
from pyspark.sql import functions as F

from areacast.operators.filters import complete_cases
from areacast.plans import cleaning
from areacast.sources import codebook as cb
from areacast.sources.tables import read_csv, read_table


def raw_rows(spark, **changes):
    base = dict(
        caseid=1, gender=1, educ=3, race=1, birthyr=1980, pew_religimp=2, ownhome=1, urbancity=3,
        child18=2, milstat_1=2, milstat_2=2, milstat_3=2, milstat_4=2, cc20_334d=1, inputstate=1,
    )
    n = max((len(v) for v in changes.values()), default=1)
    rows = [
        tuple({**base, "caseid": i, **{k: v[i] for k, v in changes.items()}}[f.name] for f in cb.SURVEY_RAW)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, cb.SURVEY_RAW)


def dims(spark):
    return (
        spark.createDataFrame([(1, "AL", "6"), (1, "AL", "6"), (2, "AK", "9")], cb.AREA_DIMENSION),
        spark.createDataFrame([(2019, "AL", 11.9), (2018, "AL", 9.0), (2019, "AK", 5.0)], cb.HOMICIDE),
        spark.createDataFrame(
            [(2020, "AL", "DEMOCRAT", 40), (2020, "AL", "REPUBLICAN", 60), (2020, "AL", "OTHER", 5),
             (2016, "AL", "DEMOCRAT", 1), (2020, "AK", "DEMOCRAT", 45), (2020, "AK", "REPUBLICAN", 55)],
            cb.ELECTION,
        ),
    )


def test_schema_of_the_tidy_survey(tidy):
    assert tuple(tidy.columns) == cb.TIDY_COLUMNS and len(tidy.columns) == 16
    kinds = dict(tidy.dtypes)
    assert kinds["caseid"] == "bigint" and kinds["age"] == "int"
    assert all(kinds[c] == "string" for c in ("gender", "educ", "race", "age_cat", "abb", "division"))
    assert all(kinds[c] == "double" for c in ("homeowner", "parent", "military_household", "defund_police", "homicide_rate", "biden_vote_share"))


def test_recodes_on_a_row(spark):
    row = cleaning.tidy_survey(raw_rows(spark), *dims(spark)).first().asDict()
    assert row == {
        "caseid": 0, "gender": "Male", "educ": "Some_college", "race": "White", "age": 40,
        "age_cat": "40-49", "abb": "AL", "division": "6", "pew_religimp": "Somewhat_important",
        "homeowner": 1.0, "urban": "Suburban", "parent": 0.0, "military_household": 0.0,
        "defund_police": 1.0, "homicide_rate": 11.9, "biden_vote_share": 40.0,
    }


def test_missing_answers(spark):
    raw = raw_rows(
        spark,
        gender=[None, 2, 1, 1, 1, 1, 1],
        educ=[1, 7, 1, 1, 1, 1, 1],
        birthyr=[1980, 1980, None, 1980, 1980, 1980, 1980],
        milstat_1=[2, 2, 2, None, None, 2, 2],
        milstat_2=[2, 2, 2, 2, 1, 2, 2],
        cc20_334d=[1, 1, 1, 1, 1, 3, 2],
        inputstate=[1, 1, 1, 1, 1, 1, 99],
    )
    out = collect(cleaning.tidy_survey(raw, *dims(spark)), "caseid")
    assert [r["gender"] for r in out][:2] == [None, "Female"]
    assert out[1]["educ"] is None
    assert out[2]["age"] is None and out[2]["age_cat"] == "70+"
    assert out[3]["military_household"] is None and out[4]["military_household"] == 1.0
    assert out[5]["defund_police"] is None
    assert out[6]["abb"] is None and out[6]["homicide_rate"] is None
    kept = complete_cases(cleaning.tidy_survey(raw, *dims(spark)))
    assert [r["caseid"] for r in collect(kept, "caseid")] == [4]


def test_areas_are_judged_before_incomplete_rows_go(spark):
    n = 501
    raw = raw_rows(
        spark, inputstate=[1] * n + [2] * 500, educ=[7] * 100 + [1] * (n - 100) + [1] * 500
    )
    clean = cleaning.clean_survey(cleaning.tidy_survey(raw, *dims(spark)))
    assert clean.large.groupBy("abb").count().collect() == [("AL", 401)]
    assert clean.national.count() == 901


def test_vote_shares(spark):
    out = collect(cleaning.vote_shares(dims(spark)[2]), "abb")
    assert [(r["abb"], r["biden_vote_share"]) for r in out] == [("AK", 45.0), ("AL", 40.0)]


def test_equals_pandas(raw, tidy):
    """The whole cleaning step against an independent pandas version."""
    s = raw["survey"].astype("float")
    dim = raw["states"].drop_duplicates()
    d = pd.DataFrame({"caseid": s.caseid.astype(int)})
    d["gender"] = np.where(s.gender == 1, "Male", "Female")
    d["educ"] = s.educ.map(cb.EDUCATION)
    d["race"] = s.race.map(cb.RACE).fillna("Other")
    d["age"] = 2020 - s.birthyr
    d["age_cat"] = pd.cut(d.age, [0, 30, 40, 50, 60, 70, 200], right=False, labels=cb.AGE_LABELS).astype(str)
    d["pew_religimp"] = s.pew_religimp.map(cb.RELIGION_IMPORTANCE)
    d["homeowner"] = (s.ownhome == 1).astype(float)
    d["urban"] = s.urbancity.map({1: "Urban", 2: "Suburban", 3: "Suburban", 5: "Suburban", 4: "Rural"})
    d["parent"] = (s.child18 == 1).astype(float)
    d["military_household"] = (s[[f"milstat_{k}" for k in range(1, 5)]] == 1).any(axis=1).astype(float)
    d["defund_police"] = 2 - s.CC20_334d
    d["fips"] = s.inputstate.astype(int)
    d = d.merge(dim, on="fips", how="left")
    h = raw["homicide"].query("YEAR == 2019")
    d = d.merge(h[["STATE", "RATE"]].rename(columns={"STATE": "abb", "RATE": "homicide_rate"}), on="abb", how="left")
    e = raw["election"].query("year == 2020").pivot(index="state_po", columns="party_simplified", values="candidatevotes")
    share = (e.DEMOCRAT / (e.DEMOCRAT + e.REPUBLICAN) * 100).rename("biden_vote_share")
    d = d.merge(share, left_on="abb", right_index=True, how="left")
    d = d[list(cb.TIDY_COLUMNS)].sort_values("caseid").reset_index(drop=True)
    got = tidy.toPandas().sort_values("caseid").reset_index(drop=True)
    got, d = got.where(got.notna(), np.nan), d.where(d.notna(), np.nan)
    pd.testing.assert_frame_equal(got, d, check_dtype=False)


def test_run_cleaning_writes_three_tables(spark, raw, raw_files, tmp_path):
    states = read_csv(spark, raw_files["states"], cb.AREA_DIMENSION)
    paths = cleaning.run_cleaning(
        spark, raw_files["survey"], states, raw_files["homicide"], raw_files["election"],
        str(tmp_path / "out"), min_exclusive=500, sample_size=700,
    )
    national, large, biased = (read_table(spark, paths[k]) for k in ("national", "large", "biased"))
    counts = raw["survey"].inputstate.value_counts()
    expected = {f"A{int(k) - 1:02d}" for k, v in counts.items() if v > 500}
    assert {r["abb"] for r in large.select("abb").distinct().collect()} == expected
    assert 0 < large.count() < national.count() < len(raw["survey"])
    assert biased.count() == 700 and biased.columns == national.columns
    assert national.filter(F.col("pew_religimp").isNull()).count() == 0


def test_biased_sample_weights(population):
    """As written only the vote share counts; as intended the young are favoured."""
    written = cleaning.draw_biased_sample(population, 1500)
    intended = cleaning.draw_biased_sample(population, 1500, age="age_cat")
    young = lambda df: df.filter("age_cat = '18-29'").count() / df.count()
    assert abs(young(written) - young(population)) < 0.04
    assert young(intended) > young(population) + 0.02
    share = lambda df: df.agg(F.avg("biden_vote_share")).first()[0]
    assert share(written) > share(population)
