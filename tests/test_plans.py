"""Physical plans: what is scanned, what is shuffled, and what never happens."""

import os
import re

import pytest
from pyspark.sql import functions as F

from areacast.operators import frames, joins
from areacast.operators.poststratify import poststratify
from areacast.plans import orders_survey, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

RELATIONAL = [
    "recode_map", "band", "dimension_join", "large_areas", "complete_cases", "area_covariates",
    "pivot_wide", "area_mean", "area_interval", "psframe", "psframe_attrs", "psframe_full",
    "cell_share", "marginal", "marginals_long", "synthetic_frame", "synthetic_estimate",
    "sample_uniform", "sample_weighted", "poststratify_fixed_coefs", "evaluate_estimates",
    "caterpillar", "line_area_mean",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_cross_join_no_window_no_python(spark, name):
    text = plan(queries.QUERIES[name](spark, FOLDER))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Window", "BatchEvalPython", "ArrowEvalPython", "InPandas"):
        assert bad not in text, bad


def test_frame_is_one_shuffle_of_partial_counts(spark):
    text = plan(queries.QUERIES["psframe"](spark, FOLDER))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert "partial_count" in text and "SortMergeJoin" not in text


def test_rows_are_never_sorted_to_be_counted(spark):
    """Attributes of any type leave the partial aggregation a hash aggregation."""
    text = plan(queries.QUERIES["psframe_attrs"](spark, FOLDER))
    assert "SortAggregate" not in text and text.count("HashAggregate") >= 2
    survey = orders_survey.complete(spark, FOLDER, with_covariate=True)
    text = plan(frames.psframe(survey, "abb", ["priority"], attributes=["division", "covariate"]))
    assert "SortAggregate" not in text and "Sort [" not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(queries.QUERIES["area_mean"](spark, FOLDER))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    orders = next(s for s in schemas if "o_custkey" in s)
    assert {c.split(":")[0] for c in orders.split(",")} == {"o_custkey", "o_orderstatus"}
    assert "PushedFilters: [In(o_orderstatus, [F,O]), IsNotNull(o_custkey)]" in text


def test_synthetic_expansion_is_never_shuffled(spark):
    """Expand, score and partially average in one stage: only averages move."""
    cells = orders_survey.tally(spark, FOLDER, ["priority", "segment", "status"])
    joint = frames.cell_share(cells, "abb", ["priority"], "n")
    parts = frames.marginals(cells, "abb", ["segment", "status"], "n")
    frame = frames.synthetic_frame(joint, parts, "abb")
    text = plan(poststratify(queries.FIXED.score(frame), "abb", weight="prob"))
    exchanges = re.findall(r"Exchange (\w+)\(([^)]*)", text)
    hashed = [keys for kind, keys in exchanges if kind == "hashpartitioning"]
    # One for the totals the shares divide by, one for the final average.
    assert len(hashed) == 2


def test_hot_area_end_to_end(spark, monkeypatch):
    """A third of the rows in one area, and no lookup side small enough."""
    survey = spark.range(30_000, numPartitions=16).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .otherwise(F.concat(F.lit("a"), (F.col("id") % 3000).cast("string")))
        .alias("abb"),
        (F.col("id") % 4).cast("string").alias("g"),
        (F.col("id") % 2).cast("double").alias("y"),
    )
    plain = frames.cell_share(survey, "abb", ["g", "y"])
    small = {tuple(r) for r in plain.select("abb", "g", "y", "n", "prob").collect()}
    monkeypatch.setattr(joins, "fits_in_broadcast", lambda *a, **k: False)
    large = frames.cell_share(survey, "abb", ["g", "y"])
    assert {tuple(r) for r in large.select("abb", "g", "y", "n", "prob").collect()} == small
