"""Registered queries: every operator over the whole order survey.

Each takes ``(spark, folder)`` and returns a DataFrame.  Computed doubles are
rounded to six digits so that independent engines agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areacast.functions import recode as rc
from areacast.functions import stats
from areacast.models.forest import fit_forest
from areacast.models.lasso import fit_lasso
from areacast.models.linear import fit_linear, fit_linear_cells
from areacast.models.multilevel import fit_multilevel
from areacast.models.predict import LinearPredictor
from areacast.models.spec import ModelSpec
from areacast.models.stack import fit_stack, forest_learner, linear_learner
from areacast.operators import covariates as cov
from areacast.operators import evaluate, filters, frames, joins
from areacast.operators import poststratify as ps
from areacast.operators import sampling
from areacast.plans.orders_survey import (
    areas,
    complete,
    covariate,
    customers,
    lines,
    respondents,
    source,
    tally,
)
from areacast.plans.studies import marginal_mean, roster_mean, score_roster
from areacast.sources import tables
from areacast.sources.shared import settle, shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AREA = "abb"
MIN_ORDERS = 600
SAMPLE = 3000
# Coefficients of a given model, for scoring without a fit.
FIXED = LinearPredictor(
    "binomial",
    -0.25,
    {},
    {
        "priority": {"1-URGENT": 0.0, "2-HIGH": 0.1, "3-MEDIUM": -0.2, "4-NOT SPECIFIED": 0.3, "5-LOW": -0.4},
        "segment": {"AUTOMOBILE": 0.0, "BUILDING": 0.15, "FURNITURE": -0.05, "HOUSEHOLD": 0.25, "MACHINERY": -0.35},
    },
)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def _code() -> Column:
    return F.substring("o_orderpriority", 1, 1).cast("int")


# --- sources and sinks -----------------------------------------------------


@query
def csv_roundtrip(spark, folder):
    """Orders written with untidy headers and read back through a declared schema."""
    path = shared_path(spark, "csv")
    orders = source(spark, folder, "orders")
    untidy = orders.select(
        F.col("o_orderkey").alias("Order Key"),
        F.col("o_orderstatus").alias("CC20_334d"),
        _code().alias("priority.Code"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("TotalPrice"),
        F.col("o_custkey").alias("not needed"),
    )
    untidy.write.option("header", True).option("nullValue", "NA").csv(path)
    schema = T.StructType(
        [
            T.StructField("order_key", T.LongType()),
            T.StructField("cc20_334d", T.StringType()),
            T.StructField("priority_code", T.IntegerType()),
            T.StructField("total_price", T.DoubleType()),
        ]
    )
    return tables.read_csv(spark, path, schema)


@query
def clean_names(spark, folder):
    """Column names in snake case, repeats numbered."""
    orders = source(spark, folder, "orders")
    messy = orders.select("o_orderkey", "o_orderstatus", "o_orderpriority").toDF(
        "Case ID", "Order Status", "order-status"
    )
    return rc.clean_names(messy)


@query
def table_roundtrip(spark, folder):
    """The survey written by area and read back."""
    path = shared_path(spark, "survey")
    survey = respondents(spark, folder).select("caseid", "priority", "y", AREA)
    tables.write_table(survey, path, partition_by=AREA)
    return tables.read_table(spark, path).select("caseid", "priority", "y", AREA)


@query
def survey_shape(spark, folder):
    return tables.shape(respondents(spark, folder))


# --- recodes ---------------------------------------------------------------


@query
def recode_binary(spark, folder):
    filled = rc.recode("o_orderstatus", {"F": True, "O": False})
    label = rc.binary(filled, "Filled", "Open")
    return source(spark, folder, "orders").select("o_orderkey", label.alias("label"))


@query
def recode_map(spark, folder):
    label = rc.recode(_code(), {1: "urgent", 2: "high", 3: "medium", 4: "unspecified"})
    return source(spark, folder, "orders").select("o_orderkey", label.alias("label"))


@query
def recode_default(spark, folder):
    code = F.when(F.col("o_orderstatus") != "P", _code())
    label = rc.recode(code, {1: "White", 2: "Black", 3: "Hispanic", 4: "Asian"}, "Other")
    return source(spark, folder, "orders").select("o_orderkey", label.alias("label"))


@query
def recode_sets(spark, folder):
    label = rc.recode(_code(), {1: "Urban", (2, 3, 5): "Suburban", 4: "Rural"})
    return source(spark, folder, "orders").select("o_orderkey", label.alias("label"))


@query
def band(spark, folder):
    value = F.when(F.col("l_returnflag") != "A", F.col("l_quantity"))
    label = rc.band(value, (10, 20, 30, 40, 50), ("0-9", "10-19", "20-29", "30-39", "40-49", "50+"))
    items = source(spark, folder, "lineitem")
    return items.groupBy("l_returnflag", label.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query
def age_from_year(spark, folder):
    age = rc.age_in(2020, F.year("o_orderdate"))
    return source(spark, folder, "orders").select("o_orderkey", age.alias("age"))


@query
def indicator(spark, folder):
    code = F.when(F.col("o_orderstatus") != "P", _code())
    return source(spark, folder, "orders").select(
        "o_orderkey", rc.indicator(code == 1).alias("urgent")
    )


@query
def any_of(spark, folder):
    y = rc.recode("o_orderstatus", {"F": 1, "O": 2})
    orders = source(spark, folder, "orders").withColumns({"item_1": y, "item_2": _code()})
    items = ["item_1", "item_2"]
    return orders.select(
        "o_orderkey",
        rc.any_of(items, 1).alias("any_item"),
        rc.any_of(items, 1, null_as_false=True).alias("any_item_no_null"),
    )


@query
def flip_outcome(spark, folder):
    code = rc.recode("o_orderstatus", {"F": 1, "O": 2, "P": 3})
    orders = source(spark, folder, "orders").withColumn("code", code)
    return orders.select("o_orderkey", rc.flip_outcome("code").alias("support"))


@query
def not_member(spark, folder):
    """Negated membership keeps the missing values."""
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    orders = source(spark, folder, "orders").withColumn("status", status)
    return orders.filter(~rc.is_member("status", ["F"])).select("o_orderkey")


# --- filters, joins, covariates -------------------------------------------


@query
def dimension_join(spark, folder):
    return respondents(spark, folder).select("caseid", AREA, "division")


@query
def distinct_areas(spark, folder):
    """Distinct area and division, with the number of distinct outcomes seen."""
    survey = respondents(spark, folder)
    return survey.groupBy(AREA, "division").agg(F.count_distinct("y").alias("n_outcomes"))


@query
def area_dimension(spark, folder):
    """Distinct area and division out of all customers."""
    return customers(spark, folder).select(AREA, "division").distinct()


@query
def area_number(spark, folder):
    survey = respondents(spark, folder)
    return survey.agg(F.count_distinct(AREA).alias("n_areas"), F.count_distinct("division").alias("n_divisions"))


@query
def large_areas(spark, folder):
    survey = respondents(spark, folder).select("caseid", AREA)
    return filters.keep_large_areas(survey, AREA, MIN_ORDERS)


@query
def area_counts(spark, folder):
    return filters.areas_above(respondents(spark, folder), AREA, MIN_ORDERS)


@query
def complete_cases(spark, folder):
    return complete(spark, folder).select("caseid", "y")


@query
def clean_survey(spark, folder):
    """Recode, attach covariates, keep large areas, then complete cases."""
    tidy = respondents(spark, folder, with_covariate=True).select(
        "caseid",
        rc.recode("priority", {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "mid"}, "low").alias("level"),
        rc.recode("segment", {"AUTOMOBILE": "A", "BUILDING": "B", "FURNITURE": "F", "HOUSEHOLD": "H"}).alias("sector"),
        rc.band("balance", (0, 3, 6), ("debt", "low", "mid", "high")).alias("balance_cat"),
        AREA,
        "division",
        "y",
        r6("covariate").alias("covariate"),
    )
    large = filters.keep_large_areas(tidy, AREA, MIN_ORDERS)
    return filters.complete_cases(large)


@query
def area_covariates(spark, folder):
    """Survey with two area tables attached, summarised by area."""
    by_key = areas(spark, folder).select("nationkey", AREA)
    balance = joins.area_join(covariate(spark, folder), by_key, "nationkey", "inner")
    size = customers(spark, folder).groupBy(AREA).agg(F.count(F.lit(1)).alias("n_customers"))
    survey = cov.attach_covariates(
        respondents(spark, folder), AREA, balance.select(AREA, "covariate"), size
    )
    return survey.groupBy(AREA).agg(
        r6(F.max("covariate")).alias("covariate"),
        F.max("n_customers").alias("n_customers"),
        F.count(F.lit(1)).alias("n"),
    )


@query
def null_key_join(spark, folder):
    """A missing key meets a missing key in one join and nothing in the other."""
    orders = source(spark, folder, "orders").select(
        "o_orderkey", rc.recode("o_orderstatus", {"F": "filled", "O": "open"}).alias("label")
    )
    sizes = settle(orders.groupBy("label").agg(F.count(F.lit(1)).alias("same")), "sizes")
    out = joins.lookup_join(orders, sizes, "label", null_safe=True)
    return joins.lookup_join(out, sizes.withColumnRenamed("same", "plain"), "label")


@query
def natural_totals(spark, folder):
    """Cells beside the total of every column they share with the totals."""
    survey = respondents(spark, folder)
    cells = frames.psframe(survey, AREA, ["division", "priority"])
    totals = survey.groupBy(AREA, "division").agg(F.count(F.lit(1)).alias("num_respondents"))
    return joins.natural_left_join(cells, settle(totals, "totals"))


def _votes(spark, folder):
    """Long table: area, status, number of orders."""
    survey = respondents(spark, folder)
    return survey.groupBy(AREA, "status").agg(F.count(F.lit(1)).alias("votes"))


@query
def pivot_wide(spark, folder):
    return cov.pivot_wider(_votes(spark, folder), AREA, "status", "votes", ["F", "O", "P"])


@query
def two_party_share(spark, folder):
    wide = cov.pivot_wider(_votes(spark, folder), AREA, "status", "votes", ["F", "O"])
    return wide.select(AREA, r6(cov.two_party_share(F.col("F"), F.col("O"))).alias("share"))


# --- means and intervals ---------------------------------------------------


@query
def area_mean(spark, folder):
    return rounded(ps.area_mean(complete(spark, folder), AREA, "y"), "truth")


@query
def area_mean_missing(spark, folder):
    """A missing answer spoils its area unless it is skipped."""
    y = F.col("y")
    return respondents(spark, folder).groupBy(AREA, "priority").agg(
        r6(stats.mean(y)).alias("strict"), r6(stats.mean(y, na="skip")).alias("lenient")
    )


@query
def disaggregate(spark, folder):
    return rounded(ps.disaggregate(complete(spark, folder), AREA, "y"), "estimate")


@query
def area_interval(spark, folder):
    means = ps.disaggregate(
        complete(spark, folder), AREA, "y", out="pct_support", num="num_respondents"
    )
    out = ps.with_interval(means, "pct_support", "num_respondents")
    return rounded(out, "pct_support", "conf_low", "conf_high")


@query
def first_areas(spark, folder):
    """The six areas with the lowest support."""
    means = ps.disaggregate(complete(spark, folder), AREA, "y")
    return rounded(evaluate.ordered_areas(means, AREA, "estimate").limit(6), "estimate")


@query
def line_area_mean(spark, folder):
    """The large table: share of returned lines by area and line status."""
    out = ps.disaggregate(lines(spark, folder), [AREA, "line_status"], "returned")
    return rounded(out, "estimate")


# --- frames ----------------------------------------------------------------


@query
def psframe(spark, folder):
    return frames.psframe(respondents(spark, folder), AREA, ["priority", "segment"])


@query
def psframe_attrs(spark, folder):
    survey = respondents(spark, folder, with_covariate=True)
    out = frames.psframe(survey, AREA, ["priority"], attributes=["division", "covariate"])
    return rounded(out, "covariate")


@query
def psframe_full(spark, folder):
    survey = respondents(spark, folder)
    return frames.psframe(survey, AREA, ["priority", "segment", "year", "status", "y"])


@query
def psframe_weighted(spark, folder):
    """Cells weighted by quantity instead of counted."""
    out = frames.psframe(lines(spark, folder), AREA, ["priority", "line_status"], "l_quantity")
    return rounded(out, "n")


@query
def cell_share(spark, folder):
    out = frames.cell_share(respondents(spark, folder), AREA, ["priority", "segment"])
    return rounded(out, "prob")


@query
def marginal(spark, folder):
    out = frames.marginal(respondents(spark, folder), AREA, "segment")
    return rounded(out, "marginal_segment")


@query
def marginals_long(spark, folder):
    out = frames.marginals_long(respondents(spark, folder), AREA, ["priority", "segment", "status"])
    return rounded(out, "share")


@query
def share_by_totals(spark, folder):
    survey = respondents(spark, folder)
    counts = settle(frames.psframe(survey, AREA, ["priority"]), "counts")
    totals = counts.groupBy(AREA).agg(F.sum("n").alias("num_respondents"))
    out = frames.share_of_totals(counts, totals, "n", "num_respondents", "prob_priority")
    return rounded(out.select(AREA, "priority", "prob_priority"), "prob_priority")


def _synthetic(cells, inner, extra, attributes=()):
    joint = frames.cell_share(cells, AREA, inner, "n", attributes)
    return frames.synthetic_frame(joint, frames.marginals(cells, AREA, extra, "n"), AREA)


@query
def synthetic_frame(spark, folder):
    cells = tally(spark, folder, ["priority", "segment", "status"])
    out = _synthetic(cells, ["priority"], ["segment", "status"])
    return out.withColumn("prob", F.round("prob", 9))


@query
def synthetic_estimate(spark, folder):
    cells = tally(spark, folder, ["priority", "segment", "status"])
    scored = FIXED.score(_synthetic(cells, ["priority"], ["segment", "status"]))
    return rounded(ps.poststratify(scored, AREA, weight="prob"), "estimate")


# --- sampling --------------------------------------------------------------


@query
def sample_uniform(spark, folder):
    orders = source(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.sample_uniform(orders, SAMPLE, "o_orderkey", 42)


@query
def sample_weighted(spark, folder):
    orders = source(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return sampling.sample_weighted(orders, SAMPLE, "o_orderkey", "o_totalprice", 42)


@query
def sample_biased(spark, folder):
    """Weights from a covariate and a bonus per level, as for a biased panel."""
    bonus = {"1-URGENT": 8.0, "2-HIGH": 6.0, "3-MEDIUM": 4.0, "4-NOT SPECIFIED": 2.0}
    weight = 0.2 * F.col("o_totalprice") / 10000 + rc.recode("o_orderpriority", bonus, 0.5)
    orders = source(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return sampling.sample_weighted(orders, SAMPLE, "o_orderkey", weight, 42)


@query
def sample_disaggregate(spark, folder):
    """Means by area in a uniform sample."""
    drawn = sampling.sample_uniform(complete(spark, folder), SAMPLE, "caseid", 42)
    return rounded(ps.disaggregate(drawn, AREA, "y"), "estimate")


# --- fitting and scoring ---------------------------------------------------


@query
def poststratify_fixed_coefs(spark, folder):
    frame = frames.psframe(respondents(spark, folder), AREA, ["priority", "segment"])
    return rounded(ps.poststratify(FIXED.score(frame), AREA), "estimate")


def _mrp(cells, spec, fitter=fit_linear, **kwargs):
    """Fit on weighted cells, score the frame taken from them, average by area."""
    fit = fitter(cells, spec.but(weight="n"), **kwargs)
    individual = [c for c in spec.columns if c not in (AREA, "division", "covariate")]
    attributes = [c for c in spec.columns if c in ("division", "covariate")]
    frame = frames.psframe(cells, AREA, individual, "n", attributes)
    return rounded(ps.poststratify(fit.score(frame), AREA), "estimate")


@query
def glm_saturated(spark, folder):
    """One factor: fitted probabilities are the group means."""
    cells = tally(spark, folder, ["segment"])
    fit = fit_linear(cells, ModelSpec("y", ["segment"], weight="n"))
    frame = frames.psframe(cells, [], ["segment"], "n")
    return rounded(fit.score(frame), "predicted_probability")


@query
def mrp_null_model(spark, folder):
    """Without predictors every area gets the overall mean."""
    return _mrp(tally(spark, folder, []), ModelSpec("y"))


@query
def mrp_fixed_effects_self(spark, folder):
    """Area terms on their own training cells give back the area means."""
    return _mrp(tally(spark, folder), ModelSpec("y", ["priority", "segment", AREA]))


@query
def mrp_aliased_linear_self(spark, folder):
    """The same under a linear model whose area covariate is aliased."""
    cells = tally(spark, folder, ["priority"], ["covariate"])
    return _mrp(cells, ModelSpec("y", ["priority", AREA, "covariate"], family="gaussian"))


@query
def glm_logit_1x(spark, folder):
    fit = fit_linear(complete(spark, folder), ModelSpec("y", ["balance"]))
    return rounded(fit.coefficients().select("term", "estimate"), "estimate")


@query
def coef_table(spark, folder):
    fit = fit_linear(complete(spark, folder), ModelSpec("y", ["balance"]))
    return rounded(fit.coefficients(), "estimate", "std_error", "conf_low", "conf_high")


@query
def ols_1x(spark, folder):
    fit = fit_linear(complete(spark, folder), ModelSpec("y", ["balance"], family="gaussian"))
    return rounded(fit.coefficients().select("term", "estimate", "std_error"), "estimate", "std_error")


@query
def ols_2x(spark, folder):
    spec = ModelSpec("l_extendedprice", ["l_quantity", "l_discount"], family="gaussian")
    fit = fit_linear(source(spark, folder, "lineitem"), spec)
    return fit.coefficients().select("term", F.round("estimate", 3).alias("estimate"))


@query
def areas_logit_table(spark, folder):
    """Area effects of a logistic model with their intervals, the areas eliminated."""
    fit = fit_linear(tally(spark, folder, []), ModelSpec("y", [AREA], weight="n"), eliminate=True)
    return rounded(fit.coefficients(), "estimate", "std_error", "conf_low", "conf_high")


@query
def areas_linear_table(spark, folder):
    """A slope within areas, area effects and their intervals, the areas eliminated."""
    spec = ModelSpec("y", ["balance", AREA], family="gaussian")
    fit = fit_linear(complete(spark, folder), spec, eliminate=True)
    return rounded(fit.coefficients(), "estimate", "std_error", "conf_low", "conf_high")


@query
def mrp_fixed_effects_long(spark, folder):
    """Fixed effects of areas beside other terms, the areas eliminated."""
    spec = ModelSpec("y", ["priority", "segment", AREA])
    return _mrp(tally(spark, folder), spec, fit_linear, eliminate=True)


@query
def group_ols(spark, folder):
    out = ps.group_line(complete(spark, folder), "segment", "balance", "y")
    return rounded(out, "intercept", "slope")


@query
def roster_scores(spark, folder):
    """Every customer scored by a fitted line, then averaged by segment."""
    spec = ModelSpec("y", ["balance", "segment"], family="gaussian")
    fit = fit_linear(complete(spark, folder), spec)
    scored = fit.score(customers(spark, folder), "predicted")
    means = scored.groupBy("segment").agg(F.avg("predicted").alias("mean_predicted"))
    return rounded(means, "mean_predicted")


@query
def roster_average(spark, folder):
    """One mean over the whole scored roster."""
    fit = fit_linear(complete(spark, folder), ModelSpec("y", ["balance"], family="gaussian"))
    scored = score_roster(fit, customers(spark, folder), "predicted")
    return rounded(roster_mean(scored, "predicted", "mean_predicted"), "mean_predicted")


@query
def mrsp_identity(spark, folder):
    """Synthetic frame under an additive linear model equals the joint frame."""
    cells = tally(spark, folder)
    spec = ModelSpec("y", ["priority", "segment", AREA], family="gaussian", weight="n")
    frame = _synthetic(cells, ["priority"], ["segment"])
    scored = fit_linear(cells, spec).score(frame)
    return rounded(ps.poststratify(scored, AREA, weight="prob"), "estimate")


@query
def mrsp_from_marginals(spark, folder):
    """The same kind of estimate without expanding a single cell."""
    cells = tally(spark, folder)
    spec = ModelSpec("y", ["priority", "segment"], family="gaussian", weight="n")
    parts = frames.marginals(cells, AREA, ["priority", "segment"], "n")
    return rounded(marginal_mean(fit_linear(cells, spec), parts), "estimate")


# --- evaluation ------------------------------------------------------------


def _sample_and_truth(spark, folder):
    survey = settle(complete(spark, folder).select("caseid", AREA, "priority", "y"), "survey")
    truth = ps.area_mean(survey, [AREA, "priority"], "y")
    drawn = sampling.sample_uniform(survey, 400, "caseid", 42)
    return truth, ps.disaggregate(drawn, [AREA, "priority"], "y")


@query
def evaluate_estimates(spark, folder):
    """Areas with an estimate only."""
    truth, estimates = _sample_and_truth(spark, folder)
    joined = evaluate.join_truth(estimates, truth, [AREA, "priority"])
    return rounded(evaluate.metrics(joined), "correlation", "mean_abs_error")


@query
def evaluate_truth(spark, folder):
    """Every area: strict (missing if one estimate is) and lenient."""
    truth, estimates = _sample_and_truth(spark, folder)
    joined = evaluate.join_truth(estimates, truth, [AREA, "priority"], "truth")
    pair = F.col("estimate"), F.col("truth")
    return joined.agg(
        r6(stats.pearson(*pair)).alias("strict_correlation"),
        r6(stats.mean_abs_error(*pair)).alias("strict_error"),
        r6(stats.pearson(*pair, na="skip")).alias("correlation"),
        r6(stats.mean_abs_error(*pair, na="skip")).alias("mean_abs_error"),
    )


@query
def compare_rounded(spark, folder):
    """The published summary: correlation to two digits, error to three."""
    truth, estimates = _sample_and_truth(spark, folder)
    _, summary = evaluate.compare_to_truth(estimates, truth, [AREA, "priority"])
    return evaluate.with_caption(summary)


@query
def caterpillar(spark, folder):
    survey = settle(complete(spark, folder).select("caseid", AREA, "priority", "segment", "y"), "survey")
    target = ps.disaggregate(survey, AREA, "y", out="pct_support", num="num_respondents")
    drawn = ps.disaggregate(sampling.sample_uniform(survey, SAMPLE, "caseid", 42), AREA, "y")
    scored = FIXED.score(frames.psframe(survey, AREA, ["priority", "segment"]))
    out = evaluate.caterpillar(target, drawn, ps.poststratify(scored, AREA), AREA)
    return rounded(out, "pct_support", "conf_low", "conf_high", "sample_estimate", "model_estimate")


# --- limits of the multilevel, penalised and stacked models -----------------


RANDOM_AREA = ModelSpec("y", [], [(AREA, [])])


@query
def multilevel_pooled(spark, folder):
    """Group variance near zero: the overall mean everywhere."""
    return _mrp(tally(spark, folder, []), RANDOM_AREA, fit_multilevel, covariance=[[1e-10]])


@query
def multilevel_unpooled(spark, folder):
    """Huge group variance: the group means."""
    return _mrp(tally(spark, folder, []), RANDOM_AREA, fit_multilevel, covariance=[[1e9]])


@query
def multilevel_given_variance(spark, folder):
    """Random intercepts of known variance: partial pooling in between."""
    return _mrp(tally(spark, folder, []), RANDOM_AREA, fit_multilevel, covariance=[[0.05]])


@query
def multilevel_areas(spark, folder):
    """Random intercepts of estimated variance, at the Laplace optimum."""
    return _mrp(tally(spark, folder, []), RANDOM_AREA, fit_multilevel)


@query
def lasso_1x(spark, folder):
    fit = fit_lasso(complete(spark, folder), ModelSpec("y", ["balance"]), penalty=0.001)
    return rounded(fit.coefficients(), "estimate")


@query
def lasso_factors(spark, folder):
    """Three factors; most levels are shrunk to zero."""
    spec = ModelSpec("y", ["priority", "segment", AREA], weight="n")
    fit = fit_lasso(tally(spark, folder), spec, penalty=0.003)
    # Four digits: the learner stops within about 1e-7 of the optimum.
    return fit.coefficients().withColumn("estimate", F.round("estimate", 4))


@query
def lasso_full_penalty(spark, folder):
    """A penalty above every gradient leaves the overall mean."""
    spec = ModelSpec("y", ["priority", "segment", AREA])
    return _mrp(tally(spark, folder), spec, fit_lasso, penalty=1.0)


@query
def stack_weights(spark, folder):
    """Weights of an overall mean and of group means, from five folds."""
    fold = {"fold": stats.fold_of(["caseid"], 5, 42)}
    cells = tally(spark, folder, ["priority"], extra=fold)
    learners = {
        "overall": lambda df, spec: fit_linear_cells(df, spec.but(fixed=())),
        "by_priority": linear_learner(),
    }
    spec = ModelSpec("y", ["priority"], weight="n")
    fit = fit_stack(cells, spec, learners, folds=5, fold="fold")
    return rounded(fit.member_table(), "weight", "cv_risk")


# --- estimates of the full models ----------------------------------------


BOTH = ("division", "covariate")
PARTIAL = ModelSpec("y", ["priority", "segment"], [("division", ["covariate"])])
PENALISED = ModelSpec("y", ["priority", "segment", AREA, "covariate"])
ENSEMBLE = ModelSpec("y", ["priority", "segment", *BOTH])


@query
def mrp_complete_pooling(spark, folder):
    return _mrp(tally(spark, folder), ModelSpec("y", ["priority", "segment"]))


@query
def mrp_from_sample(spark, folder):
    """Fit on a uniform sample, estimate for all respondents, compare with the truth."""
    survey = complete(spark, folder).select("caseid", AREA, "priority", "segment", "y")
    survey = settle(survey, "survey")
    drawn = settle(sampling.sample_uniform(survey, SAMPLE, "caseid", 42), "sample")
    fit = fit_linear(drawn, ModelSpec("y", ["priority", "segment"]))
    frame = frames.psframe(survey, AREA, ["priority", "segment"])
    estimates = ps.poststratify(fit.score(frame), AREA)
    out = evaluate.join_truth(estimates, ps.area_mean(survey, AREA, "y"), AREA)
    return rounded(out, "estimate", "truth")


@query
def mrp_partial_pooling(spark, folder):
    return _mrp(tally(spark, folder, attributes=BOTH), PARTIAL, fit_multilevel)


@query
def mrsp_multilevel(spark, folder):
    """Multilevel model on a synthetic frame."""
    cells = tally(spark, folder, attributes=BOTH)
    frame = _synthetic(cells, ["priority"], ["segment"], BOTH)
    scored = fit_multilevel(cells, PARTIAL.but(weight="n")).score(frame)
    return rounded(ps.poststratify(scored, AREA, weight="prob"), "estimate")


@query
def mrp_lasso(spark, folder):
    return _mrp(tally(spark, folder, attributes=["covariate"]), PENALISED, fit_lasso, penalty=0.01)


@query
def lasso_coefs(spark, folder):
    cells = tally(spark, folder, attributes=["covariate"])
    fit = fit_lasso(cells, PENALISED.but(weight="n"), penalty=0.002)
    return rounded(fit.coefficients(), "estimate")


UNBAGGED = {"trees": 1, "bootstrap": False}


@query
def tree_one_factor(spark, folder):
    """One tree of all respondents on one factor: the leaves are the group means."""
    cells = tally(spark, folder, ["segment"])
    fit = fit_forest(cells, ModelSpec("y", ["segment"], weight="n"), **UNBAGGED)
    frame = frames.psframe(cells, [], ["segment"], "n")
    return rounded(fit.score(frame), "predicted_probability")


@query
def mrp_tree_self(spark, folder):
    """One tree of all respondents that may try every term ends at the cells."""
    cells = tally(spark, folder, attributes=BOTH)
    return _mrp(cells, ENSEMBLE, fit_forest, tried=len(ENSEMBLE.fixed), **UNBAGGED)


@query
def mrp_forest(spark, folder):
    """500 bagged trees of any depth."""
    return _mrp(tally(spark, folder, attributes=BOTH), ENSEMBLE, fit_forest)


def _ensemble(cells, spec, **kwargs):
    """Forest and logistic regression, weighted by ten-fold cross-validation."""
    learners = {"forest": forest_learner(**kwargs), "glm": linear_learner()}
    return _mrp(cells, spec, fit_stack, learners=learners, folds=10, fold="fold")


def _ten_folds():
    return {"fold": stats.fold_of(["caseid"], 10, 42)}


@query
def mrp_stack(spark, folder):
    return _ensemble(tally(spark, folder, attributes=BOTH, extra=_ten_folds()), ENSEMBLE)


@query
def mrp_stack_trees(spark, folder):
    """The ensemble of members SQL can fit: a tree of all respondents, and group means."""
    cells = tally(spark, folder, ["priority", "segment"], extra=_ten_folds())
    learners = {
        "forest": forest_learner(tried=2, **UNBAGGED),
        "glm": lambda df, spec: fit_linear_cells(df, spec.but(fixed=("priority",))),
    }
    spec = ModelSpec("y", ["priority", "segment"])
    return _mrp(cells, spec, fit_stack, learners=learners, folds=10, fold="fold")


@query
def best_full_joint(spark, folder):
    """The ensemble on the full joint frame, order year included."""
    cells = tally(spark, folder, ["priority", "segment", "year"], BOTH, _ten_folds())
    return _ensemble(cells, ENSEMBLE.but(fixed=[*ENSEMBLE.fixed, "year"]))


@query
def glm_probabilities(spark, folder):
    """Link and response scale agree on every cell."""
    frame = frames.psframe(respondents(spark, folder), AREA, ["priority", "segment"])
    scored = FIXED.score(FIXED.score(frame, "eta", scale="link"), "p")
    return scored.select(
        AREA, "priority", "segment", r6("eta").alias("eta"), r6("p").alias("p"),
        r6(stats.inverse_logit(F.col("eta"))).alias("p_from_eta"),
    )
