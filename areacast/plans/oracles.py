"""The registered queries as plain SQL over the same tables."""

from __future__ import annotations

# The order survey, as in orders_survey.py.
SURVEY = """
cov AS (SELECT s_nationkey, avg(s_acctbal) AS covariate FROM supplier GROUP BY s_nationkey),
survey AS (
  SELECT o_orderkey AS caseid, n_name AS abb, r_name AS division, o_orderpriority AS priority,
         c_mktsegment AS segment, CAST(year(o_orderdate) AS INTEGER) AS year,
         o_orderstatus AS status, c_acctbal / 1000 AS balance, covariate,
         CASE o_orderstatus WHEN 'F' THEN CAST(1 AS DOUBLE) WHEN 'O' THEN CAST(0 AS DOUBLE) END AS y
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN cov ON s_nationkey = n_nationkey),
done AS (SELECT * FROM survey WHERE y IS NOT NULL)
"""
WITH = f"WITH {SURVEY}"
CODE = "CAST(substring(o_orderpriority, 1, 1) AS INTEGER)"
U = "((CAST('0x' || substring(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"
FIXED_ETA = """-0.25
  + CASE priority WHEN '1-URGENT' THEN 0.0 WHEN '2-HIGH' THEN 0.1 WHEN '3-MEDIUM' THEN -0.2
                  WHEN '4-NOT SPECIFIED' THEN 0.3 WHEN '5-LOW' THEN -0.4 END
  + CASE segment WHEN 'AUTOMOBILE' THEN 0.0 WHEN 'BUILDING' THEN 0.15 WHEN 'FURNITURE' THEN -0.05
                 WHEN 'HOUSEHOLD' THEN 0.25 WHEN 'MACHINERY' THEN -0.35 END"""
P_FIXED = f"1 / (1 + exp(-CAST({FIXED_ETA} AS DOUBLE)))"
AREA_MEAN = f"{WITH} SELECT abb, round(avg(y), 6) AS estimate FROM done GROUP BY abb"
OVERALL_MEAN = f"""{WITH} SELECT abb, round((SELECT avg(y) FROM done), 6) AS estimate
FROM done GROUP BY abb"""
DRAWN = "ORDER BY md5(CAST(caseid AS VARCHAR) || ':42'), caseid LIMIT"
LINES = f"""{WITH}, lines AS (
  SELECT abb, priority, l_linestatus AS line_status, l_quantity,
         CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS returned
  FROM lineitem JOIN survey ON l_orderkey = caseid)"""
NEWTON = f"""WITH RECURSIVE {SURVEY},
d AS (SELECT balance AS x, sum(y) AS s, count(*) AS n FROM done GROUP BY balance),
it AS (
  SELECT 0 AS k, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1,
         CAST(0 AS DOUBLE) AS v0, CAST(0 AS DOUBLE) AS v1
  UNION ALL
  SELECT k + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01),
         b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01),
         h11 / (h00 * h11 - h01 * h01), h00 / (h00 * h11 - h01 * h01)
  FROM (
    SELECT k, b0, b1, sum(n * p * (1 - p)) AS h00, sum(n * p * (1 - p) * x) AS h01,
           sum(n * p * (1 - p) * x * x) AS h11, sum(s - n * p) AS g0, sum((s - n * p) * x) AS g1
    FROM (SELECT k, b0, b1, x, s, n, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM it, d WHERE k < 9)
    GROUP BY k, b0, b1)),
fin AS (SELECT * FROM it WHERE k = 9),
coefs AS (SELECT '(Intercept)' AS term, b0 AS b, sqrt(v0) AS se FROM fin
          UNION ALL SELECT 'balance', b1, sqrt(v1) FROM fin)"""
SAMPLE_AND_TRUTH = f"""{WITH},
truth AS (SELECT abb, priority, avg(y) AS truth FROM done GROUP BY abb, priority),
est AS (SELECT abb, priority, avg(y) AS estimate
        FROM (SELECT * FROM done {DRAWN} 400) GROUP BY abb, priority)"""
SYNTHETIC = f"""{WITH},
tot AS (SELECT abb, CAST(count(*) AS DOUBLE) AS t FROM done GROUP BY abb),
joint AS (SELECT abb, priority, count(*) / any_value(t) AS p0 FROM done JOIN tot USING (abb) GROUP BY abb, priority),
m1 AS (SELECT abb, segment, count(*) / any_value(t) AS p1 FROM done JOIN tot USING (abb) GROUP BY abb, segment),
m2 AS (SELECT abb, status, count(*) / any_value(t) AS p2 FROM done JOIN tot USING (abb) GROUP BY abb, status),
syn AS (SELECT abb, priority, segment, status, p0 * p1 * p2 AS prob
        FROM joint JOIN m1 USING (abb) JOIN m2 USING (abb))"""


def _two_way(link: str, rows: str = "done") -> str:
    """Additive model of two factors on its 25 cells, by alternating exact updates."""
    mu, weight = {
        "logit": ("1 / (1 + exp(-eta))", "n * mu * (1 - mu)"),
        "identity": ("eta", "n"),
    }[link]
    state = "k, priority, segment, s, n, eta"

    def update(source: str, factor: str, step: int) -> str:
        return f"""SELECT k + {step} AS k, priority, segment, s, n,
          eta + sum(s - n * mu) OVER (PARTITION BY {factor}) / sum({weight}) OVER (PARTITION BY {factor}) AS eta
          FROM (SELECT {state}, {mu} AS mu FROM ({source}))"""

    inner = update("SELECT * FROM it WHERE k < 40", "priority", 0)
    return f"""WITH RECURSIVE {SURVEY},
    it AS (SELECT 0 AS k, priority, segment, sum(y) AS s, CAST(count(*) AS DOUBLE) AS n,
                  CAST(0 AS DOUBLE) AS eta FROM {rows} GROUP BY priority, segment
           UNION ALL {update(inner, "segment", 1)}),
    fit AS (SELECT priority, segment, {mu} AS mu FROM it WHERE k = 40)"""


# Random intercepts of known variance 0.05, by alternating exact updates.
GIVEN_VARIANCE = f"""WITH RECURSIVE {SURVEY},
it AS (SELECT 0 AS k, abb, sum(y) AS s, CAST(count(*) AS DOUBLE) AS n,
              CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS u FROM done GROUP BY abb
       UNION ALL
       SELECT k + 1, abb, s, n, b,
              u + (s - n * p - u / 0.05) / (n * p * (1 - p) + 1 / 0.05)
       FROM (SELECT *, 1 / (1 + exp(-(b + u))) AS p
             FROM (SELECT k, abb, s, n, u, b + sum(s - n * p) OVER () / sum(n * p * (1 - p)) OVER () AS b
                   FROM (SELECT *, 1 / (1 + exp(-(b + u))) AS p FROM it WHERE k < 4000))))"""

# Random intercepts of estimated variance v at the Laplace optimum: joint Newton steps
# for the mean b and the effects u, and a ratio step for v, from the derivatives of
# the approximate likelihood.
LAPLACE = f"""WITH RECURSIVE {SURVEY},
it AS (SELECT 0 AS k, abb, sum(y) AS s, CAST(count(*) AS DOUBLE) AS n,
              CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS u, CAST(0.1 AS DOUBLE) AS v
       FROM done GROUP BY abb
       UNION ALL
       SELECT k + 1, abb, s, n, b + db, v * h * (w * u + r - w * db),
              v * greatest(0.2, least(5, sum(r * r - r * h * t) OVER () / sum(w * h) OVER ()))
       FROM (SELECT *, sum(h * (r + w * u - 0.5 * t)) OVER () / sum(w * h) OVER () AS db
             FROM (SELECT *, w * (1 - 2 * p) * v * h AS t
             FROM (SELECT *, n * p * (1 - p) AS w, s - n * p AS r, 1 / (1 + v * n * p * (1 - p)) AS h
                   FROM (SELECT *, 1 / (1 + exp(-(b + u))) AS p FROM it WHERE k < 3000)))))"""

# One standardised predictor under an L1 penalty of 0.001, by coordinate steps.
LASSO_1X = f"""WITH RECURSIVE {SURVEY},
m AS (SELECT avg(balance) AS mx, stddev_pop(balance) AS sx, count(*) AS nn FROM done),
d AS (SELECT (balance - mx) / sx AS x, sum(y) AS s, count(*) AS n FROM done, m GROUP BY 1),
it AS (SELECT 0 AS k, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1
       UNION ALL
       SELECT k + 1, b0 + g0 / h0,
              CASE WHEN abs(b1 * h1 + g1) <= 0.001 * nn THEN 0
                   ELSE sign(b1 * h1 + g1) * (abs(b1 * h1 + g1) - 0.001 * nn) / h1 END
       FROM (SELECT k, b0, b1, sum(s - n * p) AS g0, sum(n * p * (1 - p)) AS h0,
                    sum((s - n * p) * x) AS g1, sum(n * p * (1 - p) * x * x) AS h1
             FROM (SELECT k, b0, b1, x, s, n, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM it, d WHERE k < 40)
             GROUP BY k, b0, b1), m),
fin AS (SELECT * FROM it, m WHERE k = 40)"""

# Three factors under an L1 penalty of 0.003, by proximal gradient steps on
# standardised dummies; term 0 is the intercept.
LASSO_FACTORS = f"""WITH RECURSIVE {SURVEY},
cells AS (SELECT row_number() OVER () AS c, * FROM (
  SELECT priority, segment, abb, sum(y) AS s, CAST(count(*) AS DOUBLE) AS n FROM done GROUP BY ALL)),
total AS (SELECT sum(n) AS nn FROM cells),
marks AS (SELECT c, n, unnest(['priority' || priority, 'segment' || segment, 'abb' || abb]) AS term FROM cells),
kinds AS (SELECT term, sum(n) AS size,
                 CASE WHEN term LIKE 'pri%' THEN 1 WHEN term LIKE 'seg%' THEN 2 ELSE 3 END AS factor
          FROM marks GROUP BY term),
terms AS (SELECT row_number() OVER (ORDER BY term) AS j, term, size / nn AS m,
                 sqrt(size / nn * (1 - size / nn)) AS sd
          FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY term) AS place FROM kinds), total
          WHERE place > 1),
x AS (SELECT cells.c, j, (CASE WHEN marks.term IS NULL THEN 0 ELSE 1 END - m) / sd AS x, s, cells.n
      FROM cells CROSS JOIN terms LEFT JOIN marks ON marks.c = cells.c AND marks.term = terms.term
      UNION ALL SELECT c, 0, 1, s, n FROM cells),
it AS (SELECT 0 AS k, j, CAST(0 AS DOUBLE) AS b FROM (SELECT DISTINCT j FROM x)
       UNION ALL
       SELECT k + 1, j,
              CASE WHEN j = 0 THEN b + g / 0.5
                   WHEN abs(b + g / 0.5) <= 0.003 / 0.5 THEN 0
                   ELSE sign(b + g / 0.5) * (abs(b + g / 0.5) - 0.003 / 0.5) END
       FROM (SELECT any_value(k) AS k, j, any_value(b) AS b, sum(x * (s - n / (1 + exp(-eta)))) / any_value(nn) AS g
             FROM (SELECT k, j, b, x, s, n, sum(x * b) OVER (PARTITION BY c) AS eta
                   FROM (SELECT k, it.j, b, c, x, s, n FROM it JOIN x ON it.j = x.j WHERE k < 1200)), total
             GROUP BY j)),
fin AS (SELECT j, b FROM it WHERE k = 1200)"""


def _orders(expressions: str, where: str = "") -> str:
    return f"SELECT o_orderkey, {expressions} FROM orders {where}"


def _shares(by: str, variable: str, out: str) -> str:
    return f"""SELECT {by}, {variable}, count(*) AS n,
      round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY {by}) AS DOUBLE), 6) AS {out}
      FROM survey GROUP BY {by}, {variable}"""


ORACLES: dict[str, str] = {
    "csv_roundtrip": f"""SELECT o_orderkey AS order_key, o_orderstatus AS cc20_334d,
        {CODE} AS priority_code, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS total_price
        FROM orders""",
    "clean_names": """SELECT o_orderkey AS case_id, o_orderstatus AS order_status,
        o_orderpriority AS order_status_2 FROM orders""",
    "table_roundtrip": f"{WITH} SELECT caseid, priority, y, abb FROM survey",
    "survey_shape": f"{WITH} SELECT count(*) AS n_rows, CAST(9 AS BIGINT) AS n_columns FROM survey",
    "recode_binary": _orders(
        "CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' END AS label"
    ),
    "recode_map": _orders(
        f"""CASE {CODE} WHEN 1 THEN 'urgent' WHEN 2 THEN 'high' WHEN 3 THEN 'medium'
            WHEN 4 THEN 'unspecified' END AS label"""
    ),
    "recode_default": _orders(
        f"""CASE CASE WHEN o_orderstatus <> 'P' THEN {CODE} END WHEN 1 THEN 'White' WHEN 2 THEN 'Black'
            WHEN 3 THEN 'Hispanic' WHEN 4 THEN 'Asian' ELSE 'Other' END AS label"""
    ),
    "recode_sets": _orders(
        f"""CASE WHEN {CODE} = 1 THEN 'Urban' WHEN {CODE} IN (2, 3, 5) THEN 'Suburban'
            WHEN {CODE} = 4 THEN 'Rural' END AS label"""
    ),
    "band": """SELECT l_returnflag, CASE WHEN v < 10 THEN '0-9' WHEN v < 20 THEN '10-19'
          WHEN v < 30 THEN '20-29' WHEN v < 40 THEN '30-39' WHEN v < 50 THEN '40-49' ELSE '50+' END AS band,
          count(*) AS n
        FROM (SELECT l_returnflag, CASE WHEN l_returnflag <> 'A' THEN l_quantity END AS v FROM lineitem)
        GROUP BY ALL""",
    "age_from_year": _orders("CAST(2020 - year(o_orderdate) AS INTEGER) AS age"),
    "indicator": _orders(
        f"CASE WHEN o_orderstatus <> 'P' THEN CAST({CODE} = 1 AS DOUBLE) END AS urgent"
    ),
    "any_of": _orders(
        f"""CAST((CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END) OR {CODE} = 1 AS DOUBLE) AS any_item,
            CAST(o_orderstatus = 'F' OR {CODE} = 1 AS DOUBLE) AS any_item_no_null"""
    ),
    "flip_outcome": _orders(
        "CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0 END AS support"
    ),
    "not_member": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'",
    "dimension_join": f"{WITH} SELECT caseid, abb, division FROM survey",
    "distinct_areas": f"""{WITH} SELECT abb, division, count(DISTINCT y) AS n_outcomes
        FROM survey GROUP BY abb, division""",
    "area_dimension": """SELECT DISTINCT n_name AS abb, r_name AS division FROM customer
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "area_number": f"""{WITH} SELECT count(DISTINCT abb) AS n_areas,
        count(DISTINCT division) AS n_divisions FROM survey""",
    "large_areas": f"""{WITH} SELECT caseid, abb FROM survey WHERE abb IN
        (SELECT abb FROM survey GROUP BY abb HAVING count(*) > 600)""",
    "area_counts": f"{WITH} SELECT abb, count(*) AS n FROM survey GROUP BY abb HAVING count(*) > 600",
    "complete_cases": f"{WITH} SELECT caseid, y FROM survey WHERE y IS NOT NULL",
    "clean_survey": f"""{WITH}, tidy AS (
        SELECT caseid, CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 'high'
                 WHEN priority = '3-MEDIUM' THEN 'mid' ELSE 'low' END AS level,
               CASE segment WHEN 'AUTOMOBILE' THEN 'A' WHEN 'BUILDING' THEN 'B'
                 WHEN 'FURNITURE' THEN 'F' WHEN 'HOUSEHOLD' THEN 'H' END AS sector,
               CASE WHEN balance < 0 THEN 'debt' WHEN balance < 3 THEN 'low'
                 WHEN balance < 6 THEN 'mid' ELSE 'high' END AS balance_cat,
               abb, division, y, round(covariate, 6) AS covariate FROM survey)
        SELECT * FROM tidy
        WHERE abb IN (SELECT abb FROM tidy GROUP BY abb HAVING count(*) > 600)
          AND sector IS NOT NULL AND y IS NOT NULL AND covariate IS NOT NULL""",
    "area_covariates": f"""{WITH}, size AS (
        SELECT n_name AS abb, count(*) AS n_customers FROM customer
        JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
        SELECT survey.abb, round(max(covariate), 6) AS covariate, max(n_customers) AS n_customers,
               count(*) AS n
        FROM survey LEFT JOIN size ON survey.abb = size.abb GROUP BY survey.abb""",
    "null_key_join": """WITH o AS (SELECT o_orderkey,
          CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS label FROM orders),
        t AS (SELECT label, count(*) AS same FROM o GROUP BY label)
        SELECT o.o_orderkey, o.label, a.same, b.same AS plain FROM o
        LEFT JOIN t AS a ON o.label IS NOT DISTINCT FROM a.label LEFT JOIN t AS b ON o.label = b.label""",
    "natural_totals": f"""{WITH} SELECT abb, division, priority, count(*) AS n,
        CAST(sum(count(*)) OVER (PARTITION BY abb, division) AS BIGINT) AS num_respondents
        FROM survey GROUP BY abb, division, priority""",
    "pivot_wide": f"""{WITH} SELECT abb, nullif(count(*) FILTER (status = 'F'), 0) AS F,
        nullif(count(*) FILTER (status = 'O'), 0) AS O, nullif(count(*) FILTER (status = 'P'), 0) AS P
        FROM survey GROUP BY abb""",
    "two_party_share": f"""{WITH} SELECT abb, round(100 * CAST(count(*) FILTER (status = 'F') AS DOUBLE)
        / count(*) FILTER (status IN ('F', 'O')), 6) AS share FROM survey GROUP BY abb""",
    "area_mean": f"{WITH} SELECT abb, round(avg(y), 6) AS truth FROM done GROUP BY abb",
    "area_mean_missing": f"""{WITH} SELECT abb, priority,
        CASE WHEN count(y) = count(*) THEN round(avg(y), 6) END AS strict,
        round(avg(y), 6) AS lenient FROM survey GROUP BY abb, priority""",
    "disaggregate": f"""{WITH} SELECT abb, round(avg(y), 6) AS estimate, count(*) AS num
        FROM done GROUP BY abb""",
    "area_interval": f"""{WITH}, m AS (SELECT abb, avg(y) AS p, count(*) AS n FROM done GROUP BY abb)
        SELECT abb, round(p, 6) AS pct_support, n AS num_respondents,
        round(p - 1.96 * sqrt(p * (1 - p) / n), 6) AS conf_low,
        round(p + 1.96 * sqrt(p * (1 - p) / n), 6) AS conf_high FROM m""",
    "first_areas": f"""{WITH}, m AS (SELECT abb, avg(y) AS e, count(*) AS num FROM done GROUP BY abb)
        SELECT abb, round(e, 6) AS estimate, num FROM m ORDER BY e, abb LIMIT 6""",
    "line_area_mean": f"""{LINES} SELECT abb, line_status, round(avg(returned), 6) AS estimate,
        count(*) AS num FROM lines GROUP BY abb, line_status""",
    "psframe": f"{WITH} SELECT abb, priority, segment, count(*) AS n FROM survey GROUP BY ALL",
    "psframe_attrs": f"""{WITH} SELECT abb, priority, division, round(covariate, 6) AS covariate,
        count(*) AS n FROM survey GROUP BY abb, priority, division, covariate""",
    "psframe_full": f"""{WITH} SELECT abb, priority, segment, year, status, y, count(*) AS n
        FROM survey GROUP BY ALL""",
    "psframe_weighted": f"""{LINES} SELECT abb, priority, line_status, round(sum(l_quantity), 6) AS n
        FROM lines GROUP BY abb, priority, line_status""",
    "cell_share": f"{WITH} {_shares('abb', 'priority, segment', 'prob')}",
    "marginal": f"{WITH} {_shares('abb', 'segment', 'marginal_segment')}",
    "marginals_long": f"""{WITH}, long AS (
        SELECT abb, 'priority' AS variable, priority AS level FROM survey
        UNION ALL SELECT abb, 'segment', segment FROM survey
        UNION ALL SELECT abb, 'status', status FROM survey)
        SELECT abb, variable, level, count(*) AS n,
        round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY abb, variable) AS DOUBLE), 6) AS share
        FROM long GROUP BY abb, variable, level""",
    "share_by_totals": f"""{WITH} SELECT abb, priority, round(count(*) /
        CAST(sum(count(*)) OVER (PARTITION BY abb) AS DOUBLE), 6) AS prob_priority
        FROM survey GROUP BY abb, priority""",
    "synthetic_frame": f"{SYNTHETIC} SELECT abb, priority, segment, status, round(prob, 9) AS prob FROM syn",
    "synthetic_estimate": f"""{SYNTHETIC} SELECT abb, round(sum(prob * {P_FIXED}) / sum(prob), 6) AS estimate
        FROM syn GROUP BY abb""",
    "sample_uniform": """SELECT o_orderkey, o_orderpriority FROM orders
        ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey LIMIT 3000""",
    "sample_weighted": f"""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0
        ORDER BY -ln({U}) / o_totalprice, o_orderkey LIMIT 3000""",
    "sample_biased": f"""SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
        ORDER BY -ln({U}) / (0.2::DOUBLE * o_totalprice / 10000 + CASE o_orderpriority
          WHEN '1-URGENT' THEN 8.0::DOUBLE WHEN '2-HIGH' THEN 6.0 WHEN '3-MEDIUM' THEN 4.0
          WHEN '4-NOT SPECIFIED' THEN 2.0 ELSE 0.5 END), o_orderkey LIMIT 3000""",
    "sample_disaggregate": f"""{WITH} SELECT abb, round(avg(y), 6) AS estimate, count(*) AS num
        FROM (SELECT * FROM done {DRAWN} 3000) GROUP BY abb""",
    "poststratify_fixed_coefs": f"""{WITH},
        f AS (SELECT abb, priority, segment, count(*) AS n FROM survey GROUP BY ALL)
        SELECT abb, round(sum(n * {P_FIXED}) / sum(n), 6) AS estimate FROM f GROUP BY abb""",
    "glm_saturated": f"""{WITH} SELECT segment, count(*) AS n,
        round(avg(y), 6) AS predicted_probability FROM done GROUP BY segment""",
    "areas_logit_table": f"""{WITH}, m AS (
          SELECT abb, ln(avg(y) / (1 - avg(y))) AS e, 1 / (count(*) * avg(y) * (1 - avg(y))) AS v
          FROM done GROUP BY abb),
        b AS (SELECT e AS e0, v AS v0 FROM m ORDER BY abb LIMIT 1),
        t AS (SELECT '(Intercept)' AS term, e0 AS e, sqrt(v0) AS se FROM b
              UNION ALL SELECT 'abb' || abb, e - e0, sqrt(v + v0) FROM m, b
              WHERE abb > (SELECT min(abb) FROM m))
        SELECT term, round(e, 6) AS estimate, round(se, 6) AS std_error,
        round(e - 1.959963984540054 * se, 6) AS conf_low, round(e + 1.959963984540054 * se, 6) AS conf_high FROM t""",
    "areas_linear_table": f"""{WITH}, m AS (
          SELECT abb, avg(y) AS ym, avg(balance) AS xm, CAST(count(*) AS DOUBLE) AS n,
                 regr_sxx(y, balance) AS sxx, regr_sxy(y, balance) AS sxy, regr_syy(y, balance) AS syy
          FROM done GROUP BY abb),
        s AS (SELECT sum(sxy) / sum(sxx) AS slope, sum(sxx) AS sxx,
                     (sum(syy) - sum(sxy) * sum(sxy) / sum(sxx)) / (sum(n) - count(*) - 1) AS s2 FROM m),
        e AS (SELECT abb, ym - slope * xm AS e, xm, n FROM m, s),
        b AS (SELECT e AS e0, xm AS x0, n AS n0 FROM e ORDER BY abb LIMIT 1),
        t AS (SELECT '(Intercept)' AS term, e0 AS e, sqrt(s2 * (1 / n0 + x0 * x0 / sxx)) AS se FROM b, s
              UNION ALL SELECT 'balance', slope, sqrt(s2 / sxx) FROM s
              UNION ALL SELECT 'abb' || abb, e - e0, sqrt(s2 * (1 / n + 1 / n0 + (xm - x0) * (xm - x0) / sxx))
              FROM e, b, s WHERE abb > (SELECT min(abb) FROM e))
        SELECT term, round(e, 6) AS estimate, round(se, 6) AS std_error,
        round(e - 1.959963984540054 * se, 6) AS conf_low, round(e + 1.959963984540054 * se, 6) AS conf_high FROM t""",
    "mrp_fixed_effects_long": AREA_MEAN,
    "mrp_null_model": OVERALL_MEAN,
    "mrp_fixed_effects_self": AREA_MEAN,
    "mrp_aliased_linear_self": f"""{WITH} SELECT abb, round(avg(y), 6) AS estimate
        FROM done WHERE covariate IS NOT NULL GROUP BY abb""",
    "glm_logit_1x": f"{NEWTON} SELECT term, round(b, 6) AS estimate FROM coefs",
    "coef_table": f"""{NEWTON} SELECT term, round(b, 6) AS estimate, round(se, 6) AS std_error,
        round(b - 1.959963984540054 * se, 6) AS conf_low,
        round(b + 1.959963984540054 * se, 6) AS conf_high FROM coefs""",
    "ols_1x": f"""{WITH}, m AS (
        SELECT regr_intercept(y, balance) AS a, regr_slope(y, balance) AS b,
               regr_sxx(y, balance) AS sxx, regr_syy(y, balance) AS syy, avg(balance) AS xm,
               count(*) AS n FROM done),
        v AS (SELECT *, (syy - b * b * sxx) / (n - 2) AS s2 FROM m)
        SELECT '(Intercept)' AS term, round(a, 6) AS estimate,
               round(sqrt(s2 * (1.0 / n + xm * xm / sxx)), 6) AS std_error FROM v
        UNION ALL SELECT 'balance', round(b, 6), round(sqrt(s2 / sxx), 6) FROM v""",
    "ols_2x": """WITH m AS (
        SELECT covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b,
               covar_pop(l_discount, l_discount) AS c, covar_pop(l_quantity, l_extendedprice) AS p,
               covar_pop(l_discount, l_extendedprice) AS q, avg(l_quantity) AS mx,
               avg(l_discount) AS mz, avg(l_extendedprice) AS my FROM lineitem),
        s AS (SELECT *, (p * c - q * b) / (a * c - b * b) AS bx, (q * a - p * b) / (a * c - b * b) AS bz FROM m)
        SELECT '(Intercept)' AS term, round(my - bx * mx - bz * mz, 3) AS estimate FROM s
        UNION ALL SELECT 'l_quantity', round(bx, 3) FROM s
        UNION ALL SELECT 'l_discount', round(bz, 3) FROM s""",
    "group_ols": f"""{WITH} SELECT segment, round(regr_intercept(y, balance), 6) AS intercept,
        round(regr_slope(y, balance), 6) AS slope FROM done GROUP BY segment""",
    "roster_scores": f"""{WITH}, g AS (
        SELECT segment, avg(y) AS my, avg(balance) AS mx, regr_sxy(y, balance) AS sxy,
               regr_sxx(y, balance) AS sxx FROM done GROUP BY segment),
        b AS (SELECT sum(sxy) / sum(sxx) AS slope FROM g),
        c AS (SELECT c_mktsegment AS segment, avg(c_acctbal / 1000) AS cx FROM customer GROUP BY 1)
        SELECT g.segment, round(my + slope * (cx - mx), 6) AS mean_predicted
        FROM g JOIN c ON g.segment = c.segment, b""",
    "roster_average": f"""{WITH}, m AS (
        SELECT regr_intercept(y, balance) AS a, regr_slope(y, balance) AS b FROM done)
        SELECT round(avg(a + b * c_acctbal / 1000), 6) AS mean_predicted FROM customer, m""",
    "mrsp_identity": AREA_MEAN,
    "evaluate_estimates": f"""{SAMPLE_AND_TRUTH} SELECT round(corr(estimate, truth), 6) AS correlation,
        round(avg(abs(estimate - truth)), 6) AS mean_abs_error
        FROM est JOIN truth USING (abb, priority)""",
    "evaluate_truth": f"""{SAMPLE_AND_TRUTH}
        SELECT CASE WHEN count(estimate) = count(*) THEN round(corr(estimate, truth), 6) END AS strict_correlation,
               CASE WHEN count(estimate) = count(*) THEN round(avg(abs(estimate - truth)), 6) END AS strict_error,
               round(corr(estimate, truth), 6) AS correlation,
               round(avg(abs(estimate - truth)), 6) AS mean_abs_error
        FROM truth LEFT JOIN est USING (abb, priority)""",
    "compare_rounded": f"""{SAMPLE_AND_TRUTH},
        s AS (SELECT round(corr(estimate, truth), 2) AS correlation,
                     round(avg(abs(estimate - truth)), 3) AS mean_abs_error
              FROM est JOIN truth USING (abb, priority))
        SELECT *, 'Correlation = ' || CAST(correlation AS VARCHAR) || ', Mean Absolute Error = '
               || CAST(mean_abs_error AS VARCHAR) AS caption FROM s""",
    "caterpillar": f"""{WITH},
        target AS (SELECT abb, avg(y) AS p, count(*) AS n FROM done GROUP BY abb),
        drawn AS (SELECT abb, avg(y) AS e FROM (SELECT * FROM done {DRAWN} 3000) GROUP BY abb),
        f AS (SELECT abb, priority, segment, count(*) AS n FROM done GROUP BY ALL),
        m AS (SELECT abb, sum(n * {P_FIXED}) / sum(n) AS e FROM f GROUP BY abb)
        SELECT target.abb, round(p, 6) AS pct_support, n AS num_respondents,
               round(p - 1.96 * sqrt(p * (1 - p) / n), 6) AS conf_low,
               round(p + 1.96 * sqrt(p * (1 - p) / n), 6) AS conf_high,
               round(drawn.e, 6) AS sample_estimate, round(m.e, 6) AS model_estimate
        FROM target LEFT JOIN drawn USING (abb) LEFT JOIN m USING (abb)""",
    "multilevel_pooled": OVERALL_MEAN,
    "multilevel_unpooled": AREA_MEAN,
    "multilevel_given_variance": f"""{GIVEN_VARIANCE}
        SELECT abb, round(1 / (1 + exp(-(b + u))), 6) AS estimate FROM it WHERE k = 4000""",
    "multilevel_areas": f"""{LAPLACE} SELECT abb, round(1 / (1 + exp(-(b + u))), 6) AS estimate
        FROM it WHERE k = 3000""",
    "lasso_full_penalty": OVERALL_MEAN,
    "lasso_1x": f"""{LASSO_1X} SELECT '(Intercept)' AS term, round(b0 - b1 * mx / sx, 6) AS estimate,
        CAST(0.001 AS DOUBLE) AS penalty FROM fin
        UNION ALL SELECT 'balance', round(b1 / sx, 6), CAST(0.001 AS DOUBLE) FROM fin""",
    "lasso_factors": f"""{LASSO_FACTORS}
        SELECT term, round(b / sd, 4) AS estimate, CAST(0.003 AS DOUBLE) AS penalty FROM fin JOIN terms USING (j)
        UNION ALL SELECT '(Intercept)', round(any_value(i.b) - sum(fin.b * m / sd), 4), CAST(0.003 AS DOUBLE)
        FROM fin JOIN terms USING (j), (SELECT b FROM fin WHERE j = 0) AS i""",
    "stack_weights": f"""{WITH},
        d AS (SELECT CAST('0x' || substring(md5(CAST(caseid AS VARCHAR) || ':fold:42'), 1, 13) AS BIGINT) % 5 AS fold,
                     priority, sum(y) AS s, CAST(count(*) AS DOUBLE) AS n FROM done GROUP BY ALL),
        z AS (SELECT s, n,
                (sum(s) OVER () - sum(s) OVER (PARTITION BY fold)) /
                (sum(n) OVER () - sum(n) OVER (PARTITION BY fold)) AS z1,
                (sum(s) OVER (PARTITION BY priority) - s) / (sum(n) OVER (PARTITION BY priority) - n) AS z2
              FROM d),
        g AS (SELECT sum(n * z1 * z1) AS a, sum(n * z1 * z2) AS b, sum(n * z2 * z2) AS c,
                     sum(s * z1) AS e, sum(s * z2) AS f, sum(s) AS q, sum(n) AS nn FROM z),
        w AS (SELECT *, (e * c - f * b) / (a * c - b * b) AS u1, (f * a - e * b) / (a * c - b * b) AS u2 FROM g),
        v AS (SELECT *, CASE WHEN u1 < 0 THEN 0 WHEN u2 < 0 THEN 1 ELSE u1 / (u1 + u2) END AS w1 FROM w)
        SELECT 'overall' AS learner, round(w1, 6) AS weight, round((q - 2 * e + a) / nn, 6) AS cv_risk FROM v
        UNION ALL SELECT 'by_priority', round(1 - w1, 6), round((q - 2 * f + c) / nn, 6) FROM v""",
    "tree_one_factor": f"""{WITH} SELECT segment, count(*) AS n,
        round(avg(y), 6) AS predicted_probability FROM done GROUP BY segment""",
    "mrp_tree_self": f"""{WITH} SELECT abb, round(avg(y), 6) AS estimate
        FROM done WHERE covariate IS NOT NULL GROUP BY abb""",
    "mrp_stack_trees": f"""{WITH},
        d AS (SELECT CAST('0x' || substring(md5(CAST(caseid AS VARCHAR) || ':fold:42'), 1, 13) AS BIGINT) % 10 AS fold,
                     priority, segment, sum(y) AS s, CAST(count(*) AS DOUBLE) AS n FROM done GROUP BY ALL),
        o AS (SELECT *, sum(s) OVER (PARTITION BY fold, priority) AS ps, sum(n) OVER (PARTITION BY fold, priority) AS pn
              FROM d),
        z AS (SELECT s, n,
                (sum(s) OVER (PARTITION BY priority) - ps) / (sum(n) OVER (PARTITION BY priority) - pn) AS z1,
                (sum(s) OVER (PARTITION BY priority, segment) - s) /
                (sum(n) OVER (PARTITION BY priority, segment) - n) AS z2
              FROM o),
        g AS (SELECT sum(n * z1 * z1) AS a, sum(n * z1 * z2) AS b, sum(n * z2 * z2) AS c,
                     sum(s * z1) AS e, sum(s * z2) AS f FROM z),
        w AS (SELECT *, (e * c - f * b) / (a * c - b * b) AS u1, (f * a - e * b) / (a * c - b * b) AS u2 FROM g),
        v AS (SELECT CASE WHEN u1 < 0 THEN 0 WHEN u2 < 0 THEN 1 ELSE u1 / (u1 + u2) END AS w1 FROM w),
        m AS (SELECT abb, avg(y) OVER (PARTITION BY priority) AS m1,
                     avg(y) OVER (PARTITION BY priority, segment) AS m2 FROM done)
        SELECT abb, round(avg(w1 * m1 + (1 - w1) * m2), 6) AS estimate FROM m, v GROUP BY abb""",
    "mrp_complete_pooling": f"""{_two_way('logit')},
        f AS (SELECT abb, priority, segment, count(*) AS n FROM done GROUP BY ALL)
        SELECT abb, round(sum(f.n * mu) / sum(f.n), 6) AS estimate
        FROM f JOIN fit USING (priority, segment) GROUP BY abb""",
    "mrp_from_sample": f"""{_two_way('logit', f'(SELECT * FROM done {DRAWN} 3000)')},
        f AS (SELECT abb, priority, segment, count(*) AS n, sum(y) AS s FROM done GROUP BY ALL)
        SELECT abb, round(sum(f.n * mu) / sum(f.n), 6) AS estimate, round(sum(f.s) / sum(f.n), 6) AS truth
        FROM f JOIN fit USING (priority, segment) GROUP BY abb""",
    "mrsp_from_marginals": f"""{_two_way('identity')},
        tot AS (SELECT abb, count(*) AS t FROM done GROUP BY abb),
        p AS (SELECT abb, priority, count(*) AS np FROM done GROUP BY ALL),
        q AS (SELECT abb, segment, count(*) AS nq FROM done GROUP BY ALL)
        SELECT abb, round(sum(CAST(np AS DOUBLE) * nq / (CAST(t AS DOUBLE) * t) * mu), 6) AS estimate
        FROM p JOIN q USING (abb) JOIN tot USING (abb) JOIN fit USING (priority, segment)
        GROUP BY abb""",
    "glm_probabilities": f"""{WITH} SELECT abb, priority, segment,
        round(CAST({FIXED_ETA} AS DOUBLE), 6) AS eta, round({P_FIXED}, 6) AS p,
        round({P_FIXED}, 6) AS p_from_eta FROM survey GROUP BY abb, priority, segment""",
}
