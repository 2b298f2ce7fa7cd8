"""Test statistics; the normal CDF is written out since DuckDB has none."""

from __future__ import annotations

import math
from statistics import NormalDist

from oracles.base import CTES, rnd

STATEMENTS: dict[str, str] = {}

Z = NormalDist().inv_cdf(0.975)
Z_POWER = NormalDist().inv_cdf(0.8)


def _horner(x: str, coefficients: list[str]) -> str:
    text = coefficients[0]
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c})"
    return text


def phi(e: str) -> str:
    """Standard normal CDF (Hart's approximation as given by West)."""
    top = _horner("a", ["3.52624965998911e-02", "0.700383064443688", "6.37396220353165", "33.912866078383",
                        "112.079291497871", "221.213596169931", "220.206867912376"])
    bottom = _horner("a", ["8.83883476483184e-02", "1.75566716318264", "16.064177579207", "86.7807322029461",
                           "296.564248779674", "637.333633378831", "793.826512519948", "440.413735824752"])
    far = "(a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65)))))"
    tail = (f"CASE WHEN a > 37 THEN 0 WHEN a < 7.07106781186547 THEN exp(-a * a / 2) * {top} / {bottom} "
            f"ELSE exp(-a * a / 2) / {far} / 2.506628274631 END")
    return (f"(SELECT CASE WHEN v > 0 THEN 1 - ({tail}) ELSE ({tail}) END "
            f"FROM (SELECT v, abs(v) AS a FROM (SELECT ({e})::DOUBLE AS v)))")


CTES["user_values"] = f"""
  SELECT p.customer_id, customer_segment, md5(p.customer_id)[1] < '8' AS low, answered,
    coalesce(answered, false) AS responded, f.customer_id IS NOT NULL AS converted,
    {rnd('wagered::DOUBLE / nullif(bets, 0)', 6)} AS avg_bet_size,
    (wagered - payouts - acquisition_cost)::DOUBLE AS customer_ltv,
    CASE WHEN num_deposits > 0 THEN deposits::DOUBLE END AS total_deposits
  FROM per_customer p LEFT JOIN first_deposits f USING (customer_id)
    LEFT JOIN (SELECT customer_id, bool_or(responded) AS answered FROM customer_campaigns GROUP BY 1)
      USING (customer_id)"""

CTES["rates"] = """
  SELECT customer_segment, metric, count(*) FILTER (low)::DOUBLE AS nc, count(*) FILTER (NOT low)::DOUBLE AS nt,
    count(*) FILTER (low AND hit)::DOUBLE AS xc, count(*) FILTER (NOT low AND hit)::DOUBLE AS xt
  FROM (SELECT customer_segment, low, 'responded' AS metric, responded AS hit FROM user_values
    UNION ALL SELECT customer_segment, low, 'converted', converted FROM user_values) GROUP BY 1, 2"""

STATEMENTS["ab_conversion"] = f"""
  WITH a AS (SELECT *, xc / nc AS pc, xt / nt AS pt, nc + nt AS n, xc + xt AS x FROM rates),
  b AS (
    SELECT *, pt - pc AS lift, x / n AS pool, greatest(abs(xc - nc * x / n) - 0.5, 0) AS off,
      sqrt(pc * (1 - pc) / nc + pt * (1 - pt) / nt) AS se FROM a),
  c AS (
    SELECT *, off * off * (1 / (nc * pool) + 1 / (nt * pool) + 1 / (nc * (1 - pool)) + 1 / (nt * (1 - pool))) AS chi2,
      abs(lift) / sqrt(pool * (1 - pool) * (1 / nc + 1 / nt)) AS z FROM b)
  SELECT customer_segment, metric, {rnd('pc', 6)} AS control_value, {rnd('pt', 6)} AS treatment_value,
    {rnd('lift', 6)} AS lift, {rnd('lift / pc * 100', 6)} AS lift_pct, {rnd('chi2', 6)} AS chi2,
    {rnd('2 * ' + phi('-sqrt(chi2)'), 6)} AS p_value, {rnd(f'lift - {Z} * se', 6)} AS ci_lower,
    {rnd(f'lift + {Z} * se', 6)} AS ci_upper, {rnd('2 * (asin(sqrt(pt)) - asin(sqrt(pc)))', 6)} AS effect_size,
    {rnd(phi(f'z - {Z}') + ' + ' + phi(f'-z - {Z}'), 6)} AS statistical_power,
    nc::BIGINT AS sample_size_control, nt::BIGINT AS sample_size_treatment,
    2 * {phi('-sqrt(chi2)')} < 0.05 AS is_significant
  FROM c"""

STATEMENTS["ab_z_test"] = f"""
  SELECT customer_segment, metric, {rnd('xc / nc', 6)} AS control_rate, {rnd('xt / nt', 6)} AS treatment_rate,
    {rnd('(xt / nt - xc / nc) / sqrt((xc + xt) / (nc + nt) * (1 - (xc + xt) / (nc + nt)) * (1 / nt + 1 / nc))', 6)}
      AS z_score,
    {rnd('xt / nt - 1.96 * sqrt(xt / nt * (1 - xt / nt) / nt)', 6)} AS ci_lower
  FROM rates"""

CTES["measured"] = """
  SELECT metric, answered AS treated, value FROM user_values
  UNPIVOT (value FOR metric IN (avg_bet_size, customer_ltv, total_deposits)) WHERE answered IS NOT NULL"""

CTES["arms"] = """
  SELECT metric, count(*) FILTER (NOT treated)::DOUBLE AS nc, count(*) FILTER (treated)::DOUBLE AS nt,
    avg(value) FILTER (NOT treated) AS mc, avg(value) FILTER (treated) AS mt,
    var_samp(value) FILTER (NOT treated) AS vc, var_samp(value) FILTER (treated) AS vt
  FROM measured GROUP BY 1"""


def _power(effect: str) -> str:
    root = "sqrt(nc * nt / (nc + nt) / 2)"
    return (f"CASE WHEN abs({effect}) > {Z} / {root} THEN "
            + phi(f"{root} * abs({effect}) - {Z}") + " ELSE 0.05 END")


STATEMENTS["ab_continuous_welch"] = f"""
  WITH a AS (
    SELECT *, mt - mc AS lift, vc / nc AS a, vt / nt AS b,
      (mt - mc) / sqrt(((nc - 1) * vc + (nt - 1) * vt) / (nc + nt - 2)) AS d FROM arms)
  SELECT metric, {rnd('mc', 6)} AS control_value, {rnd('mt', 6)} AS treatment_value, {rnd('lift', 6)} AS lift,
    CASE WHEN mc > 0 THEN {rnd('lift / mc * 100', 6)} ELSE 0 END AS lift_pct, {rnd('lift / sqrt(a + b)', 6)} AS t_stat,
    {rnd('sqrt(a + b)', 6)} AS se, {rnd('(a + b) * (a + b) / (a * a / (nc - 1) + b * b / (nt - 1))', 6)} AS df_welch,
    nc + nt - 2 AS df_interval, {rnd('d', 6)} AS effect_size, {rnd(_power('d'), 6)} AS statistical_power,
    nc::BIGINT AS sample_size_control, nt::BIGINT AS sample_size_treatment
  FROM a"""

STATEMENTS["ab_power"] = f"""
  SELECT metric, effect, nc::BIGINT AS sample_size_control, nt::BIGINT AS sample_size_treatment,
    {rnd(_power('effect'), 6)} AS statistical_power
  FROM (SELECT *, unnest([0.02, 0.05, 0.1, 0.2, 0.5, 1.0])::DOUBLE AS effect FROM arms)"""

EXACT = 10


def _rank_sum(source: str, label: str) -> str:
    """Normal approximation, and for small untied arms the exact law by counting rank after rank."""
    ways = ["ways0 AS (SELECT 0 AS j, 0 AS s, 1::DOUBLE AS c)"] + [
        f"ways{r} AS MATERIALIZED (SELECT j, s, sum(c) AS c FROM (SELECT * FROM ways{r - 1} UNION ALL "
        f"SELECT j + 1, s + {r}, c FROM ways{r - 1} WHERE j < {EXACT}) GROUP BY 1, 2)" for r in range(1, 2 * EXACT + 1)]
    every = " UNION ALL ".join(f"SELECT {r} AS r, * FROM ways{r}" for r in range(2, 2 * EXACT + 1))
    return f"""
  WITH {", ".join(ways)},
  law AS (
    SELECT r, j, s, sum(c) OVER (PARTITION BY r, j ORDER BY s DESC) / sum(c) OVER (PARTITION BY r, j) AS upper
    FROM ({every})),
  r AS (
    SELECT metric, treated, rank() OVER o + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0 AS rk,
      count(*) OVER (PARTITION BY metric, value) AS same FROM {source}
    WINDOW o AS (PARTITION BY metric ORDER BY value)),
  s AS (
    SELECT metric, count(*) FILTER (treated)::DOUBLE AS n1, count(*) FILTER (NOT treated)::DOUBLE AS n2,
      (sum(rk) FILTER (treated))::DOUBLE AS r1, sum(same * same - 1)::DOUBLE AS ties FROM r GROUP BY 1),
  u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1, n1 + n2 AS n FROM s WHERE n1 > 0 AND n2 > 0),
  z AS (
    SELECT *, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5)
      / nullif(sqrt(n1 * n2 / 12 * (n + 1 - coalesce(ties / nullif(n * (n - 1), 0), 0))), 0) AS z FROM u)
  SELECT metric AS {label}, {rnd('u1', 6)} AS u_statistic, {rnd('z', 6)} AS z_score,
    CASE WHEN ties = 0 AND greatest(n1, n2) <= {EXACT} THEN {rnd('least(1, 2 * upper)', 6)}
      ELSE {rnd('least(1, 2 * ' + phi('-z') + ')', 6)} END AS p_value,
    n2::BIGINT AS sample_size_control, n1::BIGINT AS sample_size_treatment
  FROM z LEFT JOIN law ON ties = 0 AND law.r = n AND j = n1
    AND law.s = greatest(u1, n1 * n2 - u1) + n1 * (n1 + 1) / 2"""


STATEMENTS["ab_mann_whitney"] = _rank_sum("measured", "metric")
CTES["measured_by_week"] = """
  SELECT strftime(date_trunc('week', signup_date), '%Y-%m-%d') AS metric, answered AS treated, avg_bet_size AS value
  FROM user_values JOIN customers USING (customer_id) WHERE answered IS NOT NULL AND avg_bet_size IS NOT NULL"""
STATEMENTS["ab_rank_sum_by_week"] = _rank_sum("measured_by_week", "signup_week")


def _quantile(p: str) -> str:
    """Normal quantile: an approximation to three digits, then five steps of Newton's method."""
    x = "x0"
    steps = ("SELECT p, CASE WHEN p < 0.5 THEN -1 ELSE 1 END * (v - (2.515517 + 0.802853 * v + 0.010328 * v * v) "
             "/ (1 + 1.432788 * v + 0.189269 * v * v + 0.001308 * v * v * v)) AS x0 "
             f"FROM (SELECT p, sqrt(-2 * ln(least(p, 1 - p))) AS v FROM (SELECT ({p})::DOUBLE AS p))")
    for k in range(1, 6):
        steps = (f"SELECT p, {x} - ({phi(x)} - p) * {(2 * math.pi) ** 0.5} * exp({x} * {x} / 2) AS x{k} FROM ({steps})")
        x = f"x{k}"
    return f"(SELECT {x} FROM ({steps}))"


STATEMENTS["ab_normality_gate"] = f"""
  WITH v AS (
    SELECT *, sum(same) OVER g AS n, sum(same) OVER (g ORDER BY value) - (same - 1) / 2.0 AS rk
    FROM (SELECT metric, treated, value::DOUBLE AS value, count(*) AS same FROM measured GROUP BY ALL)
    WINDOW g AS (PARTITION BY metric, treated)),
  s AS (
    SELECT metric, treated, n, same, value - sum(same * value) OVER g / n AS gap,
      {_quantile('(rk - 0.375) / (n + 0.25)')} AS score
    FROM v WINDOW g AS (PARTITION BY metric, treated)),
  m AS (
    SELECT metric, treated, max(n)::BIGINT AS n, sum(same * score * gap) AS xy, sum(same * score * score) AS yy,
      sum(same * gap * gap) AS xx FROM s GROUP BY 1, 2),
  j AS (SELECT *, CASE WHEN n >= 5 AND xx > 0 THEN xy * xy / (xx * yy) END AS w, ln(n::DOUBLE) AS u FROM m),
  q AS (
    SELECT *, {phi('(-1.2725 + 1.0521 * (ln(u) - u) - ln(greatest(1 - w, 1e-300))) / (1.0308 - 0.26758 * (ln(u) + 2 / u))')}
      AS p FROM j),
  x AS (
    SELECT metric, max(n) FILTER (NOT treated) AS nc, max(n) FILTER (treated) AS nt, max(w) FILTER (NOT treated) AS wc,
      max(w) FILTER (treated) AS wt, max(p) FILTER (NOT treated) AS pc, max(p) FILTER (treated) AS pt FROM q GROUP BY 1)
  SELECT metric, nc AS sample_size_control, nt AS sample_size_treatment, {rnd('wc', 6)} AS w_control,
    {rnd('pc', 6)} AS p_control, {rnd('wt', 6)} AS w_treatment, {rnd('pt', 6)} AS p_treatment,
    coalesce(pc > 0.05 AND pt > 0.05, false) AS is_normal
  FROM x WHERE nc > 0 AND nt > 0"""

STATEMENTS["ab_campaign_roi"] = f"""
  SELECT {rnd('mt - mc', 6)} AS ltv_lift, 15.0::DOUBLE AS campaign_cost,
    {rnd('(mt - mc - 15) / 15 * 100', 6)} AS roi_percent
  FROM arms WHERE metric = 'customer_ltv'"""

_ZZ = (Z + Z_POWER) ** 2
STATEMENTS["ab_sample_size"] = f"""
  WITH b AS (
    SELECT campaign_type, {rnd('count(*) FILTER (responded)::DOUBLE / count(*)', 6)} AS p
    FROM customer_campaigns JOIN campaigns USING (campaign_id) GROUP BY 1),
  g AS (SELECT *, unnest([0.05, 0.1, 0.15, 0.2, 0.3, 0.5])::DOUBLE AS x FROM b),
  m AS (SELECT *, (p + p * (1 + x)) / 2 AS pool, (p * x) * (p * x) AS gap FROM g)
  SELECT campaign_type, p AS baseline_rate, x AS expected_lift,
    ceil({_ZZ} * pool * (1 - pool) / gap)::BIGINT AS n_proportion,
    ceil(2 * {_ZZ} * pool * (1 - pool) / gap)::BIGINT AS n_proportion_two_sample,
    ceil(2 * {_ZZ} / (x * x))::BIGINT AS n_continuous
  FROM m WHERE p > 0"""


# Student's t by integration of its density (Simpson's rule), the quantile by Newton's steps.
_PANELS = 4000


def _density(x: str) -> str:
    return (f"exp(lgamma((df + 1) / 2) - lgamma(df / 2) - ln(df * pi()) / 2 - (df + 1) / 2 * ln(1 + ({x}) * ({x}) / df))")


def _tail(t: str) -> str:
    weight = f"CASE WHEN i = 0 OR i = {_PANELS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return (f"(1 - 2 * abs({t}) / {3 * _PANELS}.0 * list_sum(list_transform(range(0, {_PANELS + 1}), "
            f"lambda i: {weight} * {_density(f'abs({t}) * i / {_PANELS}.0')})))")


STATEMENTS["ab_welch_p"] = f"""
  WITH RECURSIVE a AS (
    SELECT *, mt - mc AS lift, sqrt(vc / nc + vt / nt) AS se, vc / nc AS a, vt / nt AS b,
      (mt - mc) / sqrt(((nc - 1) * vc + (nt - 1) * vt) / (nc + nt - 2)) AS d FROM arms),
  w AS (SELECT *, (a + b) * (a + b) / (a * a / (nc - 1) + b * b / (nt - 1)) AS df FROM a),
  p AS (SELECT *, {_tail('lift / se')} AS p FROM w),
  q AS (
    SELECT metric, nc + nt - 2 AS df, {Z}::DOUBLE AS t, 0 AS step FROM a
    UNION ALL
    SELECT metric, df, t + ({_tail('t')} - 0.05) / (2 * {_density('t')}), step + 1 FROM q WHERE step < 8)
  SELECT metric, {rnd('mc', 6)} AS control_value, {rnd('mt', 6)} AS treatment_value, {rnd('lift', 6)} AS lift,
    CASE WHEN mc > 0 THEN {rnd('lift / mc * 100', 6)} ELSE 0 END AS lift_pct, {rnd('lift / se', 6)} AS t_stat,
    {rnd('se', 6)} AS se, {rnd('p.df', 6)} AS df_welch, q.df AS df_interval, {rnd('d', 6)} AS effect_size,
    {rnd(_power('d'), 6)} AS statistical_power, nc::BIGINT AS sample_size_control,
    nt::BIGINT AS sample_size_treatment, {rnd('p', 6)} AS p_value, {rnd('lift - t * se', 6)} AS ci_lower,
    {rnd('lift + t * se', 6)} AS ci_upper, p < 0.05 AS is_significant
  FROM p JOIN q USING (metric) WHERE step = 8"""


# Poisson bootstrap with the same draws: two rounds of a 32-bit scrambler over key and replicate.
REPLICATES, COMMON = 1000, 8  # a value that more customers share is not drawn here


def _bounds(mean: int) -> str:
    total, out = 0.0, []
    for k in range(60):
        total += math.exp(-mean) * mean ** k / math.factorial(k)
        out.append(repr(min(total, 1.0)))
    return f"WHEN {mean} THEN [{', '.join(out)}]"


STATEMENTS["ab_bootstrap_ci"] = f"""
  WITH v AS (
    SELECT metric, treated, value::DOUBLE AS value, count(*) AS n,
      md5('7|' || metric || '|' || CASE WHEN treated THEN 'treatment' ELSE 'control' END || '|'
        || round(value::DOUBLE * 1e6)::BIGINT) AS m FROM measured GROUP BY ALL),
  k AS (
    SELECT metric, treated, value, ('0x' || m[1:8])::UBIGINT AS high, ('0x' || m[9:16])::UBIGINT AS low,
      CASE n {' '.join(_bounds(k) for k in range(1, COMMON + 1))} END::DOUBLE[] AS bounds FROM v),
  a AS (SELECT * EXCLUDE (high), r, xor(r::UBIGINT, high) AS x FROM k, range({REPLICATES}) AS t(r)),
  b AS (SELECT * EXCLUDE (x), (xor(x, x >> 16) * {0x7FEB352D}) & 4294967295 AS x FROM a),
  c AS (SELECT * EXCLUDE (x), (xor(x, x >> 15) * {0x846CA68B}) & 4294967295 AS x FROM b),
  d AS (SELECT * EXCLUDE (x, low), xor(xor(x, x >> 16), low) AS x FROM c),
  e AS (SELECT * EXCLUDE (x), (xor(x, x >> 16) * {0x7FEB352D}) & 4294967295 AS x FROM d),
  f AS (SELECT * EXCLUDE (x), (xor(x, x >> 15) * {0x846CA68B}) & 4294967295 AS x FROM e),
  u AS (SELECT metric, treated, value, r, bounds, (xor(x, x >> 16)::DOUBLE + 0.5) / 4294967296.0::DOUBLE AS u FROM f),
  w AS (SELECT metric, treated, value, r, list_count(list_filter(bounds, lambda c: c <= u))::DOUBLE AS n FROM u),
  g AS (
    SELECT metric, r, sum(n * value) FILTER (treated) / sum(n) FILTER (treated)
      - sum(n * value) FILTER (NOT treated) / sum(n) FILTER (NOT treated) AS gap FROM w GROUP BY 1, 2),
  h AS (
    SELECT metric, count(*) AS replicates, avg(gap) AS mean_difference,
      (quantile_cont(gap, 0.975) - quantile_cont(gap, 0.025)) / 2 AS margin FROM g GROUP BY 1)
  SELECT metric, {rnd('mt - mc', 6)} AS lift, replicates, {rnd('mean_difference', 6)} AS mean_difference,
    {rnd('margin', 6)} AS margin, {rnd('mt - mc - margin', 6)} AS ci_lower, {rnd('mt - mc + margin', 6)} AS ci_upper
  FROM h JOIN arms USING (metric)"""
