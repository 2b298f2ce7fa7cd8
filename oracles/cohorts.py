"""Cohort statements."""

from __future__ import annotations

from oracles.base import AS_OF, CTES, days, floor_days, months, rnd

STATEMENTS: dict[str, str] = {}

for _unit in ("month", "week"):
    CTES[f"cohort_{_unit}"] = f"""
  SELECT customer_id, date_trunc('{_unit}', signup_date)::DATE AS cohort FROM customers"""
    CTES[f"size_{_unit}"] = f"SELECT cohort, count(*) AS n FROM cohort_{_unit} GROUP BY 1"

STATEMENTS["cohort_retention_sql"] = f"""
  SELECT cohort AS cohort_month, n AS cohort_size, {months('cohort', 'm')} AS months_since_signup,
    count(DISTINCT customer_id) AS active_customers,
    {rnd('100.0 * count(DISTINCT customer_id) / n')} AS retention_rate
  FROM (SELECT customer_id, date_trunc('month', moment)::DATE AS m FROM activity)
    JOIN cohort_month USING (customer_id) JOIN size_month USING (cohort) GROUP BY cohort, m, n"""


def revenue_columns(wrap: str = "") -> str:
    return f"""
  WITH cm AS (
    SELECT customer_id, date_trunc('month', bet_date)::DATE AS m, sum(bet_amount - payout) AS ggr,
      count(DISTINCT bet_date::DATE) AS d FROM betting_activity GROUP BY 1, 2),
  g AS (
    SELECT cohort, m, n, count(*) AS active, sum(ggr) AS ggr, sum(d) AS d
    FROM cm JOIN cohort_month USING (customer_id) JOIN size_month USING (cohort) GROUP BY 1, 2, 3)
  SELECT cohort AS cohort_month, n AS cohort_size, {months('cohort', 'm')}{wrap} AS months_since_signup,
    active AS active_customers, {rnd('100.0 * active / n')} AS retention_rate, ggr::DOUBLE AS cohort_monthly_ggr,
    {rnd('ggr::DOUBLE / active')} AS avg_ggr_per_active_customer, {rnd('ggr::DOUBLE / n')} AS ggr_per_cohort_customer,
    {rnd('d::DOUBLE / active', 1)} AS avg_active_days,
    (sum(ggr) OVER (PARTITION BY cohort ORDER BY m ROWS UNBOUNDED PRECEDING))::DOUBLE AS cumulative_ggr_per_cohort,
    {rnd('(sum(ggr) OVER (PARTITION BY cohort ORDER BY m ROWS UNBOUNDED PRECEDING))::DOUBLE / n')}
      AS cumulative_ggr_per_customer
  FROM g"""


STATEMENTS["revenue_cohort_sql"] = revenue_columns()


def _number(unit: str, end: str) -> str:
    return months("cohort", end) if unit == "month" else f"(({end} - cohort) // 7)"


for _name, _unit in (("", "month"), ("_weekly", "week")):
    CTES[f"retention_{_unit}"] = f"""
  SELECT cohort AS cohort_period, {_number(_unit, 'p')} AS period_number, count(DISTINCT customer_id) AS active_customers,
    n AS cohort_size, {rnd('count(DISTINCT customer_id)::DOUBLE / n', 6)} AS retention_rate
  FROM (SELECT customer_id, date_trunc('{_unit}', moment)::DATE AS p FROM activity)
    JOIN cohort_{_unit} USING (customer_id) JOIN size_{_unit} USING (cohort)
  WHERE p >= cohort GROUP BY cohort, p, n"""
    STATEMENTS[f"retention_cohorts{_name}"] = f"SELECT * FROM retention_{_unit}"
    STATEMENTS[f"revenue_cohorts{_name}"] = f"""
  SELECT cohort AS cohort_period, {_number(_unit, 'p')} AS period_number, sum(r)::DOUBLE AS total_revenue,
    {rnd('sum(r)::DOUBLE / count(*)', 6)} AS avg_revenue_per_active, count(*) AS revenue_events,
    count(*) AS active_customers, n AS cohort_size, {rnd('sum(r)::DOUBLE / n', 6)} AS revenue_per_cohort_customer
  FROM (SELECT customer_id, date_trunc('{_unit}', bet_date)::DATE AS p, sum(bet_amount - payout) AS r
        FROM betting_activity GROUP BY 1, 2)
    JOIN cohort_{_unit} USING (customer_id) JOIN size_{_unit} USING (cohort)
  WHERE p >= cohort GROUP BY cohort, p, n"""

CTES["retention_grid"] = """
  SELECT c.cohort_period, p.period_number, coalesce(r.retention_rate, 0) AS retention_rate
  FROM (SELECT DISTINCT cohort_period FROM retention_month) c
    CROSS JOIN (SELECT DISTINCT period_number FROM retention_month) p
    LEFT JOIN retention_month r USING (cohort_period, period_number)"""
STATEMENTS["retention_long"] = "SELECT * FROM retention_grid"

STATEMENTS["retention_matrix"] = """
  SELECT c.cohort_period, string_agg(printf('%.6f', coalesce(r.retention_rate, 0)::DOUBLE), ',' ORDER BY p.n) AS rates
  FROM (SELECT DISTINCT cohort_period FROM retention_month) c
    CROSS JOIN (SELECT unnest(range((SELECT max(period_number) + 1 FROM retention_month)::BIGINT)) AS n) p
    LEFT JOIN retention_month r ON r.cohort_period = c.cohort_period AND r.period_number = p.n
  GROUP BY 1"""

STATEMENTS["retention_summary"] = f"""
  SELECT count(DISTINCT cohort_period) AS cohorts,
    {rnd('avg(retention_rate) FILTER (period_number = 1)', 6)} AS period_1_retention,
    {rnd('avg(retention_rate) FILTER (period_number = 3)', 6)} AS period_3_retention,
    {rnd('avg(retention_rate) FILTER (period_number = 6)', 6)} AS period_6_retention
  FROM retention_grid"""

CTES["ltv_by_cohort"] = f"""
  WITH c AS (
    SELECT date_trunc('month', signup_date)::DATE AS cohort_month, acquisition_cost::DOUBLE AS cost,
      (wagered - payouts)::DOUBLE AS revenue, (wagered - payouts - acquisition_cost)::DOUBLE AS ltv,
      deposits::DOUBLE AS deposits, bets,
      CASE WHEN bets > 0 THEN {days('first_bet', 'last_bet')} + 1 ELSE 0 END AS tenure,
      coalesce(wagered::DOUBLE / nullif(bets, 0), 0) AS size FROM per_customer)
  SELECT *, {rnd('avg_ltv / nullif(avg_acquisition_cost, 0)', 6)} AS ltv_cac_ratio,
    {rnd('total_revenue / customer_count', 6)} AS revenue_per_customer
  FROM (SELECT cohort_month, count(*) AS customer_count, {rnd('avg(ltv)')} AS avg_ltv,
      {rnd('median(ltv)')} AS median_ltv, {rnd('stddev_samp(ltv)')} AS std_ltv, {rnd('sum(ltv)')} AS total_ltv,
      {rnd('avg(revenue)')} AS avg_revenue, {rnd('median(revenue)')} AS median_revenue,
      {rnd('sum(revenue)')} AS total_revenue, {rnd('avg(deposits)')} AS avg_deposits,
      {rnd('sum(deposits)')} AS total_deposits, {rnd('avg(cost)')} AS avg_acquisition_cost,
      {rnd('avg(tenure)')} AS avg_tenure_days, {rnd('avg(bets)')} AS avg_total_bets, {rnd('avg(size)')} AS avg_bet_size,
      {rnd('avg(coalesce(bets::DOUBLE / nullif(tenure, 0), 0))')} AS avg_betting_frequency
    FROM c GROUP BY 1)"""
STATEMENTS["ltv_cohorts"] = "SELECT * FROM ltv_by_cohort"

CTES["churn_by_month"] = f"""
  WITH c AS (
    SELECT date_trunc('month', signup_date)::DATE AS cohort_month, last_seen,
      {floor_days('last_seen', AS_OF)} AS idle FROM per_customer)
  SELECT cohort_month, count(*) AS total_customers,
    count(*) FILTER (last_seen IS NULL OR idle > 30) AS churned_customers,
    {rnd('count(*) FILTER (last_seen IS NULL OR idle > 30)::DOUBLE / count(*)', 4)} AS churn_rate,
    count(*) FILTER (last_seen IS NULL) AS never_active_customers,
    {rnd('count(*) FILTER (last_seen IS NULL)::DOUBLE / count(*)', 4)} AS never_active_rate,
    {rnd('avg(idle)', 4)} AS avg_days_since_activity, {rnd('median(idle)', 4)} AS median_days_since_activity,
    count(*) FILTER (idle <= 30) AS active_customers,
    {rnd('1 - ' + rnd('count(*) FILTER (last_seen IS NULL OR idle > 30)::DOUBLE / count(*)', 4), 4)} AS active_rate
  FROM c GROUP BY 1"""
STATEMENTS["churn_by_cohort"] = "SELECT * FROM churn_by_month"

STATEMENTS["cohort_overview"] = f"""
  SELECT count(*) AS cohorts, {rnd('avg(avg_ltv)', 6)} AS avg_ltv, {rnd('avg(avg_acquisition_cost)', 6)} AS avg_cac,
    {rnd('sum(avg_ltv) / sum(avg_acquisition_cost)', 6)} AS ltv_cac_ratio,
    (SELECT {rnd('avg(churn_rate)', 6)} FROM churn_by_month) AS churn_rate,
    (SELECT {rnd('avg(never_active_rate)', 6)} FROM churn_by_month) AS never_active_rate
  FROM ltv_by_cohort"""

STATEMENTS["bi_heatmap_totals"] = """
  SELECT cohort_period, period_number, sum(active_customers)::BIGINT AS active_customers,
    grouping_id(cohort_period, period_number) AS margin
  FROM retention_month GROUP BY CUBE (cohort_period, period_number)"""
