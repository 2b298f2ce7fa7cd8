"""Dashboard measure statements."""

from __future__ import annotations

from oracles.base import AS_OF, CTES, days, months, rnd

STATEMENTS: dict[str, str] = {}

STATEMENTS["bi_headline"] = f"""
  SELECT {rnd('cost::DOUBLE / n', 6)} AS cac, {rnd('won::DOUBLE / n', 6)} AS conversion_rate,
    (ggr - cost)::DOUBLE AS total_ltv, {rnd('(ggr - cost)::DOUBLE / (cost::DOUBLE / n)', 4)} AS roas, mau,
    {rnd('minutes', 6)} AS avg_session_duration
  FROM (SELECT count(*) AS n, sum(acquisition_cost) AS cost, sum(wagered - payouts) AS ggr,
      count(*) FILTER (bets > 0) AS mau, (SELECT count(DISTINCT customer_id) FROM first_deposits) AS won,
      (SELECT avg(duration_minutes) FROM sessions) AS minutes FROM per_customer)"""

STATEMENTS["bi_customer_lod"] = f"""
  SELECT customer_id, (wagered - payouts - acquisition_cost)::DOUBLE AS customer_ltv, wagered::DOUBLE AS total_wagered,
    date_diff('day', signup_date, {AS_OF}) AS days_since_signup,
    CASE WHEN wagered >= 5000 THEN 'High Value' WHEN wagered >= 1000 THEN 'Medium Value'
      WHEN wagered >= 100 THEN 'Low Value' ELSE 'Inactive' END AS value_segment,
    CASE WHEN f.customer_id IS NULL THEN 'No' ELSE 'Yes' END AS has_deposited,
    date_diff('day', signup_date, {AS_OF}) AS tenure_days
  FROM per_customer LEFT JOIN (SELECT DISTINCT customer_id FROM first_deposits) f USING (customer_id)"""

STATEMENTS["bi_campaign"] = f"""
  WITH v AS (
    SELECT customer_id, wagered - payouts AS ggr, wagered - payouts - acquisition_cost AS ltv,
      customer_id IN (SELECT customer_id FROM first_deposits) AS won FROM per_customer),
  a AS (
    SELECT k.campaign_id, any_value(bonus_amount) AS bonus, count(v.customer_id) AS n,
      count(*) FILTER (responded) AS y, count(*) FILTER (NOT responded) AS z,
      count(*) FILTER (responded AND won) AS wy, count(*) FILTER (NOT responded AND won) AS wz,
      count(*) FILTER (bonus_claimed) AS claims, coalesce(sum(campaign_cost), 0)::DOUBLE AS cost,
      coalesce(sum(ltv) FILTER (responded), 0)::DOUBLE AS revenue,
      coalesce(sum(ggr) FILTER (responded), 0)::DOUBLE AS ggr
    FROM campaigns k LEFT JOIN customer_campaigns cc USING (campaign_id) LEFT JOIN v USING (customer_id) GROUP BY 1)
  SELECT campaign_id, n AS customers_targeted, y AS customers_responded,
    {rnd('y::DOUBLE / nullif(n, 0)', 6)} AS response_rate, {rnd('revenue')} AS campaign_revenue, cost AS campaign_cost,
    {rnd('(revenue - cost) / nullif(cost, 0)', 6)} AS campaign_roi,
    {rnd('cost / nullif(y, 0)', 6)} AS cost_per_response,
    {rnd('wy::DOUBLE / nullif(y, 0)', 6)} AS treatment_conversion,
    {rnd('wz::DOUBLE / nullif(z, 0)', 6)} AS control_conversion,
    {rnd('(wy::DOUBLE * z - wz::DOUBLE * y) / nullif(wz * y, 0)', 6)} AS campaign_lift,
    {rnd('ggr - coalesce(bonus, 0) * claims - cost')} AS ngr
  FROM a"""

STATEMENTS["bi_monthly"] = f"""
  WITH b AS (
    SELECT date_trunc('month', bet_date)::DATE AS month, count(DISTINCT customer_id) AS mau, count(*) AS bets,
      sum(bet_amount - payout) AS ggr, count(DISTINCT customer_id || bet_date::DATE) AS user_days,
      count(DISTINCT bet_date::DATE) AS dates FROM betting_activity GROUP BY 1),
  p AS (
    SELECT date_trunc('month', sent_date)::DATE AS month,
      sum(campaign_cost + CASE WHEN bonus_claimed THEN bonus_amount ELSE 0 END) AS promo
    FROM customer_campaigns JOIN campaigns USING (campaign_id) GROUP BY 1)
  SELECT month, mau, {rnd('user_days::DOUBLE / dates', 6)} AS avg_dau, bets, ggr::DOUBLE AS gross_gaming_revenue,
    coalesce(promo, 0)::DOUBLE AS promotional_cost, (ggr - coalesce(promo, 0))::DOUBLE AS net_gaming_revenue,
    {rnd('ggr::DOUBLE / mau', 6)} AS arpu, {rnd('bets::DOUBLE / user_days', 6)} AS bet_frequency
  FROM b LEFT JOIN p USING (month)"""

STATEMENTS["bi_cohort"] = f"""
  SELECT cohort AS cohort_period, {months('cohort', 'm')} AS period_number,
    count(DISTINCT customer_id) AS active_customers, n AS cohort_size,
    {rnd('count(DISTINCT customer_id)::DOUBLE / n', 6)} AS retention_rate
  FROM (SELECT customer_id, date_trunc('month', bet_date)::DATE AS m FROM betting_activity)
    JOIN cohort_month USING (customer_id) JOIN size_month USING (cohort) GROUP BY cohort, m, n"""


def _recency(idle: str) -> str:
    return (f"CASE WHEN {idle} <= 7 THEN 5 WHEN {idle} <= 30 THEN 4 WHEN {idle} <= 90 THEN 3 "
            f"WHEN {idle} <= 180 THEN 2 ELSE 1 END::BIGINT")


STATEMENTS["bi_rfm_lifecycle"] = f"""
  SELECT customer_id, idle AS days_since_last_activity, {_recency('idle')} AS recency_score,
    {_recency(f"date_diff('day', last_bet::DATE, {AS_OF})")} AS bet_recency_score,
    CASE WHEN bets >= 100 THEN 5 WHEN bets >= 50 THEN 4 WHEN bets >= 20 THEN 3 WHEN bets >= 5 THEN 2
      WHEN bets >= 1 THEN 1 ELSE 0 END::BIGINT AS frequency_score,
    CASE WHEN wagered >= 5000 THEN 5 WHEN wagered >= 1000 THEN 4 WHEN wagered >= 500 THEN 3
      WHEN wagered >= 100 THEN 2 WHEN wagered >= 10 THEN 1 ELSE 0 END::BIGINT AS monetary_score,
    CASE WHEN num_deposits = 0 THEN 'Prospect' WHEN idle <= 30 THEN 'Active' WHEN idle <= 90 THEN 'At Risk'
      ELSE 'Churned' END AS lifecycle_stage
  FROM (SELECT *, {days('last_seen', AS_OF)} AS idle FROM per_customer)"""

CTES["day_revenue"] = """
  SELECT bet_date::DATE AS date, sum(bet_amount - payout) AS revenue FROM betting_activity GROUP BY 1"""


def _monitor(source: str) -> str:
    return f"""
  WITH y AS (
    SELECT d.date, d.revenue::DOUBLE AS r, p.revenue::DOUBLE AS yesterday,
      (d.revenue - p.revenue)::DOUBLE / nullif(p.revenue, 0) AS change
    FROM {source} d LEFT JOIN {source} p ON p.date = d.date - 1)
  SELECT date, r AS revenue_today, yesterday AS revenue_yesterday, {rnd('change', 6)} AS daily_revenue_change,
    CASE WHEN change < -0.1 THEN '🔴 Down >10%' WHEN change > 0.1 THEN '🟢 Up >10%' ELSE '🟡 Stable' END
      AS performance_alert,
    {rnd('avg(r) OVER (ORDER BY date ROWS 6 PRECEDING)', 6)} AS moving_average_7,
    {rnd('r / 500', 6)} AS target_achievement
  FROM y"""


CTES["dense_revenue"] = """
  SELECT date, coalesce(revenue, 0) AS revenue
  FROM (SELECT unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date
        FROM day_revenue) LEFT JOIN day_revenue USING (date)"""
STATEMENTS["bi_daily_monitor"] = _monitor("day_revenue")
STATEMENTS["bi_daily_monitor_dense"] = _monitor("dense_revenue")

STATEMENTS["bi_sport_days"] = f"""
  WITH r AS (
    SELECT sport, bet_date::DATE AS date, count(*) AS n, sum(bet_amount - payout) AS revenue,
      {rnd('sum(bet_amount)::DOUBLE / count(*)')} AS stake FROM betting_activity GROUP BY 1, 2),
  d AS (
    SELECT sport, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date
    FROM r GROUP BY 1)
  SELECT d.sport, d.date, coalesce(n, 0) AS bets, coalesce(revenue, 0)::DOUBLE AS revenue,
    last_value(stake IGNORE NULLS) OVER (PARTITION BY d.sport ORDER BY d.date) AS last_mean_stake,
    n IS NOT NULL AS any_bet
  FROM d LEFT JOIN r ON r.sport = d.sport AND r.date = d.date"""

STATEMENTS["bi_hourly"] = """
  SELECT hour_of_day, coalesce(sessions, 0) AS sessions, coalesce(session_bets, 0)::BIGINT AS session_bets,
    coalesce(bets, 0) AS bets, coalesce(wagered, 0)::DOUBLE AS wagered
  FROM (SELECT hour(start_time) AS hour_of_day, count(*) AS sessions, sum(num_bets) AS session_bets
        FROM sessions GROUP BY 1)
    FULL JOIN (SELECT hour(bet_date) AS hour_of_day, count(*) AS bets, sum(bet_amount) AS wagered
        FROM betting_activity GROUP BY 1) USING (hour_of_day)"""

STATEMENTS["bi_calendar"] = f"""
  WITH m AS (SELECT date_trunc('month', date)::DATE AS m, sum(revenue) AS r FROM day_revenue GROUP BY 1),
  d AS (
    SELECT unnest(generate_series((SELECT min(signup_date) FROM customers)::TIMESTAMP,
      {AS_OF}::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date)
  SELECT date, year(date) AS year, quarter(date) AS quarter, month(date) AS month,
    date_trunc('week', date)::DATE AS week_start, year(date - INTERVAL 3 MONTHS) AS fiscal_year,
    coalesce(a.r, 0)::DOUBLE AS month_revenue, coalesce(b.r, 0)::DOUBLE AS previous_month_revenue
  FROM d LEFT JOIN m a ON a.m = date_trunc('month', date) LEFT JOIN m b
    ON b.m = date_trunc('month', date) - INTERVAL 1 MONTH"""

STATEMENTS["bi_stats"] = f"""
  SELECT {rnd('corr(total_wagered, daily_active_users)', 6)} AS correlation,
    {rnd('regr_slope(gross_gaming_revenue, x)', 6)} AS trend_slope,
    {rnd('regr_intercept(gross_gaming_revenue, x)', 3)} AS trend_intercept,
    {rnd('stddev_samp(gross_gaming_revenue)', 6)} AS std_dev,
    {rnd('quantile_cont(gross_gaming_revenue, 0.95)', 6)} AS p95_revenue
  FROM (SELECT *, (activity_date - DATE '1970-01-01')::DOUBLE AS x FROM daily)"""

STATEMENTS["bi_growth_forecast"] = f"""
  SELECT unnest(range(1, 13)) AS period, a AS historical_average,
    {rnd('a * pow(1.02, unnest(range(1, 13)))', 4)} AS forecast
  FROM (SELECT {rnd('avg(r)', 6)} AS a FROM (SELECT sum(revenue)::DOUBLE AS r FROM day_revenue
    GROUP BY date_trunc('month', date)))"""

STATEMENTS["bi_agg_tables"] = f"""
  SELECT bet_date::DATE AS date, sport, customer_segment, acquisition_channel, count(*) AS bets,
    sum(bet_amount)::DOUBLE AS wagered, sum(bet_amount - payout)::DOUBLE AS revenue
  FROM betting_activity JOIN customers USING (customer_id)
  WHERE bet_date::DATE >= {AS_OF} - INTERVAL 2 YEARS AND customer_id IN (
    SELECT customer_id FROM betting_activity WHERE bet_date::DATE >= {AS_OF} - 365)
  GROUP BY ALL"""

STATEMENTS["bi_funnel"] = f"""
  WITH f AS (
    SELECT count(*) AS a, count(*) FILTER (paid) AS b, count(*) FILTER (paid AND bets > 0) AS c,
      count(*) FILTER (paid AND bets > 0 AND {days('last_seen', AS_OF)} <= 30) AS d
    FROM (SELECT *, customer_id IN (SELECT customer_id FROM first_deposits) AS paid FROM per_customer))
  SELECT '1 registered' AS stage, a AS customers, NULL::DOUBLE AS step_rate, 1.0::DOUBLE AS overall_rate FROM f
  UNION ALL SELECT '2 first deposit', b, {rnd('b::DOUBLE / a', 6)}, {rnd('b::DOUBLE / a', 6)} FROM f
  UNION ALL SELECT '3 first bet', c, {rnd('c::DOUBLE / b', 6)}, {rnd('c::DOUBLE / a', 6)} FROM f
  UNION ALL SELECT '4 active', d, {rnd('d::DOUBLE / c', 6)}, {rnd('d::DOUBLE / a', 6)} FROM f"""
