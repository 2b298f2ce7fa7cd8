"""The multiplied views, computed here by really joining all facts.

These are the slow, literal joins; the Spark side computes the same figures without
pairing any rows, so agreement checks the multiplication rule.
"""

from __future__ import annotations

from oracles.advanced import churn_columns, deep_columns
from oracles.base import AS_OF, CTES, months, rnd
from oracles.cohorts import revenue_columns
from oracles.kpis import campaign_columns, daily_columns, ltv_columns, segmentation_columns

STATEMENTS: dict[str, str] = {}

_DEPOSIT = "(transaction_type = 'deposit')"

STATEMENTS["customer_ltv_as_written"] = ltv_columns(f"""(
    SELECT customer_id, any_value(customer_segment) AS customer_segment,
      any_value(acquisition_channel) AS acquisition_channel, any_value(signup_date) AS signup_date,
      any_value(acquisition_cost) AS acquisition_cost,
      coalesce(sum(amount) FILTER {_DEPOSIT}, 0) AS deposits,
      coalesce(sum(amount) FILTER (transaction_type = 'withdrawal'), 0) AS withdrawals,
      coalesce(sum(bet_amount), 0) AS wagered, coalesce(sum(payout), 0) AS payouts, count(bet_id) AS bets,
      min(transaction_date) AS first_tx, max(greatest(transaction_date, bet_date)) AS last_seen
    FROM customers LEFT JOIN transactions USING (customer_id) LEFT JOIN betting_activity USING (customer_id)
    GROUP BY 1)""")

STATEMENTS["cohort_retention_sql_as_written"] = f"""
  WITH seen AS (
    SELECT c.customer_id, date_trunc('month', signup_date)::DATE AS cohort_month,
      date_trunc('month', coalesce(bet_date, transaction_date))::DATE AS m
    FROM customers c LEFT JOIN betting_activity b USING (customer_id) LEFT JOIN transactions x USING (customer_id)),
  size AS (SELECT date_trunc('month', signup_date)::DATE AS cohort_month, count(*) AS n FROM customers GROUP BY 1)
  SELECT cohort_month, n AS cohort_size, ({months('cohort_month', 'm')} % 12) AS months_since_signup,
    count(DISTINCT customer_id) AS active_customers,
    {rnd('100.0 * count(DISTINCT customer_id) / n')} AS retention_rate
  FROM seen JOIN size USING (cohort_month) WHERE m IS NOT NULL GROUP BY cohort_month, m, n"""

STATEMENTS["campaign_performance_as_written"] = campaign_columns(f"""
    SELECT cc.campaign_id,
      sum(amount) FILTER ({_DEPOSIT} AND transaction_date BETWEEN start_date AND end_date + INTERVAL 30 DAYS) AS deposits,
      sum(bet_amount - payout) FILTER (bet_date BETWEEN start_date AND end_date + INTERVAL 30 DAYS) AS ggr
    FROM customer_campaigns cc JOIN campaigns k USING (campaign_id)
      LEFT JOIN transactions x ON responded AND x.customer_id = cc.customer_id
      LEFT JOIN betting_activity b ON responded AND b.customer_id = cc.customer_id
    GROUP BY 1""")

STATEMENTS["daily_engagement_as_written"] = daily_columns(f"""(
    SELECT coalesce(bet_date, transaction_date, start_time)::DATE AS activity_date,
      count(DISTINCT c.customer_id) AS dau, count(DISTINCT b.customer_id) AS bettors,
      count(DISTINCT x.customer_id) AS payers, count(DISTINCT s.customer_id) AS visitors,
      count(bet_id) AS bets, coalesce(sum(bet_amount), 0) AS wagered, coalesce(sum(payout), 0) AS payouts,
      count(*) FILTER {_DEPOSIT} AS deposits, coalesce(sum(amount) FILTER {_DEPOSIT}, 0) AS deposited,
      count(session_id) AS visits, coalesce(sum(duration_minutes), 0) AS minutes
    FROM customers c LEFT JOIN betting_activity b ON b.customer_id = c.customer_id
      LEFT JOIN transactions x ON x.customer_id = c.customer_id
      LEFT JOIN sessions s ON s.customer_id = c.customer_id
    WHERE coalesce(bet_date, transaction_date, start_time) IS NOT NULL GROUP BY 1)""")

STATEMENTS["customer_segmentation_as_written"] = segmentation_columns(f"""(
    SELECT customer_id, any_value(customer_segment) AS customer_segment,
      any_value(acquisition_channel) AS acquisition_channel, any_value(signup_date) AS signup_date,
      count(bet_id) AS bets, coalesce(sum(bet_amount), 0) AS wagered,
      coalesce(sum(bet_amount)::DOUBLE / count(bet_amount), 0) AS avg_bet, count(DISTINCT session_id) AS sessions,
      coalesce(avg(duration_minutes), 0) AS avg_minutes, coalesce(avg(num_bets), 0) AS avg_session_bets,
      coalesce(sum(amount) FILTER {_DEPOSIT}, 0) AS deposits, count(*) FILTER {_DEPOSIT} AS num_deposits,
      max(greatest(bet_date, transaction_date)) AS last_seen
    FROM customers LEFT JOIN betting_activity USING (customer_id) LEFT JOIN sessions USING (customer_id)
      LEFT JOIN transactions USING (customer_id) GROUP BY 1)""")

STATEMENTS["churn_features_sql_as_written"] = churn_columns(f"""(
    SELECT customer_id, any_value(signup_date) AS signup_date, any_value(acquisition_channel) AS acquisition_channel,
      any_value(customer_segment) AS customer_segment, any_value(age) AS age,
      count(*) FILTER (bet_date >= {AS_OF} - INTERVAL 30 DAYS) AS recent_bets,
      coalesce(sum(bet_amount) FILTER (bet_date >= {AS_OF} - INTERVAL 30 DAYS), 0) AS recent_wagered,
      count(*) FILTER (transaction_date >= {AS_OF} - INTERVAL 30 DAYS) AS recent_tx, count(bet_id) AS bets,
      count(DISTINCT bet_date::DATE) AS betting_days, count(DISTINCT session_id) AS total_sessions,
      coalesce(sum(bet_amount), 0) AS wagered, coalesce(sum(amount) FILTER {_DEPOSIT}, 0) AS deposits,
      coalesce(sum(bet_amount)::DOUBLE / count(bet_amount), 0) AS avg_bet, coalesce(avg(duration_minutes), 0) AS avg_minutes,
      count(DISTINCT sport) AS sports, stddev_samp(bet_amount::DOUBLE) AS bet_std,
      CASE WHEN count(DISTINCT bet_date::DATE) > 1 THEN stddev_samp(n) / nullif(avg(n), 0) ELSE 0 END AS steady,
      max(greatest(bet_date, transaction_date)) AS last_seen
    FROM customers LEFT JOIN betting_activity USING (customer_id) LEFT JOIN transactions USING (customer_id)
      LEFT JOIN sessions USING (customer_id) LEFT JOIN bets_by_day USING (customer_id) GROUP BY 1)""")

STATEMENTS["campaign_deep_analysis_as_written"] = deep_columns(f"""(
    SELECT cc.customer_id, cc.campaign_id, any_value(responded) AS responded,
      any_value(bonus_claimed) AS bonus_claimed, any_value(campaign_type) AS campaign_type,
      any_value(customer_segment) AS customer_segment, any_value(acquisition_channel) AS acquisition_channel,
      coalesce(sum(bet_amount) FILTER (bet_date BETWEEN start_date - INTERVAL 30 DAYS AND start_date), 0) AS pre_w,
      coalesce(sum(bet_amount) FILTER (bet_date BETWEEN start_date AND end_date), 0) AS during_w,
      count(*) FILTER (bet_date BETWEEN end_date AND end_date + INTERVAL 30 DAYS) AS post_n,
      coalesce(sum(amount) FILTER ({_DEPOSIT}
        AND transaction_date BETWEEN start_date AND end_date + INTERVAL 7 DAYS), 0) AS deposited
    FROM customer_campaigns cc JOIN campaigns k USING (campaign_id) JOIN customers c USING (customer_id)
      LEFT JOIN betting_activity b USING (customer_id) LEFT JOIN transactions x USING (customer_id)
    GROUP BY 1, 2)""")

STATEMENTS["revenue_cohort_sql_as_written"] = revenue_columns(" % 12")

# Multiplied counts may pass the range of bigint, so both sides give doubles.
_MULTIPLIED = {
    "customer_ltv_as_written": ("total_bets",),
    "daily_engagement_as_written": ("deposits_count", "total_bets", "total_sessions",
                                    "daily_betting_users", "daily_session_users",
                                    "daily_transacting_users"),
    "customer_segmentation_as_written": ("num_deposits", "total_bets"),
    "churn_features_sql_as_written": ("bets_last_30d", "total_bets", "transactions_last_30d"),
}
for _name, _columns in _MULTIPLIED.items():
    _casts = ", ".join(f"{c}::DOUBLE AS {c}" for c in _columns)
    STATEMENTS[_name] = f"SELECT * REPLACE ({_casts}) FROM ({STATEMENTS[_name]})"
