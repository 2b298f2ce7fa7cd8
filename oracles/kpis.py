"""KPI, journey and quality statements over pre-aggregated facts."""

from __future__ import annotations

from oracles.base import AS_OF, CTES, days, months, rnd, stamp

STATEMENTS: dict[str, str] = {}

STATEMENTS["acquisition_cost"] = f"""
  SELECT acquisition_channel, count(*) AS total_customers, count(f.customer_id) AS converted_customers,
    {rnd('100.0 * count(f.customer_id) / count(*)')} AS conversion_rate_pct,
    {rnd('sum(acquisition_cost)::DOUBLE / count(*)')} AS cost_per_install_cpi,
    {rnd('sum(acquisition_cost)::DOUBLE / nullif(count(f.customer_id), 0)')} AS cost_per_acquisition_cpa,
    sum(acquisition_cost)::DOUBLE AS total_acquisition_cost
  FROM customers c LEFT JOIN (SELECT DISTINCT customer_id FROM first_deposits) f USING (customer_id)
  GROUP BY 1"""


def ltv_columns(source: str) -> str:
    """Published LTV columns from totals named as in ``per_customer``."""
    return f"""
  SELECT customer_id, customer_segment, acquisition_channel, signup_date,
    acquisition_cost::DOUBLE AS acquisition_cost, deposits::DOUBLE AS total_deposits,
    withdrawals::DOUBLE AS total_withdrawals, (deposits - withdrawals)::DOUBLE AS net_deposits,
    wagered::DOUBLE AS total_wagered, payouts::DOUBLE AS total_payouts,
    (wagered - payouts)::DOUBLE AS gross_gaming_revenue,
    (wagered - payouts - acquisition_cost)::DOUBLE AS customer_ltv, tenure_days::BIGINT AS tenure_days,
    bets::BIGINT AS total_bets,
    CASE WHEN bets > 0 THEN {rnd('wagered::DOUBLE / bets')} ELSE 0 END AS avg_bet_size,
    CASE WHEN tenure_days > 0 THEN {rnd('(wagered - payouts - acquisition_cost)::DOUBLE * 30 / tenure_days')}
      ELSE 0 END AS monthly_ltv,
    {stamp('first_tx')} AS first_transaction_date, {stamp('last_seen')} AS last_activity_date
  FROM (SELECT *, CASE WHEN last_seen IS NULL THEN 0 ELSE {days('signup_date', 'last_seen')} + 1 END
          AS tenure_days FROM {source})"""


CTES["ltv"] = ltv_columns("per_customer")
STATEMENTS["customer_ltv"] = "SELECT * FROM ltv"

STATEMENTS["ltv_summary"] = f"""
  SELECT customer_segment, acquisition_channel, count(*) AS customer_count,
    {rnd('avg(customer_ltv)')} AS avg_ltv, {rnd('median(customer_ltv)')} AS median_ltv,
    {rnd('avg(acquisition_cost)')} AS avg_acquisition_cost,
    {rnd('sum(customer_ltv) / nullif(sum(acquisition_cost), 0)')} AS ltv_to_cac_ratio,
    {rnd('avg(tenure_days)', 1)} AS avg_tenure_days, {rnd('avg(total_wagered)')} AS avg_total_wagered,
    {rnd('sum(gross_gaming_revenue)')} AS total_ggr
  FROM ltv WHERE total_bets > 0 GROUP BY 1, 2"""

CTES["activity"] = """
  SELECT customer_id, bet_date AS moment, 'bet' AS kind FROM betting_activity
  UNION ALL SELECT customer_id, transaction_date, 'tx' FROM transactions"""

CTES["sent"] = """
  SELECT campaign_id, count(*) AS targeted, count(*) FILTER (responded) AS answered,
    count(*) FILTER (bonus_claimed) AS claimed, sum(campaign_cost) AS cost
  FROM customer_campaigns GROUP BY 1"""


def campaign_columns(revenue: str) -> str:
    return f"""
  SELECT c.campaign_id, campaign_name, campaign_type, start_date, end_date,
    coalesce(targeted, 0) AS customers_targeted, coalesce(answered, 0) AS customers_responded,
    coalesce(claimed, 0) AS bonuses_claimed, cost::DOUBLE AS total_campaign_cost,
    coalesce(deposits, 0)::DOUBLE AS revenue_deposits, coalesce(ggr, 0)::DOUBLE AS revenue_ggr,
    {rnd('100.0 * answered / nullif(targeted, 0)')} AS response_rate_pct,
    {rnd('100.0 * claimed / nullif(answered, 0)')} AS claim_rate_pct,
    {rnd('coalesce(ggr, 0)::DOUBLE / nullif(cost, 0)')} AS roas_ratio,
    {rnd('cost::DOUBLE / nullif(answered, 0)')} AS cost_per_response
  FROM campaigns c LEFT JOIN sent USING (campaign_id) LEFT JOIN ({revenue}) r USING (campaign_id)"""


STATEMENTS["campaign_performance"] = campaign_columns("""
    SELECT campaign_id, sum(d) AS deposits, sum(g) AS ggr FROM (
      SELECT cc.campaign_id, amount AS d, 0 AS g FROM customer_campaigns cc
        JOIN campaigns k USING (campaign_id) JOIN transactions x USING (customer_id)
      WHERE responded AND transaction_type = 'deposit'
        AND transaction_date BETWEEN start_date AND end_date + INTERVAL 30 DAYS
      UNION ALL
      SELECT cc.campaign_id, 0, bet_amount - payout FROM customer_campaigns cc
        JOIN campaigns k USING (campaign_id) JOIN betting_activity b USING (customer_id)
      WHERE responded AND bet_date BETWEEN start_date AND end_date + INTERVAL 30 DAYS)
    GROUP BY 1""")


def daily_columns(source: str) -> str:
    return f"""
  SELECT activity_date, dau AS daily_active_users, bettors AS daily_betting_users,
    payers AS daily_transacting_users, visitors AS daily_session_users, bets::BIGINT AS total_bets,
    wagered::DOUBLE AS total_wagered, payouts::DOUBLE AS total_payouts,
    (wagered - payouts)::DOUBLE AS gross_gaming_revenue, deposits::BIGINT AS deposits_count,
    deposited::DOUBLE AS deposits_amount, visits::BIGINT AS total_sessions,
    coalesce({rnd('minutes::DOUBLE / nullif(visits, 0)')}, 0) AS avg_session_duration,
    coalesce({rnd('bets::DOUBLE / nullif(bettors, 0)')}, 0) AS bets_per_betting_user,
    coalesce({rnd('wagered::DOUBLE / nullif(bets, 0)')}, 0) AS avg_bet_size,
    coalesce({rnd('visits::DOUBLE / nullif(dau, 0)')}, 0) AS sessions_per_user
  FROM {source}"""


CTES["day_bets"] = """
  SELECT bet_date::DATE AS activity_date, count(DISTINCT customer_id) AS bettors, count(*) AS bets,
    sum(bet_amount) AS wagered, sum(payout) AS payouts FROM betting_activity GROUP BY 1"""
CTES["day_tx"] = """
  SELECT transaction_date::DATE AS activity_date, count(DISTINCT customer_id) AS payers,
    count(*) FILTER (transaction_type = 'deposit') AS deposits,
    sum(amount) FILTER (transaction_type = 'deposit') AS deposited FROM transactions GROUP BY 1"""
CTES["day_visits"] = """
  SELECT start_time::DATE AS activity_date, count(DISTINCT customer_id) AS visitors,
    count(*) AS visits, sum(duration_minutes) AS minutes FROM sessions GROUP BY 1"""
CTES["day_users"] = """
  SELECT activity_date, count(DISTINCT customer_id) AS dau FROM (
    SELECT bet_date::DATE AS activity_date, customer_id FROM betting_activity
    UNION ALL SELECT transaction_date::DATE, customer_id FROM transactions
    UNION ALL SELECT start_time::DATE, customer_id FROM sessions) GROUP BY 1"""
CTES["daily"] = daily_columns("""(
    SELECT activity_date, dau, coalesce(bettors, 0) AS bettors, coalesce(payers, 0) AS payers,
      coalesce(visitors, 0) AS visitors, coalesce(bets, 0) AS bets, coalesce(wagered, 0) AS wagered,
      coalesce(payouts, 0) AS payouts, coalesce(deposits, 0) AS deposits,
      coalesce(deposited, 0) AS deposited, coalesce(visits, 0) AS visits, coalesce(minutes, 0) AS minutes
    FROM day_users LEFT JOIN day_bets USING (activity_date) LEFT JOIN day_tx USING (activity_date)
      LEFT JOIN day_visits USING (activity_date))""")
STATEMENTS["daily_engagement"] = "SELECT * FROM daily"

STATEMENTS["weekly_trends"] = f"""
  WITH w AS (
    SELECT date_trunc('week', activity_date)::DATE AS week_start, sum(daily_active_users) AS users,
      sum(total_bets) AS bets, sum(total_wagered::DECIMAL(18,2)) AS wagered,
      sum(gross_gaming_revenue::DECIMAL(18,2)) AS ggr, sum(deposits_amount::DECIMAL(18,2)) AS deposits,
      sum(avg_bet_size::DECIMAL(18,2)) AS bet_size, count(*) AS n FROM daily GROUP BY 1),
  u AS (
    SELECT date_trunc('week', moment)::DATE AS week_start, count(DISTINCT customer_id) AS people
    FROM (SELECT customer_id, moment FROM activity UNION ALL SELECT customer_id, start_time FROM sessions)
    GROUP BY 1)
  SELECT week_start, week_start + 6 AS week_end, users::BIGINT AS total_weekly_active_users,
    people AS distinct_weekly_users, {rnd('users::DOUBLE / n', 0)} AS avg_daily_active_users,
    bets::BIGINT AS total_weekly_bets, wagered::DOUBLE AS total_weekly_wagered,
    ggr::DOUBLE AS total_weekly_ggr, deposits::DOUBLE AS total_weekly_deposits,
    {rnd('bet_size::DOUBLE / n')} AS avg_bet_size,
    {rnd('100 * (ggr - lag(ggr) OVER o)::DOUBLE / nullif(lag(ggr) OVER o, 0)')} AS ggr_wow_growth_pct,
    {rnd('100 * (users - lag(users) OVER o)::DOUBLE / nullif(lag(users) OVER o, 0)')} AS users_wow_growth_pct
  FROM w JOIN u USING (week_start) WINDOW o AS (ORDER BY week_start)"""


def segmentation_columns(source: str) -> str:
    """From bets, wagered, avg_bet, sessions, avg_minutes, avg_session_bets, deposits, last_seen."""
    return f"""
  WITH s AS (
    SELECT *, {days('last_seen', AS_OF)} AS idle FROM {source}),
  r AS (
    SELECT *, CASE WHEN idle <= 7 THEN 5 WHEN idle <= 30 THEN 4 WHEN idle <= 90 THEN 3
        WHEN idle <= 180 THEN 2 ELSE 1 END AS r,
      CASE WHEN bets >= 100 THEN 5 WHEN bets >= 50 THEN 4 WHEN bets >= 20 THEN 3 WHEN bets >= 5 THEN 2
        WHEN bets >= 1 THEN 1 ELSE 0 END AS f,
      CASE WHEN wagered >= 5000 THEN 5 WHEN wagered >= 1000 THEN 4 WHEN wagered >= 500 THEN 3
        WHEN wagered >= 100 THEN 2 WHEN wagered >= 10 THEN 1 ELSE 0 END AS m FROM s)
  SELECT customer_id, customer_segment AS original_segment, acquisition_channel, signup_date,
    bets::BIGINT AS total_bets, wagered::DOUBLE AS total_wagered, {rnd('avg_bet', 6)} AS avg_bet_size,
    sessions::BIGINT AS total_sessions, {rnd('avg_minutes', 6)} AS avg_session_duration,
    {rnd('avg_session_bets', 6)} AS avg_bets_per_session, deposits::DOUBLE AS total_deposits,
    num_deposits::BIGINT AS num_deposits, idle::BIGINT AS days_since_last_activity,
    r::BIGINT AS recency_score, f::BIGINT AS frequency_score, m::BIGINT AS monetary_score,
    (r + f + m)::BIGINT AS rfm_score,
    CASE WHEN bets = 0 THEN 'Non-Gambler' WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'Champion'
      WHEN r >= 3 AND f >= 3 AND m >= 3 THEN 'Loyal Customer' WHEN r >= 4 AND m >= 3 THEN 'New Customer'
      WHEN f >= 4 AND m >= 4 THEN 'Big Spender' WHEN r <= 2 AND f >= 3 THEN 'At Risk'
      WHEN r <= 2 AND f <= 2 THEN 'Lost Customer' WHEN m <= 2 THEN 'Low Value' ELSE 'Regular'
    END AS behavioral_segment, {stamp('last_seen')} AS last_activity_date
  FROM r"""


STATEMENTS["customer_segmentation"] = segmentation_columns("""(
    SELECT *, coalesce(wagered::DOUBLE / nullif(bets, 0), 0) AS avg_bet,
      coalesce(minutes::DOUBLE / nullif(sessions, 0), 0) AS avg_minutes,
      coalesce(session_bets::DOUBLE / nullif(sessions, 0), 0) AS avg_session_bets FROM per_customer)""")

STATEMENTS["channel_attribution_sql"] = f"""
  SELECT acquisition_channel AS first_touch_channel, count(*) AS total_customers,
    count(f.customer_id) AS converted_customers,
    {rnd('100.0 * count(f.customer_id) / count(*)')} AS conversion_rate,
    sum(acquisition_cost)::DOUBLE AS total_acquisition_cost, {rnd('sum(acquisition_cost)::DOUBLE / count(*)')} AS avg_cpi,
    {rnd('sum(acquisition_cost)::DOUBLE / nullif(count(f.customer_id), 0)')} AS cpa,
    coalesce(sum(f.amount), 0)::DOUBLE AS total_first_deposits, sum(wagered - payouts)::DOUBLE AS total_ggr,
    sum(wagered - payouts - acquisition_cost)::DOUBLE AS total_ltv,
    {rnd('sum(wagered - payouts)::DOUBLE / nullif(sum(acquisition_cost), 0)')} AS roas_ggr,
    {rnd('sum(wagered - payouts - acquisition_cost)::DOUBLE / nullif(sum(acquisition_cost), 0)')} AS ltv_cac_ratio,
    {rnd('sum(f.amount)::DOUBLE / nullif(count(f.customer_id), 0)')} AS avg_first_deposit,
    {rnd('sum(wagered - payouts - acquisition_cost)::DOUBLE / count(*)')} AS avg_customer_ltv
  FROM per_customer p LEFT JOIN first_deposits f USING (customer_id) GROUP BY 1"""
