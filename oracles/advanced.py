"""Journey, churn, campaign effect, sports and daily series statements."""

from __future__ import annotations

from oracles.base import AS_OF, CTES, days, rnd, stamp

STATEMENTS: dict[str, str] = {}

STATEMENTS["customer_journey_milestones"] = f"""
  WITH fd AS (SELECT customer_id, min(transaction_date) AS d, min(amount) AS a FROM first_deposits GROUP BY 1),
  fb AS (SELECT customer_id, bet_amount AS a FROM betting_activity
    QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY bet_date, bet_amount) = 1),
  td AS (SELECT customer_id, count(DISTINCT transaction_date::DATE) AS n FROM transactions GROUP BY 1)
  SELECT p.customer_id, signup_date, acquisition_channel, customer_segment,
    {stamp('fd.d')} AS first_deposit_date, fd.a::DOUBLE AS first_deposit_amount,
    {stamp('first_bet')} AS first_bet_date, fb.a::DOUBLE AS first_bet_amount,
    betting_days AS active_betting_days, coalesce(td.n, 0) AS active_transaction_days,
    {stamp('last_seen')} AS last_activity_date,
    {days('signup_date', 'fd.d')} AS days_to_first_deposit, {days('signup_date', 'first_bet')} AS days_to_first_bet,
    CASE WHEN fd.d IS NULL THEN 'Registered - No Deposit' WHEN first_bet IS NULL THEN 'Deposited - No Bet'
      WHEN {days('last_seen', AS_OF)} <= 30 THEN 'Active' WHEN {days('last_seen', AS_OF)} <= 90 THEN 'Dormant'
      ELSE 'Churned' END AS lifecycle_stage,
    CASE WHEN betting_days >= 30 THEN 'High Frequency' WHEN betting_days >= 10 THEN 'Medium Frequency'
      WHEN betting_days >= 1 THEN 'Low Frequency' ELSE 'No Betting' END AS engagement_level
  FROM per_customer p LEFT JOIN fd USING (customer_id) LEFT JOIN fb USING (customer_id)
    LEFT JOIN td USING (customer_id)"""


def churn_columns(source: str) -> str:
    """From recent_bets, recent_wagered, recent_tx, bets, betting_days, sessions, wagered, deposits,
    avg_bet, avg_minutes, sports, bet_std, steady, last_seen."""
    return f"""
  SELECT customer_id, signup_date, acquisition_channel, customer_segment, age::BIGINT AS age,
    recent_bets::BIGINT AS bets_last_30d, recent_wagered::DOUBLE AS wagered_last_30d,
    recent_tx::BIGINT AS transactions_last_30d, bets::BIGINT AS total_bets, betting_days, total_sessions,
    wagered::DOUBLE AS total_wagered, deposits::DOUBLE AS total_deposits, {rnd('avg_bet', 6)} AS avg_bet_size,
    {rnd('avg_minutes', 6)} AS avg_session_duration, sports AS sports_diversity,
    {rnd('bet_std', 6)} AS bet_size_variance, {rnd('steady', 6)} AS betting_consistency,
    {stamp('last_seen')} AS last_activity_date,
    CASE WHEN last_seen IS NULL THEN NULL WHEN {days('last_seen', AS_OF)} > 30 AND bets > 0 THEN 1
      ELSE 0 END::BIGINT AS is_churned,
    {days('last_seen', AS_OF)} AS days_since_last_activity, date_diff('day', signup_date, {AS_OF}) AS tenure_days,
    CASE WHEN bets > 0 THEN {rnd('recent_bets::DOUBLE / bets', 6)} ELSE 0 END AS recent_activity_ratio,
    CASE WHEN wagered > 0 THEN {rnd('recent_wagered::DOUBLE / wagered', 6)} ELSE 0 END AS recent_spending_ratio,
    CASE WHEN betting_days > 0 THEN {rnd('bets::DOUBLE / betting_days', 6)} ELSE 0 END AS bets_per_active_day
  FROM {source}"""


CTES["bets_by_day"] = """
  SELECT customer_id, bet_date::DATE AS d, count(*) AS n FROM betting_activity GROUP BY 1, 2"""

STATEMENTS["churn_features_sql"] = churn_columns(f"""(
    WITH b AS (SELECT customer_id, stddev_samp(bet_amount::DOUBLE) AS bet_std, count(DISTINCT sport) AS sports,
        count(*) FILTER (bet_date >= {AS_OF} - INTERVAL 30 DAYS) AS recent_bets,
        sum(bet_amount) FILTER (bet_date >= {AS_OF} - INTERVAL 30 DAYS) AS recent_wagered
      FROM betting_activity GROUP BY 1),
    d AS (SELECT customer_id, CASE WHEN count(*) > 1 THEN stddev_samp(n) / avg(n) ELSE 0 END AS steady
      FROM bets_by_day GROUP BY 1),
    x AS (SELECT customer_id, count(*) FILTER (transaction_date >= {AS_OF} - INTERVAL 30 DAYS) AS recent_tx
      FROM transactions GROUP BY 1)
    SELECT p.* EXCLUDE (sessions), p.sessions AS total_sessions, bet_std, coalesce(sports, 0) AS sports,
      coalesce(recent_bets, 0) AS recent_bets, coalesce(recent_wagered, 0) AS recent_wagered,
      coalesce(recent_tx, 0) AS recent_tx, coalesce(steady, 0) AS steady,
      coalesce(wagered::DOUBLE / nullif(bets, 0), 0) AS avg_bet,
      coalesce(minutes::DOUBLE / nullif(sessions, 0), 0) AS avg_minutes
    FROM per_customer p LEFT JOIN b USING (customer_id) LEFT JOIN d USING (customer_id)
      LEFT JOIN x USING (customer_id))""")


def deep_columns(source: str) -> str:
    """From one row per send with pre/during/post sums."""
    return f"""
  SELECT campaign_id, campaign_type, customer_segment, acquisition_channel, count(*) AS customers_targeted,
    count(*) FILTER (responded) AS customers_responded,
    count(*) FILTER (bonus_claimed) AS customers_claimed_bonus,
    {rnd('100.0 * count(*) FILTER (responded) / count(*)')} AS response_rate,
    {rnd('100.0 * count(*) FILTER (bonus_claimed) / nullif(count(*) FILTER (responded), 0)')} AS claim_rate,
    {rnd('avg(during_w::DOUBLE) FILTER (responded)')} AS avg_wagered_responders,
    {rnd('avg(during_w::DOUBLE) FILTER (NOT responded)')} AS avg_wagered_non_responders,
    {rnd('avg((during_w - pre_w)::DOUBLE) FILTER (responded)')} AS avg_wagered_lift_responders,
    {rnd('avg((during_w - pre_w)::DOUBLE) FILTER (NOT responded)')} AS avg_wagered_lift_non_responders,
    sum(deposited)::DOUBLE AS total_deposits_generated,
    {rnd('sum(deposited)::DOUBLE / count(*)')} AS avg_deposit_per_customer,
    {rnd('100.0 * count(*) FILTER (responded AND post_n > 0) / nullif(count(*) FILTER (responded), 0)')}
      AS responder_retention_rate,
    {rnd('100.0 * count(*) FILTER (NOT responded AND post_n > 0) / nullif(count(*) FILTER (NOT responded), 0)')}
      AS non_responder_retention_rate
  FROM {source} GROUP BY 1, 2, 3, 4"""


STATEMENTS["campaign_deep_analysis"] = deep_columns("""(
    WITH s AS (
      SELECT cc.customer_id, cc.campaign_id, responded, bonus_claimed, campaign_type, customer_segment,
        acquisition_channel, start_date AS a, end_date AS z
      FROM customer_campaigns cc JOIN campaigns k USING (campaign_id) JOIN customers c USING (customer_id)),
    w AS (
      SELECT s.customer_id, s.campaign_id,
        sum(bet_amount) FILTER (bet_date BETWEEN a - INTERVAL 30 DAYS AND a) AS pre_w,
        sum(bet_amount) FILTER (bet_date BETWEEN a AND z) AS during_w,
        count(*) FILTER (bet_date BETWEEN z AND z + INTERVAL 30 DAYS) AS post_n
      FROM s JOIN betting_activity b USING (customer_id) GROUP BY 1, 2),
    d AS (
      SELECT s.customer_id, s.campaign_id, sum(amount) AS deposited FROM s JOIN transactions x USING (customer_id)
      WHERE transaction_type = 'deposit' AND transaction_date BETWEEN a AND z + INTERVAL 7 DAYS GROUP BY 1, 2)
    SELECT s.*, coalesce(pre_w, 0) AS pre_w, coalesce(during_w, 0) AS during_w, coalesce(post_n, 0) AS post_n,
      coalesce(deposited, 0) AS deposited
    FROM s LEFT JOIN w USING (customer_id, campaign_id) LEFT JOIN d USING (customer_id, campaign_id))""")

STATEMENTS["sports_preference"] = f"""
  WITH cs AS (
    SELECT customer_id, sport, count(*) AS n, sum(bet_amount) AS wagered, sum(net_result) AS net,
      count(*) FILTER (bet_won) AS won FROM betting_activity GROUP BY 1, 2),
  r AS (
    SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY wagered DESC, sport) AS by_volume,
      row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, sport) AS by_count FROM cs)
  SELECT sport, customer_segment, acquisition_channel, count(DISTINCT customer_id) AS customers_betting_sport,
    sum(n)::BIGINT AS total_bets, sum(wagered)::DOUBLE AS total_volume,
    {rnd('avg(wagered::DOUBLE / n)')} AS avg_bet_size, {rnd('avg(won::DOUBLE / n) * 100')} AS avg_win_rate_pct,
    count(*) FILTER (by_volume = 1) AS customers_primary_sport_by_volume,
    count(*) FILTER (by_count = 1) AS customers_primary_sport_by_frequency,
    sum(net)::DOUBLE AS total_customer_net_result, (-sum(net))::DOUBLE AS house_edge_revenue,
    {rnd('-100 * sum(net)::DOUBLE / nullif(sum(wagered), 0)')} AS house_edge_percentage
  FROM r JOIN customers c USING (customer_id) GROUP BY 1, 2, 3"""


def _change(column: str) -> str:
    return rnd(f"100 * ({column}::DOUBLE - lag({column}) OVER o) / nullif(lag({column}) OVER o, 0)")


def _timeseries(source: str) -> str:
    return f"""
  SELECT activity_date AS date, daily_active_users, daily_betting_users, total_bets, total_wagered,
    gross_gaming_revenue, deposits_amount, avg_bet_size,
    {rnd('avg(daily_active_users) OVER w7', 0)} AS ma7_active_users,
    {rnd('avg(total_wagered) OVER w7')} AS ma7_wagered, {rnd('avg(gross_gaming_revenue) OVER w7')} AS ma7_ggr,
    {_change('daily_active_users')} AS dod_change_active_users, {_change('total_wagered')} AS dod_change_wagered,
    {_change('gross_gaming_revenue')} AS dod_change_ggr,
    extract(dow FROM activity_date) AS day_of_week, dayname(activity_date) AS day_name,
    quarter(activity_date) AS quarter, month(activity_date) AS month, week(activity_date) AS week_of_year
  FROM {source} WINDOW o AS (ORDER BY activity_date), w7 AS (ORDER BY activity_date ROWS 6 PRECEDING)"""


STATEMENTS["daily_timeseries"] = _timeseries("daily")
STATEMENTS["daily_timeseries_dense"] = _timeseries("""(
    SELECT activity_date, coalesce(COLUMNS(* EXCLUDE (activity_date)), 0)
    FROM (SELECT unnest(generate_series(min(activity_date)::TIMESTAMP, max(activity_date)::TIMESTAMP,
        INTERVAL 1 DAY))::DATE AS activity_date FROM daily)
      LEFT JOIN daily USING (activity_date))""")
