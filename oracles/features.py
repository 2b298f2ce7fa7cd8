"""Feature, target and evaluation statements."""

from __future__ import annotations

from oracles.base import AS_OF, CTES, floor_days, rnd

STATEMENTS: dict[str, str] = {}


def _flag(column: str, values: tuple[str, ...], prefix: str) -> str:
    return ", ".join(f"({column} = '{v}')::BIGINT AS {prefix}_{v}" for v in values)


def _rate(count: str, days: int) -> str:
    return rnd(f"coalesce({count}, 0) / greatest(1.0::DOUBLE, tenure / {days}.0::DOUBLE)", 6)


CTES["feature_rows"] = f"""
  WITH fd AS (
    SELECT customer_id, transaction_date AS first_dep, amount AS first_amount FROM transactions
    WHERE transaction_type = 'deposit'
    QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY transaction_date, transaction_id) = 1),
  b AS (
    SELECT customer_id, stddev_samp(bet_amount::DOUBLE) AS std, count(*) FILTER (bet_won) AS won,
      count(DISTINCT sport) AS sports, sum(net_result) AS net,
      count(*) FILTER (bet_date >= {AS_OF} - INTERVAL 30 DAYS) AS rb,
      sum(bet_amount) FILTER (bet_date >= {AS_OF} - INTERVAL 30 DAYS) AS rw,
      count(DISTINCT bet_date::DATE) FILTER (bet_date >= {AS_OF} - INTERVAL 30 DAYS) AS rd
    FROM betting_activity GROUP BY 1),
  fav AS (
    SELECT customer_id, sport FROM betting_activity GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, sport) = 1),
  dev AS (
    SELECT customer_id, count(*) FILTER (device_type = 'mobile') AS mobile,
      count(*) FILTER (device_type = 'desktop') AS desktop FROM sessions GROUP BY 1),
  p AS (
    SELECT pc.*, date_diff('day', signup_date, {AS_OF}) AS tenure, first_dep, first_amount, std, won, sports,
      net, rb, rw, rd, fav.sport, mobile, desktop, num_tx - num_deposits AS num_w
    FROM per_customer pc LEFT JOIN fd USING (customer_id) LEFT JOIN b USING (customer_id)
      LEFT JOIN fav USING (customer_id) LEFT JOIN dev USING (customer_id))
  SELECT customer_id, age::BIGINT AS age, acquisition_cost::DOUBLE AS acquisition_cost, tenure AS tenure_days,
    {_flag('customer_segment', ('casual', 'regular', 'whale'), 'customer_segment')},
    {_flag('acquisition_channel', ('paid_search', 'social_media', 'affiliate', 'organic'), 'channel')},
    email_verified::BIGINT AS email_verified, phone_verified::BIGINT AS phone_verified,
    deposits::DOUBLE AS total_deposits, withdrawals::DOUBLE AS total_withdrawals,
    (deposits - withdrawals)::DOUBLE AS net_deposits, num_deposits, num_w AS num_withdrawals,
    coalesce({rnd('deposits::DOUBLE / nullif(num_deposits, 0)', 6)}, 0) AS avg_deposit_size,
    coalesce(first_amount, 0)::DOUBLE AS first_deposit_amount, {_rate('num_deposits', 30)} AS deposit_frequency,
    (first_dep IS NOT NULL)::BIGINT AS has_made_deposit,
    CASE WHEN first_dep IS NULL THEN -1 ELSE {floor_days('signup_date', 'first_dep')} END::BIGINT
      AS days_to_first_deposit,
    CASE WHEN first_dep IS NULL THEN tenure ELSE {floor_days('last_tx', AS_OF)} END::BIGINT
      AS days_since_last_transaction,
    CASE WHEN first_dep IS NULL THEN 0 ELSE {floor_days('first_dep', 'last_tx')} + 1 END::BIGINT
      AS transaction_span_days,
    bets AS total_bets, wagered::DOUBLE AS total_wagered, payouts::DOUBLE AS total_winnings,
    coalesce(net, 0)::DOUBLE AS net_betting_result, (wagered - payouts)::DOUBLE AS gross_gaming_revenue,
    coalesce({rnd('wagered::DOUBLE / nullif(bets, 0)', 6)}, 0) AS avg_bet_size,
    coalesce({rnd('std', 6)}, 0) AS bet_size_std, coalesce({rnd('won::DOUBLE / nullif(bets, 0)', 6)}, 0) AS win_rate,
    {_rate('bets', 7)} AS betting_frequency, coalesce(sports, 0) AS sports_diversity,
    coalesce(sport, 'none') AS favorite_sport,
    CASE WHEN bets = 0 THEN -1 ELSE {floor_days('signup_date', 'first_bet')} END::BIGINT AS days_to_first_bet,
    CASE WHEN bets = 0 THEN tenure ELSE {floor_days('last_bet', AS_OF)} END::BIGINT AS days_since_last_bet,
    CASE WHEN bets = 0 THEN 0 ELSE {floor_days('first_bet', 'last_bet')} + 1 END::BIGINT AS betting_span_days,
    betting_days AS active_betting_days, coalesce(rb, 0) AS bets_last_30d,
    coalesce(rw, 0)::DOUBLE AS wagered_last_30d, coalesce(rd, 0) AS active_days_last_30d,
    sessions AS total_sessions, coalesce({rnd('minutes::DOUBLE / nullif(sessions, 0)', 6)}, 0) AS avg_session_duration,
    minutes::BIGINT AS total_session_time,
    coalesce({rnd('session_bets::DOUBLE / nullif(sessions, 0)', 6)}, 0) AS avg_bets_per_session,
    {_rate('sessions', 7)} AS sessions_per_week,
    coalesce({rnd('mobile::DOUBLE / nullif(sessions, 0)', 6)}, 0) AS mobile_sessions_pct,
    coalesce({rnd('desktop::DOUBLE / nullif(sessions, 0)', 6)}, 0) AS desktop_sessions_pct
  FROM p"""

CTES["features"] = """
  SELECT *, (days_since_last_bet > 30 AND days_since_last_transaction > 30
      AND (total_bets > 0 OR num_deposits > 0))::BIGINT AS churn_target,
    (gross_gaming_revenue::DECIMAL(18,2) - acquisition_cost::DECIMAL(18,2))::DOUBLE AS ltv_target,
    has_made_deposit AS conversion_target
  FROM feature_rows"""
STATEMENTS["feature_matrix"] = "SELECT * FROM features"
for _kind in ("churn", "ltv", "conversion"):
    STATEMENTS[f"target_{_kind}"] = f"SELECT customer_id, {_kind}_target FROM features"

STATEMENTS["split_80_20"] = """
  SELECT churn_target, row_number() OVER w <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY churn_target)) AS is_test,
    customer_id FROM features
  WINDOW w AS (PARTITION BY churn_target ORDER BY ('0x' || md5('42|' || customer_id)[1:15])::BIGINT)"""
STATEMENTS["split_80_20"] = f"""
  SELECT churn_target, is_test, count(*) AS customers FROM ({STATEMENTS["split_80_20"]}) GROUP BY 1, 2"""

STATEMENTS["classification_report"] = f"""
  WITH r AS (SELECT churn_target AS y, (days_since_last_bet > 90)::BIGINT AS p FROM features),
  c AS (
    SELECT k, (SELECT count(*) FROM r WHERE y = k) AS support, (SELECT count(*) FROM r WHERE p = k) AS said,
      (SELECT count(*) FROM r WHERE y = k AND p = k) AS hit FROM (SELECT unnest([0, 1]) AS k)),
  m AS (
    SELECT k, support, hit, coalesce(hit::DOUBLE / nullif(said, 0), 0) AS pr,
      coalesce(hit::DOUBLE / nullif(support, 0), 0) AS re,
      coalesce(2.0 * hit / nullif(said + support, 0), 0)::DOUBLE AS f1 FROM c)
  SELECT k::VARCHAR AS class, {rnd('pr', 6)} AS precision, {rnd('re', 6)} AS recall, {rnd('f1', 6)} AS f1_score,
    support FROM m
  UNION ALL SELECT 'accuracy', {rnd('sum(hit)::DOUBLE / sum(support)', 6)}, {rnd('sum(hit)::DOUBLE / sum(support)', 6)},
    {rnd('sum(hit)::DOUBLE / sum(support)', 6)}, sum(support)::BIGINT FROM m
  UNION ALL SELECT 'macro avg', {rnd('avg(pr)', 6)}, {rnd('avg(re)', 6)}, {rnd('avg(f1)', 6)}, sum(support)::BIGINT FROM m
  UNION ALL SELECT 'weighted avg', {rnd('sum(pr * support) / sum(support)', 6)},
    {rnd('sum(re * support) / sum(support)', 6)}, {rnd('sum(f1 * support) / sum(support)', 6)},
    sum(support)::BIGINT FROM m"""

STATEMENTS["roc_pr_curves"] = f"""
  WITH v AS (
    SELECT days_since_last_bet AS s, count(*) AS n, sum(churn_target) AS pos FROM features GROUP BY 1),
  c AS (
    SELECT s, (sum(n) OVER d)::BIGINT AS called, (sum(pos) OVER d)::BIGINT AS tp,
      (sum(n) OVER ())::BIGINT AS total, (sum(pos) OVER ())::BIGINT AS p FROM v WINDOW d AS (ORDER BY s DESC))
  SELECT s AS threshold, tp AS true_positives, called - tp AS false_positives,
    {rnd('tp::DOUBLE / nullif(p, 0)', 6)} AS recall,
    {rnd('(called - tp)::DOUBLE / nullif(total - p, 0)', 6)} AS false_positive_rate,
    {rnd('tp::DOUBLE / called', 6)} AS precision
  FROM c"""


def _band(value: str, high: str, medium: str) -> str:
    return f"CASE WHEN {value} > {high} THEN 'High' WHEN {value} > {medium} THEN 'Medium' ELSE 'Low' END"


STATEMENTS["risk_bands"] = f"""
  SELECT customer_id, win_rate AS churn_probability, {_band('win_rate', '0.7', '0.3')} AS churn_risk,
    CASE WHEN has_made_deposit = 1 THEN ltv_target ELSE 0 END AS predicted_ltv,
    CASE WHEN has_made_deposit = 1 THEN {_band('ltv_target', '200', '50')} ELSE 'Low' END AS ltv_segment,
    CASE WHEN has_made_deposit = 1 THEN 1 ELSE mobile_sessions_pct END AS conversion_probability,
    CASE WHEN has_made_deposit = 1 THEN 'Converted' ELSE {_band('mobile_sessions_pct', '0.7', '0.3')} END
      AS conversion_potential,
    tenure_days, total_bets, total_wagered, days_since_last_bet, customer_segment
  FROM features JOIN customers USING (customer_id)"""
