"""Loading checks and dashboard summaries."""

from __future__ import annotations

from oracles.base import AS_OF, CTES, rnd

STATEMENTS: dict[str, str] = {}

_CHECKS = [("customers", "acquisition_cost < 0", "signup_date"),
           ("transactions", "amount <= 0", "transaction_date"),
           ("betting_activity", "bet_amount <= 0", "bet_date"),
           ("sessions", "duration_minutes < 0", "start_time")]
STATEMENTS["data_quality_summary"] = " UNION ALL ".join(f"""
  SELECT '{name}' AS table_name, count(*) AS total_records, count(*) - count(customer_id) AS null_ids,
    count(*) FILTER ({bad}) AS negative_costs, min({at})::DATE AS earliest_date, max({at})::DATE AS latest_date
  FROM {name}""" for name, bad, at in _CHECKS)

STATEMENTS["database_summary"] = """
  SELECT (SELECT count(*) FROM customers) AS total_customers, (SELECT count(*) FROM transactions) AS total_transactions,
    (SELECT count(*) FROM betting_activity) AS total_bets, (SELECT count(*) FROM sessions) AS total_sessions,
    (SELECT count(*) FROM campaigns) AS total_campaigns,
    (SELECT count(*) FROM customer_campaigns) AS total_campaign_interactions,
    (SELECT count(DISTINCT customer_id) FROM first_deposits) AS converted_customers,
    (SELECT sum(amount)::DOUBLE FROM transactions WHERE transaction_type = 'deposit') AS total_deposits,
    (SELECT sum(bet_amount)::DOUBLE FROM betting_activity) AS total_wagered,
    (SELECT sum(bet_amount - payout)::DOUBLE FROM betting_activity) AS total_ggr"""

_KEYS = [("customers", "customer_id"), ("transactions", "transaction_id"), ("betting_activity", "bet_id"),
         ("sessions", "session_id"), ("campaigns", "campaign_id"),
         ("customer_campaigns", "customer_id, campaign_id")]
STATEMENTS["dq_primary_key"] = " UNION ALL ".join(f"""
  SELECT '{name}' AS table_name, coalesce(sum(n), 0)::BIGINT AS total_rows,
    coalesce(sum(n) FILTER (missing), 0)::BIGINT AS null_keys,
    count(*) FILTER (n > 1 AND NOT missing) AS duplicate_keys,
    coalesce(sum(n - 1) FILTER (NOT missing), 0)::BIGINT AS surplus_rows
  FROM (SELECT {key}, count(*) AS n, {' OR '.join(c.strip() + ' IS NULL' for c in key.split(','))} AS missing
        FROM {name} GROUP BY ALL)""" for name, key in _KEYS)

_REFERENCES = [("transactions", "customer_id", "customers"), ("betting_activity", "customer_id", "customers"),
               ("sessions", "customer_id", "customers"), ("customer_campaigns", "customer_id", "customers"),
               ("customer_campaigns", "campaign_id", "campaigns")]
STATEMENTS["dq_foreign_key"] = " UNION ALL ".join(f"""
  SELECT '{child}' AS child_table, '{key}' AS child_column, '{parent}' AS parent_table,
    count(DISTINCT {key}) AS orphan_keys, count(*) AS orphan_rows
  FROM {child} ANTI JOIN {parent} USING ({key}) WHERE {key} IS NOT NULL""" for child, key, parent in _REFERENCES)

_REQUIRED = {"customers": ["signup_date", "acquisition_channel"],
             "transactions": ["customer_id", "transaction_type", "amount", "transaction_date"],
             "betting_activity": ["customer_id", "bet_amount", "bet_date"],
             "sessions": ["customer_id", "start_time"],
             "campaigns": ["campaign_name", "start_date", "end_date"],
             "customer_campaigns": ["customer_id", "campaign_id", "sent_date"]}
STATEMENTS["dq_domain"] = " UNION ALL ".join([f"""
  SELECT '{name}' AS table_name, '{c} not null' AS rule, count(*) - count({c}) AS violations FROM {name}"""
    for name, columns in _REQUIRED.items() for c in columns] + ["""
  SELECT 'transactions', 'transaction_type domain',
    count(*) FILTER (transaction_type NOT IN ('deposit', 'withdrawal')) FROM transactions"""])

CTES["picked"] = """
  SELECT customer_id FROM customers WHERE acquisition_channel = 'paid_search'
    AND signup_date BETWEEN DATE '1994-01-01' AND DATE '1995-06-30'"""
STATEMENTS["filter_customers"] = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS records FROM {name}"
    + ("" if name == "campaigns" else " SEMI JOIN picked USING (customer_id)") for name, _ in _KEYS)

STATEMENTS["overview_kpis"] = f"""
  SELECT *, {rnd('converted_customers::DOUBLE / total_customers', 6)} AS conversion_rate,
    {rnd('gross_gaming_revenue / converted_customers', 6)} AS avg_customer_ltv
  FROM (SELECT (SELECT count(*) FROM customers) AS total_customers,
    (SELECT count(DISTINCT customer_id) FROM first_deposits) AS converted_customers,
    (SELECT sum(amount)::DOUBLE FROM transactions WHERE transaction_type = 'deposit') AS total_deposits,
    (SELECT sum(bet_amount)::DOUBLE FROM betting_activity) AS total_wagered,
    (SELECT sum(bet_amount - payout)::DOUBLE FROM betting_activity) AS gross_gaming_revenue,
    (SELECT {rnd('sum(amount)::DOUBLE / count(*)', 6)} FROM first_deposits) AS avg_first_deposit)"""

STATEMENTS["channel_performance"] = f"""
  SELECT acquisition_channel, count(*) AS customers, sum(acquisition_cost)::DOUBLE AS acquisition_cost,
    count(f.amount) AS conversions, {rnd('count(f.amount)::DOUBLE / count(*)', 6)} AS conversion_rate,
    CASE WHEN count(f.amount) = 0 AND sum(acquisition_cost) > 0 THEN 0
      ELSE {rnd('sum(acquisition_cost)::DOUBLE / nullif(count(f.amount), 0)', 6)} END AS cpa
  FROM customers c LEFT JOIN first_deposits f USING (customer_id) GROUP BY 1"""

STATEMENTS["daily_metrics"] = """
  SELECT b.activity_date AS date, bettors AS daily_active_users, bets AS total_bets,
    wagered::DOUBLE AS total_wagered, payouts::DOUBLE AS total_payouts,
    (wagered - payouts)::DOUBLE AS gross_gaming_revenue, coalesce(users, 0) AS depositing_users,
    coalesce(d.deposited, 0)::DOUBLE AS total_deposits
  FROM day_bets b LEFT JOIN (SELECT transaction_date::DATE AS activity_date, count(DISTINCT customer_id) AS users,
      sum(amount) AS deposited FROM transactions WHERE transaction_type = 'deposit' GROUP BY 1) d USING (activity_date)"""

STATEMENTS["dataset_summary"] = f"""
  SELECT (SELECT count(*) FROM customers) AS customers, count(*) AS bets,
    {rnd('(SELECT count(*) FROM first_deposits)::DOUBLE / (SELECT count(*) FROM customers)', 6)} AS conversion_rate,
    {rnd('sum(bet_amount)::DOUBLE / count(*)', 6)} AS avg_bet_size, sum(bet_amount)::DOUBLE AS total_volume_wagered
  FROM betting_activity"""

STATEMENTS["campaign_audience"] = """
  SELECT campaign_id, customer_segment, count(*) AS eligible, count(*) FILTER (
    ('0x' || md5(campaign_id || '|' || customer_id)[1:8])::BIGINT < (0.65 * 4294967296)::BIGINT - 0) AS sampled
  FROM campaigns k JOIN customers c ON list_contains(string_split(target_segments, ','), customer_segment)
    AND signup_date <= start_date GROUP BY 1, 2"""

STATEMENTS["data_dictionary"] = """
  SELECT (SELECT count(*) FROM customers) AS total_customers, (SELECT count(*) FROM transactions) AS total_transactions,
    (SELECT count(*) FROM betting_activity) AS total_bets, (SELECT count(*) FROM sessions) AS total_sessions,
    (SELECT count(*) FROM campaigns) AS total_campaigns,
    (SELECT string_agg(DISTINCT acquisition_channel, ',' ORDER BY acquisition_channel) FROM customers) AS channels,
    (SELECT string_agg(DISTINCT customer_segment, ',' ORDER BY customer_segment) FROM customers) AS customer_segments,
    (SELECT string_agg(DISTINCT sport, ',' ORDER BY sport) FROM betting_activity) AS sports"""
