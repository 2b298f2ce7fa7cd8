"""The six tables over the driver's parquet views, plus shared building blocks.

DuckDB's ROUND works on binary doubles, Spark's on exact decimals. ``rnd`` nudges by
a ten-millionth of the last digit away from zero first so that exact halves go up as they do in decimal arithmetic;
``+ 0.0`` removes a negative zero.
"""

from __future__ import annotations

AS_OF = "DATE '2001-11-05'"


def rnd(expression: str, digits: int = 2) -> str:
    value = f"({expression})::DOUBLE"
    return f"(round({value} + sign({value}) * 1e-{digits + 7}, {digits}) + 0.0)"


def stamp(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


def days(start: str, end: str) -> str:
    """Whole 24-hour periods, toward zero."""
    return f"date_sub('day', ({start})::TIMESTAMP, ({end})::TIMESTAMP)"


def floor_days(start: str, end: str) -> str:
    return f"floor((epoch_us(({end})::TIMESTAMP) - epoch_us(({start})::TIMESTAMP)) / 86400000000.0)"


def months(start: str, end: str) -> str:
    """Difference in calendar months between two month starts."""
    return (
        f"((year({end}) - year({start})) * 12 + month({end}) - month({start}))"
    )


def money(expression: str, divisor: int) -> str:
    return f"((round(({expression}) * 100)::BIGINT // {divisor})::DECIMAL(12,0) * 0.01)::DECIMAL(10,2)"


def _id(key: str) -> str:
    return f"'CU_' || lpad({key}::VARCHAR, 12, '0')"


def _signup(key: str) -> str:
    return f"(DATE '1993-07-01' + (({key} * 7) % 900)::INTEGER)"


_DEPOSIT = "(o_orderstatus = 'O' AND o_custkey % 8 <> 0)"
_SEGMENT = ("CASE c_mktsegment WHEN 'MACHINERY' THEN 'whale' WHEN 'HOUSEHOLD' THEN 'regular' "
            "ELSE 'casual' END")

CTES: dict[str, str] = {}

CTES["customers"] = f"""
  SELECT {_id('c_custkey')} AS customer_id, {_signup('c_custkey')} AS signup_date,
    ['paid_search','social_media','affiliate','organic'][c_nationkey % 4 + 1] AS acquisition_channel,
    CASE WHEN c_nationkey % 4 = 3 THEN 0::DECIMAL(10,2) ELSE {money('abs(c_acctbal)', 100)} END AS acquisition_cost,
    18 + c_custkey % 48 AS age, {_SEGMENT} AS customer_segment,
    c_custkey % 7 <> 0 AS email_verified, c_custkey % 4 <> 0 AS phone_verified
  FROM customer"""

CTES["transactions"] = f"""
  SELECT o_orderkey::VARCHAR AS transaction_id, {_id('o_custkey')} AS customer_id,
    CASE WHEN {_DEPOSIT} THEN 'deposit' ELSE 'withdrawal' END AS transaction_type,
    {money('o_totalprice', 1000)} AS amount, o_orderdate AS transaction_date,
    o_orderpriority AS payment_method,
    {_DEPOSIT} AND row_number() OVER (
      PARTITION BY o_custkey, {_DEPOSIT} ORDER BY o_orderdate, o_orderkey) = 1 AS is_first_deposit
  FROM orders"""

CTES["betting_activity"] = f"""
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS bet_id,
    {_id('o_custkey')} AS customer_id, p_type AS sport, {money('l_extendedprice', 1000)} AS bet_amount,
    l_shipdate + to_minutes((l_partkey * 37 + l_linenumber * 11) % 1440) AS bet_date,
    l_returnflag = 'R' AS bet_won,
    CASE WHEN l_returnflag = 'R' THEN {money('l_extendedprice * 2', 1000)} ELSE 0::DECIMAL(10,2) END AS payout,
    (CASE WHEN l_returnflag = 'R' THEN {money('l_extendedprice * 2', 1000)} ELSE 0::DECIMAL(10,2) END
      - {money('l_extendedprice', 1000)})::DECIMAL(10,2) AS net_result
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""

CTES["sessions"] = f"""
  SELECT 'SES-' || user_id || '-' || bucket AS session_id, {_id('user_id')} AS customer_id,
    lo - INTERVAL 25 YEARS AS start_time, hi - INTERVAL 25 YEARS AS end_time,
    (epoch_us(hi) // 1000000 - epoch_us(lo) // 1000000) // 60 AS duration_minutes, bets AS num_bets,
    CASE WHEN first_event % 20 < 13 THEN 'mobile' WHEN first_event % 20 < 18 THEN 'desktop'
      ELSE 'tablet' END AS device_type
  FROM (SELECT user_id, epoch_us(ts) // 7200000000 AS bucket, min(ts) AS lo, max(ts) AS hi,
          count(*) FILTER (event_type = 'purchase') AS bets, min(event_id) AS first_event
        FROM events GROUP BY 1, 2)"""

CTES["campaign_rows"] = """
  SELECT k, 'CAMP_' || lpad((k + 1)::VARCHAR, 5, '0') AS campaign_id,
    ['signup_bonus','retention','engagement','vip'][k % 4 + 1] AS campaign_type,
    DATE '1993-08-01' + (k * 110)::INTEGER AS start_date,
    DATE '1993-08-01' + (k * 110 + 7 + k % 15)::INTEGER AS end_date,
    [15.0, 8.5, 10.0, 45.0][k % 4 + 1]::DECIMAL(8,2) AS cost_per_customer,
    [50, 25, 10, 200][k % 4 + 1]::DECIMAL(8,2) AS bonus_amount,
    ['casual,regular,whale','regular,whale','casual,regular,whale','whale'][k % 4 + 1] AS target_segments
  FROM (SELECT n_nationkey::BIGINT AS k FROM nation)"""

CTES["campaigns"] = "SELECT campaign_id AS campaign_name, * EXCLUDE (k) FROM campaign_rows"

CTES["customer_campaigns"] = f"""
  SELECT {_id('c_custkey')} AS customer_id, campaign_id,
    start_date + ((c_custkey + k) % 4)::INTEGER AS sent_date,
    (c_custkey * 13 + k * 7) % 97 < 4 AS responded,
    CASE WHEN (c_custkey * 13 + k * 7) % 97 < 4
      THEN start_date + (1 + (c_custkey + 3 * k) % 10)::INTEGER END AS response_date,
    (c_custkey * 13 + k * 7) % 97 < 4 AND (c_custkey + k) % 5 <> 0 AS bonus_claimed,
    cost_per_customer AS campaign_cost
  FROM customer, campaign_rows
  WHERE list_contains(string_split(target_segments, ','), {_SEGMENT})
    AND {_signup('c_custkey')} <= start_date"""

CTES["first_deposits"] = """
  SELECT customer_id, transaction_date, amount FROM transactions WHERE is_first_deposit"""

# one row per customer and fact, so that later joins cannot multiply rows
CTES["per_ledger"] = """
  SELECT customer_id, sum(amount) FILTER (transaction_type = 'deposit') AS deposits,
    sum(amount) FILTER (transaction_type = 'withdrawal') AS withdrawals,
    count(*) FILTER (transaction_type = 'deposit') AS num_deposits, count(*) AS num_tx,
    min(transaction_date) AS first_tx, max(transaction_date) AS last_tx
  FROM transactions GROUP BY 1"""

CTES["per_bets"] = """
  SELECT customer_id, sum(bet_amount) AS wagered, sum(payout) AS payouts, count(*) AS bets,
    sum(net_result) AS net_result, min(bet_date) AS first_bet, max(bet_date) AS last_bet,
    count(DISTINCT bet_date::DATE) AS betting_days
  FROM betting_activity GROUP BY 1"""

CTES["per_sessions"] = """
  SELECT customer_id, count(*) AS sessions, sum(duration_minutes) AS minutes, sum(num_bets) AS session_bets
  FROM sessions GROUP BY 1"""

CTES["per_customer"] = """
  SELECT c.*, coalesce(l.deposits, 0) AS deposits, coalesce(l.withdrawals, 0) AS withdrawals,
    coalesce(l.num_deposits, 0) AS num_deposits, coalesce(l.num_tx, 0) AS num_tx, l.first_tx, l.last_tx,
    coalesce(b.wagered, 0) AS wagered, coalesce(b.payouts, 0) AS payouts, coalesce(b.bets, 0) AS bets,
    b.first_bet, b.last_bet, coalesce(b.betting_days, 0) AS betting_days,
    greatest(l.last_tx, b.last_bet) AS last_seen,
    coalesce(s.sessions, 0) AS sessions, coalesce(s.minutes, 0) AS minutes,
    coalesce(s.session_bets, 0) AS session_bets
  FROM customers c LEFT JOIN per_ledger l USING (customer_id) LEFT JOIN per_bets b USING (customer_id)
    LEFT JOIN per_sessions s USING (customer_id)"""
