"""Session statements, and batch equivalents of the streaming results."""

from __future__ import annotations

from oracles.base import CTES, rnd, stamp

STATEMENTS: dict[str, str] = {}


def _anchored(source: str) -> str:
    """(k, ts, rn, ...) rows ordered by rn: start of the session each row belongs to."""
    return f"""
  WITH RECURSIVE ordered AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, tie) AS rn FROM {source}),
  walk AS (
    SELECT k, rn, ts, ts AS start FROM ordered WHERE rn = 1
    UNION ALL
    SELECT o.k, o.rn, o.ts, CASE WHEN o.ts - w.start > INTERVAL 7200 SECONDS THEN o.ts ELSE w.start END
    FROM walk w JOIN ordered o ON o.k = w.k AND o.rn = w.rn + 1)
  SELECT o.*, start FROM walk JOIN ordered o USING (k, rn)"""


_MINUTES = "((epoch_us(max(ts)) - epoch_us(start)) // 60000000)"

CTES["event_walk"] = _anchored("(SELECT user_id AS k, event_id AS tie, ts, event_type, value FROM events)")
STATEMENTS["sessionize_anchored"] = f"""
  SELECT k AS user_id, {stamp('start')} AS start_time, {stamp('max(ts)')} AS end_time,
    {_MINUTES} AS duration_minutes, count(*) AS num_events,
    count(*) FILTER (event_type = 'purchase') AS purchases, {rnd('sum(value)')} AS total_value
  FROM event_walk GROUP BY k, start"""

CTES["bet_walk"] = _anchored("(SELECT customer_id AS k, bet_id AS tie, bet_date AS ts, bet_amount, net_result "
                             "FROM betting_activity)")
STATEMENTS["sessionize_bets"] = f"""
  SELECT 'SES-' || k || '-' || strftime(start, '%Y%m%d%H%M%S') AS session_id, k AS customer_id,
    {stamp('start')} AS start_time, {stamp('max(ts)')} AS end_time, {_MINUTES} AS duration_minutes,
    count(*) AS num_bets, sum(bet_amount)::DOUBLE AS total_wagered, sum(net_result)::DOUBLE AS net_result
  FROM bet_walk GROUP BY k, start"""

CTES["event_gaps"] = """
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 7200 SECONDS
      THEN 0 ELSE 1 END AS opens FROM events)"""
STATEMENTS["sessionize_gap"] = f"""
  SELECT user_id, {stamp('min(ts)')} AS start_time, {stamp('max(ts)')} AS end_time,
    (epoch_us(max(ts)) - epoch_us(min(ts))) // 60000000 AS duration_minutes, count(*) AS num_events,
    count(*) FILTER (event_type = 'purchase') AS purchases, {rnd('sum(value)')} AS total_value
  FROM event_gaps GROUP BY user_id, island"""


# The streams are closed, so they hold what a batch over all events holds.

STATEMENTS["stream_hourly_kpi"] = f"""
  SELECT {stamp('h')} AS window_start, {stamp('h + INTERVAL 1 HOUR')} AS window_end, event_type,
    count(*) AS events, {rnd('sum(value)')} AS total_value
  FROM (SELECT *, date_trunc('hour', ts) AS h FROM events)
  GROUP BY h, event_type"""

STATEMENTS["stream_rolling"] = f"""
  WITH p AS (
    SELECT date_trunc('hour', ts) AS h, value FROM events WHERE event_type = 'purchase'),
  w AS (SELECT h - to_hours(unnest(range(0, 24))) AS s, value FROM p)
  SELECT {stamp('s')} AS window_start, {stamp('s + INTERVAL 24 HOURS')} AS window_end, count(*) AS purchases,
    {rnd('sum(value)')} AS revenue
  FROM w GROUP BY s"""

STATEMENTS["stream_sessions"] = f"""
  SELECT user_id, {stamp('min(ts)')} AS start_time, {stamp('max(ts)')} AS end_time, count(*) AS num_events,
    {rnd('sum(value)')} AS total_value
  FROM event_gaps GROUP BY user_id, island"""

STATEMENTS["stream_sessions_anchored"] = f"""
  SELECT k AS user_id, {stamp('start')} AS start_time, {stamp('max(ts)')} AS end_time, count(*) AS num_events,
    {rnd('sum(value)')} AS total_value
  FROM event_walk GROUP BY k, start"""

STATEMENTS["stream_alerts"] = f"""
  WITH h AS (
    SELECT date_trunc('hour', ts) AS h, round(sum(value) * 100)::BIGINT AS cents FROM events
    WHERE event_type = 'purchase' GROUP BY 1),
  c AS (SELECT *, lag(cents) OVER (ORDER BY h) AS prev FROM h),
  r AS (SELECT *, {rnd('(cents - prev)::DOUBLE / nullif(prev, 0)', 6)} AS change FROM c)
  SELECT {stamp('h')} AS window_start, cents / 100.0::DOUBLE AS revenue, prev / 100.0::DOUBLE AS previous_revenue, change,
    CASE WHEN change < -0.1 THEN '🔴 Down >10%' ELSE '🟢 Up >10%' END AS alert
  FROM r WHERE change < -0.1 OR change > 0.1"""
