"""Journey and attribution statements."""

from __future__ import annotations

from oracles.base import CTES, floor_days, rnd, stamp

STATEMENTS: dict[str, str] = {}

CTES["people"] = """
  SELECT c.customer_id, acquisition_channel, signup_date, acquisition_cost, d AS first_deposit_date,
    coalesce(a, 0) AS value, d IS NOT NULL AS converted
  FROM customers c LEFT JOIN (SELECT customer_id, min(transaction_date) AS d, sum(amount) AS a
    FROM first_deposits GROUP BY 1) USING (customer_id)"""

CTES["touch"] = """
  SELECT u.*, row_number() OVER j AS pos, count(*) OVER (PARTITION BY customer_id) AS len
  FROM (
    SELECT customer_id, value, converted, first_deposit_date, signup_date, acquisition_channel AS channel,
      signup_date AS at_date, 0 AS kind, '' AS campaign, acquisition_cost AS cost FROM people
    UNION ALL
    SELECT p.customer_id, value, converted, first_deposit_date, signup_date, campaign_type, sent_date, 1,
      campaign_id, campaign_cost
    FROM people p JOIN customer_campaigns USING (customer_id) JOIN campaigns USING (campaign_id)) u
  WHERE at_date <= CASE WHEN converted THEN first_deposit_date ELSE signup_date + INTERVAL 90 DAYS END
  WINDOW j AS (PARTITION BY customer_id ORDER BY at_date, kind, campaign)"""

CTES["journey"] = """
  SELECT p.*, coalesce(len, 0) AS num_touchpoints, coalesce(cost, 0) AS cost, coalesce(path, '') AS path
  FROM people p LEFT JOIN (SELECT customer_id, count(*) AS len, sum(cost) AS cost,
      string_agg(channel, ' → ' ORDER BY pos) AS path FROM touch GROUP BY 1) USING (customer_id)"""

STATEMENTS["journeys"] = f"""
  SELECT customer_id, acquisition_channel, signup_date, {stamp('first_deposit_date')} AS first_deposit_date,
    value::DOUBLE AS first_deposit_amount, converted, num_touchpoints, cost::DOUBLE AS total_touchpoint_cost, path
  FROM journey"""

CTES["credit"] = """
  WITH a AS (
    SELECT *, pow(2.0, -date_diff('day', at_date, max(at_date) OVER (PARTITION BY customer_id)) / 7.0) AS raw
    FROM touch WHERE converted)
  SELECT customer_id, channel, value, unnest([
    {'model': 'last_click', 'w': CASE WHEN pos = len THEN 1.0 ELSE 0 END::DOUBLE},
    {'model': 'first_touch', 'w': CASE WHEN pos = 1 THEN 1.0 ELSE 0 END::DOUBLE},
    {'model': 'linear', 'w': 1.0 / len},
    {'model': 'time_decay', 'w': raw / sum(raw) OVER (PARTITION BY customer_id)},
    {'model': 'position_based', 'w': CASE WHEN len = 1 THEN 1.0 WHEN len = 2 THEN 0.5
      WHEN pos IN (1, len) THEN 0.4 ELSE 0.2 / (len - 2) END::DOUBLE}], recursive := true)
  FROM a"""

CTES["compared"] = f"""
  SELECT model, channel, {rnd('sum(w)', 6)} AS attributed_conversions,
    {rnd('sum(w * value::DOUBLE)', 4)} AS attributed_value, count(DISTINCT customer_id) AS unique_customers,
    {rnd('sum(w * value::DOUBLE) / sum(w)', 4)} AS avg_attributed_value
  FROM credit WHERE w > 0 GROUP BY 1, 2"""

for _model, _key in (("last_click", "attr_last_click"), ("first_touch", "attr_first_touch"),
                     ("linear", "attr_linear"), ("time_decay", "attr_time_decay"),
                     ("position_based", "attr_position")):
    STATEMENTS[_key] = f"SELECT * EXCLUDE (model) FROM compared WHERE model = '{_model}'"

STATEMENTS["attr_compare"] = "SELECT * EXCLUDE (unique_customers) FROM compared"
STATEMENTS["attr_compare_pivot"] = "SELECT channel, " + ", ".join(
    f"coalesce(max(attributed_conversions) FILTER (model = '{m}'), 0) AS {m}"
    for m in ("last_click", "first_touch", "linear", "time_decay", "position_based")
) + " FROM compared GROUP BY 1"

CTES["roi"] = f"""
  SELECT model, channel, coalesce(cost, 0)::DOUBLE AS total_cost, attributed_value,
    CASE WHEN cost > 0 THEN {rnd('(attributed_value - cost) * 100 / cost', 4)} ELSE 0 END AS roi_percent,
    CASE WHEN cost > 0 THEN {rnd('attributed_value / cost', 4)} ELSE 0 END AS roas_ratio, attributed_conversions
  FROM compared LEFT JOIN (SELECT channel, sum(cost)::DOUBLE AS cost FROM touch GROUP BY 1) USING (channel)"""
STATEMENTS["attr_roi"] = "SELECT * FROM roi"
STATEMENTS["bi_channel_efficiency"] = f"""
  SELECT model, channel, attributed_conversions, total_cost,
    {rnd('attributed_conversions / nullif(total_cost, 0)', 8)} AS efficiency FROM roi"""

STATEMENTS["attr_winners"] = f"""
  SELECT model, first(channel ORDER BY attributed_conversions DESC, channel) AS top_channel,
    max(attributed_conversions) AS top_conversions,
    first(channel ORDER BY roi_percent DESC, channel) AS best_roi_channel,
    first(channel ORDER BY roas_ratio DESC, channel) AS best_roas_channel,
    {rnd('sum(attributed_conversions)', 3)} AS total_conversions
  FROM roi GROUP BY 1"""

STATEMENTS["journey_length"] = f"""
  SELECT {rnd('avg(num_touchpoints) FILTER (converted)', 6)} AS avg_touchpoints_converted,
    (median(num_touchpoints) FILTER (converted))::DOUBLE AS median_touchpoints_converted,
    {rnd('avg(num_touchpoints) FILTER (NOT converted)', 6)} AS avg_touchpoints_non_converted,
    (median(num_touchpoints) FILTER (NOT converted))::DOUBLE AS median_touchpoints_non_converted
  FROM journey"""

STATEMENTS["journey_patterns"] = """
  SELECT path, count(*) AS customers FROM journey GROUP BY 1 ORDER BY customers DESC, path LIMIT 10"""

STATEMENTS["conversion_by_length"] = f"""
  SELECT num_touchpoints, count(*) AS total_customers, count(*) FILTER (converted) AS conversions,
    {rnd('count(*) FILTER (converted)::DOUBLE / count(*)', 3)} AS conversion_rate FROM journey GROUP BY 1"""

STATEMENTS["time_to_conversion"] = f"""
  SELECT {rnd('avg(d)', 6)} AS avg_days, median(d) AS median_days, quantile_cont(d, 0.25) AS p25_days,
    quantile_cont(d, 0.75) AS p75_days
  FROM (SELECT {floor_days('signup_date', 'first_deposit_date')} AS d FROM people WHERE converted)"""

STATEMENTS["bi_attr_touch"] = f"""
  WITH m AS (
    SELECT *, count(*) OVER c AS touches, at_date = max(at_date) OVER c AS is_last,
      at_date = min(at_date) OVER c AS is_first, date_diff('day', at_date, first_deposit_date::DATE) AS age
    FROM touch WHERE converted AND kind = 1 WINDOW c AS (PARTITION BY customer_id))
  SELECT channel AS campaign_type, count(*) AS touches,
    coalesce(sum(value) FILTER (is_last), 0)::DOUBLE AS last_touch_value,
    coalesce(sum(value) FILTER (is_first), 0)::DOUBLE AS first_touch_value,
    {rnd('sum(1.0 / touches)', 6)} AS linear_weight, {rnd('sum(pow(0.5, age / 7.0))', 6)} AS time_decay_weight,
    {rnd('sum(CASE WHEN is_last OR is_first THEN 0.4 ELSE 0.2 / nullif(touches - 2, 0) END)', 6)} AS position_weight
  FROM m GROUP BY 1"""

STATEMENTS["bi_journey_flow"] = """
  SELECT pos AS step, channel, coalesce(nxt, '(end)') AS next_channel, count(*) AS customers
  FROM (SELECT *, lead(channel) OVER (PARTITION BY customer_id ORDER BY pos) AS nxt FROM touch) GROUP BY 1, 2, 3"""
