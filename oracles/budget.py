"""Response curves and the split of the budget."""

from __future__ import annotations

from marketlens.operators.budget import STEPS
from oracles.base import CTES, rnd

STATEMENTS: dict[str, str] = {}

CTES["channel_days"] = """
  SELECT acquisition_channel AS channel, signup_date AS day, sum(acquisition_cost)::DOUBLE AS s,
    sum(wagered - payouts)::DOUBLE AS v FROM per_customer GROUP BY 1, 2"""

CTES["channel_curves"] = f"""
  WITH t AS (
    SELECT channel, count(*) AS days, sum(s) AS spend, sum(v) AS value, max(s) AS largest, sum(v * v) AS vv
    FROM channel_days GROUP BY 1),
  g AS (
    SELECT channel, step, largest * power(2.0::DOUBLE, step / 4.0::DOUBLE) AS half
    FROM t, range({-STEPS}, {STEPS} + 1) AS r(step) WHERE largest > 0),
  f AS (
    SELECT channel, step, half, sum(v * s / (half + s)) AS vf, sum(power(s / (half + s), 2)) AS ff
    FROM channel_days JOIN g USING (channel) GROUP BY 1, 2, 3),
  b AS (
    SELECT channel, half, vf / ff AS top, vf * vf / ff AS gain FROM f WHERE vf > 0
    QUALIFY row_number() OVER (PARTITION BY channel ORDER BY round(vf * vf / ff, 3) DESC, step) = 1)
  SELECT channel, days, spend, value, half, top,
    CASE WHEN vv > value * value / days THEN 1 - (vv - gain) / (vv - value * value / days) END AS r_squared,
    spend / (SELECT count(DISTINCT day) FROM channel_days) AS now
  FROM t LEFT JOIN b USING (channel)"""

STATEMENTS["budget_allocation"] = f"""
  WITH w AS (SELECT sum(now) AS whole FROM channel_curves),
  l AS (
    SELECT c.channel, sqrt(c.top * c.half) AS root, c.half,
      (whole + sum(o.half)) / sum(sqrt(o.top * o.half)) AS level
    FROM channel_curves c, channel_curves o, w
    WHERE c.top > 0 AND o.top > 0 AND (-o.top / o.half, o.channel) <= (-c.top / c.half, c.channel)
    GROUP BY c.channel, c.top, c.half, whole),
  x AS (SELECT min(level) AS common FROM l WHERE root * level > half),
  a AS (
    SELECT *, coalesce(greatest(0, sqrt(top * half) * common - half), 0) AS given FROM channel_curves, w, x)
  SELECT channel, days, {rnd('top', 4)} AS curve_top, {rnd('half', 4)} AS curve_half, {rnd('r_squared', 6)} AS r_squared,
    {rnd('now', 4)} AS daily_spend, {rnd('now / whole', 6)} AS current_share, {rnd('given', 4)} AS daily_budget,
    {rnd('given / whole', 6)} AS budget_share, {rnd('top * half / power(half + given, 2)', 6)} AS marginal_return,
    {rnd('coalesce(top * now / (half + now), 0)', 4)} AS expected_now,
    {rnd('coalesce(top * given / (half + given), 0)', 4)} AS expected_value
  FROM a"""
