"""Saturating response of channels to spend, and the split of a budget that follows.

A channel's value per day is taken to rise with that day's spend s as a * s / (b + s): at most
``a``, half of it at ``b``. The best split gives every channel that gets anything the same marginal
return a * b / (b + s)^2, and nothing to channels whose first unit returns less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.numbers import fixed
from marketlens.functions.rows import beside
from marketlens.plans.facts import customer_bets
from marketlens.plans.tables import Tables

# Halves tried for each channel: its largest daily spend times 2^-STEPS/4 .. 2^STEPS/4.
STEPS = 16


def channel_days(t: Tables) -> DataFrame:
    """Spend on the customers won per channel and day, and the gross revenue they have brought."""
    revenue = F.coalesce(F.col("total_wagered") - F.col("total_payouts"), F.lit(0))
    return (
        t.customers.join(customer_bets(t), "customer_id", "left")
        .groupBy(F.col("acquisition_channel").alias("channel"), F.col("signup_date").alias("day"))
        .agg(F.sum("acquisition_cost").cast("double").alias("spend"),
             F.sum(revenue).cast("double").alias("value"))
        .where("channel IS NOT NULL AND day IS NOT NULL"))


def response_curves(days: DataFrame) -> DataFrame:
    """channel, days, spend, value, top (a), half (b), r_squared per channel.

    For a given half the best top has a closed form, so all halves of a grid are tried in one
    aggregate over the day rows, and the one with the least squared error stays. A channel without
    spend, or whose value does not rise with it, has no curve.
    """
    spent = F.coalesce("spend", F.lit(0.0))
    rows = days.select("channel", spent.alias("s"), F.coalesce("value", F.lit(0.0)).alias("v"))
    totals = rows.groupBy("channel").agg(
        F.count("*").alias("days"), F.sum("s").alias("spend"), F.sum("v").alias("value"),
        F.max("s").alias("largest"), F.sum(F.col("v") * F.col("v")).alias("vv"))
    step = F.explode(F.sequence(F.lit(-STEPS), F.lit(STEPS)))
    halves = totals.where("largest > 0").select("channel", "largest", step.alias("step")).select(
        "channel", "step", (F.col("largest") * F.pow(F.lit(2.0), F.col("step") / 4.0)).alias("half"))
    f = F.col("s") / (F.col("half") + F.col("s"))
    tried = (
        rows.where("s >= 0").join(halves, "channel").groupBy("channel", "step", "half")
        .agg(F.sum(F.col("v") * f).alias("vf"), F.sum(f * f).alias("ff")).where("vf > 0"))
    gain = F.round(F.col("vf") * F.col("vf") / F.col("ff"), 3)
    best = tried.groupBy("channel").agg(F.min(F.struct(
        (-gain).alias("less"), "step", "half", "vf", "ff")).alias("c")).select(
        F.col("channel").alias("of"), F.col("c.half").alias("half"),
        (F.col("c.vf") / F.col("c.ff")).alias("top"), (F.col("c.vf") * F.col("c.vf") / F.col("c.ff")).alias("gain"))
    spread = F.col("vv") - F.col("value") * F.col("value") / F.col("days")
    return totals.join(best, F.col("channel") == F.col("of"), "left").select(
        "channel", "days", "spend", "value", "top", "half",
        F.when(spread > 0, 1 - (F.col("vv") - F.col("gain")) / spread).alias("r_squared"))


def filled(curves: DataFrame, budget: Column) -> DataFrame:
    """``curves`` with ``given``: the part of ``budget`` that each channel gets.

    Channels are taken in the order of the return of their first unit. With the first k of them the
    common level is (budget + sum of halves) / sum of sqrt(top * half), and a channel gets
    sqrt(top * half) * level - half; the last k that leaves its last channel something counts.
    A row a channel, of which there are few.
    """
    root = F.sqrt(F.col("top") * F.col("half"))
    known = curves.where("top > 0")
    order = Window.orderBy(F.desc(F.col("top") / F.col("half")), "channel").rowsBetween(
        Window.unboundedPreceding, 0)
    levels = known.withColumn("level", (budget + F.sum("half").over(order)) / F.sum(root).over(order))
    level = levels.where(root * F.col("level") > F.col("half")).agg(F.min("level").alias("common"))
    given = F.greatest(F.lit(0.0), root * F.col("common") - F.col("half"))
    return beside(curves, level).withColumn("given", F.coalesce(given, F.lit(0.0))).drop("common")


def budget_allocation(t: Tables, budget: float | None = None) -> DataFrame:
    """Spend per day now and after the best split of ``budget`` (now's total unless given).

    Per channel: its curve, what it gets, its share, the marginal return there (equal among those
    that get anything) and the values a day that the curve expects.
    """
    days = channel_days(t)
    curves = response_curves(days)
    calendar = days.agg(F.countDistinct("day").cast("double").alias("calendar"))
    now = beside(curves, calendar).withColumn("now", F.col("spend") / F.col("calendar")).drop("calendar")
    total = beside(now, now.agg(F.sum("now").alias("all_now")))
    whole = F.lit(float(budget)) if budget is not None else F.col("all_now")
    split = filled(total, whole)

    def expected(s: str) -> Column:
        return F.coalesce(F.col("top") * F.col(s) / (F.col("half") + F.col(s)), F.lit(0.0))

    return split.select(
        "channel", "days", fixed("top", 4).alias("curve_top"), fixed("half", 4).alias("curve_half"),
        fixed("r_squared", 6).alias("r_squared"), fixed("now", 4).alias("daily_spend"),
        fixed(F.try_divide("now", "all_now"), 6).alias("current_share"),
        fixed("given", 4).alias("daily_budget"),
        fixed(F.try_divide(F.col("given"), whole), 6).alias("budget_share"),
        fixed(F.col("top") * F.col("half") / F.pow(F.col("half") + F.col("given"), F.lit(2.0)), 6)
        .alias("marginal_return"),
        fixed(expected("now"), 4).alias("expected_now"), fixed(expected("given"), 4).alias("expected_value"))
