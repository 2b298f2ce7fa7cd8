"""The views exactly as their join text reads, for comparing with figures made by it.

Facts are joined to the customer before aggregation there, so sums and counts are
multiplied; the multiples are computed with ``plans.fanout`` instead of by joining.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.dates import day, month_offset, month_start
from marketlens.functions.numbers import exact, percent, zero
from marketlens.operators import kpis
from marketlens.operators.advanced import (
    campaign_customers, churn_inputs, finish_campaign_deep, finish_churn,
)
from marketlens.operators.cohorts import finish_revenue_cohort, revenue_cohort_rows
from marketlens.plans.facts import (
    attach, customer_bets, customer_ledger, customer_sessions, customer_value, is_deposit, sum_if,
)
from marketlens.plans.fanout import copies, repeated_std
from marketlens.plans.tables import Tables


def _whole(c: Column) -> Column:
    """Multiplied counts may pass the range of bigint."""
    return c.cast("double")


def _scale(frame: DataFrame, weight: Column, money: list[str], counts: list[str]) -> DataFrame:
    scaled = {c: F.col(c) * weight for c in money}
    scaled.update({c: _whole(exact(c) * weight) for c in counts})
    return frame.withColumns(scaled)


def customer_ltv(t: Tables) -> DataFrame:
    value = customer_value(t).withColumns({
        "by_bets": copies("total_bets"), "by_tx": copies("num_transactions")})
    value = _scale(value, F.col("by_bets"), ["total_deposits", "total_withdrawals"], [])
    value = _scale(value, F.col("by_tx"), ["total_wagered", "total_payouts"], ["total_bets"])
    # GREATEST over joined rows skips a missing side just as it does over the maxima
    return kpis.finish_ltv(value.withColumns({
        "net_deposits": F.col("total_deposits") - F.col("total_withdrawals"),
        "gross_gaming_revenue": F.col("total_wagered") - F.col("total_payouts"),
    }).withColumn("customer_ltv", F.col("gross_gaming_revenue") - F.col("acquisition_cost")))


def _month_component(months: Column) -> Column:
    """The month part of an age: 14 months -> 2, -2 -> -2."""
    return months % 12


def cohort_retention(t: Tables) -> DataFrame:
    """A customer with any bet is only ever seen on betting days."""
    bets = t.betting_activity.groupBy("customer_id", month_start("bet_date").alias("month")).agg(
        F.lit(1).alias("seen"))
    others = t.ledger.groupBy(
        "customer_id", month_start("transaction_date").alias("month")).agg(F.lit(1).alias("seen"))
    bettors = bets.select("customer_id").distinct()
    active = bets.unionByName(others.join(bettors, "customer_id", "left_anti"))
    cohorts = t.customers.select("customer_id", month_start("signup_date").alias("cohort_month"))
    sizes = cohorts.groupBy("cohort_month").agg(F.count("*").alias("cohort_size"))
    counted = active.join(cohorts, "customer_id").groupBy("cohort_month", "month").agg(
        F.count("*").alias("active_customers"))
    return counted.join(sizes, "cohort_month").select(
        "cohort_month", "cohort_size",
        _month_component(month_offset("cohort_month", "month")).alias("months_since_signup"),
        "active_customers",
        percent("active_customers", "cohort_size").alias("retention_rate"))


def campaign_performance(t: Tables) -> DataFrame:
    responders = t.customer_campaigns.where("responded").select("customer_id", "campaign_id")
    counts = attach(
        responders, customer_bets(t).select("customer_id", "total_bets"),
        customer_ledger(t).select("customer_id", "num_transactions"))
    revenue = (
        kpis.campaign_revenue(t).join(counts, ["customer_id", "campaign_id"])
        .groupBy("campaign_id").agg(
            F.sum(F.col("deposits") * copies("total_bets")).alias("deposits"),
            F.sum(F.col("ggr") * copies("num_transactions")).alias("ggr"))
    )
    return kpis.finish_campaign_performance(kpis.campaign_sends(t), revenue)


def daily_engagement(t: Tables) -> DataFrame:
    """Days of betting customers are betting days; transaction days count for customers
    without bets and session days for customers with neither."""
    bet_days = t.betting_activity.groupBy(
        "customer_id", day("bet_date").alias("activity_date")).agg(
        F.count("*").alias("bets_today"), F.sum("bet_amount").alias("wagered_today"),
        F.sum("payout").alias("paid_today"))
    tx_days = t.ledger.groupBy("customer_id", day("transaction_date").alias("activity_date")).agg(
        F.count("*").alias("tx_today"), F.count_if(is_deposit()).alias("deposits_today"),
        sum_if(is_deposit(), "amount").alias("amount_today"))
    visit_days = t.sessions.groupBy("customer_id", day("start_time").alias("activity_date")).agg(
        F.count("*").alias("visits_today"), F.sum("duration_minutes").alias("minutes_today"),
        F.count("duration_minutes").alias("timed_today"))
    totals = attach(
        t.customers.select("customer_id"),
        customer_bets(t).select("customer_id", "total_bets"),
        customer_ledger(t).select(
            "customer_id", "num_transactions", "num_deposits", "total_deposits"),
        customer_sessions(t).select(
            "customer_id", "total_sessions", "session_minutes", "timed_sessions"))
    n_tx, n_visits = copies("num_transactions"), copies("total_sessions")

    def rows(frame: DataFrame, **columns: Column) -> DataFrame:
        columns = {**{c: F.lit(0) for c in (
            "bettor", "payer", "visitor", "bets", "wagered", "paid", "deposits", "deposited",
            "visits", "minutes", "timed")}, **columns}
        return frame.select("activity_date", *[c.cast("decimal(38,2)").alias(k)
                                               for k, c in columns.items()])

    has = lambda c: F.when(zero(c) > 0, 1).otherwise(0)
    bettors = rows(
        bet_days.join(totals, "customer_id"),
        bettor=F.lit(1), payer=has("num_transactions"), visitor=has("total_sessions"),
        bets=F.col("bets_today") * n_tx * n_visits, wagered=F.col("wagered_today") * n_tx * n_visits,
        paid=F.col("paid_today") * n_tx * n_visits,
        deposits=F.col("bets_today") * zero("num_deposits") * n_visits,
        deposited=F.col("bets_today") * zero("total_deposits") * n_visits,
        visits=F.col("bets_today") * n_tx * zero("total_sessions"),
        minutes=F.col("bets_today") * n_tx * zero("session_minutes"),
        timed=F.col("bets_today") * n_tx * zero("timed_sessions"))
    payers = rows(
        tx_days.join(totals.where("total_bets IS NULL"), "customer_id"),
        payer=F.lit(1), visitor=has("total_sessions"),
        deposits=F.col("deposits_today") * n_visits,
        deposited=zero("amount_today") * n_visits,
        visits=F.col("tx_today") * zero("total_sessions"),
        minutes=F.col("tx_today") * zero("session_minutes"),
        timed=F.col("tx_today") * zero("timed_sessions"))
    visitors = rows(
        visit_days.join(totals.where("total_bets IS NULL AND num_transactions IS NULL"),
                        "customer_id"),
        visitor=F.lit(1), visits=F.col("visits_today"), minutes=zero("minutes_today"),
        timed=F.col("timed_today"))
    # one row per customer and day, so counting rows counts customers
    count = lambda c: _whole(F.sum(c))
    daily = bettors.unionByName(payers).unionByName(visitors).groupBy("activity_date").agg(
        F.count("*").alias("daily_active_users"), count("bettor").alias("daily_betting_users"),
        count("payer").alias("daily_transacting_users"), count("visitor").alias("daily_session_users"),
        count("bets").alias("total_bets"), F.sum("wagered").alias("total_wagered"),
        F.sum("paid").alias("total_payouts"), count("deposits").alias("deposits_count"),
        F.sum("deposited").alias("deposits_amount"), count("visits").alias("total_sessions"),
        count("minutes").alias("minutes"), count("timed").alias("timed"))
    return kpis.finish_daily(daily)


def customer_segmentation(t: Tables) -> DataFrame:
    frame = attach(customer_value(t), customer_sessions(t)).withColumns(kpis.behaviour_averages())
    by_tx_visits = copies("num_transactions", "total_sessions")
    by_bets_visits = copies("total_bets", "total_sessions")
    return kpis.finish_segmentation(frame.withColumns({
        "total_bets": _whole(exact("total_bets") * by_tx_visits),
        "total_wagered": F.col("total_wagered") * by_tx_visits,
        "total_deposits": F.col("total_deposits") * by_bets_visits,
        "num_deposits": _whole(exact("num_deposits") * by_bets_visits),
    }), t)


def churn_features(t: Tables) -> DataFrame:
    """Five-way: bets, transactions, sessions and betting days all multiply each other."""
    frame = churn_inputs(t)
    bets_by = copies("num_transactions", "total_sessions", "betting_days")
    tx_by = copies("total_bets", "total_sessions", "betting_days")
    days_by = copies("total_bets", "num_transactions", "total_sessions")
    return finish_churn(frame.withColumns({
        "bet_size_std": repeated_std("bet_size_std", "total_bets", bets_by),
        "bets_per_day_std": repeated_std("bets_per_day_std", "betting_days", days_by),
        "recent_bets": _whole(exact("recent_bets") * bets_by),
        "recent_wagered": F.col("recent_wagered") * bets_by,
        "recent_transactions": _whole(exact("recent_transactions") * tx_by),
        "total_bets": _whole(exact("total_bets") * bets_by),
        "total_wagered": F.col("total_wagered") * bets_by,
        "total_deposits": F.col("total_deposits") * tx_by,
    }), t)


def campaign_deep_analysis(t: Tables) -> DataFrame:
    frame = attach(
        campaign_customers(t), customer_bets(t).select("customer_id", "total_bets"),
        customer_ledger(t).select("customer_id", "num_transactions"))
    by_tx = copies("num_transactions")
    return finish_campaign_deep(frame.withColumns({
        "pre_wagered": F.col("pre_wagered") * by_tx,
        "during_wagered": F.col("during_wagered") * by_tx,
        "deposits": F.col("deposits") * copies("total_bets"),
    }))


def revenue_cohort(t: Tables) -> DataFrame:
    return finish_revenue_cohort(revenue_cohort_rows(t).withColumn(
        "months_since_signup", _month_component(F.col("months_since_signup"))))
