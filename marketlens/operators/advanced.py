"""Journey milestones, churn features, campaign effects, sports and the daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.calendar import dense_days
from marketlens.functions.dates import day, whole_days
from marketlens.functions.numbers import (
    exact, fixed, growth, ladder, percent, ratio, share, zero,
)
from marketlens.operators.kpis import _campaign_days, _moments, daily_engagement, inside
from marketlens.plans.facts import (
    attach, customer_bet_profile, customer_sessions, customer_sport_profile, customer_sports,
    is_deposit, sum_if,
)
from marketlens.plans.tables import Tables

# Names of engagement levels and weekdays.
ENGAGEMENT_RUNGS = [(30, "High Frequency"), (10, "Medium Frequency"), (1, "Low Frequency")]
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def _ledger_days(t: Tables, recent_days: int = 30) -> DataFrame:
    """Transactions per customer by way of customer-days."""
    days = t.ledger.groupBy("customer_id", day("transaction_date").alias("tx_day")).agg(
        F.count("*").alias("n"), sum_if(is_deposit(), "amount").alias("deposited"),
        F.count_if(is_deposit()).alias("deposits"), F.max("transaction_date").alias("last"))
    recent = F.col("tx_day") >= F.date_sub(t.today, recent_days)
    return days.groupBy("customer_id").agg(
        F.count("*").alias("transaction_days"), F.sum("n").alias("num_transactions"),
        F.sum("deposited").alias("total_deposits"), F.sum("deposits").alias("num_deposits"),
        F.sum(F.when(recent, F.col("n"))).alias("recent_transactions"),
        F.max("last").alias("last_transaction_date"))


def customer_journey_milestones(t: Tables) -> DataFrame:
    first = t.first_deposits.groupBy("customer_id").agg(
        F.min("transaction_date").alias("first_deposit_date"),
        F.min("amount").alias("first_deposit_amount"))
    frame = attach(t.customers, first, _ledger_days(t), customer_bet_profile(t)).withColumns({
        "last_activity_date": F.greatest("last_bet_date", "last_transaction_date"),
        "active_betting_days": zero("betting_days"),
        "active_transaction_days": zero("transaction_days"),
    })
    idle = whole_days("last_activity_date", t.midnight)
    stage = (
        F.when(F.col("first_deposit_date").isNull(), "Registered - No Deposit")
        .when(F.col("first_bet_date").isNull(), "Deposited - No Bet")
        .when(idle <= 30, "Active").when(idle <= 90, "Dormant").otherwise("Churned")
    )
    return frame.select(
        "customer_id", "signup_date", "acquisition_channel", "customer_segment",
        "first_deposit_date", "first_deposit_amount", "first_bet_date", "first_bet_amount",
        "active_betting_days", "active_transaction_days", "last_activity_date",
        whole_days("signup_date", "first_deposit_date").alias("days_to_first_deposit"),
        whole_days("signup_date", "first_bet_date").alias("days_to_first_bet"),
        stage.alias("lifecycle_stage"),
        ladder("active_betting_days", ENGAGEMENT_RUNGS, "No Betting", descending=True)
        .alias("engagement_level"),
    )


def churn_inputs(t: Tables) -> DataFrame:
    """Customer totals behind the churn features, without fan-out."""
    return attach(t.customers, _ledger_days(t), customer_bet_profile(t),
                  customer_sport_profile(t), customer_sessions(t)).withColumns({
        "last_activity_date": F.greatest("last_bet_date", "last_transaction_date"),
        **{c: zero(c) for c in (
            "total_bets", "total_wagered", "total_deposits", "betting_days", "total_sessions",
            "sports_diversity", "recent_bets", "recent_wagered", "recent_transactions")},
        "avg_bet_size": zero(ratio("total_wagered", exact("total_bets"), 6)),
        "avg_session_duration": zero(share("session_minutes", "timed_sessions", 6)),
        "bets_per_day": share("total_bets", "betting_days"),
    })


def finish_churn(frame: DataFrame, t: Tables) -> DataFrame:
    idle = whole_days("last_activity_date", t.midnight)
    steady = F.when(F.col("betting_days") > 1,
                    fixed(F.try_divide(F.col("bets_per_day_std"), F.col("bets_per_day")), 6)
                    ).otherwise(0.0)
    churned = (
        F.when(F.col("last_activity_date").isNull(), None)
        .when((idle > 30) & (F.col("total_bets") > 0), 1).otherwise(0)
    )
    guarded = lambda a, b: zero(F.round(ratio(exact(a), exact(b)), 6))
    return frame.select(
        "customer_id", "signup_date", "acquisition_channel", "customer_segment", "age",
        F.col("recent_bets").alias("bets_last_30d"),
        F.col("recent_wagered").alias("wagered_last_30d"),
        F.col("recent_transactions").alias("transactions_last_30d"),
        "total_bets", "betting_days", "total_sessions", "total_wagered", "total_deposits",
        "avg_bet_size", "avg_session_duration", "sports_diversity",
        fixed("bet_size_std", 6).alias("bet_size_variance"), steady.alias("betting_consistency"),
        "last_activity_date", churned.alias("is_churned"),
        idle.alias("days_since_last_activity"),
        F.datediff(t.today, "signup_date").alias("tenure_days"),
        guarded("recent_bets", "total_bets").alias("recent_activity_ratio"),
        zero(ratio("recent_wagered", "total_wagered", 6)).alias("recent_spending_ratio"),
        guarded("total_bets", "betting_days").alias("bets_per_active_day"),
    )


def churn_features(t: Tables) -> DataFrame:
    return finish_churn(churn_inputs(t), t)


def campaign_windows(t: Tables) -> DataFrame:
    """Bets and deposits around each campaign per customer, one row per pair with activity."""
    facts = _moments(
        t.betting_activity, "bet_date", F.count("*").alias("bets"),
        F.sum("bet_amount").alias("wagered"),
    ).unionByName(
        _moments(t.ledger.where(is_deposit()), "transaction_date",
                 F.sum("amount").alias("deposited")),
        allowMissingColumns=True,
    )
    start, end = F.col("start_date"), F.col("end_date")
    spans = {
        "pre": inside(F.date_sub(start, 30), start), "during": inside(start, end),
        "post": inside(end, F.date_add(end, 30)),
    }
    sums: list[Column] = []
    for name, span in spans.items():
        sums += [F.sum(F.when(span, F.col("bets"))).alias(f"{name}_bets"),
                 F.sum(F.when(span, F.col("wagered"))).alias(f"{name}_wagered")]
    paid = inside(start, F.date_add(end, 7))
    return (
        facts.join(_campaign_days(t, 30, 30), "day").groupBy("customer_id", "campaign_id")
        .agg(*sums, F.sum(F.when(paid, F.col("deposited"))).alias("deposits"))
    )


WINDOW_SUMS = ["pre_bets", "pre_wagered", "during_bets", "during_wagered", "post_bets",
               "post_wagered", "deposits"]


def campaign_customers(t: Tables) -> DataFrame:
    """Sends with window sums, campaign type and the customer's segment and channel."""
    who = t.customers.select("customer_id", "customer_segment", "acquisition_channel")
    kind = t.campaigns.select("campaign_id", "campaign_type")
    return (
        t.customer_campaigns.select("customer_id", "campaign_id", "responded", "bonus_claimed")
        .join(campaign_windows(t), ["customer_id", "campaign_id"], "left")
        .withColumns({c: zero(c) for c in WINDOW_SUMS})
        .join(kind, "campaign_id").join(who, "customer_id")
    )


def finish_campaign_deep(frame: DataFrame) -> DataFrame:
    yes, no = F.col("responded"), ~F.col("responded")
    lift = F.col("during_wagered") - F.col("pre_wagered")
    back = F.col("post_bets") > 0
    keys = ["campaign_id", "campaign_type", "customer_segment", "acquisition_channel"]
    agg = frame.groupBy(*keys).agg(
        F.count("*").alias("customers_targeted"), F.count_if(yes).alias("customers_responded"),
        F.count_if(no).alias("silent"), F.count_if("bonus_claimed").alias("customers_claimed_bonus"),
        F.sum(F.when(yes, F.col("during_wagered"))).alias("w1"),
        F.sum(F.when(no, F.col("during_wagered"))).alias("w0"),
        F.sum(F.when(yes, lift)).alias("l1"), F.sum(F.when(no, lift)).alias("l0"),
        F.sum("deposits").alias("total_deposits_generated"),
        F.count_if(yes & back).alias("back1"), F.count_if(no & back).alias("back0"),
    )
    responded, silent = exact("customers_responded"), exact("silent")
    return agg.select(
        *keys, "customers_targeted", "customers_responded", "customers_claimed_bonus",
        percent("customers_responded", "customers_targeted").alias("response_rate"),
        percent("customers_claimed_bonus", "customers_responded").alias("claim_rate"),
        ratio("w1", responded, 2).alias("avg_wagered_responders"),
        ratio("w0", silent, 2).alias("avg_wagered_non_responders"),
        ratio("l1", responded, 2).alias("avg_wagered_lift_responders"),
        ratio("l0", silent, 2).alias("avg_wagered_lift_non_responders"),
        "total_deposits_generated",
        ratio("total_deposits_generated", exact("customers_targeted"), 2)
        .alias("avg_deposit_per_customer"),
        percent("back1", "customers_responded").alias("responder_retention_rate"),
        percent("back0", "silent").alias("non_responder_retention_rate"),
    )


def campaign_deep_analysis(t: Tables) -> DataFrame:
    return finish_campaign_deep(campaign_customers(t))


def sports_preference(t: Tables) -> DataFrame:
    """A customer has at most one row per sport here, so ranking needs no window:
    the favourite is the minimum of (negated measure, sport)."""
    who = t.customers.select("customer_id", "customer_segment", "acquisition_channel")
    rows = customer_sports(t)
    best = rows.groupBy("customer_id").agg(
        F.min(F.struct((-F.col("total_wagered")).alias("x"), "sport")).getField("sport")
        .alias("top_volume"),
        F.min(F.struct((-F.col("bets_count")).alias("x"), "sport")).getField("sport")
        .alias("top_frequency"),
    )
    keys = ["sport", "customer_segment", "acquisition_channel"]
    agg = rows.join(best, "customer_id").join(who, "customer_id").groupBy(*keys).agg(
        F.count("*").alias("customers_betting_sport"), F.sum("bets_count").alias("total_bets"),
        F.sum("total_wagered").alias("total_volume"),
        # means of per-customer means, unweighted on purpose; kept exact to 10 digits
        F.sum(ratio("total_wagered", exact("bets_count")).cast("decimal(28,10)")).alias("sizes"),
        F.sum(share("won", "bets_count").cast("decimal(28,10)")).alias("wins"),
        F.count_if(F.col("sport") == F.col("top_volume"))
        .alias("customers_primary_sport_by_volume"),
        F.count_if(F.col("sport") == F.col("top_frequency"))
        .alias("customers_primary_sport_by_frequency"),
        F.sum("net_result").alias("total_customer_net_result"),
    )
    n = exact("customers_betting_sport")
    net = F.col("total_customer_net_result")
    return agg.select(
        *keys, "customers_betting_sport", "total_bets", "total_volume",
        ratio("sizes", n, 2).alias("avg_bet_size"),
        ratio(F.col("wins") * 100, n, 2).alias("avg_win_rate_pct"),
        "customers_primary_sport_by_volume", "customers_primary_sport_by_frequency",
        "total_customer_net_result", (-net).alias("house_edge_revenue"),
        ratio(net * -100, "total_volume", 2).alias("house_edge_percentage"),
    )


def daily_timeseries(t: Tables, dense: bool = False) -> DataFrame:
    """Moving averages and changes over day rows; with ``dense``, over calendar days, where days
    without activity count as 0."""
    order = Window.orderBy("activity_date")  # one row per day: calendar-sized
    week = order.rowsBetween(-6, 0)

    def mean(c: str, digits: int) -> Column:
        return ratio(F.sum(exact(c) if c == "daily_active_users" else F.col(c)).over(week),
                     exact(F.count("*").over(week)), digits)

    def change(c: str) -> Column:
        now = exact(c) if c == "daily_active_users" else F.col(c)
        return growth(now, F.lag(now).over(order))

    date = F.col("activity_date")
    dow = F.dayofweek(date) - 1  # 0 = Sunday
    rows = daily_engagement(t)
    if dense:
        rows = dense_days(rows, "activity_date", zeros=[c for c in rows.columns if c != "activity_date"])
    return rows.select(
        date.alias("date"), "daily_active_users", "daily_betting_users", "total_bets",
        "total_wagered", "gross_gaming_revenue", "deposits_amount", "avg_bet_size",
        mean("daily_active_users", 0).alias("ma7_active_users"),
        mean("total_wagered", 2).alias("ma7_wagered"),
        mean("gross_gaming_revenue", 2).alias("ma7_ggr"),
        change("daily_active_users").alias("dod_change_active_users"),
        change("total_wagered").alias("dod_change_wagered"),
        change("gross_gaming_revenue").alias("dod_change_ggr"),
        dow.alias("day_of_week"),
        F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.dayofweek(date)).alias("day_name"),
        F.quarter(date).alias("quarter"), F.month(date).alias("month"),
        F.weekofyear(date).alias("week_of_year"),
    )
