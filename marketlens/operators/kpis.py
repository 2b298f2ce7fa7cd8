"""Acquisition, lifetime value, campaigns, engagement and segmentation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.dates import day, week_start, whole_days
from marketlens.functions.numbers import (
    exact, growth, ladder, percent, ratio, share, zero,
)
from marketlens.functions.ranks import quantiles
from marketlens.plans.facts import (
    attach, customer_bets, customer_sessions, customer_value, is_deposit,
)
from marketlens.plans.tables import Tables

# Score ladders.
RECENCY_RUNGS = [(7, 5), (30, 4), (90, 3), (180, 2)]
FREQUENCY_RUNGS = [(100, 5), (50, 4), (20, 3), (5, 2), (1, 1)]
MONETARY_RUNGS = [(5000, 5), (1000, 4), (500, 3), (100, 2), (10, 1)]


def converters(t: Tables) -> DataFrame:
    """Customers with a first deposit."""
    return t.first_deposits.select("customer_id").distinct().withColumn("converted", F.lit(1))


def acquisition_cost(t: Tables) -> DataFrame:
    joined = t.customers.join(converters(t), "customer_id", "left")
    per_channel = joined.groupBy("acquisition_channel").agg(
        F.count("*").alias("total_customers"),
        F.count("converted").alias("converted_customers"),
        F.sum("acquisition_cost").alias("total_acquisition_cost"),
    )
    cost = "total_acquisition_cost"
    return per_channel.select(
        "acquisition_channel", "total_customers", "converted_customers",
        percent("converted_customers", "total_customers").alias("conversion_rate_pct"),
        ratio(cost, exact("total_customers"), 2).alias("cost_per_install_cpi"),
        ratio(cost, exact("converted_customers"), 2).alias("cost_per_acquisition_cpa"),
        cost,
    )


def finish_ltv(frame: DataFrame) -> DataFrame:
    """The published LTV columns from customer totals."""
    tenure = F.when(
        F.col("last_activity_date").isNotNull(), whole_days("signup_date", "last_activity_date") + 1
    ).otherwise(0)
    per_bet = F.when(F.col("total_bets") > 0,
                     ratio("total_wagered", exact("total_bets"), 2)).otherwise(0)
    per_month = F.when(
        F.col("tenure_days") > 0,
        ratio(F.col("customer_ltv") * 30, exact("tenure_days"), 2),
    ).otherwise(0)
    return frame.withColumn("tenure_days", tenure).select(
        "customer_id", "customer_segment", "acquisition_channel", "signup_date",
        "acquisition_cost", "total_deposits", "total_withdrawals", "net_deposits",
        "total_wagered", "total_payouts", "gross_gaming_revenue", "customer_ltv", "tenure_days",
        "total_bets", per_bet.alias("avg_bet_size"), per_month.alias("monthly_ltv"),
        "first_transaction_date", "last_activity_date",
    )


def customer_ltv(t: Tables) -> DataFrame:
    return finish_ltv(customer_value(t))


def ltv_summary(t: Tables) -> DataFrame:
    keys = ["customer_segment", "acquisition_channel"]
    bettors = customer_ltv(t).where("total_bets > 0")
    totals = bettors.groupBy(*keys).agg(
        F.count("*").alias("customer_count"),
        F.sum("customer_ltv").alias("ltv"), F.sum("acquisition_cost").alias("cost"),
        F.sum("tenure_days").alias("tenure"), F.sum("total_wagered").alias("wagered"),
        F.sum("gross_gaming_revenue").alias("total_ggr"),
    )
    n = exact("customer_count")
    return totals.join(quantiles(bettors, keys, "customer_ltv", {"median": 0.5}), keys).select(
        *keys, "customer_count",
        ratio("ltv", n, 2).alias("avg_ltv"), F.round("median", 2).alias("median_ltv"),
        ratio("cost", n, 2).alias("avg_acquisition_cost"),
        ratio("ltv", "cost", 2).alias("ltv_to_cac_ratio"),
        share("tenure", "customer_count", 1).alias("avg_tenure_days"),
        ratio("wagered", n, 2).alias("avg_total_wagered"), "total_ggr",
    )


def _moments(fact: DataFrame, stamp: str, *sums: Column) -> DataFrame:
    """Fact rows per customer and day, keeping midnight apart from the rest of the day.

    Windows that end on a date include that day's 00:00:00 only, so a day can be cut
    by a window edge only at midnight: the reduction loses nothing.
    """
    at_midnight = (F.col(stamp) == F.col(stamp).cast("date").cast("timestamp_ntz"))
    return fact.groupBy(
        "customer_id", day(stamp).alias("day"), at_midnight.alias("at_midnight")
    ).agg(*sums)


def _campaign_days(t: Tables, before: int, after: int) -> DataFrame:
    """One row per campaign and calendar day from ``before`` days ahead to ``after`` behind."""
    return t.campaigns.select(
        "campaign_id", "start_date", "end_date",
        F.explode(F.sequence(F.date_sub("start_date", before), F.date_add("end_date", after)))
        .alias("day"),
    )


def inside(first: Column, last: Column) -> Column:
    """The moment lies in [first 00:00, last 00:00], both dates."""
    return (F.col("day") >= first) & (
        (F.col("day") < last) | ((F.col("day") == last) & F.col("at_midnight"))
    )


def campaign_revenue(t: Tables) -> DataFrame:
    """Deposits and GGR per customer and campaign from start to 30 days past the end.

    Joined on the calendar day, so a row only meets campaigns whose window holds it;
    the customer's other campaigns are never paired with it.
    """
    facts = _moments(
        t.betting_activity, "bet_date", F.sum(F.col("bet_amount") - F.col("payout")).alias("ggr")
    ).unionByName(
        _moments(t.ledger.where(is_deposit()), "transaction_date", F.sum("amount").alias("deposits")),
        allowMissingColumns=True,
    )
    window = inside(F.col("start_date"), F.date_add("end_date", 30))
    return (
        facts.join(_campaign_days(t, 0, 30), "day").where(window)
        .groupBy("customer_id", "campaign_id")
        .agg(F.sum("deposits").alias("deposits"), F.sum("ggr").alias("ggr"))
    )


def campaign_sends(t: Tables) -> DataFrame:
    """Sends, responses and cost per campaign; campaigns without sends are kept."""
    sends = t.customer_campaigns.groupBy("campaign_id").agg(
        F.count("customer_id").alias("customers_targeted"),
        F.count_if("responded").alias("customers_responded"),
        F.count_if("bonus_claimed").alias("bonuses_claimed"),
        F.sum("campaign_cost").alias("total_campaign_cost"),
    )
    counts = ("customers_targeted", "customers_responded", "bonuses_claimed")
    return t.campaigns.join(sends, "campaign_id", "left").withColumns({c: zero(c) for c in counts})


def finish_campaign_performance(sends: DataFrame, revenue: DataFrame) -> DataFrame:
    joined = sends.join(revenue, "campaign_id", "left").withColumns(
        {"revenue_deposits": zero("deposits"), "revenue_ggr": zero("ggr")})
    cost = "total_campaign_cost"
    return joined.select(
        "campaign_id", "campaign_name", "campaign_type", "start_date", "end_date",
        "customers_targeted", "customers_responded", "bonuses_claimed", cost,
        "revenue_deposits", "revenue_ggr",
        percent("customers_responded", "customers_targeted").alias("response_rate_pct"),
        percent("bonuses_claimed", "customers_responded").alias("claim_rate_pct"),
        ratio("revenue_ggr", cost, 2).alias("roas_ratio"),
        ratio(cost, exact("customers_responded"), 2).alias("cost_per_response"),
    )


def campaign_performance(t: Tables) -> DataFrame:
    responders = t.customer_campaigns.where("responded").select("customer_id", "campaign_id")
    revenue = (
        campaign_revenue(t).join(responders, ["customer_id", "campaign_id"], "left_semi")
        .groupBy("campaign_id")
        .agg(F.sum("deposits").alias("deposits"), F.sum("ggr").alias("ggr"))
    )
    return finish_campaign_performance(campaign_sends(t), revenue)


def daily_facts(t: Tables, period: Callable[[str], Column] | None = None) -> DataFrame:
    """Per day: users by activity and the sums of all three facts, in two reductions.

    With a ``period``, ``period_users`` counts the customers whose first day in the period it is,
    so that its sum over a period's days is the period's distinct users, without a second read.
    """
    bets = t.betting_activity.select(
        "customer_id", day("bet_date").alias("activity_date"), F.lit(1).alias("bet"),
        "bet_amount", "payout")
    ledger = t.ledger.select(
        "customer_id", day("transaction_date").alias("activity_date"), F.lit(1).alias("entry"),
        F.when(is_deposit(), 1).alias("deposit"), F.when(is_deposit(), F.col("amount")).alias("amount"))
    visits = t.sessions.select(
        "customer_id", day("start_time").alias("activity_date"), F.lit(1).alias("visit"),
        "duration_minutes", F.when(F.col("duration_minutes").isNotNull(), 1).alias("timed"))
    rows = bets.unionByName(ledger, allowMissingColumns=True).unionByName(
        visits, allowMissingColumns=True)
    measures = ["bet", "bet_amount", "payout", "entry", "deposit", "amount", "visit",
                "duration_minutes", "timed"]
    per_customer = rows.groupBy("activity_date", "customer_id").agg(
        *[F.sum(m).alias(m) for m in measures])
    more = []
    if period is not None:
        # a window holds the days of one customer in one period
        whole = Window.partitionBy("customer_id", period("activity_date"))
        per_customer = per_customer.withColumn(
            "opens", F.col("activity_date") == F.min("activity_date").over(whole))
        more = [F.count_if("opens").alias("period_users")]
    total = lambda c: zero(F.sum(c))
    return per_customer.groupBy("activity_date").agg(
        F.count("*").alias("daily_active_users"),
        F.count("bet").alias("daily_betting_users"),
        F.count("entry").alias("daily_transacting_users"),
        F.count("visit").alias("daily_session_users"),
        total("bet").alias("total_bets"), total("bet_amount").alias("total_wagered"),
        total("payout").alias("total_payouts"), total("deposit").alias("deposits_count"),
        total("amount").alias("deposits_amount"), total("visit").alias("total_sessions"),
        total("duration_minutes").alias("minutes"), total("timed").alias("timed"), *more,
    )


def finish_daily(frame: DataFrame, *more: str) -> DataFrame:
    def guarded(top: Column, bottom: str) -> Column:
        return zero(ratio(top, exact(bottom), 2))

    return frame.select(
        "activity_date", "daily_active_users", "daily_betting_users", "daily_transacting_users",
        "daily_session_users", "total_bets", "total_wagered", "total_payouts",
        (F.col("total_wagered") - F.col("total_payouts")).alias("gross_gaming_revenue"),
        "deposits_count", "deposits_amount", "total_sessions",
        guarded(exact("minutes"), "timed").alias("avg_session_duration"),
        guarded(exact("total_bets"), "daily_betting_users").alias("bets_per_betting_user"),
        guarded(F.col("total_wagered"), "total_bets").alias("avg_bet_size"),
        guarded(exact("total_sessions"), "daily_active_users").alias("sessions_per_user"), *more,
    )


def daily_engagement(t: Tables) -> DataFrame:
    return finish_daily(daily_facts(t))


def weekly_trends(t: Tables) -> DataFrame:
    """Weekly sums of the daily report.

    ``total_weekly_active_users`` adds up daily users; ``distinct_weekly_users`` counts
    each customer once.
    """
    daily = finish_daily(daily_facts(t, week_start), "period_users").withColumn(
        "week_start", week_start("activity_date"))
    weekly = daily.groupBy("week_start").agg(
        F.sum("daily_active_users").alias("total_weekly_active_users"),
        F.sum("total_bets").alias("total_weekly_bets"),
        F.sum("total_wagered").alias("total_weekly_wagered"),
        F.sum("gross_gaming_revenue").alias("total_weekly_ggr"),
        F.sum("deposits_amount").alias("total_weekly_deposits"),
        F.sum("avg_bet_size").alias("bet_size"), F.count("*").alias("days_in_week"),
        F.sum("period_users").alias("distinct_weekly_users"),
    )
    # ordered over weeks: calendar-sized, whatever the volume of the facts
    order = Window.orderBy("week_start")
    previous = lambda c: F.lag(c).over(order)
    return weekly.select(
        "week_start", F.date_add("week_start", 6).alias("week_end"),
        "total_weekly_active_users", "distinct_weekly_users",
        share("total_weekly_active_users", "days_in_week", 0).alias("avg_daily_active_users"),
        "total_weekly_bets", "total_weekly_wagered", "total_weekly_ggr", "total_weekly_deposits",
        ratio("bet_size", exact("days_in_week"), 2).alias("avg_bet_size"),
        growth("total_weekly_ggr", previous("total_weekly_ggr")).alias("ggr_wow_growth_pct"),
        growth(exact("total_weekly_active_users"), exact(previous("total_weekly_active_users")))
        .alias("users_wow_growth_pct"),
    )


def recency_score(days: Column | str) -> Column:
    return ladder(days, RECENCY_RUNGS, 1)


def frequency_score(bets: Column | str) -> Column:
    return ladder(bets, FREQUENCY_RUNGS, 0, descending=True)


def monetary_score(wagered: Column | str) -> Column:
    return ladder(wagered, MONETARY_RUNGS, 0, descending=True)


def behavioral_segment() -> Column:
    """Ordered rules over the three scores."""
    r, f, m = F.col("recency_score"), F.col("frequency_score"), F.col("monetary_score")
    rules = [
        ("Non-Gambler", F.col("total_bets") == 0),
        ("Champion", F.least(r, f, m) >= 4),
        ("Loyal Customer", F.least(r, f, m) >= 3),
        ("New Customer", (r >= 4) & (m >= 3)),
        ("Big Spender", F.least(f, m) >= 4),
        ("At Risk", (r <= 2) & (f >= 3)),
        ("Lost Customer", (r <= 2) & (f <= 2)),
        ("Low Value", m <= 2),
    ]
    chosen = F.when(rules[0][1], rules[0][0])
    for name, rule in rules[1:]:
        chosen = chosen.when(rule, name)
    return chosen.otherwise("Regular")


def finish_segmentation(frame: DataFrame, t: Tables) -> DataFrame:
    since = whole_days("last_activity_date", t.midnight)
    scored = frame.withColumn("days_since_last_activity", since).withColumns({
        "recency_score": recency_score("days_since_last_activity"),
        "frequency_score": frequency_score("total_bets"),
        "monetary_score": monetary_score("total_wagered"),
    })
    return scored.select(
        "customer_id", F.col("customer_segment").alias("original_segment"),
        "acquisition_channel", "signup_date", "total_bets", "total_wagered", "avg_bet_size",
        "total_sessions", "avg_session_duration", "avg_bets_per_session", "total_deposits",
        "num_deposits", "days_since_last_activity", "recency_score", "frequency_score",
        "monetary_score",
        (F.col("recency_score") + F.col("frequency_score") + F.col("monetary_score"))
        .alias("rfm_score"),
        behavioral_segment().alias("behavioral_segment"), "last_activity_date",
    )


def behaviour_averages() -> dict[str, Column]:
    """Per-customer means from totals; 0 when there is nothing to average."""
    return {
        "avg_bet_size": zero(F.round(ratio("total_wagered", exact("total_bets")), 6)),
        "total_sessions": zero("total_sessions"),
        "avg_session_duration": zero(share("session_minutes", "timed_sessions", 6)),
        "avg_bets_per_session": zero(share("session_bets", "counted_sessions", 6)),
    }


def customer_segmentation(t: Tables) -> DataFrame:
    frame = attach(customer_value(t), customer_sessions(t)).withColumns(behaviour_averages())
    return finish_segmentation(frame, t)


def channel_attribution(t: Tables) -> DataFrame:
    """First-touch channel report."""
    deposits = t.first_deposits.groupBy("customer_id").agg(
        F.sum("amount").alias("first_amount"), F.count("*").alias("first_rows"))
    joined = attach(t.customers, deposits, customer_bets(t)).withColumns({
        "ggr": zero(F.col("total_wagered") - F.col("total_payouts")),
    }).withColumn("ltv", F.col("ggr") - F.col("acquisition_cost"))
    per_channel = joined.groupBy(F.col("acquisition_channel").alias("first_touch_channel")).agg(
        F.count("*").alias("total_customers"), F.count("first_rows").alias("converted_customers"),
        F.sum("acquisition_cost").alias("total_acquisition_cost"),
        zero(F.sum("first_amount")).alias("total_first_deposits"),
        F.sum("ggr").alias("total_ggr"), F.sum("ltv").alias("total_ltv"),
    )
    cost, n, won = "total_acquisition_cost", exact("total_customers"), exact("converted_customers")
    return per_channel.select(
        "first_touch_channel", "total_customers", "converted_customers",
        percent("converted_customers", "total_customers").alias("conversion_rate"),
        cost, ratio(cost, n, 2).alias("avg_cpi"), ratio(cost, won, 2).alias("cpa"),
        "total_first_deposits", "total_ggr", "total_ltv",
        ratio("total_ggr", cost, 2).alias("roas_ggr"),
        ratio("total_ltv", cost, 2).alias("ltv_cac_ratio"),
        ratio("total_first_deposits", won, 2).alias("avg_first_deposit"),
        ratio("total_ltv", n, 2).alias("avg_customer_ltv"),
    )
