"""Dashboard measures: headline figures, levels of detail, calendars and monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.calendar import dense_days
from marketlens.functions.dates import (
    day, month_offset, month_start, week_start, whole_days,
)
from marketlens.functions.numbers import exact, fixed, ladder, ratio, share, zero
from marketlens.operators.cohorts import cohort_members, cohort_sizes
from marketlens.operators.kpis import (
    converters, daily_engagement, frequency_score, monetary_score, recency_score,
)
from marketlens.functions.rows import beside
from marketlens.plans.facts import (
    attach, customer_bet_days, customer_bets, customer_ledger, customer_value,
)
from marketlens.plans.tables import Tables

# Value segments and alert texts.
VALUE_RUNGS = [(5000, "High Value"), (1000, "Medium Value"), (100, "Low Value")]
ALERT_DOWN, ALERT_UP, ALERT_STABLE = "🔴 Down >10%", "🟢 Up >10%", "🟡 Stable"
ALERT_THRESHOLD = 0.10


def headline(t: Tables) -> DataFrame:
    people = t.customers.agg(
        F.count("*").alias("customers"), F.sum("acquisition_cost").alias("cost"))
    won = converters(t).agg(F.count("*").alias("won"))
    bets = customer_bets(t).agg(
        F.count("*").alias("mau"), F.sum("total_wagered").alias("wagered"),
        F.sum("total_payouts").alias("paid"))
    visits = t.sessions.agg(F.sum("duration_minutes").alias("minutes"),
                            F.count("duration_minutes").alias("visits"))
    # four single-row aggregates side by side
    row = beside(people, won, bets, visits)
    ltv = F.col("wagered") - F.col("paid") - F.col("cost")
    return row.select(
        ratio("cost", exact("customers"), 6).alias("cac"),
        share("won", "customers", 6).alias("conversion_rate"), ltv.alias("total_ltv"),
        ratio(ltv * F.col("customers"), "cost", 4).alias("roas"), "mau",
        share("minutes", "visits", 6).alias("avg_session_duration"))


def customer_lod(t: Tables) -> DataFrame:
    tenure = F.datediff(t.today, "signup_date")
    frame = customer_value(t).join(converters(t), "customer_id", "left")
    return frame.select(
        "customer_id", "customer_ltv", "total_wagered", tenure.alias("days_since_signup"),
        ladder("total_wagered", VALUE_RUNGS, "Inactive", descending=True).alias("value_segment"),
        F.when(F.col("converted").isNotNull(), "Yes").otherwise("No").alias("has_deposited"),
        tenure.alias("tenure_days"))


def campaign_measures(t: Tables) -> DataFrame:
    """ROI, response, lift of responders over the rest, and GGR net of promotion."""
    value = customer_value(t).join(converters(t), "customer_id", "left").select(
        "customer_id", "customer_ltv", "gross_gaming_revenue",
        F.col("converted").isNotNull().alias("won"))
    yes, no = F.col("responded"), ~F.col("responded")
    agg = t.customer_campaigns.join(value, "customer_id").groupBy("campaign_id").agg(
        F.count("*").alias("targeted"), F.count_if(yes).alias("answered"),
        F.count_if(no).alias("silent"), F.count_if(yes & F.col("won")).alias("won1"),
        F.count_if(no & F.col("won")).alias("won0"), F.count_if("bonus_claimed").alias("claims"),
        F.sum("campaign_cost").alias("cost"),
        F.sum(F.when(yes, F.col("customer_ltv"))).alias("revenue"),
        F.sum(F.when(yes, F.col("gross_gaming_revenue"))).alias("ggr"))
    counts = ("targeted", "answered", "silent", "won1", "won0", "claims", "cost", "revenue", "ggr")
    rows = t.campaigns.select("campaign_id", "bonus_amount").join(
        agg, "campaign_id", "left").withColumns({c: zero(c) for c in counts})
    treated = ratio(exact("won1"), exact("answered"))
    control = ratio(exact("won0"), exact("silent"))
    return rows.select(
        "campaign_id", F.col("targeted").alias("customers_targeted"),
        F.col("answered").alias("customers_responded"),
        share("answered", "targeted", 6).alias("response_rate"),
        F.col("revenue").alias("campaign_revenue"), F.col("cost").alias("campaign_cost"),
        ratio(F.col("revenue") - F.col("cost"), "cost", 6).alias("campaign_roi"),
        ratio("cost", exact("answered"), 6).alias("cost_per_response"),
        F.round(treated, 6).alias("treatment_conversion"),
        F.round(control, 6).alias("control_conversion"),
        ratio(exact("won1") * exact("silent") - exact("won0") * exact("answered"),
              exact("won0") * exact("answered"), 6).alias("campaign_lift"),
        (F.col("ggr") - zero("bonus_amount") * F.col("claims") - F.col("cost")).alias("ngr"))


def monthly(t: Tables) -> DataFrame:
    """Active users, revenue per user, revenue net of promotion and betting frequency."""
    # a window holds the betting days of one customer in one month
    whole = Window.partitionBy("customer_id", month_start("bet_day"))
    days = customer_bet_days(t).withColumn("opens", F.col("bet_day") == F.min("bet_day").over(whole))
    per_day = days.groupBy("bet_day").agg(
        F.count_if("opens").alias("opened"), F.sum(F.col("wagered") - F.col("payouts")).alias("ggr"),
        F.sum("bets").alias("bets"), F.count("*").alias("users"))
    # a customer opens each of its months once: the sum over days counts distinct users
    per_month = per_day.groupBy(month_start("bet_day").alias("month")).agg(
        F.sum("opened").alias("mau"), F.sum("ggr").alias("ggr"), F.sum("bets").alias("bets"),
        F.sum("users").alias("user_days"), F.count("*").alias("dates"))
    promo = t.customer_campaigns.join(
        t.campaigns.select("campaign_id", "bonus_amount"), "campaign_id",
    ).groupBy(month_start("sent_date").alias("month")).agg(
        F.sum(F.col("campaign_cost") + F.when(F.col("bonus_claimed"), F.col("bonus_amount"))
              .otherwise(0)).alias("promo"))
    rows = per_month.join(promo, "month", "left")
    return rows.select(
        "month", "mau", share("user_days", "dates", 6).alias("avg_dau"), "bets",
        F.col("ggr").alias("gross_gaming_revenue"), zero("promo").alias("promotional_cost"),
        (F.col("ggr") - zero("promo")).alias("net_gaming_revenue"),
        ratio("ggr", exact("mau"), 6).alias("arpu"),
        share("bets", "user_days", 6).alias("bet_frequency"))


def cohort(t: Tables) -> DataFrame:
    """Betting retention with the cohort size as a fixed level of detail."""
    months = customer_bet_days(t).select(
        "customer_id", month_start("bet_day").alias("activity")).distinct()
    active = months.join(cohort_members(t), "customer_id").groupBy("cohort", "activity").agg(
        F.count("*").alias("active_customers"))
    return active.join(cohort_sizes(t), "cohort").select(
        F.col("cohort").alias("cohort_period"),
        month_offset("cohort", "activity").alias("period_number"), "active_customers",
        "cohort_size", share("active_customers", "cohort_size", 6).alias("retention_rate"))


def rfm_lifecycle(t: Tables) -> DataFrame:
    idle = whole_days("last_activity_date", t.midnight)
    bet_idle = F.datediff(t.today, F.to_date("last_bet_date"))
    stage = (
        F.when(F.col("num_deposits") == 0, "Prospect").when(idle <= 30, "Active")
        .when(idle <= 90, "At Risk").otherwise("Churned"))
    return customer_value(t).select(
        "customer_id", idle.alias("days_since_last_activity"),
        recency_score(idle).alias("recency_score"),
        recency_score(bet_idle).alias("bet_recency_score"),
        frequency_score("total_bets").alias("frequency_score"),
        monetary_score("total_wagered").alias("monetary_score"), stage.alias("lifecycle_stage"))


def daily_revenue(t: Tables) -> DataFrame:
    return t.betting_activity.groupBy(day("bet_date").alias("date")).agg(
        F.sum(F.col("bet_amount") - F.col("payout")).alias("revenue"), F.count("*").alias("bets"),
        F.sum("bet_amount").alias("wagered"))


def daily_monitor(t: Tables, target: float = 500.0, dense: bool = False) -> DataFrame:
    """Revenue against the day before, with an alert, a 7-row mean and a daily target.

    ``dense`` adds the days without bets with a revenue of 0, so the mean is one of 7 days.
    """
    order = Window.orderBy("date")  # one row per day: calendar-sized
    before = F.when(F.datediff("date", F.lag("date").over(order)) == 1,
                    F.lag("revenue").over(order))
    week = order.rowsBetween(-6, 0)
    change = ratio(F.col("revenue") - F.col("yesterday"), "yesterday")
    alert = F.when(F.col("change") < -ALERT_THRESHOLD, ALERT_DOWN).when(
        F.col("change") > ALERT_THRESHOLD, ALERT_UP).otherwise(ALERT_STABLE)
    rows = daily_revenue(t).select("date", "revenue")
    if dense:
        rows = dense_days(rows, "date", zeros=["revenue"])
    rows = rows.withColumn("yesterday", before).withColumn("change", change)
    return rows.select(
        "date", F.col("revenue").alias("revenue_today"),
        F.col("yesterday").alias("revenue_yesterday"),
        F.round("change", 6).alias("daily_revenue_change"), alert.alias("performance_alert"),
        ratio(F.sum("revenue").over(week), exact(F.count("*").over(week)), 6)
        .alias("moving_average_7"),
        ratio("revenue", F.lit(target).cast("decimal(20,2)"), 6).alias("target_achievement"))


def sport_days(t: Tables) -> DataFrame:
    """Every day of each sport between its first bet and its last: bets, revenue, and the mean
    stake of the last day that had any."""
    rows = t.betting_activity.groupBy("sport", day("bet_date").alias("date")).agg(
        F.count("*").alias("bets"), F.sum(F.col("bet_amount") - F.col("payout")).alias("revenue"),
        ratio(F.sum("bet_amount"), exact(F.count("*")), 2).alias("last_mean_stake"))
    return dense_days(rows, "date", ["sport"], zeros=["bets", "revenue"],
                      carried=["last_mean_stake"]).withColumnRenamed("present", "any_bet")


def hourly(t: Tables) -> DataFrame:
    """Sessions and bets by hour of day."""
    visits = t.sessions.groupBy(F.hour("start_time").alias("hour_of_day")).agg(
        F.count("*").alias("sessions"), F.sum("num_bets").alias("session_bets"))
    bets = t.betting_activity.groupBy(F.hour("bet_date").alias("hour_of_day")).agg(
        F.count("*").alias("bets"), F.sum("bet_amount").alias("wagered"))
    both = visits.unionByName(bets, allowMissingColumns=True)
    return both.groupBy("hour_of_day").agg(*[
        zero(F.sum(c)).alias(c) for c in ("sessions", "session_bets", "bets", "wagered")])


def calendar(t: Tables, fiscal_start_month: int = 4) -> DataFrame:
    """Every date from the first signup to today with fiscal year and month revenue."""
    span = t.customers.agg(F.min("signup_date").alias("lo"))
    dates = span.select(F.explode(F.sequence("lo", t.today)).alias("date"))
    revenue = daily_revenue(t).groupBy(month_start("date").alias("month_first")).agg(
        F.sum("revenue").alias("month_revenue"))
    previous = revenue.select(
        F.add_months("month_first", 1).alias("month_first"),
        F.col("month_revenue").alias("previous_month_revenue"))
    fiscal = F.year("date") - F.when(F.month("date") >= fiscal_start_month, 0).otherwise(1)
    return dates.withColumn("month_first", month_start("date")).join(
        revenue, "month_first", "left").join(previous, "month_first", "left").select(
        "date", F.year("date").alias("year"), F.quarter("date").alias("quarter"),
        F.month("date").alias("month"), week_start("date").alias("week_start"),
        fiscal.alias("fiscal_year"), zero("month_revenue").alias("month_revenue"),
        zero("previous_month_revenue").alias("previous_month_revenue"))


def series_stats(t: Tables) -> DataFrame:
    """Correlation, linear trend, deviation and 95th percentile of the daily series."""
    start = F.lit("1970-01-01").cast("date")
    rows = daily_engagement(t).select(
        F.col("gross_gaming_revenue").cast("double").alias("revenue"),
        F.col("total_wagered").cast("double").alias("wagered"),
        F.col("daily_active_users").cast("double").alias("users"),
        F.datediff("activity_date", start).cast("double").alias("x"))
    # one value per day: the percentile buffer is calendar-sized
    return rows.agg(
        fixed(F.corr("wagered", "users"), 6).alias("correlation"),
        fixed(F.regr_slope("revenue", "x"), 6).alias("trend_slope"),
        fixed(F.regr_intercept("revenue", "x"), 3).alias("trend_intercept"),
        fixed(F.stddev_samp("revenue"), 6).alias("std_dev"),
        fixed(F.percentile("revenue", F.lit(0.95)), 6).alias("p95_revenue"))


def growth_forecast(t: Tables, growth: float = 0.02, periods: int = 12) -> DataFrame:
    """Mean monthly revenue compounded over future months."""
    history = daily_revenue(t).groupBy(month_start("date").alias("m")).agg(
        F.sum("revenue").alias("revenue")).agg(
        ratio(F.sum("revenue"), exact(F.count("*")), 6).cast("double").alias("average"))
    ahead = history.withColumn(
        "period", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    return ahead.select(
        "period", F.col("average").alias("historical_average"),
        fixed(F.col("average") * F.pow(F.lit(1.0 + growth), F.col("period")), 4)
        .alias("forecast"))


def daily_aggregate(t: Tables, years: int = 2, active_days: int | None = None,
                    whole_months: bool = False) -> DataFrame:
    """Pre-aggregated extract: last ``years`` by day, sport, segment and channel.

    ``active_days`` keeps customers with a bet in that many days before today only;
    ``whole_months`` starts at the first of the month that the period begins in.
    """
    since = F.add_months(t.today, -12 * years)
    since = F.trunc(since, "month") if whole_months else since
    # compared as instants, so that the bound reaches the file scan
    midnight = lambda date: date.cast("timestamp_ntz")
    bets = t.betting_activity.where(F.col("bet_date") >= midnight(since))
    if active_days is not None:
        recent = t.betting_activity.where(
            F.col("bet_date") >= midnight(F.date_sub(t.today, active_days))).select("customer_id")
        bets = bets.join(recent.distinct(), "customer_id", "left_semi")
    # reduced per customer before the customer attributes are joined
    small = bets.groupBy("customer_id", "sport", day("bet_date").alias("date")).agg(
        F.count("*").alias("n"), F.sum("bet_amount").alias("stake"), F.sum("payout").alias("paid"))
    who = t.customers.select("customer_id", "customer_segment", "acquisition_channel")
    return small.join(who, "customer_id").groupBy(
        "date", "sport", "customer_segment", "acquisition_channel").agg(
        F.sum("n").alias("bets"), F.sum("stake").alias("wagered"),
        F.sum(F.col("stake") - F.col("paid")).alias("revenue"))


def funnel(t: Tables) -> DataFrame:
    """Registered, first deposit, first bet, active: counts with step and overall rates."""
    frame = attach(
        t.customers.select("customer_id"), converters(t), customer_bets(t), customer_ledger(t))
    last = F.greatest("last_bet_date", "last_transaction_date")
    paid = F.col("converted").isNotNull()
    bet = paid & (F.col("total_bets") > 0)
    live = bet & (whole_days(last, t.midnight) <= 30)
    stages = ["1 registered", "2 first deposit", "3 first bet", "4 active"]
    counted = frame.agg(
        F.count("*").alias(stages[0]), F.count_if(paid).alias(stages[1]),
        F.count_if(bet).alias(stages[2]), F.count_if(live).alias(stages[3]))
    order = Window.orderBy("stage")  # four rows
    return counted.unpivot([], stages, "stage", "customers").select(
        "stage", "customers",
        share("customers", F.lag("customers").over(order), 6).alias("step_rate"),
        share("customers", F.first("customers").over(order), 6).alias("overall_rate"))
