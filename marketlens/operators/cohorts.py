"""Retention, revenue, lifetime value and churn by signup cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.dates import (
    floor_days, month_offset, month_start, period_offset, period_start, whole_days,
)
from marketlens.functions.numbers import exact, fixed, percent, ratio, share, zero
from marketlens.functions.ranks import quantiles
from marketlens.functions.rows import beside
from marketlens.plans.facts import (
    activity_days, attach, customer_bet_days, customer_bets, customer_ledger,
)
from marketlens.plans.tables import Tables


def cohort_members(t: Tables, period: str = "monthly") -> DataFrame:
    return t.customers.select("customer_id", period_start("signup_date", period).alias("cohort"))


def cohort_sizes(t: Tables, period: str = "monthly") -> DataFrame:
    return cohort_members(t, period).groupBy("cohort").agg(F.count("*").alias("cohort_size"))


def _active_periods(t: Tables, period: str) -> DataFrame:
    """One row per customer and period with any bet or transaction."""
    return activity_days(t).select(
        "customer_id", period_start("activity_day", period).alias("activity_period")).distinct()


def cohort_retention(t: Tables) -> DataFrame:
    """Retention by calendar months since signup, activity before signup included."""
    active = _active_periods(t, "monthly").join(cohort_members(t), "customer_id")
    counted = active.groupBy("cohort", "activity_period").agg(
        F.count("*").alias("active_customers"))
    return counted.join(cohort_sizes(t), "cohort").select(
        F.col("cohort").alias("cohort_month"), "cohort_size",
        month_offset("cohort", "activity_period").alias("months_since_signup"),
        "active_customers", percent("active_customers", "cohort_size").alias("retention_rate"))


def revenue_cohort_rows(t: Tables) -> DataFrame:
    days = customer_bet_days(t)
    monthly = days.groupBy("customer_id", month_start("bet_day").alias("activity_month")).agg(
        F.sum(F.col("wagered") - F.col("payouts")).alias("ggr"), F.count("*").alias("days"))
    rows = monthly.join(cohort_members(t), "customer_id").groupBy("cohort", "activity_month").agg(
        F.count("*").alias("active_customers"), F.sum("ggr").alias("ggr"),
        F.sum("days").alias("days"))
    return rows.join(cohort_sizes(t), "cohort").withColumn(
        "months_since_signup", month_offset("cohort", "activity_month"))


def finish_revenue_cohort(rows: DataFrame) -> DataFrame:
    # months of one cohort: calendar-sized
    upto = Window.partitionBy("cohort").orderBy("activity_month").rowsBetween(
        Window.unboundedPreceding, 0)
    running = F.sum("ggr").over(upto)
    n, size = exact("active_customers"), exact("cohort_size")
    return rows.select(
        F.col("cohort").alias("cohort_month"), "cohort_size", "months_since_signup",
        "active_customers", percent("active_customers", "cohort_size").alias("retention_rate"),
        F.col("ggr").alias("cohort_monthly_ggr"),
        ratio("ggr", n, 2).alias("avg_ggr_per_active_customer"),
        ratio("ggr", size, 2).alias("ggr_per_cohort_customer"),
        share("days", "active_customers", 1).alias("avg_active_days"),
        running.alias("cumulative_ggr_per_cohort"),
        ratio(running, size, 2).alias("cumulative_ggr_per_customer"))


def revenue_cohort(t: Tables) -> DataFrame:
    return finish_revenue_cohort(revenue_cohort_rows(t))


def retention_cohorts(t: Tables, period: str = "monthly") -> DataFrame:
    """Share of a cohort active in period 0, 1, ...; activity before signup is dropped."""
    counted = (
        _active_periods(t, period).join(cohort_members(t, period), "customer_id")
        .withColumn("period_number", period_offset("cohort", "activity_period", period))
        .where("period_number >= 0")
        .groupBy("cohort", "period_number").agg(F.count("*").alias("active_customers"))
    )
    return counted.join(cohort_sizes(t, period), "cohort").select(
        F.col("cohort").alias("cohort_period"), "period_number", "active_customers",
        "cohort_size", share("active_customers", "cohort_size", 6).alias("retention_rate"))


def retention_long(t: Tables, period: str = "monthly") -> DataFrame:
    """Every cohort with every period number that occurs; 0 where nobody was active."""
    observed = retention_cohorts(t, period).select(
        "cohort_period", "period_number", "retention_rate")
    cohorts = observed.groupBy("cohort_period").agg(F.lit(1).alias("k"))
    # the list of period numbers is calendar-sized: one small array carried to each cohort
    numbers = observed.agg(F.array_sort(F.collect_set("period_number")).alias("numbers"))
    grid = beside(cohorts, numbers).select(
        "cohort_period", F.explode("numbers").alias("period_number"))
    return grid.join(observed, ["cohort_period", "period_number"], "left").select(
        "cohort_period", "period_number", zero("retention_rate").alias("retention_rate"))


def retention_matrix(t: Tables, period: str = "monthly", periods: int | None = None) -> DataFrame:
    """One column per period number 0 .. periods-1; unless given, the width is measured
    first (a single number comes back to the driver)."""
    observed = retention_cohorts(t, period)
    if periods is None:
        periods = (observed.agg(F.max("period_number")).first()[0] or 0) + 1
    return (
        observed.groupBy("cohort_period")
        .pivot("period_number", list(range(periods))).agg(F.max("retention_rate"))
        .select("cohort_period", *[
            zero(F.col(f"`{i}`")).alias(f"period_{i}") for i in range(periods)])
    )


def retention_rows(t: Tables, period: str = "monthly") -> DataFrame:
    """The matrix in a fixed schema: per cohort its rates for periods 0, 1, ... as text.

    Every row has as many rates as the largest period number that occurs, plus one.
    """
    observed = retention_cohorts(t, period).select(
        "cohort_period", "period_number", "retention_rate")
    cohorts = observed.groupBy("cohort_period").agg(F.lit(1).alias("k"))
    # one number; the calendar bounds it
    width = observed.agg(F.max("period_number").cast("int").alias("last"))
    grid = beside(cohorts, width).select(
        "cohort_period", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("period_number"))
    cell = F.struct("period_number", F.format_string(
        "%.6f", zero("retention_rate").cast("double")).alias("rate"))
    return grid.join(observed, ["cohort_period", "period_number"], "left").groupBy(
        "cohort_period").agg(F.array_sort(F.collect_list(cell)).alias("cells")).select(
        "cohort_period", F.array_join("cells.rate", ",").alias("rates"))


def retention_summary(t: Tables, checkpoints: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    """Mean retention at given periods over all cohorts, inactive ones counting as 0."""
    observed = retention_cohorts(t)
    totals = observed.where(F.col("period_number").isin(list(checkpoints))).agg(*[
        zero(F.sum(F.when(F.col("period_number") == p, F.col("retention_rate")))).alias(f"s{p}")
        for p in checkpoints])
    cohorts = observed.agg(F.countDistinct("cohort_period").alias("cohorts"))
    return beside(totals, cohorts).select("cohorts", *[
        ratio(f"s{p}", exact("cohorts"), 6).alias(f"period_{p}_retention") for p in checkpoints])


def revenue_cohorts(t: Tables, period: str = "monthly") -> DataFrame:
    """GGR per cohort and period over customer-period totals."""
    per_customer = customer_bet_days(t).groupBy(
        "customer_id", period_start("bet_day", period).alias("activity_period")).agg(
        F.sum(F.col("wagered") - F.col("payouts")).alias("revenue"))
    rows = (
        per_customer.join(cohort_members(t, period), "customer_id")
        .withColumn("period_number", period_offset("cohort", "activity_period", period))
        .where("period_number >= 0").groupBy("cohort", "period_number")
        .agg(F.sum("revenue").alias("total_revenue"), F.count("*").alias("revenue_events"))
    )
    return rows.join(cohort_sizes(t, period), "cohort").select(
        F.col("cohort").alias("cohort_period"), "period_number", "total_revenue",
        ratio("total_revenue", exact("revenue_events"), 6).alias("avg_revenue_per_active"),
        "revenue_events", F.col("revenue_events").alias("active_customers"), "cohort_size",
        ratio("total_revenue", exact("cohort_size"), 6).alias("revenue_per_cohort_customer"))


def cohort_customers(t: Tables) -> DataFrame:
    """Per-customer measures behind the lifetime value cohorts."""
    frame = attach(t.customers, customer_bets(t), customer_ledger(t))
    tenure = F.when(F.col("total_bets") > 0, whole_days("first_bet_date", "last_bet_date") + 1)
    wagered, bets = zero("total_wagered"), zero("total_bets")
    return frame.select(
        "customer_id", month_start("signup_date").alias("cohort_month"), "acquisition_channel",
        "customer_segment", "acquisition_cost", (wagered - zero("total_payouts")).alias("revenue"),
        zero("total_deposits").alias("deposits"), zero(tenure).alias("tenure_days"),
        bets.alias("bets"),
        zero(ratio("total_wagered", exact("total_bets"), 10)).alias("bet_size"),
        zero(share("total_bets", tenure, 10)).alias("frequency"),
    ).withColumn("ltv", F.col("revenue") - F.col("acquisition_cost"))


def ltv_cohorts(t: Tables) -> DataFrame:
    customers = cohort_customers(t)
    n = exact("customer_count")
    totals = customers.groupBy("cohort_month").agg(
        F.count("*").alias("customer_count"), F.sum("ltv").alias("total_ltv"),
        F.stddev_samp("ltv").alias("std"), F.sum("revenue").alias("total_revenue"),
        F.sum("deposits").alias("total_deposits"), F.sum("acquisition_cost").alias("cost"),
        F.sum("tenure_days").alias("tenure"), F.sum("bets").alias("bets"),
        F.sum("bet_size").alias("bet_size"), F.sum("frequency").alias("frequency"))
    medians = quantiles(customers, ["cohort_month"], "ltv", {"median_ltv": 0.5}).join(
        quantiles(customers, ["cohort_month"], "revenue", {"median_revenue": 0.5}),
        "cohort_month")
    published = totals.join(medians, "cohort_month").select(
        "cohort_month", "customer_count", ratio("total_ltv", n, 2).alias("avg_ltv"),
        F.round("median_ltv", 2).alias("median_ltv"), fixed("std", 2).alias("std_ltv"),
        "total_ltv", ratio("total_revenue", n, 2).alias("avg_revenue"),
        F.round("median_revenue", 2).alias("median_revenue"), "total_revenue",
        ratio("total_deposits", n, 2).alias("avg_deposits"), "total_deposits",
        ratio("cost", n, 2).alias("avg_acquisition_cost"),
        share("tenure", "customer_count", 2).alias("avg_tenure_days"),
        share("bets", "customer_count", 2).alias("avg_total_bets"),
        ratio("bet_size", n, 2).alias("avg_bet_size"),
        ratio("frequency", n, 2).alias("avg_betting_frequency"))
    return published.withColumns({
        "ltv_cac_ratio": ratio("avg_ltv", "avg_acquisition_cost", 6),
        "revenue_per_customer": ratio("total_revenue", exact("customer_count"), 6)})


def churn_by_cohort(t: Tables, churn_period_days: int = 30) -> DataFrame:
    """Inactive for longer than the period, or never active, counts as churned."""
    last = attach(
        t.customers.select("customer_id", month_start("signup_date").alias("cohort_month")),
        customer_bets(t).select("customer_id", "last_bet_date"),
        customer_ledger(t).select("customer_id", "last_transaction_date"),
    ).withColumn("last_seen", F.greatest("last_bet_date", "last_transaction_date"))
    rows = last.withColumn("idle", floor_days("last_seen", t.midnight))
    never = F.col("last_seen").isNull()
    agg = rows.groupBy("cohort_month").agg(
        F.count("*").alias("total_customers"),
        F.count_if(never | (F.col("idle") > churn_period_days)).alias("churned_customers"),
        F.count_if(never).alias("never_active_customers"),
        F.sum("idle").alias("idle_sum"), F.count("idle").alias("idle_n"),
        # whole days: the buffer holds at most one entry per calendar day
        F.median("idle").alias("median_days"))
    return agg.select(
        "cohort_month", "total_customers", "churned_customers",
        share("churned_customers", "total_customers", 4).alias("churn_rate"),
        "never_active_customers",
        share("never_active_customers", "total_customers", 4).alias("never_active_rate"),
        share("idle_sum", "idle_n", 4).alias("avg_days_since_activity"),
        F.round("median_days", 4).alias("median_days_since_activity"),
        (F.col("total_customers") - F.col("churned_customers")).alias("active_customers"),
        (1 - share("churned_customers", "total_customers", 4)).alias("active_rate"))


def cohort_overview(t: Tables) -> DataFrame:
    """Unweighted means over cohorts."""
    n = exact("cohorts")
    value = ltv_cohorts(t).agg(
        F.count("*").alias("cohorts"), F.sum("avg_ltv").alias("ltv"),
        F.sum("avg_acquisition_cost").alias("cac")).select(
        "cohorts", ratio("ltv", n, 6).alias("avg_ltv"), ratio("cac", n, 6).alias("avg_cac"),
        zero(ratio("ltv", "cac", 6)).alias("ltv_cac_ratio"))
    churn = churn_by_cohort(t).agg(
        ratio(F.sum("churn_rate"), exact(F.count("*")), 6).alias("churn_rate"),
        ratio(F.sum("never_active_rate"), exact(F.count("*")), 6).alias("never_active_rate"))
    return beside(value, churn)


def cohort_heatmap_totals(t: Tables) -> DataFrame:
    """Active customers by cohort and period with both margins and the grand total."""
    cells = retention_cohorts(t).select("cohort_period", "period_number", "active_customers")
    return cells.cube("cohort_period", "period_number").agg(
        F.sum("active_customers").alias("active_customers"),
        F.grouping_id().alias("margin"))
