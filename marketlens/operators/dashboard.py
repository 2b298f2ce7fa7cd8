"""Filters and small summaries that a dashboard asks for."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.dates import day
from marketlens.functions.numbers import exact, ratio, share, zero
from marketlens.operators.kpis import converters
from marketlens.functions.rows import beside
from marketlens.plans.facts import is_deposit, sum_if
from marketlens.plans.tables import Tables

FACTS = ("transactions", "ledger", "first_deposits", "betting_activity", "sessions",
         "customer_campaigns")


def filter_customers(t: Tables, start: dt.date | None = None, end: dt.date | None = None,
                     channel: str | None = None, segment: str | None = None) -> Tables:
    """Restrict customers and, through them, every fact; campaigns stay whole.

    None (or "All") means no restriction. The result is another table bundle.
    """
    kept = t.customers
    if start is not None:
        kept = kept.where(F.col("signup_date") >= F.lit(start))
    if end is not None:
        kept = kept.where(F.col("signup_date") <= F.lit(end))
    if channel not in (None, "All"):
        kept = kept.where(F.col("acquisition_channel") == channel)
    if segment not in (None, "All"):
        kept = kept.where(F.col("customer_segment") == segment)
    ids = kept.select("customer_id")

    def restricted(name: str):
        return lambda: getattr(t, name).join(ids, "customer_id", "left_semi")

    swapped = {name: restricted(name) for name in FACTS}
    return Tables(t.as_of, customers=kept, campaigns=lambda: t.campaigns, **swapped)


def table_counts(t: Tables) -> DataFrame:
    """Rows per table, one row each."""
    out = None
    for name in Tables.NAMES:
        frame = t.ledger if name == "transactions" else getattr(t, name)
        counted = frame.agg(F.count("*").alias("records")).withColumn("table_name", F.lit(name))
        out = counted if out is None else out.unionByName(counted)
    return out


def overview_kpis(t: Tables) -> DataFrame:
    people = t.customers.agg(F.count("*").alias("total_customers"))
    first = t.first_deposits.agg(
        F.countDistinct("customer_id").alias("converted_customers"),
        F.sum("amount").alias("first_sum"), F.count("amount").alias("first_rows"))
    ledger = t.ledger.agg(zero(sum_if(is_deposit(), "amount")).alias("total_deposits"))
    bets = t.betting_activity.agg(
        zero(F.sum("bet_amount")).alias("total_wagered"),
        zero(F.sum(F.col("bet_amount") - F.col("payout"))).alias("gross_gaming_revenue"))
    # four single-row aggregates side by side
    row = beside(people, first, ledger, bets)
    return row.select(
        "total_customers", "converted_customers",
        zero(share("converted_customers", "total_customers", 6)).alias("conversion_rate"),
        "total_deposits", "total_wagered", "gross_gaming_revenue",
        zero(ratio("gross_gaming_revenue", exact("converted_customers"), 6))
        .alias("avg_customer_ltv"),
        ratio("first_sum", exact("first_rows"), 6).alias("avg_first_deposit"),
    )


def channel_performance(t: Tables) -> DataFrame:
    """Conversions count first-deposit rows; CPA is 0 when there is a cost but no conversion."""
    first = t.first_deposits.groupBy("customer_id").agg(F.count("*").alias("rows"))
    agg = t.customers.join(first, "customer_id", "left").groupBy("acquisition_channel").agg(
        F.count("*").alias("customers"), F.sum("acquisition_cost").alias("acquisition_cost"),
        zero(F.sum("rows")).alias("conversions"))
    cpa = F.when((F.col("conversions") == 0) & (F.col("acquisition_cost") > 0), 0).otherwise(
        ratio("acquisition_cost", exact("conversions"), 6))
    return agg.select(
        "acquisition_channel", "customers", "acquisition_cost", "conversions",
        share("conversions", "customers", 6).alias("conversion_rate"), cpa.alias("cpa"))


def daily_metrics(t: Tables) -> DataFrame:
    """Betting days with that day's deposits, 0 where there were none."""
    bets = (
        t.betting_activity.groupBy(day("bet_date").alias("date"), "customer_id").agg(
            F.count("*").alias("n"), F.sum("bet_amount").alias("stake"),
            F.sum("payout").alias("paid"))
        .groupBy("date").agg(
            F.count("*").alias("daily_active_users"), F.sum("n").alias("total_bets"),
            F.sum("stake").alias("total_wagered"), F.sum("paid").alias("total_payouts"))
    )
    deposits = (
        t.ledger.where(is_deposit()).groupBy(day("transaction_date").alias("date"), "customer_id")
        .agg(F.sum("amount").alias("amount"))
        .groupBy("date").agg(F.count("*").alias("depositing_users"),
                             F.sum("amount").alias("total_deposits"))
    )
    return bets.join(deposits, "date", "left").withColumns({
        "gross_gaming_revenue": F.col("total_wagered") - F.col("total_payouts"),
        "depositing_users": zero("depositing_users"), "total_deposits": zero("total_deposits"),
    })


def dataset_summary(t: Tables) -> DataFrame:
    people = t.customers.agg(F.count("*").alias("customers"))
    first = t.first_deposits.agg(F.count("*").alias("first_deposits"))
    bets = t.betting_activity.agg(F.count("*").alias("bets"), F.sum("bet_amount").alias("volume"))
    return beside(people, first, bets).select(
        "customers", "bets",
        share("first_deposits", "customers", 6).alias("conversion_rate"),
        ratio("volume", exact("bets"), 6).alias("avg_bet_size"),
        F.col("volume").alias("total_volume_wagered"))


def campaign_audience(t: Tables, fraction: float = 0.65) -> DataFrame:
    """Repeatable sample of the customers eligible per campaign.

    Eligible: the segment is targeted and signup is not after the start. The target
    list is exploded so that the match is an equi-join on the segment with a date
    filter; the side to broadcast is left to measured sizes.
    """
    targets = t.campaigns.select(
        "campaign_id", "start_date",
        F.explode(F.split("target_segments", r"\s*,\s*")).alias("customer_segment"))
    people = t.customers.select("customer_id", "customer_segment", "signup_date")
    eligible = people.join(targets, "customer_segment").where("signup_date <= start_date")
    # md5 of the pair: the same customers on every run and in every engine
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", "campaign_id", "customer_id")), 1, 8), 16, 10)
    marked = eligible.withColumn("taken", draw.cast("long") < F.lit(int(fraction * 2**32)))
    return marked.select("campaign_id", "customer_id", "customer_segment", "taken")


def campaign_audience_sizes(t: Tables) -> DataFrame:
    return campaign_audience(t).groupBy("campaign_id", "customer_segment").agg(
        F.count("*").alias("eligible"), F.count_if("taken").alias("sampled"))


def data_dictionary(t: Tables) -> DataFrame:
    """One row: table counts, date range and the value lists."""
    people = t.customers.agg(
        F.count("*").alias("total_customers"),
        F.array_sort(F.collect_set("acquisition_channel")).alias("channels"),
        F.array_sort(F.collect_set("customer_segment")).alias("customer_segments"))
    bets = t.betting_activity.agg(
        F.count("*").alias("total_bets"), F.array_sort(F.collect_set("sport")).alias("sports"))
    row = beside(people, bets)
    for name, label in (("ledger", "total_transactions"), ("sessions", "total_sessions"),
                        ("campaigns", "total_campaigns")):
        row = beside(row, getattr(t, name).agg(F.count("*").alias(label)))
    return row
