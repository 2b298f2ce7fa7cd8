"""Loading checks: summaries, key constraints and value rules as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.dates import day
from marketlens.functions.rows import beside
from marketlens.plans.facts import is_deposit, sum_if
from marketlens.plans.tables import Tables
from marketlens.schemas import FOREIGN_KEYS, NOT_NULL, PRIMARY_KEYS, TRANSACTION_TYPES


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def data_quality_summary(t: Tables) -> DataFrame:
    checks = [
        ("customers", F.col("acquisition_cost") < 0, "signup_date"),
        ("transactions", F.col("amount") <= 0, "transaction_date"),
        ("betting_activity", F.col("bet_amount") <= 0, "bet_date"),
        ("sessions", F.col("duration_minutes") < 0, "start_time"),
    ]
    return _union([
        getattr(t, "ledger" if name == "transactions" else name).agg(
            F.count("*").alias("total_records"),
            F.count_if(F.col("customer_id").isNull()).alias("null_ids"),
            F.count_if(bad).alias("negative_costs"),
            day(F.min(stamp)).alias("earliest_date"), day(F.max(stamp)).alias("latest_date"),
        ).withColumn("table_name", F.lit(name))
        for name, bad, stamp in checks
    ])


def database_summary(t: Tables) -> DataFrame:
    ledger = t.ledger.agg(F.count("*").alias("total_transactions"),
                          sum_if(is_deposit(), "amount").alias("total_deposits"))
    bets = t.betting_activity.agg(
        F.count("*").alias("total_bets"), F.sum("bet_amount").alias("total_wagered"),
        F.sum(F.col("bet_amount") - F.col("payout")).alias("total_ggr"))
    singles = [
        t.customers.agg(F.count("*").alias("total_customers")), ledger, bets,
        t.sessions.agg(F.count("*").alias("total_sessions")),
        t.campaigns.agg(F.count("*").alias("total_campaigns")),
        t.customer_campaigns.agg(F.count("*").alias("total_campaign_interactions")),
        t.first_deposits.agg(F.countDistinct("customer_id").alias("converted_customers")),
    ]
    # each side is a global aggregate: exactly one row
    return beside(*singles)


def dq_primary_key(t: Tables) -> DataFrame:
    """Rows without a key, keys given more than once, and the surplus rows."""
    out = []
    for name, key in PRIMARY_KEYS.items():
        frame = getattr(t, "ledger" if name == "transactions" else name)
        missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
        per_key = frame.groupBy(*key).agg(F.count("*").alias("n"))
        whole = ~missing
        out.append(per_key.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
            F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("null_keys"),
            F.count_if(whole & (F.col("n") > 1)).alias("duplicate_keys"),
            F.coalesce(F.sum(F.when(whole, F.col("n") - 1)), F.lit(0)).alias("surplus_rows"),
        ).withColumn("table_name", F.lit(name)))
    return _union(out)


def dq_foreign_key(t: Tables) -> DataFrame:
    """Rows whose reference has no parent; the child is reduced to its keys first."""
    out = []
    for child, column, parent in FOREIGN_KEYS:
        frame = getattr(t, "ledger" if child == "transactions" else child)
        keys = frame.where(F.col(column).isNotNull()).groupBy(column).agg(
            F.count("*").alias("n"))
        orphans = keys.join(getattr(t, parent).select(column), column, "left_anti")
        out.append(orphans.agg(
            F.count("*").alias("orphan_keys"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"),
        ).withColumns({"child_table": F.lit(child), "child_column": F.lit(column),
                       "parent_table": F.lit(parent)}))
    return _union(out)


def dq_domain(t: Tables) -> DataFrame:
    """NOT NULL and CHECK violations, one row per rule and one scan per table."""
    out = []
    for name, columns in NOT_NULL.items():
        rules: dict[str, Column] = {f"{c} not null": F.col(c).isNull() for c in columns}
        if name == "transactions":
            rules["transaction_type domain"] = ~F.col("transaction_type").isin(TRANSACTION_TYPES)
        frame = getattr(t, "ledger" if name == "transactions" else name)
        counted = frame.agg(*[F.count_if(bad).alias(rule) for rule, bad in rules.items()])
        out.append(
            counted.unpivot([], list(rules), "rule", "violations")
            .withColumn("table_name", F.lit(name))
        )
    return _union(out)
