"""Facts reduced to one row per customer, per customer-day or per day.

Every operator starts from one of these. Reducing a fact *before* joining keeps sums
free of join fan-out, lets Spark combine map-side (so a customer holding a third of
the rows costs one buffer per task), and leaves joins with one row per key. Unused
aggregates are removed by column pruning, so a broad builder costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.dates import day
from marketlens.functions.numbers import zero
from marketlens.plans.tables import Tables

def is_deposit() -> Column:
    return F.col("transaction_type") == "deposit"


def is_withdrawal() -> Column:
    return F.col("transaction_type") == "withdrawal"


def sum_if(condition: Column, value: str) -> Column:
    return F.sum(F.when(condition, F.col(value)))


def customer_ledger(t: Tables) -> DataFrame:
    return t.ledger.groupBy("customer_id").agg(
        sum_if(is_deposit(), "amount").alias("total_deposits"),
        sum_if(is_withdrawal(), "amount").alias("total_withdrawals"),
        F.count_if(is_deposit()).alias("num_deposits"),
        F.count_if(is_withdrawal()).alias("num_withdrawals"),
        F.count("*").alias("num_transactions"),
        F.min("transaction_date").alias("first_transaction_date"),
        F.max("transaction_date").alias("last_transaction_date"),
    )


def customer_bets(t: Tables) -> DataFrame:
    return t.betting_activity.groupBy("customer_id").agg(
        F.sum("bet_amount").alias("total_wagered"),
        F.sum("payout").alias("total_payouts"),
        F.sum("net_result").alias("customer_net_result"),
        F.count("*").alias("total_bets"),
        F.min("bet_date").alias("first_bet_date"),
        F.max("bet_date").alias("last_bet_date"),
    )


def customer_bet_days(t: Tables) -> DataFrame:
    """One row per customer and betting day; the number of days is calendar-bounded."""
    return (
        t.betting_activity.groupBy("customer_id", day("bet_date").alias("bet_day"))
        .agg(
            F.sum("bet_amount").alias("wagered"), F.sum("payout").alias("payouts"),
            F.count("*").alias("bets"),
        )
    )


def customer_sessions(t: Tables) -> DataFrame:
    return t.sessions.groupBy("customer_id").agg(
        F.count("*").alias("total_sessions"),
        F.sum("duration_minutes").alias("session_minutes"),
        F.count("duration_minutes").alias("timed_sessions"),
        F.sum("num_bets").alias("session_bets"),
        F.count("num_bets").alias("counted_sessions"),
        F.count_if(F.col("device_type") == "mobile").alias("mobile_sessions"),
        F.count_if(F.col("device_type") == "desktop").alias("desktop_sessions"),
    )


def attach(base: DataFrame, *others: DataFrame) -> DataFrame:
    """Left-join frames that hold one row per customer."""
    for other in others:
        base = base.join(other, "customer_id", "left")
    return base


def customer_value(t: Tables) -> DataFrame:
    """Customers with deposit and wager totals; gaps filled with 0."""
    frame = attach(t.customers, customer_ledger(t), customer_bets(t))
    counts = ["num_deposits", "num_withdrawals", "num_transactions", "total_bets"]
    sums = ["total_deposits", "total_withdrawals", "total_wagered", "total_payouts",
            "customer_net_result"]
    return frame.withColumns({c: zero(c) for c in counts + sums}).withColumns({
        "net_deposits": F.col("total_deposits") - F.col("total_withdrawals"),
        "gross_gaming_revenue": F.col("total_wagered") - F.col("total_payouts"),
        "last_activity_date": F.greatest("last_bet_date", "last_transaction_date"),
    }).withColumn("customer_ltv", F.col("gross_gaming_revenue") - F.col("acquisition_cost"))


def activity_days(t: Tables, *, sessions: bool = False) -> DataFrame:
    """Everything a customer did, one row per customer and day."""
    bets = t.betting_activity.select("customer_id", day("bet_date").alias("activity_day"))
    ledger = t.ledger.select("customer_id", day("transaction_date").alias("activity_day"))
    union = bets.unionByName(ledger)
    if sessions:
        union = union.unionByName(
            t.sessions.select("customer_id", day("start_time").alias("activity_day"))
        )
    return union.distinct()


def sample_std(n: str, total: str, squares: str) -> Column:
    """Sample standard deviation from exact sums; NULL below two values."""
    spread = (
        F.col(n).cast("decimal(11,0)") * F.col(squares).cast("decimal(27,4)")
        - F.col(total).cast("decimal(18,2)") * F.col(total).cast("decimal(18,2)")
    ).cast("double")
    count = F.col(n).cast("double")
    return F.when(F.col(n) > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (count * (count - 1))))


def customer_bet_profile(t: Tables, recent_days: int = 30) -> DataFrame:
    """Betting habits per customer, built over customer-days in two reductions.

    Distinct days become row counts and the spread of daily bets a plain sum, so no
    distinct aggregate is expanded over raw bets.
    """
    days = t.betting_activity.groupBy("customer_id", day("bet_date").alias("bet_day")).agg(
        F.count("*").alias("n"), F.sum("bet_amount").alias("stake"),
        F.sum(F.col("bet_amount") * F.col("bet_amount")).alias("stake2"),
        F.sum("payout").alias("paid"), F.sum("net_result").alias("net"),
        F.count_if("bet_won").alias("won"),
        F.min("bet_date").alias("first"), F.max("bet_date").alias("last"),
        # a struct buffer forces sort aggregation: kept apart, so it is pruned if unused
        F.min(F.struct("bet_date", "bet_amount")).alias("first_row"),
    )
    recent = F.col("bet_day") >= F.date_sub(t.today, recent_days)
    total = days.groupBy("customer_id").agg(
        F.sum("n").alias("total_bets"), F.sum("stake").alias("total_wagered"),
        F.sum("stake2").alias("squares"), F.sum("paid").alias("total_payouts"),
        F.sum("net").alias("customer_net_result"), F.sum("won").alias("bets_won"),
        F.min("first").alias("first_bet_date"), F.max("last").alias("last_bet_date"),
        F.min("first_row").alias("first_row"),
        F.count("*").alias("betting_days"),
        F.sum(F.col("n") * F.col("n")).alias("bets_per_day_squares"),
        F.sum(F.when(recent, F.col("n"))).alias("recent_bets"),
        F.sum(F.when(recent, F.col("stake"))).alias("recent_wagered"),
        F.count_if(recent).alias("recent_days"),
    )
    return total.withColumns({
        "first_bet_amount": F.col("first_row.bet_amount"),
        "bet_size_std": sample_std("total_bets", "total_wagered", "squares"),
        "bets_per_day_std": sample_std("betting_days", "total_bets", "bets_per_day_squares"),
    }).drop("first_row")


def customer_sports(t: Tables) -> DataFrame:
    """One row per customer and sport."""
    return t.betting_activity.groupBy("customer_id", "sport").agg(
        F.count("*").alias("bets_count"), F.sum("bet_amount").alias("total_wagered"),
        F.count_if("bet_won").alias("won"), F.sum("net_result").alias("net_result"),
    )


def customer_sport_profile(t: Tables) -> DataFrame:
    """Number of sports and the most frequent one (smallest name on ties)."""
    # counts negated so that one min() takes the highest count, then the smallest name
    most = F.min(F.struct((-F.col("bets_count")).alias("minus"), "sport"))
    return customer_sports(t).groupBy("customer_id").agg(
        F.count("sport").alias("sports_diversity"),
        most.getField("sport").alias("favorite_sport"),
    )
