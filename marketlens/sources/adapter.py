"""Derive the six tables from TPC-H-like parquet plus an ``events`` table.

The rules are in FIXTURES.md section 2. Customer attributes that a fact row needs
(signup date, segment parity) are functions of the customer key, so the facts are
built without joining the customer table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.plans.tables import Tables

AS_OF = dt.date(2001, 11, 5)
SESSION_BUCKET_SECONDS = 7200
DEPOSIT = "o_orderstatus = 'O' AND o_custkey % 8 <> 0"  # one customer in eight never deposits

# Declared rather than inferred: no job to read footers before a plan can be built.
INPUTS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def money(expression: str, divisor: int) -> Column:
    """A double amount divided down in whole cents, so engines cannot disagree."""
    # amounts are positive, so adding a half and cutting rounds like round() does
    cents = f"cast(({expression}) * 100 + 0.5D as bigint) div {divisor}"
    return F.expr(f"cast(cast({cents} as decimal(12,0)) * 0.01 as decimal(10,2))")


def customer_key(column: str) -> Column:
    return F.concat(F.lit("CU_"), F.lpad(F.col(column).cast("string"), 12, "0"))


def _signup(key: str) -> str:
    return f"date_add(DATE'1993-07-01', cast(({key} * 7) % 900 as int))"


def _choice(expression: str, *values: object) -> Column:
    column = F.when(F.expr(f"{expression} = 0"), F.lit(values[0]))
    for i, value in enumerate(values[1:], 1):
        column = column.when(F.expr(f"{expression} = {i}"), F.lit(value))
    return column


class _Source:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(INPUTS[name]).parquet(f"{self.folder}/{name}.parquet")

    def customers(self) -> DataFrame:
        null = lambda dtype: F.lit(None).cast(dtype)
        return self.read("customer").select(
            customer_key("c_custkey").alias("customer_id"),
            F.expr(_signup("c_custkey")).alias("signup_date"),
            _choice("c_nationkey % 4", "paid_search", "social_media", "affiliate", "organic")
            .alias("acquisition_channel"),
            F.when(F.expr("c_nationkey % 4 = 3"), F.lit(0).cast("decimal(10,2)"))
            .otherwise(money("abs(c_acctbal)", 100)).alias("acquisition_cost"),
            F.expr("cast(18 + c_custkey % 48 as int)").alias("age"),
            null("string").alias("gender"), null("string").alias("country"),
            null("string").alias("state"), null("string").alias("city"),
            self._segment().alias("customer_segment"),
            F.expr("c_custkey % 7 <> 0").alias("email_verified"),
            F.expr("c_custkey % 4 <> 0").alias("phone_verified"),
        )

    @staticmethod
    def _segment() -> Column:
        return (
            F.when(F.col("c_mktsegment") == "MACHINERY", "whale")
            .when(F.col("c_mktsegment") == "HOUSEHOLD", "regular")
            .otherwise("casual")
        )

    def ledger(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").cast("string").alias("transaction_id"),
            customer_key("o_custkey").alias("customer_id"),
            F.when(F.expr(DEPOSIT), "deposit").otherwise("withdrawal")
            .alias("transaction_type"),
            money("o_totalprice", 1000).alias("amount"),
            F.col("o_orderdate").alias("transaction_date"),
            F.col("o_orderpriority").alias("payment_method"),
        )

    def _first_deposit_rows(self) -> DataFrame:
        # min(struct) combines map-side, so one customer owning a third of the orders
        # costs one buffer per task rather than one huge sort
        first = F.min(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))
        return (
            self.read("orders").where(DEPOSIT)
            .groupBy("o_custkey").agg(first.alias("f")).select("o_custkey", "f.*")
        )

    def first_deposits(self) -> DataFrame:
        return self._first_deposit_rows().select(
            customer_key("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("transaction_date"),
            money("o_totalprice", 1000).alias("amount"),
        )

    def transactions(self) -> DataFrame:
        # joined on the order key: unique, so a heavy customer is spread evenly
        flagged = self._first_deposit_rows().select(
            F.col("o_orderkey").cast("string").alias("transaction_id"),
            F.lit(True).alias("flag"),
        )
        return (
            self.ledger().join(flagged, "transaction_id", "left")
            .withColumn("is_first_deposit", F.coalesce("flag", F.lit(False))).drop("flag")
        )

    def betting_activity(self) -> DataFrame:
        lines = self.read("lineitem").join(
            self.read("orders").select("o_orderkey", "o_custkey"),
            F.col("l_orderkey") == F.col("o_orderkey"),
        )
        parts = self.read("part").select("p_partkey", "p_type")
        bets = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        won = F.col("l_returnflag") == "R"
        stake = money("l_extendedprice", 1000)
        payout = F.when(won, money("l_extendedprice * 2", 1000)).otherwise(
            F.lit(0).cast("decimal(10,2)")
        )
        return bets.select(
            F.concat_ws("-", *[F.col(c).cast("string") for c in
                               ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
            .alias("bet_id"),
            customer_key("o_custkey").alias("customer_id"),
            F.lit(None).cast("string").alias("session_id"),
            F.col("p_type").alias("sport"),
            stake.alias("bet_amount"),
            F.expr("l_shipdate + make_dt_interval(0, 0, cast((l_partkey * 37 + l_linenumber * 11)"
                   " % 1440 as int))").alias("bet_date"),
            won.alias("bet_won"),
            payout.alias("payout"),
            (payout - stake).cast("decimal(10,2)").alias("net_result"),
            F.lit(None).cast("decimal(8,2)").alias("odds"),
        )

    def sessions(self) -> DataFrame:
        # zone-free epoch seconds: both operands are NTZ
        second = f"timestampdiff(SECOND, {EPOCH}, ts)"
        grouped = (
            self.read("events")
            .groupBy("user_id", F.expr(f"{second} div {SESSION_BUCKET_SECONDS}").alias("bucket"))
            .agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"),
                 F.count_if(F.col("event_type") == "purchase").alias("bets"),
                 F.min("event_id").alias("first_event"))
        )
        whole = lambda c: f"timestampdiff(SECOND, {EPOCH}, {c})"
        device = (
            F.when(F.expr("first_event % 20 < 13"), "mobile")
            .when(F.expr("first_event % 20 < 18"), "desktop").otherwise("tablet")
        )
        shift = F.expr("make_ym_interval(25, 0)")
        return grouped.select(
            F.concat_ws("-", F.lit("SES"), F.col("user_id"), F.col("bucket")).alias("session_id"),
            customer_key("user_id").alias("customer_id"),
            (F.col("lo") - shift).alias("start_time"), (F.col("hi") - shift).alias("end_time"),
            F.expr(f"cast(({whole('hi')} - {whole('lo')}) div 60 as int)").alias("duration_minutes"),
            F.col("bets").cast("int").alias("num_bets"),
            F.lit(None).cast("decimal(10,2)").alias("total_wagered"),
            F.lit(None).cast("decimal(10,2)").alias("net_result"),
            device.alias("device_type"),
            F.lit(None).cast("string").alias("browser"),
            F.lit(None).cast("string").alias("country"),
        )

    def _campaign_rows(self) -> DataFrame:
        return (
            self.read("nation").select(F.col("n_nationkey").cast("bigint").alias("k"))
            .select(
                "k",
                F.expr("concat('CAMP_', lpad(cast(k + 1 as string), 5, '0'))").alias("campaign_id"),
                _choice("k % 4", "signup_bonus", "retention", "engagement", "vip")
                .alias("campaign_type"),
                F.expr("date_add(DATE'1993-08-01', cast(k * 110 as int))").alias("start_date"),
                F.expr("date_add(DATE'1993-08-01', cast(k * 110 + 7 + k % 15 as int))")
                .alias("end_date"),
                _choice("k % 4", 15.0, 8.5, 10.0, 45.0).cast("decimal(8,2)")
                .alias("cost_per_customer"),
                _choice("k % 4", 50, 25, 10, 200).cast("decimal(8,2)").alias("bonus_amount"),
                _choice("k % 4", "casual,regular,whale", "regular,whale", "casual,regular,whale",
                        "whale").alias("target_segments"),
            )
        )

    def campaigns(self) -> DataFrame:
        return self._campaign_rows().select(
            "campaign_id", F.col("campaign_id").alias("campaign_name"), "campaign_type",
            "start_date", "end_date", F.lit(None).cast("string").alias("description"),
            "cost_per_customer", "bonus_amount",
            F.lit(None).cast("decimal(8,2)").alias("min_deposit"), "target_segments",
        )

    def customer_campaigns(self) -> DataFrame:
        # nation has 25 rows at every scale: at most 75 rows, where a join by the three
        # segments would leave all customers to three tasks
        targets = F.broadcast(
            self._campaign_rows().withColumn("segment", F.explode(F.split("target_segments", ",")))
        )
        people = self.read("customer").select(
            "c_custkey", self._segment().alias("segment"),
            F.expr(_signup("c_custkey")).alias("signup_date"),
        )
        responded = F.expr("(c_custkey * 13 + k * 7) % 97 < 4")
        return (
            people.join(targets, "segment")
            .where("signup_date <= start_date")
            .select(
                customer_key("c_custkey").alias("customer_id"), "campaign_id",
                F.expr("date_add(start_date, cast((c_custkey + k) % 4 as int))").alias("sent_date"),
                responded.alias("responded"),
                F.when(responded, F.expr(
                    "date_add(start_date, cast(1 + (c_custkey + 3 * k) % 10 as int))"
                )).alias("response_date"),
                (responded & F.expr("(c_custkey + k) % 5 <> 0")).alias("bonus_claimed"),
                F.col("cost_per_customer").alias("campaign_cost"),
            )
        )


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return _Source(spark, folder).read("events")


def from_testdata(spark: SparkSession, folder: str, as_of: dt.date = AS_OF) -> Tables:
    source = _Source(spark, folder)
    names = (*Tables.NAMES, "ledger", "first_deposits")
    return Tables(as_of, **{name: getattr(source, name) for name in names})
