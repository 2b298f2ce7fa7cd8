"""Customer features and targets as of a date, and evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.dates import floor_days
from marketlens.functions.numbers import exact, fixed, ratio, share, zero
from marketlens.functions.ranks import ranked_values
from marketlens.functions.rows import beside
from marketlens.plans.facts import (
    attach, customer_bet_profile, customer_ledger, customer_sessions, customer_sport_profile,
    is_deposit,
)
from marketlens.plans.tables import Tables
from marketlens.schemas import CHANNELS, SEGMENTS

TARGETS = {"churn": "churn_target", "ltv": "ltv_target", "conversion": "conversion_target"}
CHURN_DAYS = 30


def _first_deposit(t: Tables) -> DataFrame:
    """Earliest deposit by date, then id."""
    first = F.min(F.struct("transaction_date", "transaction_id", "amount"))
    return t.ledger.where(is_deposit()).groupBy("customer_id").agg(first.alias("f")).select(
        "customer_id", F.col("f.transaction_date").alias("first_deposit_at"),
        F.col("f.amount").alias("first_amount"))


def _profile(t: Tables) -> dict[str, Column]:
    flags = {f"customer_segment_{s}": (F.col("customer_segment") == s) for s in SEGMENTS}
    flags |= {f"channel_{c}": (F.col("acquisition_channel") == c) for c in CHANNELS}
    flags |= {c: F.coalesce(c, F.lit(False)) for c in ("email_verified", "phone_verified")}
    return {
        "age": F.col("age"), "acquisition_cost": F.col("acquisition_cost"),
        "tenure_days": F.col("tenure"), **{k: v.cast("int") for k, v in flags.items()},
    }


def _per(count: str, days: int) -> Column:
    """Events per that many days of tenure, of which at least one is assumed."""
    periods = F.greatest(F.lit(1.0), F.col("tenure") / F.lit(float(days)))
    return fixed(F.coalesce(count, F.lit(0)) / periods, 6)


def _money_features(t: Tables) -> dict[str, Column]:
    deposited = F.col("first_deposit_at").isNotNull()
    return {
        "total_deposits": zero("total_deposits"), "total_withdrawals": zero("total_withdrawals"),
        "net_deposits": zero("total_deposits") - zero("total_withdrawals"),
        "num_deposits": zero("num_deposits"), "num_withdrawals": zero("num_withdrawals"),
        "avg_deposit_size": zero(ratio("total_deposits", exact("num_deposits"), 6)),
        "first_deposit_amount": zero("first_amount"), "deposit_frequency": _per("num_deposits", 30),
        "has_made_deposit": deposited.cast("int"),
        "days_to_first_deposit": F.when(deposited, floor_days("signup_date", "first_deposit_at"))
        .otherwise(-1),
        "days_since_last_transaction": F.when(
            deposited, floor_days("last_transaction_date", t.midnight)).otherwise(F.col("tenure")),
        "transaction_span_days": F.when(
            deposited, floor_days("first_deposit_at", "last_transaction_date") + 1).otherwise(0),
    }


def _betting_features(t: Tables) -> dict[str, Column]:
    bettor = F.col("first_bet_date").isNotNull()
    ggr = zero("total_wagered") - zero("total_payouts")
    return {
        "total_bets": zero("total_bets"), "total_wagered": zero("total_wagered"),
        "total_winnings": zero("total_payouts"), "net_betting_result": zero("customer_net_result"),
        "gross_gaming_revenue": ggr,
        "avg_bet_size": zero(ratio("total_wagered", exact("total_bets"), 6)),
        "bet_size_std": F.coalesce(fixed("bet_size_std", 6), F.lit(0.0)),
        "win_rate": zero(share("bets_won", "total_bets", 6)),
        "betting_frequency": _per("total_bets", 7), "sports_diversity": zero("sports_diversity"),
        "favorite_sport": F.coalesce("favorite_sport", F.lit("none")),
        "days_to_first_bet": F.when(bettor, floor_days("signup_date", "first_bet_date"))
        .otherwise(-1),
        "days_since_last_bet": F.when(bettor, floor_days("last_bet_date", t.midnight))
        .otherwise(F.col("tenure")),
        "betting_span_days": F.when(bettor, floor_days("first_bet_date", "last_bet_date") + 1)
        .otherwise(0),
        "active_betting_days": zero("betting_days"), "bets_last_30d": zero("recent_bets"),
        "wagered_last_30d": zero("recent_wagered"), "active_days_last_30d": zero("recent_days"),
    }


def _session_features() -> dict[str, Column]:
    return {
        "total_sessions": zero("total_sessions"),
        "avg_session_duration": zero(share("session_minutes", "timed_sessions", 6)),
        "total_session_time": zero("session_minutes"),
        "avg_bets_per_session": zero(share("session_bets", "counted_sessions", 6)),
        "sessions_per_week": _per("total_sessions", 7),
        "mobile_sessions_pct": zero(share("mobile_sessions", "total_sessions", 6)),
        "desktop_sessions_pct": zero(share("desktop_sessions", "total_sessions", 6)),
    }


def feature_matrix(t: Tables, prediction_type: str | None = None) -> DataFrame:
    """49 features per customer, with the target of ``prediction_type`` or all three.

    Five facts reduced to customers and joined on the key they are already hashed by.
    """
    if prediction_type is not None and prediction_type not in TARGETS:
        raise ValueError(f"Unknown prediction type: {prediction_type}")
    base = t.customers.where("customer_id IS NOT NULL").withColumn(
        "tenure", F.datediff(t.today, "signup_date"))
    frame = attach(base, customer_ledger(t), _first_deposit(t), customer_bet_profile(t),
                   customer_sport_profile(t), customer_sessions(t))
    features = {**_profile(t), **_money_features(t), **_betting_features(t), **_session_features()}
    matrix = frame.select("customer_id", *[c.alias(name) for name, c in features.items()])
    wanted = TARGETS if prediction_type is None else {prediction_type: TARGETS[prediction_type]}
    targets = {
        "churn": (
            (F.col("days_since_last_bet") > CHURN_DAYS)
            & (F.col("days_since_last_transaction") > CHURN_DAYS)
            & ((F.col("total_bets") > 0) | (F.col("num_deposits") > 0))).cast("int"),
        "ltv": F.col("gross_gaming_revenue") - F.col("acquisition_cost"),
        "conversion": F.col("has_made_deposit"),
    }
    return matrix.withColumns({TARGETS[k]: targets[k] for k in wanted})


def target(t: Tables, prediction_type: str) -> DataFrame:
    return feature_matrix(t, prediction_type).select("customer_id", TARGETS[prediction_type])


def with_split(df: DataFrame, seed: int = 42, fraction: float = 0.2,
               label: str | None = None) -> DataFrame:
    """Repeatable ``is_test`` flag: of each label's n rows, round(fraction * n) are held out.

    A hash of seed and customer orders the rows, so the choice is the same on any number of
    executors. The last draw held out is found from exact distributed ranks; without ``label``
    all rows are one group. A missing label is a group of its own.
    """
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "customer_id")), 1, 15),
                  16, 10).cast("long")
    group = F.coalesce(F.col(label).cast("string"), F.lit("")) if label else F.lit("")
    drawn = df.withColumns({"_draw": draw, "_group": group})
    ranks = ranked_values(drawn.select("_group", "_draw"), ["_group"], "_draw")
    wanted = F.round(F.col("total") * F.lit(fraction)).cast("long")
    # a row a label
    last = ranks.where(F.col("before") < wanted).groupBy("_group").agg(F.max("_draw").alias("_last"))
    return drawn.join(last, "_group", "left").withColumn(
        "is_test", F.coalesce(F.col("_draw") <= F.col("_last"), F.lit(False))).select(*df.columns, "is_test")


def split_sizes(t: Tables) -> DataFrame:
    return with_split(target(t, "churn"), label="churn_target").groupBy("churn_target", "is_test").agg(
        F.count("*").alias("customers"))


# --- evaluation ---------------------------------------------------------------------------

def classification_report(predictions: DataFrame, label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class with accuracy, macro and weighted means.

    One pass to the confusion counts; all else works on classes.
    """
    cells = predictions.groupBy(F.col(label).cast("int").alias("y"),
                                F.col(prediction).cast("int").alias("p")).agg(
        F.count("*").alias("n"))
    sides = cells.select(
        F.explode(F.array(
            F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("said"),
                     F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"),
                     F.col("n").alias("said"), F.lit(0).cast("bigint").alias("hit")),
        )).alias("s")).select("s.*")
    d = lambda c: F.col(c).cast("double")
    per_class = sides.groupBy("class").agg(*[
        F.sum(c).alias(c) for c in ("support", "said", "hit")]).select(
        "class", "support", "hit",
        F.coalesce(F.try_divide(d("hit"), d("said")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(d("hit"), d("support")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * d("hit"), d("said") + d("support")), F.lit(0.0))
        .alias("f1_score"))
    total = F.sum("support")
    measures = ("precision", "recall", "f1_score")
    overall = per_class.agg(
        total.alias("support"), F.try_divide(F.sum("hit"), total).alias("accuracy"),
        *[F.avg(m).alias(f"m_{m}") for m in measures],
        *[F.try_divide(F.sum(F.col(m) * F.col("support")), total).alias(f"w_{m}")
          for m in measures])
    rows = F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), *[
            F.col("accuracy").alias(m) for m in measures]),
        F.struct(F.lit("macro avg").alias("class"), *[F.col(f"m_{m}").alias(m) for m in measures]),
        F.struct(F.lit("weighted avg").alias("class"), *[
            F.col(f"w_{m}").alias(m) for m in measures])))
    summary = overall.select("support", rows.alias("r")).select("r.*", "support")
    both = per_class.select(F.col("class").cast("string").alias("class"), *measures, "support")
    return both.unionByName(summary).select(
        "class", *[fixed(m, 6).alias(m) for m in measures], "support")


def curve_points(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """ROC and precision-recall points, one per distinct score (highest first).

    Cumulative counts come from distributed ranks, so no task sorts all scores.
    """
    ranked = ranked_values(scored, [], score, {"positives": F.sum(F.col(label).cast("long"))})
    all_positive = scored.agg(F.sum(F.col(label).cast("long")).alias("all_positives"))
    tp = F.col("all_positives") - F.col("before_positives")
    called = F.col("total") - F.col("before")
    negatives = F.col("total") - F.col("all_positives")
    # a single row of totals
    return beside(ranked, all_positive).select(
        F.col(score).alias("threshold"), tp.alias("true_positives"),
        (called - tp).alias("false_positives"),
        share(tp, "all_positives", 6).alias("recall"),
        share(called - tp, negatives, 6).alias("false_positive_rate"),
        share(tp, called, 6).alias("precision"))


def inactivity_predictions(t: Tables, days: int = 90) -> DataFrame:
    """A rule-based churn call: no bet for longer than ``days``; the score is the gap."""
    return feature_matrix(t, "churn").select(
        "customer_id", F.col("churn_target").alias("label"),
        F.col("days_since_last_bet").alias("score"),
        (F.col("days_since_last_bet") > days).cast("int").alias("prediction"))


# --- bands --------------------------------------------------------------------------------

def probability_band(c: Column | str) -> Column:
    value = F.col(c) if isinstance(c, str) else c
    return F.when(value > 0.7, "High").when(value > 0.3, "Medium").otherwise("Low")


def ltv_band(c: Column | str) -> Column:
    value = F.col(c) if isinstance(c, str) else c
    return F.when(value > 200, "High").when(value > 50, "Medium").otherwise("Low")


def banded(scores: DataFrame) -> DataFrame:
    """Published score columns from churn, value and conversion predictions.

    Without a deposit the value counts as 0 / Low; with one the conversion is certain.
    """
    paid = F.col("has_made_deposit") == 1
    return scores.select(
        "customer_id", "churn_probability", probability_band("churn_probability")
        .alias("churn_risk"),
        F.when(paid, F.col("ltv_prediction")).otherwise(0.0).alias("predicted_ltv"),
        F.when(paid, ltv_band("ltv_prediction")).otherwise("Low").alias("ltv_segment"),
        F.when(paid, 1.0).otherwise(F.col("conversion_score")).alias("conversion_probability"),
        F.when(paid, "Converted").otherwise(probability_band("conversion_score"))
        .alias("conversion_potential"),
        "tenure_days", "total_bets", "total_wagered", "days_since_last_bet", "customer_segment")


def risk_bands(t: Tables) -> DataFrame:
    """The band rules on known scores: win rate, realised value and mobile share."""
    segment = F.when(F.col("customer_segment_whale") == 1, "whale").when(
        F.col("customer_segment_regular") == 1, "regular").otherwise("casual")
    return banded(feature_matrix(t, "ltv").select(
        "*", F.col("win_rate").cast("double").alias("churn_probability"),
        F.col("ltv_target").cast("double").alias("ltv_prediction"),
        F.col("mobile_sessions_pct").cast("double").alias("conversion_score"),
        segment.alias("customer_segment")))
