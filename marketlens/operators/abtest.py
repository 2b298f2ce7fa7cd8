"""A/B tests on a user-level frame: one row per user with ``group`` and metric columns."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.numbers import exact, fixed, ratio, share
from marketlens.functions.ranks import ranked_values
from marketlens.functions.stats import (
    normal_cdf, normal_points, normal_quantile, t_p_value, t_quantile, two_sided_normal, z_value,
)
from marketlens.plans.facts import attach, customer_value
from marketlens.plans.tables import Tables

CONTROL, TREATMENT = "control", "treatment"
RATE_METRICS = {"responded": "Response Rate", "converted": "Conversion Rate"}
VALUE_METRICS = {"avg_bet_size": "Average Bet Size", "customer_ltv": "Customer LTV",
                 "total_deposits": "Total Deposits"}


def ab_users(t: Tables, split: str = "hash") -> DataFrame:
    """Users with a group and the five metrics; NULL where a metric does not apply.

    ``hash`` assigns groups by the customer id, ``response`` compares customers that
    answered a campaign with those that were sent one and never answered.
    """
    answers = t.customer_campaigns.groupBy("customer_id").agg(
        F.max("responded").alias("answered"))
    first = t.first_deposits.select("customer_id").distinct().withColumn("paid", F.lit(True))
    users = attach(customer_value(t), answers, first)
    if split == "hash":
        low = F.substring(F.md5("customer_id"), 1, 1) < "8"
        users = users.withColumn("group", F.when(low, CONTROL).otherwise(TREATMENT))
    elif split == "response":
        users = users.where("answered IS NOT NULL").withColumn(
            "group", F.when(F.col("answered"), TREATMENT).otherwise(CONTROL))
    else:
        raise ValueError(f"Unknown split: {split}")
    return users.select(
        "customer_id", "group", "customer_segment",
        F.coalesce("answered", F.lit(False)).alias("responded"),
        F.coalesce("paid", F.lit(False)).alias("converted"),
        ratio("total_wagered", exact("total_bets"), 6).cast("double").alias("avg_bet_size"),
        F.col("customer_ltv").cast("double").alias("customer_ltv"),
        F.when(F.col("num_deposits") > 0, F.col("total_deposits")).cast("double")
        .alias("total_deposits"))


def _arm(name: str) -> Column:
    return F.col("group") == name


# --- planning -----------------------------------------------------------------------------

def sample_size(baseline: Column, lift: Column, alpha: float = 0.05, power: float = 0.8,
                two_sample: bool = False) -> Column:
    """Users per group to see a relative lift of a rate.

    The usual two-sample formula has twice this variance; ``two_sample`` applies it.
    """
    z = z_value(1 - alpha / 2) + z_value(power)
    raised = baseline * (1 + lift)
    pooled = (baseline + raised) / 2
    n = F.lit(z * z) * pooled * (1 - pooled) / F.pow(raised - baseline, F.lit(2.0))
    return F.ceil(n * 2 if two_sample else n)


def sample_size_continuous(effect: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Users per group to see a standardised mean difference."""
    z = z_value(1 - alpha / 2) + z_value(power)
    return F.ceil(F.lit(2.0) * F.pow(F.lit(z) / effect, F.lit(2.0)))


def sample_size_plan(t: Tables, lifts: Sequence[float] = (0.05, 0.1, 0.15, 0.2, 0.3, 0.5)
                     ) -> DataFrame:
    """Required sizes for every campaign type's response rate and a grid of lifts."""
    base = t.customer_campaigns.join(
        t.campaigns.select("campaign_id", "campaign_type"), "campaign_id",
    ).groupBy("campaign_type").agg(
        share(F.count_if("responded"), F.count("*"), 6).cast("double").alias("baseline_rate"))
    grid = base.withColumn("expected_lift", F.explode(F.array(*[F.lit(x) for x in lifts])))
    rate, lift = F.col("baseline_rate"), F.col("expected_lift")
    return grid.where(rate > 0).select(
        "campaign_type", "baseline_rate", "expected_lift",
        sample_size(rate, lift).alias("n_proportion"),
        sample_size(rate, lift, two_sample=True).alias("n_proportion_two_sample"),
        sample_size_continuous(lift).alias("n_continuous"))


# --- rates --------------------------------------------------------------------------------

def rate_counts(users: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Sizes and successes of both arms, one row per key and metric, in one reduction."""
    sums = [F.count_if(_arm(arm)).alias(f"n_{side}")
            for side, arm in (("c", CONTROL), ("t", TREATMENT))]
    for m in metrics:
        sums += [F.count_if(_arm(arm) & F.col(m)).alias(f"{m}_{side}")
                 for side, arm in (("c", CONTROL), ("t", TREATMENT))]
    wide = users.groupBy(*keys).agg(*sums)
    rows = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}_c").alias("x_c"),
                 F.col(f"{m}_t").alias("x_t")) for m in metrics])).alias("row")
    return wide.select(*keys, "n_c", "n_t", rows).select(*keys, "n_c", "n_t", "row.*")


def conversion_test(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Yates-corrected chi-square, Wald interval, Cohen's h and post-hoc power."""
    z = z_value(1 - alpha / 2)
    d = lambda c: F.col(c).cast("double")
    n_c, n_t, x_c, x_t = d("n_c"), d("n_t"), d("x_c"), d("x_t")
    p_c, p_t = F.try_divide(x_c, n_c), F.try_divide(x_t, n_t)
    lift = p_t - p_c
    total, wins = n_c + n_t, x_c + x_t
    # all four cells of a 2 x 2 table deviate by the same amount
    off = F.abs(x_c - n_c * wins / total)
    off = off - F.least(F.lit(0.5), off)
    cells = F.try_divide(total * total * total, n_c * n_t * wins * (total - wins))
    chi2 = off * off * cells
    se = F.sqrt(p_c * (1 - p_c) / n_c + p_t * (1 - p_t) / n_t)
    pooled = wins / total
    se_pooled = F.sqrt(pooled * (1 - pooled) * (1 / n_c + 1 / n_t))
    z_seen = F.when(se_pooled > 0, F.abs(lift) / se_pooled).otherwise(0.0)
    angle = lambda p: F.asin(F.sqrt(p))
    keys = [c for c in counts.columns if c not in ("n_c", "n_t", "x_c", "x_t")]
    tested = counts.where("n_c > 0 AND n_t > 0").select(
        *keys, p_c.alias("control_value"), p_t.alias("treatment_value"), lift.alias("lift"),
        F.when(p_c > 0, lift / p_c * 100).otherwise(0.0).alias("lift_pct"),
        chi2.alias("chi2"), two_sided_normal(F.sqrt(chi2)).alias("p_value"),
        (lift - z * se).alias("ci_lower"), (lift + z * se).alias("ci_upper"),
        (2 * (angle(p_t) - angle(p_c))).alias("effect_size"),
        (normal_cdf(z_seen - z) + normal_cdf(-z_seen - z)).alias("statistical_power"),
        F.col("n_c").alias("sample_size_control"), F.col("n_t").alias("sample_size_treatment"))
    return tested.withColumn("is_significant", F.col("p_value") < alpha)


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns to fixed digits."""
    return frame.withColumns({
        name: fixed(name, digits) for name, kind in frame.dtypes if kind == "double"})


def ab_conversion(t: Tables) -> DataFrame:
    counts = rate_counts(ab_users(t), list(RATE_METRICS), ["customer_segment"])
    return rounded(conversion_test(counts))


def z_test(counts: DataFrame) -> DataFrame:
    """Pooled z score, and the lower bound of the treatment rate at z = 1.96."""
    d = lambda c: F.col(c).cast("double")
    p_c, p_t = F.try_divide(d("x_c"), d("n_c")), F.try_divide(d("x_t"), d("n_t"))
    pooled = (d("x_c") + d("x_t")) / (d("n_c") + d("n_t"))
    se = F.sqrt(pooled * (1 - pooled) * (1 / d("n_t") + 1 / d("n_c")))
    keys = [c for c in counts.columns if c not in ("n_c", "n_t", "x_c", "x_t")]
    return counts.where("n_c > 0 AND n_t > 0").select(
        *keys, p_c.alias("control_rate"), p_t.alias("treatment_rate"),
        F.try_divide(p_t - p_c, se).alias("z_score"),
        (p_t - 1.96 * F.sqrt(p_t * (1 - p_t) / d("n_t"))).alias("ci_lower"))


def ab_z_test(t: Tables) -> DataFrame:
    return rounded(z_test(rate_counts(ab_users(t), list(RATE_METRICS), ["customer_segment"])))


# --- values -------------------------------------------------------------------------------

def value_rows(users: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """metric, group, value without NULLs."""
    return users.select("group", *metrics).unpivot(
        ["group"], list(metrics), "metric", "value").where("value IS NOT NULL")


def continuous_stats(rows: DataFrame) -> DataFrame:
    """Sizes, means and variances of both arms per metric."""
    sums = []
    for side, arm in (("c", CONTROL), ("t", TREATMENT)):
        value = F.when(_arm(arm), F.col("value"))
        sums += [F.count(value).alias(f"n_{side}"), F.avg(value).alias(f"mean_{side}"),
                 F.var_samp(value).alias(f"var_{side}")]
    return rows.groupBy("metric").agg(*sums).where("n_c > 0 AND n_t > 0")


def power_continuous(effect: Column, n_c: Column, n_t: Column, alpha: float = 0.05) -> Column:
    """alpha below the critical effect, else the normal power; within 0 and 1."""
    z = z_value(1 - alpha / 2)
    root = F.sqrt(n_c * n_t / (n_c + n_t) / 2)
    size = F.abs(effect)
    value = F.when(size > F.lit(z) / root, normal_cdf(root * size - z)).otherwise(alpha)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def welch(stats: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Everything about the mean difference that needs no t distribution.

    ``df_interval`` (n1 + n2 - 2) serves the interval, ``df_welch`` the p-value.
    """
    d = lambda c: F.col(c).cast("double")
    n_c, n_t, v_c, v_t = d("n_c"), d("n_t"), d("var_c"), d("var_t")
    lift = F.col("mean_t") - F.col("mean_c")
    a, b = v_c / n_c, v_t / n_t
    se = F.sqrt(a + b)
    pooled = F.sqrt(F.try_divide((n_c - 1) * v_c + (n_t - 1) * v_t, n_c + n_t - 2))
    effect = F.when(pooled > 0, lift / pooled).otherwise(0.0)
    df = F.try_divide((a + b) * (a + b), a * a / (n_c - 1) + b * b / (n_t - 1))
    return stats.select(
        "metric", F.col("mean_c").alias("control_value"), F.col("mean_t").alias("treatment_value"),
        lift.alias("lift"),
        F.when(F.col("mean_c") > 0, lift / F.col("mean_c") * 100).otherwise(0.0).alias("lift_pct"),
        F.try_divide(lift, se).alias("t_stat"), se.alias("se"), df.alias("df_welch"),
        (n_c + n_t - 2).alias("df_interval"), effect.alias("effect_size"),
        power_continuous(effect, n_c, n_t, alpha).alias("statistical_power"),
        F.col("n_c").alias("sample_size_control"), F.col("n_t").alias("sample_size_treatment"))


def ab_continuous_welch(t: Tables) -> DataFrame:
    rows = value_rows(ab_users(t, "response"), list(VALUE_METRICS))
    return rounded(welch(continuous_stats(rows)))


def welch_test(stats: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Welch statistics with p-value and interval."""
    return welch(stats, alpha).withColumns({
        "p_value": t_p_value("t_stat", "df_welch"),
        "margin": t_quantile(alpha, "df_interval") * F.col("se"),
    })


def ab_welch_p(t: Tables) -> DataFrame:
    rows = value_rows(ab_users(t, "response"), list(VALUE_METRICS))
    tested = welch_test(continuous_stats(rows)).withColumns({
        "ci_lower": F.col("lift") - F.col("margin"), "ci_upper": F.col("lift") + F.col("margin"),
        "is_significant": F.col("p_value") < 0.05})
    return rounded(tested.drop("margin"))


EXACT_ARM = 10  # up to this size of both arms, untied values are tested by the exact law


def rank_sum_ways(n: Column, total: Column) -> Column:
    """For s = 0 .. n * total: in how many ways n of the ranks 1 .. total add up to s.

    Rank after rank is either left out or taken, so the ways for j ranks and sum s grow by those for
    j - 1 ranks and sum s - rank.
    """
    length = (n * total + 1).cast("int")
    first = F.transform(F.sequence(F.lit(0), n.cast("int")), lambda j: F.transform(
        F.sequence(F.lit(0), length - 1), lambda s: F.when((j == 0) & (s == 0), 1.0).otherwise(0.0)))

    def take(ways: Column, rank: Column) -> Column:
        return F.transform(ways, lambda row, j: F.transform(row, lambda v, s: F.when(
            (j > 0) & (s >= rank), v + F.get(F.get(ways, j - 1), s - rank)).otherwise(v)))

    return F.aggregate(F.sequence(F.lit(1), total.cast("int")), first, take, lambda ways: F.get(ways, n.cast("int")))


def exact_rank_sum_p(n_t: Column, n_c: Column, u: Column) -> Column:
    """Two-sided p-value: twice the share of splits whose U is at least the larger U, at most 1."""
    ways = rank_sum_ways(n_t, n_t + n_c)
    least = F.greatest(u, n_t * n_c - u) + n_t * (n_t + 1) / 2

    def share(found: Column) -> Column:
        def add(a, v):
            return a + v

        upper = F.aggregate(F.slice(found, least.cast("int") + 1, F.size(found)), F.lit(0.0), add)
        return upper / F.aggregate(found, F.lit(0.0), add)

    # the ways are worked out once and handed on
    return F.least(F.lit(1.0), 2 * F.get(F.transform(F.array(ways), share), 0))


def mann_whitney(rows: DataFrame) -> DataFrame:
    """Two-sided rank-sum test per metric from distributed average ranks.

    Untied values in arms of at most ``EXACT_ARM`` are tested by the exact law of U, all others by
    its normal approximation with corrections for ties and continuity.
    """
    ranked = ranked_values(
        rows, ["metric"], "value", {"treated": F.count_if(_arm(TREATMENT))})
    n = F.col("n").cast("double")
    agg = ranked.groupBy("metric").agg(
        F.sum("treated").cast("double").alias("n_t"), F.sum("n").cast("double").alias("n_all"),
        F.sum(F.col("treated") * (F.col("before") + (n + 1) / 2)).alias("rank_sum"),
        F.sum(n * n * n - n).alias("ties"))
    n_t, n_all = F.col("n_t"), F.col("n_all")
    n_c = n_all - n_t
    u = F.col("rank_sum") - n_t * (n_t + 1) / 2
    sigma = F.sqrt(n_t * n_c / 12 * (n_all + 1 - F.try_divide(
        F.col("ties"), n_all * (n_all - 1))))
    high = F.greatest(u, n_t * n_c - u)
    z = F.try_divide(high - n_t * n_c / 2 - 0.5, sigma)
    exact_law = (F.col("ties") == 0) & (F.greatest(n_t, n_c) <= EXACT_ARM)
    return agg.where("n_t > 0 AND n_t < n_all").select(
        "metric", u.alias("u_statistic"), z.alias("z_score"),
        F.when(exact_law, exact_rank_sum_p(n_t, n_c, u))
        .otherwise(F.least(F.lit(1.0), 2 * normal_cdf(-z))).alias("p_value"),
        n_c.cast("long").alias("sample_size_control"),
        n_t.cast("long").alias("sample_size_treatment"))


def ab_rank_sum_by_week(t: Tables) -> DataFrame:
    """The rank-sum test of bet sizes within each signup week, whose arms may be small."""
    week = F.date_format(F.date_trunc("week", "signup_date"), "yyyy-MM-dd")
    weeks = t.customers.select("customer_id", week.alias("metric"))
    rows = ab_users(t, "response").join(weeks, "customer_id").select(
        "metric", "group", F.col("avg_bet_size").alias("value")).where("value IS NOT NULL")
    return rounded(mann_whitney(rows).withColumnRenamed("metric", "signup_week"))


def ab_mann_whitney(t: Tables) -> DataFrame:
    return rounded(mann_whitney(value_rows(ab_users(t, "response"), list(VALUE_METRICS))))


POISSON_TABLE = 64  # up to this mean, counts come from a table of the exact law
_MATRIX = 1000  # values whose draws for all replicates are held at a time


def poisson_bounds(mean: int) -> list[float]:
    """Cumulative probabilities of 0, 1, ... until no double is left below 1."""
    term, total, out = math.exp(-mean), 0.0, []
    while total + term > total or len(out) < mean:
        total += term
        out.append(total)
        term *= mean / len(out)
    return out


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 32 bits that spreads every bit of its argument."""
    x = (x ^ (x >> np.uint64(16))) * np.uint64(0x7FEB352D) & np.uint64(0xFFFFFFFF)
    x = (x ^ (x >> np.uint64(15))) * np.uint64(0x846CA68B) & np.uint64(0xFFFFFFFF)
    return x ^ (x >> np.uint64(16))


def poisson_draws(n: np.ndarray, key: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson counts with means ``n``, a row a value and a column a replicate.

    Draw (value, replicate) is a function of the value's 64-bit key and the replicate's number, so
    there is no generator to carry on.
    """
    high, low = key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)
    counter = np.arange(replicates, dtype=np.uint64)
    bits = scrambled(scrambled(counter[None] ^ high[:, None]) ^ low[:, None])
    u = (bits.astype(float) + 0.5) / 2.0**32
    out = np.empty(u.shape)
    for mean in np.unique(n[n <= POISSON_TABLE]):
        rows = n == mean
        out[rows] = np.searchsorted(poisson_bounds(int(mean)), u[rows], "right")
    large = np.flatnonzero(n > POISSON_TABLE)
    if len(large):  # the normal law, whose error in a sum of many is far below the draws' own
        m = n[large, None].astype(float)
        out[large] = np.maximum(np.floor(m + np.sqrt(m) * normal_points(u[large]) + 0.5), 0)
    return out


def bootstrap_replicates(rows: DataFrame, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """Poisson bootstrap sums: metric, group, replicate, rows drawn, sum drawn.

    A resample of n equal values is a Poisson(n) count, so equal values are merged first
    and each distinct value draws one count per replicate, keyed by the value to six digits:
    a lost task recomputes exactly the same draws. Batches are matrices; tasks emit only
    their own totals, ``replicates`` rows per metric and arm.
    """
    value = F.col("value").cast("double")
    text = F.concat_ws("|", F.lit(str(seed)), "metric", "group", F.round(value * 1e6).cast("long"))
    half = [F.conv(F.substring(F.md5(text), k, 8), 16, 10).cast("long") for k in (1, 9)]
    distinct = rows.groupBy("metric", "group", value.alias("value")).agg(
        F.count("*").alias("n")).select("metric", "group", "value", "n", *[
            h.alias(name) for h, name in zip(half, ("high", "low"), strict=True)])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            for arm, part in batch.groupby(["metric", "group"], sort=False):
                total = sums.setdefault(arm, np.zeros((2, replicates)))
                key = (part["high"].to_numpy(np.uint64) << np.uint64(32)) | part["low"].to_numpy(np.uint64)
                n, x = part["n"].to_numpy(), part["value"].to_numpy()
                for k in range(0, len(part), _MATRIX):
                    drawn = poisson_draws(n[k:k + _MATRIX], key[k:k + _MATRIX], replicates)
                    total += np.stack([np.ones(len(drawn)), x[k:k + _MATRIX]]) @ drawn
        for (metric, group), total in sums.items():
            yield pd.DataFrame({"metric": metric, "group": group,
                                "replicate": np.arange(replicates),
                                "drawn": total[0], "total": total[1]})

    parts = distinct.mapInPandas(
        draw, "metric string, group string, replicate int, drawn double, total double")
    return parts.groupBy("metric", "group", "replicate").agg(
        F.sum("drawn").alias("drawn"), F.sum("total").alias("total"))


def bootstrap_margin(rows: DataFrame, alpha: float = 0.05, replicates: int = 1000) -> DataFrame:
    """Half the width of the percentile interval of the mean difference."""
    means = bootstrap_replicates(rows, replicates).groupBy("metric", "replicate").agg(*[
        F.sum(F.when(_arm(arm), F.try_divide("total", "drawn"))).alias(side)
        for side, arm in (("c", CONTROL), ("t", TREATMENT))])
    diff = F.col("t") - F.col("c")
    return means.groupBy("metric").agg(
        F.count("*").alias("replicates"), F.avg(diff).alias("mean_difference"),
        ((F.percentile(diff, F.lit(1 - alpha / 2)) - F.percentile(diff, F.lit(alpha / 2))) / 2)
        .alias("margin"))


def ab_bootstrap_ci(t: Tables) -> DataFrame:
    rows = value_rows(ab_users(t, "response"), list(VALUE_METRICS))
    lift = welch(continuous_stats(rows)).select("metric", "lift")
    return rounded(lift.join(bootstrap_margin(rows), "metric").select(
        "metric", "lift", "replicates", "mean_difference", "margin",
        (F.col("lift") - F.col("margin")).alias("ci_lower"),
        (F.col("lift") + F.col("margin")).alias("ci_upper")))


LEAST_FOR_NORMALITY = 5


def normality_gate(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per metric: may the means be compared by t test?

    The Shapiro-Francia test of each arm with Royston's p-value: the squared correlation of the ordered
    values with normal scores, the same rule at every size. Ranks are exact and distributed; equal
    values share the score of their mean rank. An arm without spread or with fewer than
    ``LEAST_FOR_NORMALITY`` values is not normal.
    """
    plain = rows.select("metric", "group", F.col("value").cast("double").alias("value"))
    ranked = ranked_values(plain, ["metric", "group"], "value")
    rank = F.col("before") + (F.col("n") + 1) / 2
    score = normal_quantile((rank - 0.375) / (F.col("total") + 0.25))
    centre = plain.groupBy("metric", "group").agg(F.avg("value").alias("mean"))
    gap, many = F.col("value") - F.col("mean"), F.col("n")
    sums = ranked.withColumn("score", score).join(centre, ["metric", "group"]).groupBy("metric", "group").agg(
        F.sum("n").alias("n"), F.sum(many * F.col("score") * gap).alias("xy"),
        F.sum(many * F.col("score") * F.col("score")).alias("yy"), F.sum(many * gap * gap).alias("xx"))
    fits = (F.col("n") >= LEAST_FOR_NORMALITY) & (F.col("xx") > 0)
    w = F.when(fits, F.col("xy") * F.col("xy") / (F.col("xx") * F.col("yy")))
    u = F.log(F.col("n").cast("double"))
    # fixed values: Royston's mean and deviation of log(1 - W)
    mean = -1.2725 + 1.0521 * (F.log(u) - u)
    spread = 1.0308 - 0.26758 * (F.log(u) + 2 / u)
    z = F.when(F.col("w").isNotNull(), (
        mean - F.log(F.greatest(1 - F.col("w"), F.lit(1e-300)))) / spread)
    tested = sums.withColumn("w", w).withColumn("z", z).withColumn("p", normal_cdf("z"))
    wide = tested.groupBy("metric").agg(*[
        F.max(F.when(_arm(arm), F.col(c))).alias(f"{name}_{arm}")
        for arm in (CONTROL, TREATMENT)
        for name, c in (("sample_size", "n"), ("w", "w"), ("p", "p"))])
    normal = (F.col("p_control") > alpha) & (F.col("p_treatment") > alpha)
    return wide.where("sample_size_control > 0 AND sample_size_treatment > 0").select(
        "metric", "sample_size_control", "sample_size_treatment", "w_control", "p_control",
        "w_treatment", "p_treatment", F.coalesce(normal, F.lit(False)).alias("is_normal"))


def ab_normality_gate(t: Tables) -> DataFrame:
    rows = value_rows(ab_users(t, "response"), list(VALUE_METRICS))
    return rounded(normality_gate(rows))


# --- whole campaign -----------------------------------------------------------------------

RESULT_COLUMNS = ["metric", "control_value", "treatment_value", "lift", "lift_pct", "p_value",
                  "ci_lower", "ci_upper", "is_significant", "statistical_power", "effect_size",
                  "sample_size_control", "sample_size_treatment"]


def campaign_analysis(users: DataFrame, alpha: float = 0.05, replicates: int = 1000) -> DataFrame:
    """All tests whose metric column exists, one result row per metric.

    Value metrics take the t test where the normality gate holds, else the rank-sum test
    with a bootstrap interval.
    """
    rates = [m for m in RATE_METRICS if m in users.columns]
    values = [m for m in VALUE_METRICS if m in users.columns]
    parts = []
    if rates:
        parts.append(conversion_test(rate_counts(users, rates), alpha).select(*RESULT_COLUMNS))
    if values:
        rows = value_rows(users, values)
        stats = continuous_stats(rows)
        gate = normality_gate(rows).select("metric", "is_normal")
        ranks = mann_whitney(rows).select("metric", F.col("p_value").alias("p_ranks"))
        boot = bootstrap_margin(rows, alpha, replicates).select(
            "metric", F.col("margin").alias("margin_boot"))
        chosen = welch_test(stats, alpha).join(gate, "metric").join(ranks, "metric", "left").join(
            boot, "metric", "left")
        pick = lambda a, b: F.when(F.col("is_normal"), F.col(a)).otherwise(F.col(b))
        margin = pick("margin", "margin_boot")
        parts.append(chosen.withColumns({
            "p_value": pick("p_value", "p_ranks"), "ci_lower": F.col("lift") - margin,
            "ci_upper": F.col("lift") + margin,
        }).withColumn("is_significant", F.col("p_value") < alpha).select(*RESULT_COLUMNS))
    result = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    names = F.create_map(*[F.lit(x) for kv in {**RATE_METRICS, **VALUE_METRICS}.items()
                           for x in kv])
    return result.withColumn("metric_name", names[F.col("metric")])


def ab_campaign_analysis(t: Tables) -> DataFrame:
    return rounded(campaign_analysis(ab_users(t)))


def report(results: DataFrame) -> DataFrame:
    """Results as formatted text."""
    four = lambda c: F.format_string("%.4f", F.col(c))
    return results.select(
        F.col("metric_name").alias("Metric"), four("control_value").alias("Control"),
        four("treatment_value").alias("Treatment"), four("lift").alias("Lift"),
        F.format_string("%.2f%%", "lift_pct").alias("Lift %"), four("p_value").alias("P-Value"),
        F.when(F.col("is_significant"), "✓").otherwise("✗").alias("Significant"),
        four("ci_lower").alias("CI Lower"), four("ci_upper").alias("CI Upper"),
        four("effect_size").alias("Effect Size"),
        F.format_string("%.2f", "statistical_power").alias("Statistical Power"),
        F.col("sample_size_control").alias("Sample Size (C)"),
        F.col("sample_size_treatment").alias("Sample Size (T)"))


def ab_report(t: Tables) -> DataFrame:
    return report(campaign_analysis(ab_users(t)))


def campaign_roi(stats: DataFrame, cost: float = 15.0) -> DataFrame:
    """Return on a per-customer cost from the lift in lifetime value."""
    lift = F.col("mean_t") - F.col("mean_c")
    return stats.where("metric = 'customer_ltv'").select(
        lift.alias("ltv_lift"), F.lit(cost).alias("campaign_cost"),
        ((lift - cost) / cost * 100).alias("roi_percent"))


def ab_campaign_roi(t: Tables) -> DataFrame:
    rows = value_rows(ab_users(t, "response"), ["customer_ltv"])
    return rounded(campaign_roi(continuous_stats(rows)))


def ab_power(t: Tables) -> DataFrame:
    """Power of the value tests for a grid of effect sizes at the arms' actual sizes."""
    rows = value_rows(ab_users(t, "response"), list(VALUE_METRICS))
    grid = continuous_stats(rows).withColumn(
        "effect", F.explode(F.array(*[F.lit(x) for x in (0.02, 0.05, 0.1, 0.2, 0.5, 1.0)])))
    d = lambda c: F.col(c).cast("double")
    return rounded(grid.select(
        "metric", "effect", F.col("n_c").alias("sample_size_control"),
        F.col("n_t").alias("sample_size_treatment"),
        power_continuous(F.col("effect"), d("n_c"), d("n_t")).alias("statistical_power")))
