"""Distributions against published values, ranks and quantiles against numpy."""

import itertools
import math
import random
from collections import Counter
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlens.functions import stats
from marketlens.functions.ranks import quantiles, ranked_values
from marketlens.operators import abtest


def test_normal_cdf(spark):
    xs = [-38.0, -8.0, -7.07, -3.2, -1.959964, -0.5, 0.0, 0.3, 1.0, 2.5, 7.2, 40.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double")
           .select(stats.normal_cdf("x")).collect()]
    assert got == pytest.approx([NormalDist().cdf(x) for x in xs], abs=1e-14)
    assert stats.z_value(0.975) == pytest.approx(1.959964, abs=1e-6)


@pytest.mark.parametrize("df,critical", [
    (1, 12.7062), (30, 2.0423), (1e6, 1.959966)])
def test_t_distribution(spark, df, critical):
    row = spark.createDataFrame([(float(df), critical)], "df double, t double").select(
        stats.t_quantile(0.05, "df"), stats.t_p_value("t", "df"), stats.t_p_value(-F.col("t"), "df"),
        stats.t_p_value(F.lit(0.0), "df"), stats.t_p_value("t", F.lit(0.0)),
        stats.t_quantile(0.01, "df")).first()
    assert row[0] == pytest.approx(critical, abs=1e-4)
    assert row[1] == row[2] == pytest.approx(0.05, abs=1e-5)
    assert row[3] == 1 and row[4] is None
    back = spark.createDataFrame([(float(df), row[5])], "df double, t double").select(
        stats.t_p_value("t", "df")).first()[0]
    assert back == pytest.approx(0.01, abs=1e-10)


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 7.25, 100.0, 1e6]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(
        stats.log_gamma("x")).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], abs=1e-12, rel=1e-13)


def test_chi_square_point(spark):
    # 3.841 is the 5 % point of chi-square with one degree of freedom
    p = spark.range(1).select(stats.two_sided_normal(F.sqrt(F.lit(3.841459)))).first()[0]
    assert p == pytest.approx(0.05, abs=1e-6)


def test_conversion_example(spark):
    counts = spark.createDataFrame(
        [("m", 2000, 2000, 198, 245)], "metric string, n_c long, n_t long, x_c long, x_t long")
    r = abtest.conversion_test(counts).first()
    assert r["lift"] == pytest.approx(0.0235)
    assert r["chi2"] == pytest.approx(5.371407, abs=1e-6)
    assert r["p_value"] == pytest.approx(0.020469, abs=1e-6) and r["is_significant"]


def test_ranks_and_quantiles_with_a_hot_group(spark):
    random.seed(3)
    data = [("hot", float(random.randrange(400))) for _ in range(3000)]
    data += [(f"g{i % 7}", float(random.randrange(50))) for i in range(500)] + [("one", 4.0)]
    df = spark.createDataFrame(data, "g string, v double")
    wanted = {"low": 0.25, "mid": 0.5, "high": 0.95}
    got = {r["g"]: r for r in quantiles(df, ["g"], "v", wanted).collect()}
    frame = pd.DataFrame(data, columns=["g", "v"])
    for group, values in frame.groupby("g")["v"]:
        for name, p in wanted.items():
            assert got[group][name] == pytest.approx(np.quantile(values, p), abs=1e-5)
    ranked = ranked_values(df, ["g"], "v", buckets=5).toPandas()
    check = frame.groupby("g")["v"].rank(method="min").sub(1).astype(int)
    expected = frame.assign(before=check).drop_duplicates()
    merged = ranked.merge(expected, on=["g", "v"], suffixes=("", "_x"))
    assert len(merged) == len(ranked) and (merged["before"] == merged["before_x"]).all()


def test_mann_whitney_with_ties(spark):
    control, treatment = [1, 2, 2, 3, 5, 5, 8], [2, 3, 5, 7, 8, 9, 9, 10]
    data = [("m", "control", float(v)) for v in control]
    data += [("m", "treatment", float(v)) for v in treatment]
    r = abtest.mann_whitney(
        spark.createDataFrame(data, "metric string, group string, value double")).first()
    ranks = pd.Series(control + treatment).rank()
    n1, n2 = len(treatment), len(control)
    u = ranks[n2:].sum() - n1 * (n1 + 1) / 2
    ties = sum(c**3 - c for c in ranks.value_counts())
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd
    assert r["u_statistic"] == u
    assert r["p_value"] == pytest.approx(2 * (1 - NormalDist().cdf(z)), abs=1e-12)


@pytest.mark.parametrize("n,m", [(1, 1), (3, 5), (10, 10), (10, 11), (2, 10)])
def test_exact_rank_sum_law(spark, n, m):
    """Enumeration up to the bound, the normal approximation beyond it."""
    random.seed(n * 20 + m)
    values = random.sample(range(1000), n + m)
    treated = values[:n]
    data = [("m", "treatment" if k < n else "control", float(v)) for k, v in enumerate(values)]
    r = abtest.mann_whitney(
        spark.createDataFrame(data, "metric string, group string, value double")).first()
    u = sum(a > b for a in treated for b in values[n:])
    assert r["u_statistic"] == u
    if m <= abtest.EXACT_ARM:
        ways = Counter({(0, 0): 1})
        for rank in range(1, n + m + 1):
            for (j, s), c in list(ways.items()):
                ways[j + 1, s + rank] += 0  # the key
            ways = Counter({k: ways[k] + ways.get((k[0] - 1, k[1] - rank), 0) for k in ways})
        least = max(u, n * m - u) + n * (n + 1) // 2
        count = sum(c for (j, s), c in ways.items() if j == n and s >= least)
        assert r["p_value"] == pytest.approx(min(1, 2 * count / math.comb(n + m, n)), abs=1e-12)
    else:
        sd = math.sqrt(n * m * (n + m + 1) / 12)
        z = (max(u, n * m - u) - n * m / 2 - 0.5) / sd
        assert r["p_value"] == pytest.approx(min(1, 2 * (1 - NormalDist().cdf(z))), abs=1e-12)


def test_rank_sum_ways_by_enumeration(spark):
    got = spark.createDataFrame([(3, 7)], "n int, total int").select(
        abtest.rank_sum_ways(F.col("n"), F.col("total"))).first()[0]
    told = Counter(sum(c) for c in itertools.combinations(range(1, 8), 3))
    assert got == [told[s] for s in range(22)]


def test_normal_quantile(spark):
    ps = [1e-12, 1e-5, 0.02, 0.02425, 0.3, 0.5, 0.8, 0.99, 1 - 1e-9]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(
        stats.normal_quantile("p")).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-9, abs=1e-12)


def test_normality_of_an_arm_by_plain_sums(spark):
    random.seed(5)
    arms = {"control": [random.gauss(3, 2) for _ in range(40)],
            "treatment": [float(random.randrange(6)) ** 2 for _ in range(60)]}
    data = [("m", g, v) for g, values in arms.items() for v in values]
    r = abtest.normality_gate(
        spark.createDataFrame(data, "metric string, group string, value double")).first()
    for g, values in arms.items():
        n, x = len(values), np.array(values)
        ranks = pd.Series(values).rank().to_numpy()
        m = np.array([NormalDist().inv_cdf((k - 0.375) / (n + 0.25)) for k in ranks])
        w = (m @ (x - x.mean())) ** 2 / ((m @ m) * ((x - x.mean()) ** 2).sum())
        u = math.log(n)
        z = (math.log(1 - w) - (1.0521 * (math.log(u) - u) - 1.2725)) / (
            1.0308 - 0.26758 * (math.log(u) + 2 / u))
        assert r[f"w_{g}"] == pytest.approx(w) and r[f"p_{g}"] == pytest.approx(1 - NormalDist().cdf(z))
    assert r["p_control"] > 0.05 > r["p_treatment"]


def test_bootstrap_is_repeatable_and_near_theory(spark):
    random.seed(1)
    data = [("m", g, random.gauss(m, 1.0)) for g, m in (("control", 0.0), ("treatment", 1.0))
            for _ in range(400)]
    rows = spark.createDataFrame(data, "metric string, group string, value double")
    first = abtest.bootstrap_margin(rows).first()
    again = abtest.bootstrap_margin(rows.repartition(7)).first()
    assert first["margin"] == pytest.approx(again["margin"], abs=1e-9)
    assert first["margin"] == pytest.approx(1.96 * math.sqrt(2 / 400), rel=0.15)
    means = pd.DataFrame(data, columns=["m", "g", "v"]).groupby("g")["v"].mean()
    assert first["mean_difference"] == pytest.approx(means["treatment"] - means["control"], abs=0.02)


@pytest.mark.parametrize("n", [4999, 5001])
def test_one_normality_rule_at_every_size(spark, n):
    def gate(value):
        rows = spark.range(2 * n).select(
            F.lit("m").alias("metric"),
            F.when(F.col("id") % 2 == 0, "control").otherwise("treatment").alias("group"),
            value.alias("value"))
        return abtest.normality_gate(rows).first()

    flat = gate(F.col("id").cast("double"))
    assert not flat["is_normal"] and flat["sample_size_control"] == n
    # the squared correlation of a uniform arm with normal scores tends to 3 / pi
    assert flat["w_control"] == pytest.approx(3 / math.pi, abs=2e-3)
    constant = gate(F.lit(1.0))
    assert not constant["is_normal"] and constant["w_control"] is None
    bell = gate(sum((F.xxhash64("id", F.lit(k)) / 2.0**64 for k in range(50)), F.lit(0.0)))
    assert bell["p_control"] > 1e-4


@pytest.mark.parametrize("mean", [1, 2, 64, 65, 5000])
def test_poisson_draws(mean):
    """Mean and variance on both sides of the table's bound, and no dependence on the company."""
    r = np.random.default_rng(3)
    key = r.integers(0, 2**63, 400).astype(np.uint64)
    n = np.full(400, mean)
    drawn = abtest.poisson_draws(n, key, 500)
    assert drawn.mean() == pytest.approx(mean, rel=0.01) and drawn.var() == pytest.approx(mean, rel=0.03)
    assert (abtest.poisson_draws(n[7:9], key[7:9], 500) == drawn[7:9]).all()
    assert abs(np.corrcoef(drawn[0], drawn[1])[0, 1]) < 0.2


def test_normal_points():
    ps = np.array([1e-9, 0.01, 0.3, 0.5, 0.9, 1 - 1e-6])
    assert stats.normal_points(ps) == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-7, abs=1e-9)
