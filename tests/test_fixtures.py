"""Hand-computed cases, one per decision about semantics."""

import math

import pytest
from conftest import rows

from marketlens.operators import advanced, attribution, bi, cohorts, dashboard, features, kpis, written


def customer(cid="a", signup="2024-01-01", channel="organic", segment="casual", cost=0, **more):
    return dict(customer_id=cid, signup_date=signup, acquisition_channel=channel,
                customer_segment=segment, acquisition_cost=cost, **more)


def bet(i, cid="a", at="2024-01-10", amount=5, payout=0, sport="x", won=False):
    return dict(bet_id=str(i), customer_id=cid, bet_date=at, bet_amount=amount, payout=payout,
                net_result=payout - amount, sport=sport, bet_won=won)


def tx(i, cid="a", at="2024-01-05", amount=10, kind="deposit", first=False):
    return dict(transaction_id=str(i), customer_id=cid, transaction_date=at, amount=amount,
                transaction_type=kind, is_first_deposit=first)


def test_fanout(make_tables):
    t = make_tables(customers=[customer()], transactions=[tx(1), tx(2)],
                    betting_activity=[bet(i) for i in range(3)])
    right = rows(kpis.customer_ltv(t))[0]
    assert (right["total_deposits"], right["total_wagered"], right["total_bets"]) == (20, 15, 3)
    naive = rows(written.customer_ltv(t))[0]
    assert (naive["total_deposits"], naive["total_wagered"], naive["total_bets"]) == (60, 30, 6)


def test_month_offset(make_tables):
    t = make_tables(customers=[customer()], betting_activity=[
        bet(1, at="2025-03-02"), bet(2, at="2023-11-02")])
    assert {r["months_since_signup"] for r in rows(cohorts.cohort_retention(t))} == {14, -2}
    assert {r["months_since_signup"] for r in rows(written.cohort_retention(t))} == {2, -2}
    assert {r["period_number"] for r in rows(cohorts.retention_cohorts(t))} == {14}


def test_activity_of_bettors(make_tables):
    t = make_tables(customers=[customer()], betting_activity=[bet(1, at="2024-02-02")],
                    transactions=[tx(1, at="2024-03-03")])
    assert {r["months_since_signup"] for r in rows(cohorts.cohort_retention(t))} == {1, 2}
    assert {r["months_since_signup"] for r in rows(written.cohort_retention(t))} == {1}


def test_first_bet_tie(make_tables):
    t = make_tables(customers=[customer()], betting_activity=[
        bet(1, amount=7), bet(2, amount=5), bet(3, at="2024-01-11", amount=1)])
    assert rows(advanced.customer_journey_milestones(t))[0]["first_bet_amount"] == 5


def journey(make_tables, *touches, deposit="2024-06-01"):
    """Touches after the acquisition through channel A on day 0."""
    days = "2024-01-01"
    campaigns, sends = [], []
    for i, (channel, day) in enumerate(touches):
        campaigns.append(dict(campaign_id=f"c{i}", campaign_name="n", campaign_type=channel,
                              start_date=day, end_date=day))
        sends.append(dict(customer_id="a", campaign_id=f"c{i}", sent_date=day, responded=True,
                          campaign_cost=1))
    return make_tables(customers=[customer(signup=days, channel="A")], campaigns=campaigns,
                       customer_campaigns=sends,
                       transactions=[tx(1, at=deposit, first=True)] if deposit else [])


def credit(t, model):
    return {c: r["attributed_conversions"] for c, r in
            rows(attribution.attributed_conversions(t, model), "channel").items()}


def test_position_based(make_tables):
    assert credit(journey(make_tables), "position_based") == {"A": 1.0}
    two = journey(make_tables, ("B", "2024-01-02"))
    assert credit(two, "position_based") == {"A": 0.5, "B": 0.5}
    same = journey(make_tables, ("A", "2024-01-02"))
    assert credit(same, "position_based") == {"A": 1.0}
    four = journey(make_tables, ("B", "2024-01-02"), ("C", "2024-01-03"), ("A", "2024-01-04"))
    assert credit(four, "position_based") == pytest.approx({"A": 0.8, "B": 0.1, "C": 0.1})
    assert credit(four, "linear") == pytest.approx({"A": 0.5, "B": 0.25, "C": 0.25})
    assert credit(four, "last_click") == {"A": 1.0}


def test_time_decay(make_tables):
    t = journey(make_tables, ("B", "2024-01-08"))
    assert credit(t, "time_decay") == pytest.approx({"A": 1 / 3, "B": 2 / 3}, abs=1e-6)


def test_unknown_model(make_tables):
    with pytest.raises(ValueError, match="Unknown model"):
        attribution.attributed_conversions(journey(make_tables), "best")


def test_journey_window(make_tables):
    # day 90 after 2024-01-01 is 2024-03-31
    t = journey(make_tables, ("B", "2024-03-31"), ("C", "2024-04-01"), deposit=None)
    got = rows(attribution.journeys(t))[0]
    assert got["num_touchpoints"] == 2 and not got["converted"]
    assert [p["channel"] for p in got["touchpoints"]] == ["A", "B"]


def test_no_conversions_is_empty(make_tables):
    t = journey(make_tables, deposit=None)
    assert rows(attribution.compare_models(t)) == []


def test_score_edges(spark):
    days = spark.createDataFrame(
        [(d,) for d in (7, 8, 30, 31, 90, 91, 180, 181, None)], "d int")
    assert [r[0] for r in days.select(kpis.recency_score("d")).collect()] == [
        5, 4, 4, 3, 3, 2, 2, 1, 1]
    wagered = spark.createDataFrame(
        [(w,) for w in (9.99, 10.0, 100.0, 500.0, 1000.0, 5000.0)], "w double")
    assert [r[0] for r in wagered.select(kpis.monetary_score("w")).collect()] == [0, 1, 2, 3, 4, 5]
    bets = spark.createDataFrame([(b,) for b in (0, 1, 5, 20, 50, 100)], "b int")
    assert [r[0] for r in bets.select(kpis.frequency_score("b")).collect()] == [0, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("bets,scores,expected", [
    (0, (5, 5, 5), "Non-Gambler"), (1, (4, 4, 4), "Champion"), (1, (3, 3, 5), "Loyal Customer"),
    (1, (4, 2, 3), "New Customer"), (1, (2, 4, 4), "Big Spender"), (1, (2, 3, 2), "At Risk"),
    (1, (1, 2, 2), "Lost Customer"), (1, (3, 3, 2), "Low Value"), (1, (3, 2, 3), "Regular"),
])
def test_behavioral_segments(spark, bets, scores, expected):
    row = spark.createDataFrame(
        [(bets, *scores)],
        "total_bets int, recency_score int, frequency_score int, monetary_score int")
    assert row.select(kpis.behavioral_segment()).first()[0] == expected


def test_never_active(make_tables):
    t = make_tables(customers=[customer()])
    got = rows(cohorts.churn_by_cohort(t))[0]
    assert (got["churned_customers"], got["never_active_customers"], got["active_rate"]) == (1, 1, 0)
    assert rows(advanced.churn_features(t))[0]["is_churned"] is None


def test_campaign_edges(make_tables):
    """Windows include their first and last midnight, so neighbours overlap there."""
    t = make_tables(
        customers=[customer()],
        campaigns=[dict(campaign_id="c", campaign_name="c", campaign_type="vip",
                        start_date="2024-02-01", end_date="2024-02-10")],
        customer_campaigns=[dict(customer_id="a", campaign_id="c", sent_date="2024-02-01",
                                 responded=True, bonus_claimed=False, campaign_cost=1)],
        betting_activity=[bet(1, at="2024-02-01"), bet(2, at="2024-02-10"),
                          bet(3, at="2024-02-10T00:00:01"), bet(4, at="2024-03-11"),
                          bet(5, at="2024-03-11T00:00:01"), bet(6, at="2024-01-02")])
    got = rows(advanced.campaign_windows(t))[0]
    assert (got["pre_bets"], got["during_bets"], got["post_bets"]) == (2, 2, 3)
    assert rows(kpis.campaign_performance(t))[0]["revenue_ggr"] == 20


def test_zero_guards(make_tables):
    t = make_tables(
        customers=[customer(cost=3, channel="affiliate")],
        campaigns=[dict(campaign_id="c", campaign_name="c", campaign_type="vip",
                        start_date="2024-02-01", end_date="2024-02-10")])
    campaign = rows(kpis.campaign_performance(t))[0]
    assert campaign["customers_targeted"] == 0 and campaign["response_rate_pct"] is None
    assert rows(dashboard.channel_performance(t))[0]["cpa"] == 0
    assert rows(kpis.acquisition_cost(t))[0]["cost_per_acquisition_cpa"] is None


def test_features_of_one_bet(make_tables):
    t = make_tables(customers=[customer()], betting_activity=[bet(1)])
    got = rows(features.feature_matrix(t))[0]
    assert got["bet_size_std"] == 0.0 and got["days_since_last_transaction"] == got["tenure_days"]
    assert rows(advanced.churn_features(t))[0]["bet_size_variance"] is None


def test_mode_tie_and_deposit_order(make_tables):
    t = make_tables(
        customers=[customer()],
        betting_activity=[bet(i, sport=s) for i, s in enumerate("baab")],
        transactions=[tx(1, at="2024-03-01", amount=99), tx(2, at="2024-02-01", amount=7)])
    got = rows(features.feature_matrix(t))[0]
    assert got["favorite_sport"] == "a" and got["first_deposit_amount"] == 7


def test_segment_list(make_tables):
    t = make_tables(
        customers=[customer("a"), customer("b", segment="whale"),
                   customer("c", segment="whale", signup="2024-05-01")],
        campaigns=[dict(campaign_id="c", campaign_name="c", campaign_type="retention",
                        start_date="2024-02-01", end_date="2024-02-10",
                        target_segments="regular,whale")])
    assert [r["customer_id"] for r in rows(dashboard.campaign_audience(t))] == ["b"]


def test_value_segments_and_filters(make_tables):
    t = make_tables(
        customers=[customer("a"), customer("b", channel="affiliate")],
        betting_activity=[bet(1, amount=100), bet(2, cid="b", amount=1000)])
    assert {r["customer_id"]: r["value_segment"] for r in rows(bi.customer_lod(t))} == {
        "a": "Low Value", "b": "Medium Value"}
    kept = dashboard.filter_customers(t, channel="affiliate", segment="All")
    assert rows(dashboard.overview_kpis(kept))[0]["total_wagered"] == 1000
    assert math.isclose(rows(bi.daily_monitor(t))[0]["target_achievement"], 0 + 1100 / 500)


def test_multiplied_counts_pass_the_range_of_bigint(spark):
    from marketlens.plans.fanout import copies

    row = spark.createDataFrame([(3_000_000, 3_000_000, 3_000_000)], "a long, b long, c long")
    assert int(row.select(copies("a", "b", "c").alias("w")).first()["w"]) == 27 * 10**18


def test_cohort_in_period_100(make_tables):
    t = make_tables(customers=[customer()], betting_activity=[bet(1, at="2032-05-02"), bet(2)])
    line = rows(cohorts.retention_rows(t))[0]["rates"].split(",")
    assert len(line) == 101 and line[0] == line[100] == "1.000000" and set(line[1:100]) == {"0.000000"}
    assert "period_100" in cohorts.retention_matrix(t).columns
