"""Files, views and models."""

import json
import pathlib

import pytest
from conftest import SMALL, rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from marketlens import views
from marketlens.operators import kpis, models
from marketlens.sources import files
from marketlens.sources.adapter import AS_OF, from_testdata


@pytest.fixture(scope="module")
def tables(spark):
    return from_testdata(spark, SMALL)


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    files.write_tables(tables, folder)
    return folder


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_round_trip(spark, tables, tmp_path, format):
    files.write_tables(tables, str(tmp_path), format)
    again = files.load_tables(spark, str(tmp_path), AS_OF, format)
    for name in again.NAMES:
        assert getattr(again, name).count() == getattr(tables, name).count()
    key = lambda df: sorted(map(str, df.collect()))
    assert key(kpis.acquisition_cost(again)) == key(kpis.acquisition_cost(tables))
    assert key(kpis.customer_ltv(again)) == key(kpis.customer_ltv(tables))


def test_csv_is_read_by_header(spark, tmp_path):
    (tmp_path / "customers.csv").write_text(
        "acquisition_channel,customer_id,signup_date,email_verified,extra\n"
        "organic,c1,2024-03-01,True,9\n")
    got = files.read_table(spark, str(tmp_path), "customers").first()
    assert (got["customer_id"], got["acquisition_channel"], got["email_verified"]) == (
        "c1", "organic", True)
    assert got["acquisition_cost"] == 0 and got["age"] is None


def test_missing_input_raises(spark, tmp_path):
    with pytest.raises(AnalysisException):
        files.load_tables(spark, str(tmp_path), AS_OF).customers.count()


def test_date_filters_reach_the_scan(spark, stored):
    t = files.load_tables(spark, stored, AS_OF, "parquet")
    from marketlens.operators.bi import daily_aggregate

    plan = daily_aggregate(t, years=1)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(bet_date" in plan
    scan = next(line for line in plan.splitlines() if "ReadSchema" in line and "bet_date" in line)
    assert "odds" not in scan and "session_id" not in scan


def test_dictionary_and_incremental_aggregate(spark, tables, tmp_path):
    files.write_data_dictionary(tables, str(tmp_path))
    part = next(pathlib.Path(tmp_path, "data_dictionary.json").glob("part-*.json"))
    found = json.loads(part.read_text())
    assert found["channels"] == ["affiliate", "organic", "paid_search", "social_media"]
    files.write_daily_aggregate(tables, str(tmp_path / "daily"))
    before = spark.read.parquet(str(tmp_path / "daily")).agg(F.sum("bets"), F.count("*")).first()
    files.write_daily_aggregate(tables, str(tmp_path / "daily"), years=1)
    assert spark.read.parquet(str(tmp_path / "daily")).agg(
        F.sum("bets"), F.count("*")).first() == before


def test_views(spark, tables):
    views.register(tables)
    assert spark.sql("SELECT count(*) FROM v_customer_ltv_analysis").first()[0] == 150
    top = spark.sql("SELECT * FROM v_ltv_summary ORDER BY avg_ltv DESC LIMIT 3").collect()
    assert len(top) == 3


def test_models(spark, stored, tmp_path):
    t = files.load_tables(spark, stored, AS_OF, "parquet")
    trained = {k: models.train(t, k, trees=5, rounds=3) for k in models.KINDS}
    for kind, result in trained.items():
        assert not set(result.features) & set(models.LEAKS[kind])
        if result.best:
            assert set(result.metrics) == set(result.models) and len(result.models) == 4
    best = {k: r.best_model for k, r in trained.items() if r.best}
    assert "ltv" in best
    scores = models.risk_scores(t, best).orderBy("customer_id").collect()
    assert len(scores) == 150
    for r in scores:
        assert r["churn_probability"] is None or 0 <= r["churn_probability"] <= 1
        assert 0 <= r["conversion_probability"] <= 1
    models.save_models(best, str(tmp_path))
    loaded = models.load_models(str(tmp_path), list(best))
    assert models.risk_scores(t, loaded).orderBy("customer_id").collect() == scores
    some = t.customers.limit(3)
    assert models.risk_scores(t, best, some).count() == 3


def test_customer_without_age_is_scored(spark, tables):
    from marketlens.plans.tables import Tables

    people = tables.customers.withColumn("age", F.when(
        F.col("customer_id") > "CU_000000000010", F.col("age")))
    frames = {n: getattr(tables, n) for n in Tables.NAMES if n != "customers"}
    t = Tables(tables.as_of, customers=people, **frames)
    trained = {k: models.train(t, k, trees=3, rounds=2) for k in models.KINDS}
    assert "age_missing" in trained["churn"].features
    scores = models.risk_scores(t, {k: r.best_model for k, r in trained.items() if r.best})
    assert scores.count() == scores.select("customer_id").distinct().count() == people.count()


def test_adapter_reads_whole_tables(spark, tables):
    assert tables.transactions.count() == spark.read.parquet(f"{SMALL}/orders.parquet").count()
    assert tables.betting_activity.count() == spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert tables.campaigns.count() == spark.read.parquet(f"{SMALL}/nation.parquet").count()


def test_attribution_parameters(tables):
    from marketlens.operators import attribution

    even = {r["channel"]: r["attributed_conversions"] for r in attribution.attributed_conversions(
        tables, "time_decay", half_life=1e12).collect()}
    linear = {r["channel"]: r["attributed_conversions"] for r in attribution.attributed_conversions(
        tables, "linear").collect()}
    assert even == pytest.approx(linear, abs=1e-4)
    ends = attribution.attributed_conversions(tables, "position_based", first=1.0, last=0.0)
    first = attribution.attributed_conversions(tables, "first_touch")
    key = lambda df: {r["channel"]: r["attributed_conversions"] for r in df.collect()
                      if r["attributed_conversions"]}
    assert key(ends) == pytest.approx(key(first), abs=1e-4)
    a, b = (rows(attribution.compare_models(tables, anchor=x)) for x in attribution.ANCHORS)
    # the anchor scales all touches of a journey alike
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_weights_sum_to_one_and_models_agree(tables):
    from marketlens.operators import attribution

    credit = attribution.credit_cells(tables)
    per = credit.groupBy("customer_id").agg(*[
        F.sum(w()).alias(m) for m, w in attribution.MODELS.items()])
    worst = per.agg(*[F.max(F.abs(F.col(m) - 1)).alias(m) for m in attribution.MODELS]).first()
    assert max(worst) < 1e-9
    totals = rows(attribution.attribution_winners(tables))
    assert len({round(r["total_conversions"], 2) for r in totals}) == 1


def test_trainings_and_scores_share_one_matrix(spark, monkeypatch):
    from marketlens.registry import ModelQueries

    built = []
    whole = models.feature_matrix
    monkeypatch.setattr(models, "feature_matrix", lambda *a: built.append(a) or whole(*a))
    queries = ModelQueries(trees=3, rounds=2)
    assert queries.queries()["risk_scores"](spark, SMALL).count() == 150
    assert queries.queries()["model_comparison"](spark, SMALL).count() > 0
    assert len(built) == 1


def test_many_rows_in_one_part_are_spread(spark):
    from marketlens.functions.rows import spread
    from marketlens.session import checkpoint_dir

    checkpoint_dir(spark)
    one = spark.range(100).coalesce(1).checkpoint()
    assert spread(one, "id").rdd.getNumPartitions() == 1
    wide = spread(one, "id", least=25)
    assert wide.rdd.getNumPartitions() == 4 and sorted(r[0] for r in wide.collect()) == list(range(100))
