"""Names of all registered queries and the projection the driver compares."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from marketlens.operators import (
    abtest, advanced, attribution, audiences, bi, budget, cohorts, dashboard, features, kpis, models, quality, sessions,
    written,
)
from marketlens.plans.tables import Tables
from marketlens.sources.adapter import from_testdata, read_events
from marketlens.streaming import streams

Operator = Callable[[Tables], DataFrame]

OPERATORS: dict[str, Operator] = {
    "acquisition_cost": kpis.acquisition_cost,
    "customer_ltv": kpis.customer_ltv,
    "ltv_summary": kpis.ltv_summary,
    "campaign_performance": kpis.campaign_performance,
    "daily_engagement": kpis.daily_engagement,
    "weekly_trends": kpis.weekly_trends,
    "customer_segmentation": kpis.customer_segmentation,
    "channel_attribution_sql": kpis.channel_attribution,
    "customer_journey_milestones": advanced.customer_journey_milestones,
    "churn_features_sql": advanced.churn_features,
    "campaign_deep_analysis": advanced.campaign_deep_analysis,
    "sports_preference": advanced.sports_preference,
    "daily_timeseries": advanced.daily_timeseries,
    "daily_timeseries_dense": lambda t: advanced.daily_timeseries(t, dense=True),
    "data_quality_summary": quality.data_quality_summary,
    "database_summary": quality.database_summary,
    "dq_primary_key": quality.dq_primary_key,
    "dq_foreign_key": quality.dq_foreign_key,
    "dq_domain": quality.dq_domain,
    "filter_customers": lambda t: dashboard.table_counts(dashboard.filter_customers(
        t, dt.date(1994, 1, 1), dt.date(1995, 6, 30), "paid_search", "All")),
    "overview_kpis": dashboard.overview_kpis,
    "channel_performance": dashboard.channel_performance,
    "daily_metrics": dashboard.daily_metrics,
    "dataset_summary": dashboard.dataset_summary,
    "campaign_audience": dashboard.campaign_audience_sizes,
    "data_dictionary": dashboard.data_dictionary,
    "customer_ltv_as_written": written.customer_ltv,
    "cohort_retention_sql_as_written": written.cohort_retention,
    "campaign_performance_as_written": written.campaign_performance,
    "daily_engagement_as_written": written.daily_engagement,
    "customer_segmentation_as_written": written.customer_segmentation,
    "churn_features_sql_as_written": written.churn_features,
    "campaign_deep_analysis_as_written": written.campaign_deep_analysis,
    "revenue_cohort_sql_as_written": written.revenue_cohort,
    "cohort_retention_sql": cohorts.cohort_retention,
    "revenue_cohort_sql": cohorts.revenue_cohort,
    "retention_cohorts": cohorts.retention_cohorts,
    "retention_cohorts_weekly": lambda t: cohorts.retention_cohorts(t, "weekly"),
    "retention_matrix": cohorts.retention_rows,
    "retention_long": cohorts.retention_long,
    "retention_summary": cohorts.retention_summary,
    "revenue_cohorts": cohorts.revenue_cohorts,
    "revenue_cohorts_weekly": lambda t: cohorts.revenue_cohorts(t, "weekly"),
    "ltv_cohorts": cohorts.ltv_cohorts,
    "churn_by_cohort": cohorts.churn_by_cohort,
    "cohort_overview": cohorts.cohort_overview,
    "bi_heatmap_totals": cohorts.cohort_heatmap_totals,
    "journeys": attribution.journey_paths,
    "attr_last_click": lambda t: attribution.attributed_conversions(t, "last_click"),
    "attr_first_touch": lambda t: attribution.attributed_conversions(t, "first_touch"),
    "attr_linear": lambda t: attribution.attributed_conversions(t, "linear"),
    "attr_time_decay": lambda t: attribution.attributed_conversions(t, "time_decay"),
    "attr_position": lambda t: attribution.attributed_conversions(t, "position_based"),
    "attr_compare": attribution.compare_models,
    "attr_compare_pivot": attribution.compare_pivot,
    "attr_roi": attribution.attribution_roi,
    "attr_winners": attribution.attribution_winners,
    "journey_length": attribution.journey_length,
    "journey_patterns": attribution.journey_patterns,
    "conversion_by_length": attribution.conversion_by_length,
    "time_to_conversion": attribution.time_to_conversion,
    "bi_attr_touch": attribution.campaign_touch_credit,
    "bi_channel_efficiency": attribution.channel_efficiency,
    "bi_journey_flow": attribution.journey_flow,
    "ab_sample_size": abtest.sample_size_plan,
    "ab_conversion": abtest.ab_conversion,
    "ab_continuous_welch": abtest.ab_continuous_welch,
    "ab_welch_p": abtest.ab_welch_p,
    "ab_mann_whitney": abtest.ab_mann_whitney,
    "ab_rank_sum_by_week": abtest.ab_rank_sum_by_week,
    "ab_bootstrap_ci": abtest.ab_bootstrap_ci,
    "ab_power": abtest.ab_power,
    "ab_normality_gate": abtest.ab_normality_gate,
    "ab_campaign_analysis": abtest.ab_campaign_analysis,
    "ab_report": abtest.ab_report,
    "ab_campaign_roi": abtest.ab_campaign_roi,
    "ab_z_test": abtest.ab_z_test,
    "bi_headline": bi.headline,
    "bi_customer_lod": bi.customer_lod,
    "bi_campaign": bi.campaign_measures,
    "bi_monthly": bi.monthly,
    "bi_cohort": bi.cohort,
    "bi_rfm_lifecycle": bi.rfm_lifecycle,
    "bi_daily_monitor": bi.daily_monitor,
    "bi_daily_monitor_dense": lambda t: bi.daily_monitor(t, dense=True),
    "bi_sport_days": bi.sport_days,
    "bi_hourly": bi.hourly,
    "bi_calendar": bi.calendar,
    "bi_stats": bi.series_stats,
    "bi_growth_forecast": bi.growth_forecast,
    "bi_agg_tables": lambda t: bi.daily_aggregate(t, years=2, active_days=365),
    "bi_funnel": bi.funnel,
    "sessionize_bets": sessions.betting_sessions,
    "feature_matrix": features.feature_matrix,
    "target_churn": lambda t: features.target(t, "churn"),
    "target_ltv": lambda t: features.target(t, "ltv"),
    "target_conversion": lambda t: features.target(t, "conversion"),
    "split_80_20": features.split_sizes,
    "classification_report": lambda t: features.classification_report(
        features.inactivity_predictions(t)),
    "roc_pr_curves": lambda t: features.curve_points(features.inactivity_predictions(t)),
    "risk_bands": features.risk_bands,
    "behaviour_clusters": audiences.behaviour_clusters,
    "behaviour_membership": audiences.behaviour_membership,
    "lookalikes": audiences.lookalikes,
    "budget_allocation": budget.budget_allocation,
}

# These read the event table itself rather than the six tables.
EVENT_OPERATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "sessionize_anchored": sessions.event_sessions,
    "sessionize_gap": lambda events: sessions.event_sessions(events, anchored=False),
}


def portable(df: DataFrame) -> DataFrame:
    """Types that mean the same in every engine: bigint, double, string, date, boolean."""
    out = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DecimalType, T.FloatType)):
            column = column.cast("double")
        elif isinstance(kind, T.IntegralType):
            column = column.cast("bigint")
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            column = F.concat_ws(",", column)
        out.append(column.alias(field.name))
    return df.select(*out)


def runner(operator: Operator) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return portable(operator(from_testdata(spark, folder)))

    run.__doc__ = operator.__doc__
    return run


def event_runner(operator: Callable[[DataFrame], DataFrame]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return portable(operator(read_events(spark, folder)))

    return run


# Streams over the event files, driven to their end: all windows and sessions are closed.
STREAMS: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "stream_hourly_kpi": lambda e, f: streams.run_available(streams.hourly_kpis(e), f),
    "stream_rolling": lambda e, f: streams.run_available(streams.rolling_revenue(e), f),
    "stream_sessions": lambda e, f: streams.run_available(streams.gap_sessions(e), f),
    "stream_sessions_anchored": lambda e, f: streams.run_available(
        streams.anchored_sessions(e), f),
    "stream_alerts": streams.revenue_alerts,
}


def stream_runner(start: Callable[[DataFrame, str], DataFrame]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return portable(streams.run_complete(spark, folder, start, "events.parquet"))

    return run


SIDE_BY_SIDE = 200_000  # customers up to whom the kinds of models are trained at the same time


class ModelQueries:
    """Queries over trained models; the three trainings are shared by all of them, and they and the
    scores share one matrix of features."""

    def __init__(self, trees: int = 100, rounds: int = 100):
        self.size = {"trees": trees, "rounds": rounds}
        self.cache: dict[tuple[str, str, str], models.Trained] = {}
        self.matrices: dict[tuple[str, str], DataFrame] = {}

    def matrix(self, spark: SparkSession, folder: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, folder)
        if key not in self.matrices:
            self.matrices[key] = models.shared_matrix(from_testdata(spark, folder))
        return self.matrices[key]

    def trained(self, spark: SparkSession, folder: str, kind: str) -> models.Trained:
        key = (spark.sparkContext.applicationId, folder, kind)
        if key not in self.cache:
            self.cache[key] = models.train(
                from_testdata(spark, folder), kind, matrix=self.matrix(spark, folder), **self.size)
        return self.cache[key]

    def all_trained(self, spark: SparkSession, folder: str) -> list[models.Trained]:
        """Every kind's training; side by side where all their rows fit into few tasks."""
        few = self.matrix(spark, folder).count() <= SIDE_BY_SIDE

        @inheritable_thread_target(spark)
        def one(kind: str) -> models.Trained:
            return self.trained(spark, folder, kind)

        with ThreadPoolExecutor(len(models.KINDS) if few else 1) as pool:
            return list(pool.map(one, models.KINDS))

    def scores(self, spark: SparkSession, folder: str) -> DataFrame:
        best = {trained.kind: trained.best_model for trained in self.all_trained(spark, folder)}
        return models.risk_scores(from_testdata(spark, folder), best, matrix=self.matrix(spark, folder))

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        def over(kind: str, use: Callable[[models.Trained, SparkSession], DataFrame]):
            return lambda spark, folder: portable(use(self.trained(spark, folder, kind), spark))

        def each(use: Callable[[models.Trained, SparkSession], DataFrame]):
            def run(spark: SparkSession, folder: str) -> DataFrame:
                parts = [use(trained, spark) for trained in self.all_trained(spark, folder)]
                return portable(reduce(DataFrame.unionByName, parts))
            return run

        return {
            "train_churn": over("churn", models.model_comparison),
            "train_ltv": over("ltv", models.model_comparison),
            "train_conversion": over("conversion", models.model_comparison),
            "model_comparison": each(models.model_comparison),
            "feature_importance": each(models.feature_importance),
            "scale": over("churn", models.scaling),
            "churn_test_report": over("churn", lambda m, _: models.test_report(m)),
            "churn_test_curves": over("churn", lambda m, _: models.test_curves(m)),
            "residuals": over("ltv", lambda m, _: models.residuals(m)),
            "risk_scores": lambda spark, folder: portable(self.scores(spark, folder)),
            "risk_distribution": lambda spark, folder: portable(
                models.risk_distribution(self.scores(spark, folder))),
        }


MODEL_QUERIES = ModelQueries()


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        **{name: runner(op) for name, op in OPERATORS.items()},
        **{name: event_runner(op) for name, op in EVENT_OPERATORS.items()},
        **{name: stream_runner(op) for name, op in STREAMS.items()},
        **MODEL_QUERIES.queries(),
    }
