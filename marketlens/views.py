"""The named report views, for use from ``spark.sql``."""

from __future__ import annotations

from marketlens.operators import advanced, cohorts, kpis, quality
from marketlens.plans.tables import Tables

VIEWS = {
    "v_customer_acquisition_cost": kpis.acquisition_cost,
    "v_customer_ltv_analysis": kpis.customer_ltv,
    "v_ltv_summary": kpis.ltv_summary,
    "v_cohort_analysis": cohorts.cohort_retention,
    "v_campaign_performance": kpis.campaign_performance,
    "v_daily_engagement": kpis.daily_engagement,
    "v_customer_segmentation": kpis.customer_segmentation,
    "v_channel_attribution": kpis.channel_attribution,
    "v_weekly_trends": kpis.weekly_trends,
    "v_customer_journey": advanced.customer_journey_milestones,
    "v_churn_features": advanced.churn_features,
    "v_campaign_deep_analysis": advanced.campaign_deep_analysis,
    "v_sports_preference_analysis": advanced.sports_preference,
    "v_daily_metrics_timeseries": advanced.daily_timeseries,
    "v_revenue_cohort_analysis": cohorts.revenue_cohort,
    "v_data_quality_summary": quality.data_quality_summary,
    "v_database_summary": quality.database_summary,
}


def register(t: Tables, tables: bool = True) -> None:
    """Register the report views and, unless told otherwise, the six tables."""
    if tables:
        t.register_views()
    for name, build in VIEWS.items():
        build(t).createOrReplaceTempView(name)
