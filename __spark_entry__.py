"""

Each query runs one analysis over the whole sample views.  Floating-point results are rounded (money to cents,
the rest to six digits) and days shown as text, so that both engines give the same values; the analyses
themselves never do that.
"""

from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable
from datetime import datetime
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

import driver_sql  # noqa: E402
from lodgelens.plans import (  # noqa: E402
    daily,
    funnel,
    grid,
    leadtime,
    monitor,
    occupancy,
    ppc,
    pricing,
    profile,
    rooms,
    segments,
    trends,
    upsell,
    visits,
)
from lodgelens.session import StoredTables, configure, cut_lineage  # noqa: E402
from lodgelens.sources import many_csv, store  # noqa: E402
from lodgelens.sources.sample_views import RAW_VIEWS, VIEWS, WHOLE_VIEWS, load_raw, load_views  # noqa: E402
from lodgelens.tables import HotelTables  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"
MONEY = {"revenue", "diff", "diff_sum", "recomposed", "total_price"}

Query = Callable[[SparkSession, str], DataFrame]
Analysis = Callable[[HotelTables], DataFrame]


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    def shown(field: T.StructField):
        if isinstance(field.dataType, T.DecimalType):
            return F.col(field.name).cast("double").alias(field.name)
        if isinstance(field.dataType, (T.DateType, T.TimestampNTZType)):
            return F.col(field.name).cast("string").alias(field.name)
        if not isinstance(field.dataType, T.DoubleType):
            return F.col(field.name)
        money = field.name in MONEY or field.name.endswith("_revenue")
        return F.round(field.name, 2 if money else digits).alias(field.name)

    return df.select(*[shown(f) for f in df.schema])


def _query(analysis: Analysis, digits: int = 6, views: dict[str, str] = VIEWS) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(analysis(load_views(configure(spark), sf_dir, views)), digits)

    return run


def _naive_predictions(t: HotelTables) -> DataFrame:
    """Last week's fill rate as the prediction of today's."""
    days = daily.daily_features(t).where(F.col("fill_rate_lag7").isNotNull() & F.col("fill_rate").isNotNull())
    return days.select("hotel_id", "date", F.col("fill_rate_lag7").alias("prediction"), F.col("fill_rate").alias("label"))


def _complete_days(t: HotelTables) -> DataFrame:
    return daily.daily_features(t).na.drop("any")


def _train_days(t: HotelTables) -> DataFrame:
    return daily.chronological_split(_complete_days(t)).where(F.col("role") == "train")


def _fold_overview(t: HotelTables) -> DataFrame:
    roles = daily.fold_roles(daily.fold_blocks(_train_days(t).drop("role")))
    return roles.groupBy("hotel_id", "fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def _split_days(t: HotelTables) -> DataFrame:
    return daily.chronological_split(_complete_days(t)).select("hotel_id", "date", "role")


def _history(t: HotelTables) -> DataFrame:
    """Reports of three days, each about the predictions before it, written to a log and the last one once more."""
    spark = t.daily_occupancy.sparkSession
    path = StoredTables(spark, "reports").folder
    told = cut_lineage(_naive_predictions(t))
    for year in (1995, 1997, 1998, 1998):
        day = datetime(year, 6, 1, 12)
        known = told.where(F.col("date") < F.lit(day.date()))
        report = monitor.model_report(known, t, "last_week", day, tables=("daily_occupancy",))
        store.append_report(report, path)
    return monitor.metric_history(store.read_reports(spark, path, report))


def _monthly_sketches(t: HotelTables) -> DataFrame:
    daily = StoredTables(t.search_log.sparkSession, "sketches").put(trends.daily_sketches(t), "daily")
    return trends.monthly_check(t, daily)


def _loaded(table: str) -> Analysis:
    """A raw form of a table, typed and filled by the loader's rules."""
    return lambda t: many_csv.split_rows(load_raw(t, table), table, "hotel_id", "file")[0]


def _rejected(t: HotelTables) -> DataFrame:
    """Lines that break a rule, by table, file and reason."""
    bad = [many_csv.split_rows(load_raw(t, table), table, "hotel_id", "file")[1] for table in RAW_VIEWS]
    stacked = reduce(DataFrame.unionByName, bad)
    return stacked.groupBy("hotel_id", "table_name", "file", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line")
    )


def _total_variance(t: HotelTables) -> DataFrame:
    """Number of principal components and the sum of their variances, per property."""
    found = grid.principal_components(grid.model_rows(t))
    return found.groupBy("hotel_id").agg(F.count("component").alias("components"), F.sum("variance").alias("total_variance"))


def _linear_grid(t: HotelTables) -> tuple[DataFrame, DataFrame]:
    rows = cut_lineage(grid.model_rows(t))
    return rows, grid.linear_grid(rows)


def _ridge_folds(t: HotelTables) -> DataFrame:
    """Mean squared error of every ridge point and fold on the selected features."""
    found = _linear_grid(t)[1].where((F.col("model") == "ridge") & (F.col("method") == grid.SELECTED))
    alpha = F.get_json_object("params", "$.alpha").cast("double").alias("alpha")
    return found.select("hotel_id", alpha, F.posexplode("fold_mse").alias("fold", "mse"))


def _best_linear(t: HotelTables) -> DataFrame:
    rows, found = _linear_grid(t)
    return grid.best_models(grid.linear_results(rows, cut_lineage(found)))


def _trees(t: HotelTables, model: str) -> DataFrame:
    branched = cut_lineage(grid.branch_rows(grid.model_rows(t)))
    return grid.tree_grid(grid.tree_errors(branched, {model: grid.TREE_POINTS[model]}))


ANALYSES: dict[str, Query] = {
    "lead_time_by_segment": _query(leadtime.lead_time_by_segment),
    "lead_time_percentiles": _query(leadtime.lead_time_percentiles),
    "lead_time_monthly": _query(leadtime.lead_time_monthly),
    "lead_time_box": _query(leadtime.lead_time_box),
    "lead_time_by_source": _query(leadtime.lead_time_by_source),
    "lead_time_by_source_monthly": _query(leadtime.lead_time_by_source_monthly),
    "lead_time_by_source_box": _query(leadtime.lead_time_by_source_box),
    "bookings_by_source": _query(leadtime.bookings_by_source),
    "bookings_by_segment": _query(leadtime.bookings_by_segment),
    "funnel": _query(funnel.funnel),
    "funnel_rows": _query(lambda t: funnel.funnel(t, "rows")),
    "funnel_rates": _query(lambda t: funnel.funnel_rates(t, "rows")),
    "funnel_by_currency": _query(funnel.funnel_by_currency),
    "segment_stats": _query(segments.segment_stats),
    "segment_revenue": _query(segments.segment_revenue),
    "segment_top3": _query(segments.segment_top),
    "revenue_totals": _query(segments.revenue_totals),
    "campaign_by_segment": _query(segments.campaign_by_segment, views=WHOLE_VIEWS),
    "top_campaigns": _query(segments.top_campaigns),
    "campaign_summary": _query(segments.campaign_summary),
    "room_choice_by_segment": _query(rooms.room_choice_by_segment),
    "room_choice_by_source": _query(rooms.room_choice_by_source, views=WHOLE_VIEWS),
    "room_choice_by_source_and_currency": _query(rooms.room_choice_by_source_and_currency),
    "room_avg_price": _query(rooms.room_avg_price),
    "ppc_daily_traffic": _query(ppc.ppc_daily_traffic),
    "ppc_daily_spend": _query(ppc.ppc_daily_spend, views=WHOLE_VIEWS),
    "ppc_conversions": _query(ppc.ppc_conversions),
    "ppc_bookings_by_segment": _query(ppc.ppc_bookings_by_segment),
    "ppc_revenue_by_segment": _query(ppc.ppc_revenue_by_segment),
    "ppc_revenue_wide": _query(ppc.ppc_revenue_wide),
    "upsell_by_segment": _query(upsell.upsell_by_segment),
    "upsell_levels": _query(upsell.upsell_levels),
    "upsell_revenue": _query(upsell.upsell_revenue),
    "upsell_revenue_tiers": _query(upsell.upsell_revenue_tiers),
    "upsell_revenue_tiers_all": _query(lambda t: upsell.upsell_revenue_tiers(t, all_products=True)),
    "visits_before_booking": _query(visits.visits_before_booking, views=WHOLE_VIEWS),
    "visits_distribution": _query(visits.visits_distribution),
    "visits_summary": _query(visits.visits_summary),
    "visits_overall": _query(visits.visits_overall),
    "visits_levels": _query(visits.visits_levels),
    "repeat_bookers": _query(visits.repeat_bookers),
    "repeat_totals": _query(visits.repeat_totals),
    "booking_frequency": _query(visits.booking_frequency),
    "top_bookers": _query(visits.top_bookers),
    "top_booker_sources": _query(visits.top_booker_sources),
    "price_reconciliation": _query(pricing.price_reconciliation),
    "price_diff_top5": _query(pricing.price_diff_top),
    "price_diff_series": _query(pricing.price_diff_series),
    "booking_stats": _query(pricing.booking_stats),
    "utm_split": _query(ppc.utm_split),
    "utm_split_untrimmed": _query(lambda t: ppc.utm_split(t, "website_daily_users", trim=False)),
    "utm_matches": _query(ppc.utm_matches),
    "utm_match_levels": _query(lambda t: ppc.utm_matches(t, with_all_levels=True)),
    "load_booking_data": _query(_loaded("booking_data")),
    "load_sessions": _query(_loaded("search_log_session")),
    "load_daily_visitors": _query(_loaded("datepicker_daily_visitors")),
    "rejected_lines": _query(_rejected),
    "base_stats": _query(profile.base_stats),
    "profile_tables": _query(profile.profile_tables),
    "row_counts": _query(profile.row_counts),
    "data_quality": _query(profile.data_quality),
    "daily_features": _query(daily.daily_features),
    "scaled_features": _query(daily.scaled_features, digits=5),
    "augmented_features": _query(lambda t: daily.scaled_features(t, seed=occupancy.SEED), digits=5),
    "daily_metrics": _query(monitor.daily_metrics, views=WHOLE_VIEWS),
    "model_metrics": _query(lambda t: monitor.model_metrics(_naive_predictions(t)), views=WHOLE_VIEWS),
    "metric_history": _query(_history),
    "monthly_sketches": _query(_monthly_sketches),
    "residual_histogram": _query(lambda t: monitor.residual_histogram(_naive_predictions(t))),
    "chronological_split": _query(_split_days),
    "ts_folds": _query(_fold_overview),
    "feature_selection": _query(lambda t: occupancy.select_features(_train_days(t)), digits=3),
    "model_statistics": _query(lambda t: grid.moment_list(grid.moments(grid.model_rows(t))), digits=2),
    "feature_covariance": _query(lambda t: grid.covariances(grid.model_rows(t))),
    "pca_total_variance": _query(_total_variance),
    "ridge_grid": _query(_ridge_folds, digits=4),
}

# Single fits at one point of the full grids (``occupancy.MODELS``).
FOREST = {"random_forest": occupancy.with_grid("random_forest", trees=(100,), depth=(10,), min_leaf=(1,))}
BOOSTING = {"gradient_boosting": occupancy.with_grid("gradient_boosting", trees=(100,), rate=(0.1,), depth=(3,))}


def _fits(models: dict[str, occupancy.Model], **options: object) -> Analysis:
    """Result rows of the models, fitted property by property."""
    return lambda t: occupancy.per_hotel(t, lambda i: occupancy.fit_occupancy(t, i, models, **options).results)


def _report(t: HotelTables) -> DataFrame:
    return monitor.model_report(_naive_predictions(t), t, "last_week", datetime(1998, 6, 1, 12))


def _report_fields(t: HotelTables) -> DataFrame:
    """The same reports with one row per table whose quality they state."""
    quality = [f"quality.{c}" for c in ("table_name", "missing_values", "row_count", "duplicate_rows")]
    figures = [f"daily_metrics.{c}" for c in ("bookings", "occupancy_rate", "website_visitors")]
    listed = _report(t).withColumn("quality", F.explode("data_quality"))
    return listed.select(
        "hotel_id", F.col("report_date").cast("string").alias("report_date"), "timestamp", "model_name",
        "model_metrics.*", "rmse_vs_baseline", *quality, *figures,
    )


def _reports(t: HotelTables) -> DataFrame:
    """One monitoring report per property, as JSON text."""
    report = _report(t)
    return report.select("hotel_id", "report_date", F.to_json(F.struct(*report.columns)).alias("report"))


# No SQL counterpart (but for the flat form of the reports): nested reports, eigenvectors, model fits of each property.
ANALYSES |= {
    "report_fields": _query(_report_fields),
    "model_report": _query(_reports),
    "pca_components": _query(lambda t: grid.principal_components(grid.model_rows(t)).drop("axis")),
    "model_grid_linear": _query(lambda t: _linear_grid(t)[1].drop("fold_mse", "coefficients", "place")),
    "best_model_linear": _query(_best_linear),
    "forest_grid": _query(lambda t: _trees(t, "random_forest")),
    "boosting_grid": _query(lambda t: _trees(t, "gradient_boosting")),
    "best_model": _query(lambda t: grid.best_models(grid.model_choice(t))),
    "forest_fit": _query(_fits(FOREST, methods=(occupancy.SELECTED,), search=False)),
    "boosting_fit": _query(_fits(BOOSTING, methods=(occupancy.SELECTED,), search=False)),
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: lead-time statistics per guest segment."""
    return queries()["lead_time_by_segment"](spark, SMOKE_DIR)


def _has_llm() -> bool:
    """Whether the training-data operators are installed; their folders and the pipeline can be left out together."""
    found = importlib.util.find_spec
    return all(found(name) for name in ("lodgelens.llm", "corpus_pipeline")) and bool(found("lodgelens.llm.registry"))


def queries() -> dict[str, Query]:
    if not _has_llm():
        return dict(ANALYSES)
    import corpus_pipeline
    from lodgelens.llm import registry

    return {**ANALYSES, **registry.queries(), "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    if not _has_llm():
        return driver_sql.oracle_sql()
    import corpus_pipeline
    from lodgelens.llm import registry

    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**driver_sql.oracle_sql(), **registry.oracle_sql(), **pipeline}
