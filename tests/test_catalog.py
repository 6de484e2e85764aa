"""The registered queries: coverage, shape, and a sample against DuckDB."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import canonical

SMALL = "/root/testdata/sf0.001"
# One key per operator of the inventory.
INVENTORY = """
scan_csv_raw canonical_columns source_file_profile landing_schema_check landing_quality_gate landing_route ingestion_audit
grid_reference scan_parquet sink_activity_partitioned sink_hourly_summary sink_dashboard_csv format_footprint pipeline_status_record
standardize_types clean_valid clean_rejected fill_measures derive_measures derive_calendar internet_share_rounded
internet_share_exact null_counts cleaning_report normalize_grid_id drop_geometry filter_date_window ensure_date
hourly_grid_summary daily_traffic_summary daily_kpi grid_kpi peak_activity_hour global_internet_share network_summary
control_totals network_hourly_trend top_internet_hours activity_floor bucket_history ingestion_profile alert_summary
signal_overlap_metrics risk_threshold_sensitivity
dim_time dim_grid fact_network_activity star_activity grid_centroid enrich_geo reference_coverage eligible_grids model_dataset
three_way_comparison top20_attention grid_neighbours neighbour_activity surging_grids leakage_compare
hotspot_ranking hotspots_as_of previous_activity loo_baseline timestamp_gaps densify_hours feat_avg_activity feat_peak_ratio
feat_active_hours feat_variability feat_internet_share feat_activity_growth network_features feat_recent_6 feat_cyclic_time
risk_target trailing_high_activity hour_bucket_baseline latest_features history_summary hourly_cadence
dashboard_summary top_activity_grids alert_feed grid_activity_24h grid_location risk_lookup resolve_as_of
reject_union dedupe_keys grid_set_difference scalar_catalog
network_alerts anomaly_scores disagreement_summary chronological_split class_weights risk_model_train risk_model_metrics
model_rule_agreement feature_importance risk_scores risk_levels evidence_package severity_assessment anomaly_reconciliation
display_priority pipeline_health
dq_grain dq_grid_reference dq_geometry dq_adjacency dq_enrichment dq_round_trip dq_partitions dq_alerts dq_source dq_features
dq_risk_scores dq_foreign_keys dq_publish
""".split()


def test_every_inventory_key_is_registered():
    assert len(INVENTORY) == 120
    assert set(INVENTORY) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_the_hotspots(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 10 and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize(
    "name",
    ["hourly_grid_summary", "cleaning_report", "landing_quality_gate", "star_activity", "grid_neighbours", "network_alerts", "network_features", "dq_publish"],
)
def test_sample_matches_duckdb_on_the_smallest_tables(spark, name):
    con = duckdb.connect()
    for path in pathlib.Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, SMALL)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), names)
