"""Flights with a single fix are reported, with scores of 0."""

from pyspark.sql import functions as F

from aerolith.plans import flights

DATA = "/root/testdata/sf0.001"


def test_single_fix_flights_are_reported(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    user = events.agg(F.min("user_id")).first()[0]
    first = events.filter(F.col("user_id") == user).orderBy("event_id").limit(1)
    events.filter(F.col("user_id") != user).unionByName(first).write.parquet(f"{tmp_path}/events.parquet")
    report = {r["flight_id"]: r for r in flights.flight_quality_report(spark, str(tmp_path)).collect()}
    metrics = {r["flight_id"]: r for r in flights.trajectory_metrics(spark, str(tmp_path)).collect()}
    assert len(report) == len(metrics) == events.select("user_id").distinct().count()
    assert (report[user]["fixes"], report[user]["gps"]) == (1, 0.0) and "INSUFFICIENT_TELEMETRY_POINTS" in report[user]["warnings"]
    assert (metrics[user]["fixes"], metrics[user]["max_gap"], metrics[user]["continuity"], metrics[user]["overlap"]) == (1, 999.0, 0.0, 0.0)
