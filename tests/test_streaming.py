"""The event log as a stream, drained with availableNow."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.streaming import ontology


def test_log_round_trip_and_stream(spark, tmp_path):
    path, rows = str(tmp_path / "log"), [("a", 1000, "point", {"x": "1"}), ("a", 2000, "point", {"x": None, "y": "2"}), ("b", 1500, "line", {"z": "3"}), ("a", 2000, "point", {"x": None, "y": "2"})]
    events = spark.createDataFrame(rows, "id string, date bigint, type string, data map<string,string>")
    ontology.append(events, path)
    kept = []
    query = ontology.hydrate(ontology.read_stream(spark, path), lambda df, _: kept.extend(df.collect()), str(tmp_path / "check"))
    query.awaitTermination(60)
    assert len(kept) == 4 and ontology.job_status(query)["status"] == "idle"
    log = spark.createDataFrame(kept, events.select("id", "date", "type", "data").schema)
    state = {r["id"]: r["state"] for r in ontology.state_at(ontology.snapshots(log), F.lit(10_000)).collect()}
    assert state == {"a": {"y": "2"}, "b": {"z": "3"}}


def test_stream_deduplicates_within_its_watermark(spark, tmp_path):
    path = str(tmp_path / "log")
    for date in (1000, 2000):
        ontology.append(spark.createDataFrame([("a", date, "point", {"x": "1"}), ("b", date, "point", {"x": "1"})], "id string, date bigint, type string, data map<string,string>"), path)
    out = ontology.deduplicated(ontology.read_stream(spark, path)).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination(60)
    assert sorted(r["id"] for r in spark.table("seen").collect()) == ["a", "b"]
