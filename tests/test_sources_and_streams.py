from __future__ import annotations

import json

from pyspark.sql import functions as F

from archweave.contract import FLEET
from archweave.derive import facts
from archweave.operators.events import buffer_status, publish_pipeline
from archweave.sources import facts as src
from archweave.streaming import publish

SF = "/root/testdata/sf0.001"


def test_facts_and_rejects(spark, tmp_path):
    doc = {"repo": "a", "snapshot": "1", "schemaVersion": "1.0", "files": [{"path": "x.ts", "parseDiagnosticCount": 2}, {"path": "x.ts", "parseDiagnosticCount": 0}], "dependencies": [{"from": "x.ts", "target": "y.ts", "resolution": "resolved-project"}, {"from": "z.ts", "target": "q", "resolution": "resolved-external"}]}
    (tmp_path / "f.json").write_text("\n".join([json.dumps(doc), json.dumps({**doc, "schemaVersion": "9"}), "{broken"]))
    got = src.read_facts(spark, str(tmp_path))
    assert [r.path for r in got["files"].orderBy("ordinal").collect()] == ["x.ts", "x.ts"]
    assert {r.from_path: r.to_path for r in got["dependencies"].collect()} == {"x.ts": "y.ts", "z.ts": None}
    assert sorted(r.reason for r in got["rejects"].collect()) == ["not-json", "version"]
    issues = src.validate_fact_keys(got["files"], got["dependencies"], "from_path")
    assert sorted((r.path, r.issue) for r in issues.collect()) == [("x.ts", "duplicate-path"), ("z.ts", "unknown-file")]
    r = src.parse_health(got["files"]).first()
    assert (r.n_affected, r.n_diagnostics, r.paths) == (1, 2, ["x.ts"])


def test_baseline_of_both_versions(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"repo": "a", "violations": ["k1", "k2"]}\n{"repo": "a", "records": {"k2": "x", "k3": "y"}}')
    keys = src.read_baseline(spark, str(tmp_path))
    assert sorted(r.key for r in keys.collect()) == ["k1", "k2", "k3"]
    src.write_baseline(keys, f"{tmp_path}/out")
    assert sorted(r.key for r in src.read_baseline(spark, f"{tmp_path}/out").collect()) == ["k1", "k2", "k3"]


def events(spark):
    return facts(spark, SF, "domain_events").withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))


def test_stream_publishes_as_the_batch_does(spark, tmp_path):
    rows = events(spark)
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second start finds nothing new
        stream = publish.published(publish.stream_events(spark, f"{tmp_path}/in", 1), FLEET)
        q = publish.write_published(stream, f"{tmp_path}/ok", f"{tmp_path}/bad", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(90)
    want = publish_pipeline(rows, FLEET)
    for path, where in (("ok", "reject is null"), ("bad", "reject is not null")):
        got = spark.read.parquet(f"{tmp_path}/{path}").select("event_id", "reject")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.where(where).select("event_id", "reject").collect()), key=repr)


def test_stream_state_is_the_batch_state(spark, tmp_path):
    status = F.expr("CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'dispatched' END")
    events(spark).repartition(3).write.parquet(f"{tmp_path}/in")
    shape = lambda df: df.select(F.col("correlation_id").alias("id"), F.col("event_id").alias("seq"), status.alias("status"), F.lit("e").alias("error"))
    q = publish.stream_buffer_status(shape(publish.stream_events(spark, f"{tmp_path}/in", 1))).writeStream.format("memory").queryName("buffered").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted(map(tuple, spark.table("buffered").collect())) == sorted(map(tuple, buffer_status(shape(events(spark))).collect()))
