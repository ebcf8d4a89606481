"""Work that has to grow with the input, no faster."""

from __future__ import annotations

import re
import time

from archweave import derive
from archweave.contract import FLEET
from archweave.jobs import oracle
from archweave.jobs import queries as jobs
from archweave.operators import experiments, health, reports, structure
from tests.harness import connect, difference

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dependencies_join_on_both_keys(spark):
    """A join on repo alone would pair all files of a repository."""
    found = derive.facts(spark, SF, "dependencies")
    joins = [line for line in _plan(found).splitlines() if "Join " in line]
    assert len(joins) == 1 and "Inner" in joins[0] and "repo" in joins[0] and "wanted" in joins[0]
    want = connect(SF).execute(f"{derive.with_views('dependencies')} SELECT {', '.join(found.columns)} FROM dependencies").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want) and want


def test_rules_in_ui_cost_nothing_at_keywords(spark):
    """Lines that only begin like helpers are passed over; one at the end is found."""
    text = "export const a = 1\n" * 4000
    rows = spark.createDataFrame([("r", f"src/ui/f{i}.ts", text + ("export const shouldPay = (o) => o.total > 1;" if i % 2 else ""), None) for i in range(24)], "repo string, path string, content string, layer string")
    begun = time.time()
    found = health.smell_evidence(rows, FLEET).where("smell = 'domain-logic-in-ui'").collect()
    assert {r.path for r in found} == {f"src/ui/f{i}.ts" for i in range(1, 24, 2)}
    assert time.time() - begun < 20


def test_http_import_after_blank_lines():
    """Runs of newlines are read once; what matches is the same."""
    quick = re.compile(structure._HTTP)
    for before, fits in (("", True), ("\n\n  ", True), ("x;\n\n", True), ("x ", False), (" \t", True), ("x\r\n\r\n", True)):
        assert bool(quick.search(f"{before}import {{ a }} from 'next/server'")) is fits
    begun = time.time()
    assert not quick.search("\n" * 40_000)
    assert time.time() - begun < 2


def test_ledger_entries_of_one_sequence_have_an_order(spark, tmp_path):
    """Whichever way rows come: of two entries of sequence 2, that of the smaller hash comes first."""
    rows = [("l", 1, "0" * 64, "h1"), ("l", 2, "h1", "a"), ("l", 2, "a", "b")]
    seen = [sorted(map(tuple, reports.verify_ledger(spark.createDataFrame(r, "ledger string, sequence long, previous_hash string, entry_hash string").coalesce(1)).collect())) for r in (rows, rows[::-1])]
    assert seen[0] == seen[1] == [("l", 2, "sequence")]
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id", ascending=False).coalesce(1)
    events.withColumn("user_id", events["user_id"] % 3).write.parquet(f"{tmp_path}/events.parquet/")
    con_dir = tmp_path / "one"
    con_dir.mkdir()
    next((tmp_path / "events.parquet").glob("*.parquet")).rename(con_dir / "events.parquet")
    assert difference(spark, jobs.queries()["verify_ledger"], oracle.oracle_sql()["verify_ledger"], str(con_dir)) is None


def test_strict_rows_do_not_carry_their_document(spark, tmp_path):
    """One document of many rows: laying them out was quadratic in its size."""
    import json

    from archweave.sources import strict_facts as strict

    files = [{"path": f"src/f{i}.ts", "contentHash": "h", "parseStatus": "parsed", "parseDiagnosticCount": 0, "exportsOnlyTypes": False, "typeOnlyExportNames": [], "hasTopLevelSideEffects": False} for i in range(6000)]
    document = {"repo": "r", "snapshot": "s", "schemaVersion": "1.1", "completeness": "complete", "completenessReasons": [], "files": files} | {k: "x" for k in strict.IDENTITIES}
    document |= {k: [] for k in strict.FACTS if k != "files"}
    (tmp_path / "facts.json").write_text(json.dumps(document))
    begun = time.time()
    got = strict.read_facts_strictly(spark, str(tmp_path / "facts.json"))
    assert got["files"].count() == 6000 and got["rejects"].count() == 0
    assert time.time() - begun < 30


def test_bootstrap_in_blocks(spark):
    """Draws in numpy are those of Spark's hash; several blocks share a task's draws out, none lost."""
    import numpy as np
    from pyspark.sql import functions as F

    made = spark.range(50).select(F.xxhash64(F.lit(7), F.lit(2), "id").alias("a"), F.xxhash64(F.lit(7), F.lit(2), "id", (F.col("id") + 1).cast("int")).alias("h")).toPandas()
    ids = np.arange(1, 51, dtype=np.uint64)
    assert (experiments._hashed(made["a"].to_numpy().view(np.uint64), ids).view(np.int64) == made["h"].to_numpy()).all()
    assert all(sum(experiments._share(t, 1003, b, 100, 5) for b in range(11)) == t for t in (0, 1, 1003, 5000))
    rows = [(r, t, 100 * r + 10 * t + p, 100 + p, 90 + 3 * p) for r in range(2) for t in range(3) for p in range(9)]
    df = spark.createDataFrame(rows, "repository_id long, task_id long, pair_id long, control_ms long, treatment_ms long")
    whole, split = experiments.paired_bootstrap(df, 200).first(), experiments.paired_bootstrap(df, 200, size=4).first()
    assert whole.estimate == split.estimate and abs(whole.lower - split.lower) < 0.05 and abs(whole.upper - split.upper) < 0.05
    assert split == experiments.paired_bootstrap(df.repartition(5), 200, size=4).first()
