"""Reports per repository, from coverage and verdicts. Every repository has its rows, clean and empty ones too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archweave.contract import Contract

#: Bounds of the governance weight.
_HEAVY_FILES, _HEAVY_LAYERS, _HEAVY_RULES, _LIGHT_LAYERS, _LIGHT_FILES = 25, 6, 4, 2, 150


def governance_weight(coverage: DataFrame, contract: Contract) -> DataFrame:
    """(repo, n_governed, n_populated, files_per_layer, rules_per_layer, weight); ratios are null where nothing is governed."""
    declared, rules = len(contract.layers), len(contract.rules)
    per_repo = coverage.groupBy("repo").agg(F.sum("n_files").alias("n_governed"), F.count_if(F.col("n_files") > 0).alias("n_populated"))
    files = F.col("n_governed") / max(1, declared)
    known = (F.col("n_governed") > 0) & F.lit(declared > 0)
    heavy = (files < _HEAVY_FILES) & F.lit(declared >= _HEAVY_LAYERS or rules / max(1, declared) >= _HEAVY_RULES)
    light = F.lit(declared <= _LIGHT_LAYERS) & (F.col("n_governed") >= _LIGHT_FILES)
    weight = F.when(~known, "unknown").when(heavy, "heavy").when(light, "light").otherwise("typical")
    tenth = lambda c: F.when(known, F.floor(c * 10 + 0.5) / 10)
    return per_repo.select("repo", "n_governed", "n_populated", tenth(files).alias("files_per_layer"), tenth(F.lit(rules / max(1, declared))).alias("rules_per_layer"), weight.alias("weight"))


def coverage_honesty(coverage: DataFrame) -> DataFrame:
    """(repo, status): empty-scope, weak below 50 %, partial below 80 %, strong."""
    one = coverage.groupBy("repo").agg(F.max("total").alias("total"), F.max("percent").alias("percent"))
    status = F.when(F.col("total") == 0, "empty-scope").when(F.col("percent") < 50, "weak").when(F.col("percent") < 80, "partial").otherwise("strong")
    return one.select("repo", "total", "percent", status.alias("status"))


def operating_mode(coverage: DataFrame, verdict: DataFrame, mature: int = 150, optional_cores: tuple[str, ...] = ()) -> DataFrame:
    """(repo, mode): suggest, adapt or enforce.

    A tree that is mostly presentation, without a core, isn't enforced, nor is one with files in a core layer that the
    contract has as optional.
    """
    files = lambda name: F.max(F.when(F.col("layer") == name, F.col("n_files")))
    c = coverage.groupBy("repo").agg(F.max("total").alias("total"), F.max("percent").alias("percent"), F.count_if(F.col("layer").isin(*optional_cores) & (F.col("n_files") > 0)).alias("loose") if optional_cores else F.lit(0).alias("loose"), files("DomainModel").alias("domain"), files("PersistenceAdapters").alias("persistence"), files("PresentationAdapters").alias("presentation"))
    joined = c.join(verdict.select("repo", "valid"), "repo")
    met = F.col("valid") & (F.col("total") > 0) & (F.col("percent") >= 50)
    hollow = met & (F.col("domain") == 0) & (F.col("persistence") == 0) & (F.col("presentation") >= 0.5 * F.col("total"))
    mode = F.when((F.col("total") == 0) | (F.col("loose") > 0) | hollow, "adapt").when(met, "enforce").when((F.col("percent") < 50) | (F.col("total") >= mature) | ~met, "adapt").otherwise("suggest")
    return joined.select("repo", mode.alias("mode"))


def dead_rules(coverage: DataFrame, contract: Contract) -> DataFrame:
    """(repo, edge, reason): rules between one layer, of unknown layers, or of empty layers that aren't optional."""
    known = {x.name: x.optional for x in contract.layers}
    rows = []
    for r in contract.rules:
        edge = f"{r.source}->{r.target}"
        if r.source == r.target:
            rows.append((edge, "self", None))
            continue
        for side in (r.source, r.target):
            rows.append((edge, "unknown" if side not in known else "empty", side))
    each = F.explode(F.array(*[F.struct(F.lit(e).alias("edge"), F.lit(why).alias("reason"), F.lit(side).cast("string").alias("side")) for e, why, side in rows]))
    out = coverage.select("repo").distinct().select("repo", each.alias("x")).select("repo", "x.*")
    empty = coverage.where("n_files = 0").select("repo", F.col("layer").alias("side")).where(~F.col("layer").isin([n for n, o in known.items() if o]))
    always = out.where("reason <> 'empty'").select("repo", "edge", "reason")
    return always.union(out.where("reason = 'empty'").join(empty, ["repo", "side"], "left_semi").select("repo", "edge", "reason")).distinct()


def verify_ledger(entries: DataFrame) -> DataFrame:
    """entries (ledger, sequence, previous_hash, entry_hash) -> (ledger, sequence, failure) of broken links.

    Sequences start at 1 without gaps; the first previous hash is zeros, each other that of the entry before. Entries of
    one sequence stand in the order of their entry_hash, then previous_hash.
    """
    w = W.partitionBy("ledger").orderBy("sequence", "entry_hash", "previous_hash")
    before, place = F.lag("entry_hash").over(w), F.row_number().over(w)
    failure = F.when(F.col("sequence") != place, "sequence").when(F.col("previous_hash") != F.coalesce(before, F.lit("0" * 64)), "chain")
    return entries.withColumn("failure", failure).where("failure is not null").select("ledger", "sequence", "failure")


def entry_hash(payload, previous_hash):
    """The hash of a ledger entry: of its canonical payload and the hash of the entry before."""
    return F.sha2(F.concat(payload, F.lit("|"), previous_hash), 256)


def verify_evidence(entries: DataFrame, runs: DataFrame, manifests: DataFrame) -> DataFrame:
    """(ledger, sequence, failure): every way in which a ledger of runs isn't the evidence that its manifest asks for.

    entries (ledger, sequence, previous_hash, entry_hash, payload, manifest_hash, cell_id, session, started, finished);
    runs (ledger, sequence, cell_id, session), the order that was registered; manifests (ledger, manifest_hash).
    Failures: sequence, chain, entry-hash, manifest, order, overlap (begins before the run before has ended),
    duplicate-session, duplicate-cell, and missing for registered runs without an entry. Entries of one sequence stand
    in the order of their entry_hash, then previous_hash, session and finished.
    """
    w = W.partitionBy("ledger").orderBy("sequence", "entry_hash", "previous_hash", "session", "finished")
    wanted = runs.select("ledger", "sequence", F.col("cell_id").alias("wanted_cell"), F.col("session").alias("wanted_session"))
    rows = entries.withColumns({"place": F.row_number().over(w), "before": F.lag("entry_hash").over(w), "ended": F.lag("finished").over(w)})
    rows = rows.withColumns({f"n_{c}": F.count("*").over(W.partitionBy("ledger", c)) for c in ("session", "cell_id")})
    rows = rows.join(wanted, ["ledger", "sequence"], "left").join(manifests.select("ledger", F.col("manifest_hash").alias("wanted_manifest")), "ledger", "left")
    tests = [
        (F.col("sequence") != F.col("place"), "sequence"),
        (F.col("previous_hash") != F.coalesce("before", F.lit("0" * 64)), "chain"),
        (F.col("entry_hash") != entry_hash(F.col("payload"), F.col("previous_hash")), "entry-hash"),
        (~F.col("manifest_hash").eqNullSafe(F.col("wanted_manifest")), "manifest"),
        (~(F.col("cell_id").eqNullSafe(F.col("wanted_cell")) & F.col("session").eqNullSafe(F.col("wanted_session"))), "order"),
        (F.col("started") < F.col("ended"), "overlap"),
        (F.col("n_session") > 1, "duplicate-session"),
        (F.col("n_cell_id") > 1, "duplicate-cell"),
    ]
    found = rows.select("ledger", "sequence", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for c, k in tests]))).alias("failure"))
    lost = runs.select("ledger", "sequence").join(entries.select("ledger", "sequence"), ["ledger", "sequence"], "left_anti")
    return found.union(lost.select("ledger", "sequence", F.lit("missing")))


def bench_budgets(measured: DataFrame, budgets: DataFrame) -> DataFrame:
    """(scenario, p, value, ceiling): percentiles (scenario, p50, p95) above their ceilings (scenario, p, ceiling)."""
    long = measured.select("scenario", F.explode(F.map_from_arrays(F.array(F.lit("p50"), F.lit("p95")), F.array("p50", "p95"))).alias("p", "value"))
    return long.join(budgets, ["scenario", "p"]).where(F.col("value") > F.col("ceiling")).select("scenario", "p", "value", "ceiling")
