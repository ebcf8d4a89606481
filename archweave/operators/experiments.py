"""Paired experiments: arms, censored percentiles, bootstrap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from archweave.operators.quantiles import at_rank, medians, value_counts
from archweave.ship import ship_package


def pair_arms(cells: DataFrame) -> DataFrame:
    """(pair_id, repository_id, task_id, control_ms, treatment_ms) of pairs that have both arms."""
    value = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("restricted_ms")))
    return cells.groupBy("pair_id", "repository_id", "task_id").agg(value("control").alias("control_ms"), value("treatment").alias("treatment_ms")).where("control_ms is not null and treatment_ms is not null")


def arm_summary(cells: DataFrame) -> DataFrame:
    ok = F.col("outcome") == "first_valid"
    out = cells.groupBy("arm").agg(F.count("*").alias("n_cells"), F.count_if(ok).alias("n_completed"), F.count_if(~ok).alias("n_censored"), F.sum("restricted_ms").alias("ms"))
    return out.select("arm", "n_cells", "n_completed", "n_censored", F.round(F.col("n_completed") / F.col("n_cells"), 6).alias("completion"), F.round(F.col("ms") / F.col("n_cells"), 6).alias("restricted_mean"))


def first_valid_percentile(cells: DataFrame, share: float) -> DataFrame:
    """Per arm: the time of rank ceil(share * cells) among successes; null and not_reached if there are too few."""
    every = cells.groupBy("arm").agg(F.ceil(F.count("*") * share).alias("rank"))
    counts = value_counts(cells.where("outcome = 'first_valid'").select("arm", "restricted_ms"), ["arm"], "restricted_ms")
    found = every.join(counts, "arm", "left").groupBy("arm").agg(at_rank("restricted_ms", F.col("rank")).alias("value"))
    return found.select("arm", "value", F.when(F.col("value").isNull(), "not_reached").otherwise("reached").alias("status"))


#: Pairs that a bootstrap's task holds at once, and draws that it makes at once.
BLOCK, _DRAWS = 65_536, 1 << 20
_XX = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _hashed(seeds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of int places, each with the hash of the columns before it as its seed."""
    p1, p2, p3, p5 = _XX
    h = (seeds + p5 + np.uint64(4)) ^ (places * p1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _share(times: int, total: int, block: int, size: int, key: int) -> int:
    """How many of ``times`` draws among ``total`` numbers fall into one block of ``size``; each block finds its own by halving,
    with draws that all blocks make alike."""
    low, high, node = 0, -(-total // size), 1
    while high - low > 1 and times:
        mid = (low + high) // 2
        left = (mid - low) * size / (min(high * size, total) - low * size)
        taken = int(np.random.Generator(np.random.Philox(key=[key, node])).binomial(times, left))
        low, high, times, node = (low, mid, taken, 2 * node) if block < mid else (mid, high, times - taken, 2 * node + 1)
    return times


def _block_sums(size: int, kind: pa.DataType):
    """Over the draws of a block (b, k, n_pairs, block, hash, of_block) and its pairs (i, treatment, control): sums per b."""

    def run(draws: pa.Table, pairs: pa.Table) -> pa.Table:
        names = ["b", "treatment", "control"]
        order = np.argsort(pairs["i"].to_numpy())
        treatment, control = (pairs[c].to_numpy()[order] for c in names[1:])
        if not len(draws) or not len(order):
            return pa.table([pa.array([], t) for t in (pa.int64(), kind, kind)], names)
        b, k, seeds = draws["b"].to_numpy(), draws["k"].to_numpy(), draws["hash"].to_numpy().view(np.uint64)
        total, block = draws["n_pairs"][0].as_py(), draws["block"][0].as_py()
        times = k * total
        if total > size:
            times = np.array([_share(t, total, block, size, h) for t, h in zip(times.tolist(), seeds.tolist(), strict=True)], np.int64)
            seeds = draws["of_block"].to_numpy().view(np.uint64)
        sums = np.zeros((2, len(b)), treatment.dtype)
        ends = np.cumsum(times)
        for at in range(0, int(ends[-1]), _DRAWS):
            # Draws of one batch, by the resamples that they belong to.
            first, last = np.searchsorted(ends, [at, min(at + _DRAWS, ends[-1]) - 1], "right")
            upto = np.minimum(ends[first : last + 1], at + _DRAWS)
            since = np.concatenate([[at], upto[:-1]])
            n = upto - since
            place = np.arange(at, upto[-1]) - np.repeat(ends[first : last + 1] - times[first : last + 1], n) + 1
            drawn = _hashed(np.repeat(seeds[first : last + 1], n), place.astype(np.uint64)).view(np.int64) % len(order)
            held = np.flatnonzero(n)
            for out, values in zip(sums, (treatment, control), strict=True):
                out[first + held] += np.add.reduceat(values[drawn], since[held] - at)
        return pa.table([pa.array(b), pa.array(sums[0], kind), pa.array(sums[1], kind)], names)

    return run


def paired_bootstrap(pairs: DataFrame, resamples: int = 1000, seed: int = 7, size: int = BLOCK) -> DataFrame:
    """(lower, upper, estimate) of mean(treatment) / mean(control): repositories are resampled, then their tasks, then replicates.

    Each level draws as many as there are, with replacement, by hashes of (seed, resample, place), so partitions and
    retries don't matter and nothing is collected. Draws of one unit are combined to a count before the next level.
    Replicates are drawn in blocks of ``size`` pairs, each by one Arrow group that returns sums; where a task has more
    pairs, how many draws fall into each block is drawn first, by halves.
    """
    ship_package(pairs.sparkSession)
    number = lambda df, by, order: df.withColumn("i", F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1)
    exact = isinstance(pairs.schema["treatment_ms"].dataType, IntegralType) and isinstance(pairs.schema["control_ms"].dataType, IntegralType)
    kind = "long" if exact else "double"
    rows = number(pairs.select("repository_id", "task_id", "pair_id", F.col("control_ms").cast(kind).alias("control"), F.col("treatment_ms").cast(kind).alias("treatment")), ["repository_id", "task_id"], "pair_id")
    tasks = number(rows.groupBy("repository_id", "task_id").agg(F.count("*").alias("n_pairs")), ["repository_id"], "task_id")
    repositories = tasks.groupBy("repository_id").agg(F.count("*").alias("n_tasks"))
    total = repositories.agg(F.count("*").alias("n_repositories"))
    repositories = number(repositories, [F.lit(0)], "repository_id")

    def drawn(units: DataFrame, times: Column, among: str, *level: str) -> DataFrame:
        """units (b, level...) -> (b, level..., i, k): each unit draws ``times`` of ``among`` numbers."""
        each = units.select("b", *level, F.col(among), F.explode(F.sequence(F.lit(1), times.cast("int"))).alias("place")).where(F.col(among) > 0)
        at = F.pmod(F.xxhash64(F.lit(seed), F.lit(len(level)), "b", *level, "place"), F.col(among)).cast("int")
        return each.groupBy("b", *level, at.alias("i")).agg(F.count("*").alias("k"))

    base = pairs.sparkSession.range(resamples).select(F.col("id").alias("b")).join(total.where("n_repositories > 0"), F.lit(True))
    level = drawn(base, F.col("n_repositories"), "n_repositories").join(repositories, "i").select("b", "repository_id", "n_tasks", "k")
    level = drawn(level, F.col("k") * F.col("n_tasks"), "n_tasks", "repository_id").join(tasks, ["repository_id", "i"]).select("b", "repository_id", "task_id", "n_pairs", "k")
    keys = ["repository_id", "task_id"]
    blocks = F.sequence(F.lit(0), F.floor((F.col("n_pairs") - 1) / size).cast("int"))
    hashes = [F.xxhash64(F.lit(seed), F.lit(len(keys)), "b", *keys).alias("hash"), F.xxhash64(F.lit(seed), F.lit(len(keys)), "b", *keys, "block").alias("of_block")]
    draws = level.select("b", *keys, "n_pairs", "k", F.explode(blocks).alias("block")).select("b", *keys, "n_pairs", "k", "block", *hashes)
    held = rows.select(*keys, "i", "treatment", "control", F.floor(F.col("i") / size).cast("int").alias("block"))
    by = [*keys, "block"]
    sums = draws.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(_block_sums(size, pa.int64() if exact else pa.float64()), f"b long, treatment {kind}, control {kind}")
    ratios = sums.groupBy("b").agg((F.sum("treatment") / F.sum("control")).alias("ratio"))
    point = pairs.agg((F.sum("treatment_ms") / F.sum("control_ms")).alias("estimate"))
    return ratios.agg(F.percentile("ratio", 0.025).alias("lower"), F.percentile("ratio", 0.975).alias("upper")).join(point)


def experiment_verdict(cells: DataFrame, most: float, allowed: float) -> DataFrame:
    """Whether the ratio of restricted means is at most ``most`` and completion falls by ``allowed`` at most."""
    s = arm_summary(cells)
    pick = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    out = s.agg(*[pick(a, c).alias(f"{a}_{c}") for a in ("control", "treatment") for c in ("restricted_mean", "completion")])
    ratio = F.col("treatment_restricted_mean") / F.col("control_restricted_mean")
    delta = F.col("treatment_completion") - F.col("control_completion")
    return out.select(F.round(ratio, 6).alias("ratio"), F.round(delta, 6).alias("completion_delta"), ((ratio <= most) & (delta >= -allowed)).alias("passed"))


def usage_summary(cells: DataFrame) -> DataFrame:
    """Per arm: token sums over the cells that report usage, cost in millionths only if every cell reports one.

    cells (arm, input_tokens, output_tokens, cost_micros); a cell reports if input_tokens isn't null.
    """
    told = F.col("input_tokens").isNotNull()
    n = cells.groupBy("arm").agg(
        F.count_if(told).alias("n_reported"),
        F.count_if(~told).alias("n_unreported"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.when(told, F.col("output_tokens"))), F.lit(0)).alias("output_tokens"),
        F.sum("cost_micros").alias("cost"),
        F.bool_and(told & F.col("cost_micros").isNotNull()).alias("whole"),
    )
    return n.select("arm", "n_reported", "n_unreported", "input_tokens", "output_tokens", F.when(F.col("whole"), F.col("cost")).alias("cost_micros"), (~F.col("whole")).alias("is_partial"))


def adoption_matrix(results: DataFrame, dimensions: dict[str, list[str]]) -> DataFrame:
    """(dimension, value, n): cells of each expected value, also those without any. results has a column per dimension."""
    names = list(dimensions)
    long = results.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in names])).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
    wanted = results.sparkSession.createDataFrame([(d, v) for d in names for v in dimensions[d]], "dimension string, value string")
    return F.broadcast(wanted).join(long, ["dimension", "value"], "left").fillna(0, ["n"])


def adoption_summary(results: DataFrame, matrix: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: cells, green and other ones, medians, open issues of severity P0 and P1, acceptance.

    results (apply_ms, percent, state), issues (severity).
    """
    one = results.agg(F.count("*").alias("n_cells"), F.count_if(F.col("state") == "green").alias("n_green"))
    median = lambda c: medians(results.select(F.lit(0).alias("_"), c), ["_"], c).select(F.col("median").alias(f"median_{c}"))
    open_ = issues.agg(F.count_if(F.col("severity").rlike("^P[01]$")).alias("n_open"))
    shown = matrix.agg(F.bool_and(F.col("n") > 0).alias("represented"))
    # Four tables of one row.
    joined = one.join(median("apply_ms"), F.lit(True), "left").join(median("percent"), F.lit(True), "left").join(open_, F.lit(True), "left").join(shown, F.lit(True), "left")
    accepted = F.col("represented") & (F.col("n_open") == 0) & F.coalesce(F.col("median_percent") >= 90, F.lit(False))
    return joined.select("n_cells", "n_green", (F.col("n_cells") - F.col("n_green")).alias("n_adapt"), "median_apply_ms", "median_percent", "n_open", accepted.alias("accepted"))


def arm_comparison(cells: DataFrame) -> DataFrame:
    """cells (prompt, arm, n_violations, file, governed), a row a file -> (arm, n_prompts, means of violations and files, governed).

    A prompt's files that violate count once, however often each does.
    """
    own = cells.groupBy("arm", "prompt").agg(F.sum("n_violations").alias("v"), F.countDistinct(F.when(F.col("n_violations") > 0, F.col("file"))).alias("f"), F.max("governed").alias("g"))
    mean = lambda c: F.round(F.sum(c) / F.count("*"), 6)
    return own.groupBy("arm").agg(F.count("*").alias("n_prompts"), mean("v").alias("mean_violations"), mean("f").alias("mean_misplaced"), mean(F.coalesce("g", F.lit(0))).alias("mean_governed"))


def loop_cost(cases: DataFrame) -> DataFrame:
    """cases (arm, kind, turns, cheated) -> (arm, n_cases, n_green, median_turns, cheated_rate); median of type-only ones that came to green."""
    counts = cases.groupBy("arm").agg(F.count("*").alias("n_cases"), F.count_if((F.col("kind") == "type-only") & F.col("turns").isNotNull()).alias("n_green"), F.round(F.count_if("cheated") / F.count("*"), 6).alias("cheated_rate"))
    middle = medians(cases.where("kind = 'type-only' and turns is not null"), ["arm"], "turns")
    return counts.join(middle.withColumnRenamed("median", "median_turns"), "arm", "left").select("arm", "n_cases", "n_green", "median_turns", "cheated_rate")


def placement_turns(attempts: DataFrame, layer) -> DataFrame:
    """attempts (scenario, arm, turn, path, wanted) -> (scenario, arm, turns, landed): the first turn in the right layer.

    Where none is, one turn more than there are attempts. layer: Column -> Column of a path's layer.
    """
    right = layer(F.col("path")) == F.col("wanted")
    out = attempts.groupBy("scenario", "arm").agg(F.min(F.when(right, F.col("turn"))).alias("hit"), F.max("turn").alias("last"))
    return out.select("scenario", "arm", F.coalesce("hit", F.col("last") + 1).alias("turns"), F.col("hit").isNotNull().alias("landed"))


def placement_comparison(turns: DataFrame, base: str, other: str) -> DataFrame:
    """(scenario, base_turns, other_turns, delta, reduction, better) of two arms."""
    pick = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("turns")))
    both = turns.groupBy("scenario").agg(pick(base).alias("base_turns"), pick(other).alias("other_turns")).where("base_turns is not null and other_turns is not null")
    delta = F.col("base_turns") - F.col("other_turns")
    return both.select("scenario", "base_turns", "other_turns", delta.alias("delta"), F.round(delta / F.col("base_turns"), 6).alias("reduction"), (delta > 0).alias("better"))


def arm_outcomes(cells: DataFrame) -> DataFrame:
    """Per arm: turns, escapes, false blocks, bypasses, decisions, and how the last build ended.

    cells (arm, turns, escapes, false_blocks, bypasses, decisions, ci).
    """
    total = lambda c: F.sum(c).alias(c)
    ci = lambda x: F.count_if(F.col("ci") == x).alias(f"n_{x}")
    n = cells.groupBy("arm").agg(F.count("*").alias("n_cells"), *map(total, ("turns", "escapes", "false_blocks", "bypasses", "decisions")), *map(ci, ("green", "red", "not_run")))
    return n.withColumn("mean_turns", F.round(F.col("turns") / F.col("n_cells"), 6))


def primary_verdict(verdict: DataFrame, interval: DataFrame, below: float) -> DataFrame:
    """``experiment_verdict`` with the bootstrap's upper bound (one row): passed only if that is below ``below`` too."""
    both = verdict.join(interval.select("upper"), F.lit(True))
    return both.select("ratio", "completion_delta", "upper", (F.col("passed") & (F.col("upper") < below)).alias("passed"))
