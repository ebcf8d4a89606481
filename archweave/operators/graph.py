"""Value graphs, cycles and intent graphs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archweave.keys import scope, shared, sized
from archweave.lineage import cut
from archweave.ship import ship_package


def value_graph(edges: DataFrame, governed: DataFrame) -> DataFrame:
    """Distinct (keys, from_path, to_path) that aren't type-only nor self, between governed files (keys, path)."""
    keys, on = scope(edges), shared(edges, governed)
    found = edges.where(~F.col("type_only") & F.col("to_path").isNotNull() & (F.col("from_path") != F.col("to_path"))).select(*keys, "from_path", "to_path").distinct()
    found = found.join(governed.select(*on, F.col("path").alias("from_path")), [*on, "from_path"], "left_semi")
    return found.join(governed.select(*on, F.col("path").alias("to_path")), [*on, "to_path"], "left_semi").select(*keys, "from_path", "to_path")


def strong_components(edges: list[tuple[str, str]]) -> list[list[str]]:
    """Strongly connected components of more than one node, members sorted; iterative, by two passes."""
    ahead: dict[str, list[str]] = {}
    back: dict[str, list[str]] = {}
    for a, b in edges:
        ahead.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    done: list[str] = []
    seen: set[str] = set()
    for root in ahead:
        if root in seen:
            continue
        seen.add(root)
        path = [(root, iter(ahead.get(root, ())))]
        while path:
            node, rest = path[-1]
            for n in rest:
                if n not in seen:
                    seen.add(n)
                    path.append((n, iter(ahead.get(n, ()))))
                    break
            else:
                done.append(node)
                path.pop()
    taken: set[str] = set()
    out = []
    for root in reversed(done):
        if root in taken:
            continue
        taken.add(root)
        members, open_ = [root], [root]
        while open_:
            for n in back.get(open_.pop(), ()):
                if n in seen and n not in taken:
                    taken.add(n)
                    members.append(n)
                    open_.append(n)
        if len(members) > 1:
            out.append(sorted(members))
    return out


def _ends(edges: DataFrame, name: str) -> DataFrame:
    return edges.select("repo", F.col(name).alias("node")).distinct()


def trimmed(graph: DataFrame, rounds: int) -> DataFrame:
    """Edges without those that start or end in no cycle for sure: nodes without a way in or out go, a few rounds."""
    for _ in range(rounds):
        starts = _ends(graph, "from_path").withColumnRenamed("node", "to_path")
        ends = _ends(graph, "to_path").withColumnRenamed("node", "from_path")
        graph = cut(graph.join(starts, ["repo", "to_path"], "left_semi").join(ends, ["repo", "from_path"], "left_semi").select("repo", "from_path", "to_path"))
    return graph


def _state(table: DataFrame) -> tuple:
    """Tells two tables of one loop apart."""
    return tuple(table.agg(F.count("*"), F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)"))).first())


def _until_stable(table: DataFrame, step) -> DataFrame:
    table, seen = cut(table), None
    while seen != (now := _state(table)):
        seen, table = now, cut(step(table))
    return table


def reach_members(graph: DataFrame, rounds: int = 3) -> DataFrame:
    """(repo, anchor, node) of all cycle groups, by joins alone: for repositories that no single task can hold.

    Each pass colours nodes by the greatest node that leads to them. Those that lead back to their colour's own node,
    inside the colour, are its group. Groups go, edges between colours go, and what is left is coloured again. Every
    step is written to the checkpoint folder; passes end when no edge is left.
    """
    found, rest = None, trimmed(graph, rounds)
    while not rest.isEmpty():
        nodes = _ends(rest, "from_path").union(_ends(rest, "to_path")).distinct()

        def forward(colours: DataFrame, rest=rest) -> DataFrame:
            told = rest.join(colours.withColumnRenamed("node", "from_path"), ["repo", "from_path"]).select("repo", F.col("to_path").alias("node"), "colour")
            return colours.union(told).groupBy("repo", "node").agg(F.max("colour").alias("colour"))

        colours = _until_stable(nodes.withColumn("colour", F.col("node")), forward)
        side = lambda end, c: colours.select("repo", F.col("node").alias(end), F.col("colour").alias(c))  # noqa: E731, B023
        inner = cut(rest.join(side("from_path", "a"), ["repo", "from_path"]).join(side("to_path", "b"), ["repo", "to_path"]).where("a = b").select("repo", "from_path", "to_path", F.col("a").alias("colour")))

        def backward(reached: DataFrame, inner=inner) -> DataFrame:
            told = inner.join(reached.withColumnRenamed("node", "to_path"), ["repo", "to_path", "colour"]).select("repo", F.col("from_path").alias("node"), "colour")
            return reached.union(told).distinct()

        groups = _until_stable(colours.where("node = colour").select("repo", "node", "colour"), backward)
        found = groups if found is None else found.union(groups)
        done = groups.select("repo", "node")
        rest = inner.join(done.withColumnRenamed("node", "from_path"), ["repo", "from_path"], "left_anti").join(done.withColumnRenamed("node", "to_path"), ["repo", "to_path"], "left_anti")
        rest = trimmed(rest.select("repo", "from_path", "to_path"), rounds)
    if found is None:
        return graph.select("repo", F.col("from_path").alias("anchor"), F.col("from_path").alias("node")).limit(0)
    anchor = found.groupBy("repo", "colour").agg(F.min("node").alias("anchor"), F.count("*").alias("n")).where("n > 1")
    return found.join(anchor, ["repo", "colour"]).select("repo", "anchor", "node")


#: Edges of a repository that one task may hold.
ONE_TASK = 2_000_000


def find_cycles(graph: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(repo, anchor, n_members, members): one row for each cycle group of a repository; anchor is its first member.

    Repositories of up to ``one_task`` edges are a task's work each; larger ones go through ``reach_members``. Each snapshot
    is a graph of its own.
    """
    keys = scope(graph)
    if len(keys) > 1:
        named = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("repo")
        found = find_cycles(graph.select(named, "from_path", "to_path"), one_task)
        told = F.from_json("repo", ", ".join(f"{k} {graph.schema[k].dataType.simpleString()}" for k in keys))
        return found.withColumn("_at", told).select(*[F.col("_at")[k].alias(k) for k in keys], "anchor", "n_members", "members")
    ship_package(graph.sparkSession)
    graph = cut(graph.select("repo", "from_path", "to_path"))
    giants = graph.groupBy("repo").agg(F.count("*").alias("n")).where(F.col("n") > one_task).select("repo")

    def run(table: pa.Table) -> pa.Table:
        found = strong_components(list(zip(table["from_path"].to_pylist(), table["to_path"].to_pylist(), strict=True)))
        return pa.table(
            {
                "repo": pa.array([table["repo"][0].as_py()] * len(found), pa.string()),
                "anchor": pa.array([m[0] for m in found], pa.string()),
                "n_members": pa.array([len(m) for m in found], pa.int64()),
                "members": pa.array([",".join(m) for m in found], pa.string()),
            }
        )

    schema = "repo string, anchor string, n_members long, members string"
    if giants.isEmpty():
        return graph.groupBy("repo").applyInArrow(run, schema)
    giants = cut(giants)
    members = reach_members(graph.join(giants, "repo", "left_semi"))
    large = members.groupBy("repo", "anchor").agg(F.count("*").alias("n_members"), F.array_join(F.array_sort(F.collect_list("node")), ",").alias("members"))
    return graph.join(giants, "repo", "left_anti").groupBy("repo").applyInArrow(run, schema).union(large)


def intent_cycles(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """edges (from_intent, to_intent) -> (anchor, n_members, members) of intents that lead back to themselves."""
    graph = edges.where("from_intent <> to_intent").select(F.lit("").alias("repo"), F.col("from_intent").alias("from_path"), F.col("to_intent").alias("to_path")).distinct()
    return find_cycles(graph, one_task).select("anchor", "n_members", "members")


def apply_cycle_policy(cycles: DataFrame, policies: DataFrame) -> DataFrame:
    """policies (repo, cycle_policy): strict blocks, soft and framework-soft warn, off drops."""
    joined = cycles.join(sized(policies, 10_000), shared(cycles, policies))
    return joined.where("cycle_policy <> 'off'").select(*scope(cycles), F.lit("CIRCULAR_DEPENDENCY").alias("rule_id"), F.col("anchor").alias("file"), (F.col("cycle_policy") == "strict").alias("blocking"))


def intent_graph(flows: DataFrame) -> DataFrame:
    """Distinct edges (from_intent, to_intent, kind) and how often each was seen."""
    return flows.groupBy("from_intent", "to_intent", "kind").agg(F.count("*").alias("n"))


def layered_graph(edges: DataFrame, layer) -> DataFrame:
    """(layer, n_nodes, n_sources): intents by layer, those without one in Unclassified. layer: Column -> Column."""
    nodes = edges.select(F.col("from_intent").alias("node"), F.lit(1).alias("out")).union(edges.select("to_intent", F.lit(0))).groupBy("node").agg(F.max("out").alias("out"))
    return nodes.groupBy(F.coalesce(layer(F.col("node")), F.lit("Unclassified")).alias("layer")).agg(F.count("*").alias("n_nodes"), F.sum("out").cast("long").alias("n_sources"))


def flow_drift(flows: DataFrame) -> DataFrame:
    """(from_intent, to_intent, drift): declared but never observed, or observed but not declared."""
    pairs = flows.groupBy("from_intent", "to_intent").agg(F.bool_or(F.col("kind") != "observed").alias("declared"), F.bool_or(F.col("kind") == "observed").alias("observed"))
    drift = F.when(~F.col("observed"), "unobserved").when(~F.col("declared") & (F.col("from_intent") != "unknown"), "undeclared")
    return pairs.select("from_intent", "to_intent", drift.alias("drift")).where("drift is not null")
