"""Merkle manifest of a table: a tree of hashes for each group of rows, one over the groups' roots, a proof for each row.

Leaves of a group, in order, are hashed in runs of ``FANOUT``; while several nodes remain, each run of them (the last may
be shorter, even one node) becomes the SHA-256 of their hex texts. The roots of the groups, by group (null first, then
by bytes), are the leaves of one more tree. A proof lists, level by level, what stands before and after a node in its run;
whoever has a leaf and its proof recomputes the root (``folded``) without the table.

Places in a group come from a range sort, whose partitions are numbered by counts of (partition, group). Aligned blocks of
``FANOUT ** LEVELS`` leaves are then hashed by one task each; above them blocks exchange roots as a butterfly. In round r,
each block knows the root of its aligned group of FANOUT ** r blocks, sends it to its partners (the blocks at
the same place in the other groups of its run), and hashes what it receives, as all blocks of the run do redundantly; the siblings
are noted on the way. After the last round every block has the upper part of its proofs, and nothing is passed down.
Where the last group of a run is incomplete, its blocks also serve the partners that they lack, dealt evenly. Messages
carry one hash; a block sends and receives at most FANOUT - 1 a round, but for such blocks.

Texts are read once, by map tasks that hash the leaves; what is sorted, exchanged and checkpointed has two digests and
the order's columns a row.

Defined results: null fields are hashed as ``-``; rows with a null order column come first in their group; rows of
the same order are ordered by leaf, equal leaves at will; a null group is one of its own; a group of one row has its leaf
for root; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archweave.lineage import cut
from archweave.ship import ship_package

FANOUT, LEVELS = 8, 3
#: Rows of (partition, group) counts that are broadcast; more are joined.
SMALL = 1_000_000
SIBLINGS = "array<struct<before: string, after: string>>"
_PAIR = pa.struct([("before", pa.string()), ("after", pa.string())])
_UPPER = "abcdefghijklmnopqrstuvwxyz".upper()


def field(value: Column) -> Column:
    """``-`` if null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def lower_cased(text: Column) -> Column:
    """A-Z only."""
    return F.translate(text, _UPPER, _UPPER.lower())


def folded(start: Column, siblings: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(siblings, start, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proof_digest(siblings: Column) -> Column:
    return F.sha2(F.array_join(F.transform(siblings, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def _sized(df: DataFrame, most: int = SMALL) -> DataFrame:
    """To be broadcast, if it has few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def placed(nodes: DataFrame) -> DataFrame:
    """(group, order, node) and what else ``nodes`` has, with each row's place in its group (``pos``) and the group's size (``total``)."""
    slim = cut(nodes.withColumn("_row", F.monotonically_increasing_id()))
    ordered = cut(slim.repartitionByRange("group", "order", "node", "_row").sortWithinPartitions("group", "order", "node", "_row").drop("_row"))
    at = F.monotonically_increasing_id()  # partition and place in it, as checkpointed
    numbered = ordered.select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    counts = cut(numbered.groupBy("group", "part").agg(F.min("at").alias("begin"), F.count("*").alias("n")))
    group = W.partitionBy("group")
    before = F.sum("n").over(group.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(F.col("group").alias("_group"), F.col("part").alias("_part"), (F.coalesce(before, F.lit(0)) - F.col("begin")).alias("move"), F.sum("n").over(group).alias("total"))
    joined = numbered.join(_sized(cut(starts)), F.col("group").eqNullSafe(F.col("_group")) & (F.col("part") == F.col("_part")))
    return joined.select(*nodes.columns, (F.col("at") + F.col("move")).alias("pos"), "total")


def _heights(total: Column, fanout: int) -> Column:
    """Levels of a tree of so many leaves."""
    return sum((F.when(total > fanout**t, 1).otherwise(0) for t in range(1, 64) if fanout**t < 1 << 62), F.when(total > 1, 1).otherwise(0))


def _subtree(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    tree = [nodes]
    for _ in range(levels):
        below = tree[-1]
        tree.append([sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return tree


def _block_root(fanout: int, levels: int):
    def f(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        top = _subtree(table["node"].to_pylist(), min(levels, table["height"][0].as_py()), fanout)[-1]
        first = table.slice(0, 1)
        return pa.table({"group": first["group"], "block": first["block"], "blocks": first["blocks"], "node": pa.array(top, pa.string())})

    return f


def _exchange(blocks: DataFrame, width: int, fanout: int) -> DataFrame:
    """One round: groups of ``width`` blocks learn each other's roots and become groups of ``fanout`` times as many."""
    groups = F.ceil(F.col("blocks") / width).cast("long")
    mine = F.expr(f"block div {width}")
    place = F.col("block") % width
    size = lambda g: F.least(F.lit(width).cast("long"), F.col("blocks") - g * width)
    first = mine - mine % fanout
    others = F.sequence(first, F.least(first + fanout, groups) - 1)
    none = F.array().cast("array<long>")
    partners = lambda g: F.when(g == mine, F.array("block")).when(place < size(g), F.transform(F.sequence(place, size(g) - 1, size(mine)), lambda p: g * width + p)).otherwise(none)
    own = F.when(F.col("to") == F.col("block"), F.struct("blocks", "siblings"))
    sent = blocks.select("*", mine.alias("from"), F.explode(F.flatten(F.transform(others, partners))).alias("to")).select("group", "to", "from", "node", own.alias("own"))
    met = sent.groupBy("group", "to").agg(F.sort_array(F.collect_list(F.struct("from", "node"))).alias("run"), F.first("own", ignorenulls=True).alias("own"))
    at = F.expr(f"to div {width}")
    nodes = lambda keep: F.array_join(F.transform(F.filter("run", keep), lambda m: m["node"]), "")
    sibling = F.struct(nodes(lambda m: m["from"] < at).alias("before"), nodes(lambda m: m["from"] > at).alias("after"))
    several = F.col("own.blocks") > width
    return met.select(
        "group",
        F.col("to").alias("block"),
        F.col("own.blocks").alias("blocks"),
        F.when(several, F.sha2(nodes(lambda m: F.lit(True)), 256)).otherwise(F.col("run")[0]["node"]).alias("node"),
        F.when(several, F.concat("own.siblings", F.array(sibling))).otherwise(F.col("own.siblings")).alias("siblings"),
    )


def _with_proofs(carried: list[str], told: list[str], fanout: int, levels: int):
    """carried: columns of the rows to keep; told: columns of the block's row that hold for all of them."""

    def f(key: tuple, table: pa.Table, upper: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        tree = _subtree(table["node"].to_pylist(), min(levels, table["height"][0].as_py()), fanout)
        above = [(s["before"], s["after"]) for s in upper["siblings"][0].as_py()]
        before, after = [], []
        for i in range(table.num_rows):
            for below in tree[:-1]:
                start = i - i % fanout
                before.append("".join(below[start:i]))
                after.append("".join(below[i + 1 : start + fanout]))
                i //= fanout
            for b, a in above:
                before.append(b)
                after.append(a)
        each = len(tree) - 1 + len(above)
        pairs = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], fields=list(_PAIR))
        ends = pa.array(range(0, each * table.num_rows + 1, each) if each else [0] * (table.num_rows + 1), pa.int32())
        same = {c: pa.array([upper[c][0].as_py()] * table.num_rows, pa.string()) for c in told}
        return pa.table({c: table[c] for c in carried} | same | {"siblings": pa.ListArray.from_arrays(ends, pairs)})

    return f


def climbed(rows: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Placed rows in their blocks, and of each block (group, block, root, siblings): the part of its proofs above it."""
    size = fanout**levels
    in_blocks = rows.withColumn("block", F.expr(f"pos div {size}")).withColumn("blocks", F.ceil(F.col("total") / size).cast("long")).withColumn("height", _heights(F.col("total"), fanout))
    slim = in_blocks.select("group", "block", "blocks", "pos", "node", "height")
    blocks = slim.groupBy("group", "block").applyInArrow(_block_root(fanout, levels), "group string, block long, blocks long, node string")
    blocks = cut(blocks.withColumn("siblings", F.array().cast(SIBLINGS)))
    width, most = 1, blocks.agg(F.max("blocks")).first()[0] or 0
    while width < most:
        blocks = _exchange(blocks, width, fanout)
        width *= fanout
    return in_blocks, cut(blocks) if width > 1 else blocks


def manifest(docs: DataFrame, fields: list[str], group: str, order: str, presented: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Per row: ``order``, leaf, subroot, root, siblings (the proof, level by level), and ``presented``: another leaf to
    be held against the proof, as a Column of ``docs``; by default the leaf itself."""
    ship_package(docs.sparkSession)
    own = leaf([F.col(c) for c in fields])
    nodes = docs.select(F.col(group).cast("string").alias("group"), F.col(order).alias("order"), own.alias("node"), (own if presented is None else presented).alias("presented"))
    in_blocks, upper = climbed(placed(nodes), fanout, levels)
    # The tree over the groups: one row each, by the same steps.
    subroots = upper.where("block = 0").select(F.lit("").alias("group"), F.col("group").alias("order"), "node")
    top_blocks, top = climbed(placed(subroots), fanout, levels)
    top = top.select("group", "block", F.col("node").alias("root"), "siblings")
    tops = top_blocks.groupBy("group", "block").cogroup(top.groupBy("group", "block")).applyInArrow(
        _with_proofs(["order"], ["root"], fanout, levels), f"order string, root string, siblings {SIBLINGS}"
    )
    tops = cut(tops.select(F.col("order").alias("_group"), "root", F.col("siblings").alias("top")))
    known = upper.join(_sized(tops), F.col("group").eqNullSafe(F.col("_group"))).select("group", "block", F.col("node").alias("subroot"), "root", F.concat("siblings", "top").alias("siblings"))
    rows = in_blocks.select("group", "block", "pos", "height", "order", "node", "presented")
    kind = rows.schema["order"].dataType.simpleString()
    proofs = rows.groupBy("group", "block").cogroup(known.groupBy("group", "block")).applyInArrow(
        _with_proofs(["order", "node", "presented"], ["subroot", "root"], fanout, levels),
        f"order {kind}, node string, presented string, subroot string, root string, siblings {SIBLINGS}",
    )
    return proofs.select(F.col("order").alias(order), F.col("node").alias("leaf"), "presented", "subroot", "root", "siblings")
