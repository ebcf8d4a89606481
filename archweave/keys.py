"""What facts are keyed by: a repository, and one snapshot of it where tables hold several."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPE = ("repo", "snapshot")


def scope(df: DataFrame) -> list[str]:
    """The keys that a table has."""
    return [k for k in SCOPE if k in df.columns]


def shared(facts: DataFrame, other: DataFrame) -> list[str]:
    """What facts join another table on. That table may hold for all snapshots, as contracts do; the other way round, facts would meet every snapshot's rows."""
    lost = [k for k in scope(other) if k not in facts.columns]
    if lost:
        raise ValueError(f"facts lack {', '.join(lost)}, which the other table is keyed by")
    return scope(other)


def sized(df: DataFrame, most: int) -> DataFrame:
    """To be broadcast, if it has ``most`` rows or fewer; nothing is cut off."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
