"""The total order of contests, and the player's side of them."""

from __future__ import annotations

from duelkit.sources.tables import SERVE, kept
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chronological_order(df: DataFrame, *keys: Column | str, seq: str = "seq") -> DataFrame:
    """Numbers rows from 0 by ``keys`` without a global window: a range-partitioned sort is written once; partitions'
    counts, one row each, become offsets. Rows of equal keys keep an order of their own, the same for every reader."""
    ordered = kept(df.orderBy(*keys).withColumn("_uid", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_uid", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of the sort
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.col("_uid").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(seq, F.col("_before") + own).drop("_part", "_before", "_uid")


def unique_order(df: DataFrame, order: list[str], name: str = "_seq") -> tuple[DataFrame, str]:
    """``df`` and a column that orders its rows without ties or nulls: ``seq`` if that is the order asked for (it is taken to be
    unique and not null, as :func:`duelkit.operators.clean.with_seq` makes it), else ``name``, numbered here by ``order``."""
    if list(order) == ["seq"]:
        return df, "seq"
    return chronological_order(df, *order, seq=name), name


def ranked(df: DataFrame, by: list[str], *keys: Column | str) -> DataFrame:
    """Adds ``rank`` (from 1, by ``keys``) and ``rank_of`` (how many) within each group of ``by``, however large: rows are
    numbered over all groups, and a group's first number, one row each, is taken off."""
    numbered = chronological_order(df, *by, *keys, seq="_at")
    groups = numbered.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(F.min("_at").alias("_first"), F.count("*").alias("rank_of"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    joined = numbered.join(groups, same) if by else numbered.crossJoin(F.broadcast(groups))
    return joined.select(*df.columns, (F.col("_at") - F.col("_first") + 1).alias("rank"), "rank_of")


def sides(df: DataFrame, keep: list[str], stats: list[str] | None = None) -> DataFrame:
    """Two rows a contest: ``player_id, opponent_id, won, side``, own and opponent's (``o_``) statistics; one pass."""
    stats = [c for c in (SERVE if stats is None else stats) if f"w_{c}" in df.columns]

    def side(own: str, other: str, name: str, rival: str) -> Column:
        columns = [F.col(f"{own}_{c}").alias(c) for c in stats] + [F.col(f"{other}_{c}").alias(f"o_{c}") for c in stats]
        return F.struct(F.lit(own).alias("side"), F.col(f"{name}_id").alias("player_id"), F.col(f"{rival}_id").alias("opponent_id"), F.lit(int(own == "w")).alias("won"), *columns)

    both = F.array(side("w", "l", "winner", "loser"), side("l", "w", "loser", "winner"))
    return df.select(*keep, F.inline(both)).where("player_id is not null")


def attach_sides(df: DataFrame, features: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """``df`` with a player's features back on the contest: ``w_*`` and ``l_*`` of every column. ``features`` has ``key``, which names
    a contest, and ``side``; a contest without a row for a side has nulls there."""
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.struct(F.col(c).alias("v"))))["v"].alias(f"{s}_{c}")
    each = features.groupBy(*key).agg(*[pick(s, c) for s in "wl" for c in columns])
    return df.join(each, key, "left")
