"""Form, workload and head-to-head records from stored state: new contests go on without reading history again.

What is stored of a player's past is what later contests can still see: the rows that windows reach (the last ten valid
contests, and those within a year of the last dated one), and the state of what goes on for ever (averages, loads, streak).
Of a pair it is the contests and the wins of its first player, in all and by surface."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from duelkit.operators import fatigue, form, h2h, scan
from duelkit.sources.tables import kept
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days that some window looks back.
REACH = 365


class Store(NamedTuple):
    """``rows``: players' rows that windows still reach; ``players``: a row a player."""

    rows: DataFrame
    players: DataFrame


def recent(pm: DataFrame, order: list[str], day: str = "day") -> DataFrame:
    """The rows that a later contest's windows can reach: of each player the last ten valid ones, and those of the last year.
    Contests that aren't told are in no window."""
    back = Window.partitionBy("player_id", "valid").orderBy(*[F.desc_nulls_last(c) for c in order])
    last = F.max(day).over(Window.partitionBy("player_id"))
    told = pm.withColumns({"_back": F.row_number().over(back), "_last": last})
    return told.where((F.col("valid") & (F.col("_back") <= form.LAST)) | (F.col(day) >= F.col("_last") - REACH)).drop("_back", "_last")


def player_features(pm: DataFrame, order: list[str], store: Store | None = None, digits: int = 4, keep: Sequence[str] | None = None, after: bool = True, metrics: Sequence[str] = form.METRICS) -> tuple[DataFrame, Store | None]:
    """All form and workload features (of them ``keep``, if given) of the new rows ``pm`` (of :func:`form.serve_return_metrics`, with ``day, elo, o_elo, sets,
    minutes``), and the store after them (none without ``after``). ``order`` orders rows without ties, and new rows come after those of the store.

    ``metrics`` are those whose form is asked for; a store serves these ones. Features are the same whether history comes in one run or in several."""
    source = pm.columns
    wanted = lambda df: df if keep is None else df.select(*[c for c in df.columns if c in source or c in ("_new", "_row", "_block") or c in keep])
    new = pm.withColumn("_new", F.lit(True))
    wide = new if store is None else new.unionByName(store.rows.select(*source).withColumn("_new", F.lit(False)))
    start = None if store is None else store.players
    out = scan.in_blocks(wide, order)  # one numbering for both scans, of narrow rows
    out = form.hard_12_months(form.opponent_quality(form.rolling(out, order, digits, metrics), order), digits=digits, metrics=metrics)
    out = wanted(fatigue.load_30_days(fatigue.rest_days(out, order), order)).where("_new").drop("_new")
    out, averages = form.exponential_from(out, order, own="elo", other="o_elo", digits=digits, start=start, metrics=metrics)
    out, loads = fatigue.fatigue_from(wanted(out), order, start=start)
    out, streaks = form.streak_from(wanted(out), order, start=start)
    out = wanted(out).drop("_row", "_block")
    if not after:
        return out, None
    players = averages.join(loads, "player_id").join(streaks, "player_id")
    if store is not None:
        players = players.unionByName(store.players.join(players.select("player_id"), "player_id", "left_anti"))
    return out, Store(kept(recent(wide.drop("_new"), order), "recent"), kept(players, "players"))


def pair_features(df: DataFrame, order: list, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`h2h.head_to_head` of new contests after stored ``pairs``, and the pairs after them."""
    made = h2h.head_to_head(df, order, start=pairs)
    now = h2h.pair_counts(df)
    both = now if pairs is None else now.unionByName(pairs).groupBy("a", "b", "surface").agg(F.sum("n").alias("n"), F.sum("a_won").alias("a_won"))
    return made, kept(both, "pairs")

