"""Form features, strictly before each contest: last-ten windows, exponential averages, streaks, opponents' quality."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from duelkit.functions.values import safe_ratio
from duelkit.operators import scan
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The nine metrics, in the order of the published features.
METRICS = ["srv_1st_pct", "srv_2nd_pct", "srv_bp_saved_pct", "ret_pts_pct", "ret_bp_conv_pct", "hold_pct", "break_pct", "dominance_ratio", "pressure_index"]
SHORT_DAYS, LONG_DAYS, QUALITY_DAYS = 45.0, 120.0, 45.0
LAST, LEAST, LEAST_MOMENTUM = 10, 3, 6


def serve_return_metrics(pm: DataFrame) -> DataFrame:
    """Adds ``told`` (the contest has a date's text, readable or not), ``valid`` (told, and both sides have serve statistics) and
    the nine metrics, null on rows that aren't valid. The text is ``tourney_date_raw``, else ``tourney_date``; without either
    column all are told. Contests that aren't told have no form features, and no others count them."""
    date = next((c for c in ("tourney_date_raw", "tourney_date") if c in pm.columns), None)
    told = F.coalesce(F.trim(F.col(date).cast("string")) != "", F.lit(False)) if date else F.lit(True)
    need = [F.col(f"{s}{c}").isNotNull() for s in ("", "o_") for c in ("svpt", "1stIn", "1stWon", "2ndWon")]
    valid = told
    for n in need:
        valid = valid & n
    own_won, other_won = F.col("1stWon") + F.col("2ndWon"), F.col("o_1stWon") + F.col("o_2ndWon")
    bp_saved, ret_pts = safe_ratio("bpSaved", "bpFaced"), safe_ratio(F.col("o_svpt") - other_won, "o_svpt")
    conv = safe_ratio(F.col("o_bpFaced") - F.col("o_bpSaved"), "o_bpFaced")
    made = {
        "srv_1st_pct": safe_ratio("1stWon", "1stIn"),
        "srv_2nd_pct": safe_ratio("2ndWon", F.col("svpt") - F.col("1stIn")),
        "srv_bp_saved_pct": bp_saved,
        "ret_pts_pct": ret_pts,
        "ret_bp_conv_pct": conv,
        "hold_pct": 1 - safe_ratio(F.col("bpFaced") - F.col("bpSaved"), "SvGms"),
        "break_pct": safe_ratio(F.col("o_bpFaced") - F.col("o_bpSaved"), "o_SvGms"),
        "dominance_ratio": safe_ratio(ret_pts, 1 - safe_ratio(own_won, "svpt")),
        "pressure_index": bp_saved + conv,
    }
    return pm.withColumns({"told": told, "valid": valid} | {k: F.when(valid, v) for k, v in made.items()})


def shown(pm: DataFrame, columns: list[str]) -> DataFrame:
    """The features without those of contests that aren't told."""
    return pm.withColumns({c: F.when(F.col("told"), F.col(c)) for c in columns}) if "told" in pm.columns else pm


def _windows(order: list[str]) -> tuple[Window, Window, Window]:
    """Rows of the same validity up to this one; the last ten of them; all rows before this one."""
    same = Window.partitionBy("player_id", "valid").orderBy(*order)
    return same, same.rowsBetween(1 - LAST, 0), Window.partitionBy("player_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _carried(pm: DataFrame, after: dict[str, Column], order: list[str]) -> DataFrame:
    """What each value was after the player's last valid contest before this one."""
    before = _windows(order)[2]
    pm = pm.withColumns({f"_{k}": F.struct(v.alias("v")) for k, v in after.items()})
    return pm.withColumns({k: F.last(F.when(F.col("valid"), F.col(f"_{k}")), ignorenulls=True).over(before)["v"] for k in after}).drop(*[f"_{k}" for k in after])


def rolling(pm: DataFrame, order: list[str], digits: int = 4, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Adds ``r10_n`` and, for each of ``metrics``, ``r10_{metric}``: the mean of the known values of the last ten valid contests
    (at least three values; 4 digits as published), and ``momentum_*``: the mean of their later half less that of the earlier half
    (at least six values)."""
    ten = _windows(order)[1]
    after = {"r10_n": F.count("*").over(ten)}
    for m in metrics:
        after[f"r10_{m}"] = F.when(F.count(m).over(ten) >= LEAST, F.round(F.avg(m).over(ten), digits))
    for m in [m for m in ("dominance_ratio", "hold_pct") if m in metrics]:
        values = F.collect_list(m).over(ten)
        mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)
        half = F.floor(F.size(values) / 2).cast("int")
        late, early = F.slice(values, half + 1, F.size(values) - half), F.slice(values, 1, half)
        after[f"momentum_{m}"] = F.when(F.size(values) >= LEAST_MOMENTUM, F.round(mean(late) - mean(early), digits))
    return shown(_carried(pm, after, order).withColumn("r10_n", F.coalesce("r10_n", F.lit(0))), list(after))


def streak(pm: DataFrame, order: list[str], day: str = "day") -> DataFrame:
    """The contests of :func:`streak_from`."""
    return streak_from(pm, order, day)[0]


def streak_from(pm: DataFrame, order: list[str], day: str = "day", start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Adds ``streak``: the signed length of the run of equal results up to the last valid contest; 0 without one. Contests
    without ``day`` don't count, if there is such a column. Also returns each player's streak after the last contest
    (``player_id, _streak``), from which new contests go on (``start``)."""
    whole = pm.columns
    counts = F.col("valid") & F.col(day).isNotNull() if day in whole else F.col("valid")
    pm = pm.withColumns({"_valid": F.col("valid"), "valid": counts})
    same = _windows(order)[0]
    run = Window.partitionBy("player_id", "valid", "won").orderBy(*order)
    pm = pm.withColumns({"_at": F.row_number().over(same), "_island": F.row_number().over(same) - F.row_number().over(run)})
    length = F.row_number().over(Window.partitionBy("player_id", "valid", "won", "_island").orderBy(*order))
    if start is not None:  # the first run of equal results goes on from the stored one
        pm = pm.join(start.select("player_id", F.col("_streak").alias("_stored")), "player_id", "left")
        length = length + F.when((F.col("_island") == 0) & (F.signum("_stored") == 2 * F.col("won") - 1), F.abs("_stored")).otherwise(F.lit(0))
    pm = pm.withColumn("_length", F.when(F.col("won") == 1, length).otherwise(-length))
    out = _carried(pm, {"streak": F.col("_length")}, order)
    before = F.coalesce("_stored", F.lit(0)) if start is not None else F.lit(0)
    out = out.withColumn("streak", F.coalesce("streak", before))
    last = F.max_by(F.when(F.col("valid"), F.col("_length")).otherwise(F.col("streak")), F.struct(*order))
    after = out.groupBy("player_id").agg(last.cast("long").alias("_streak"))
    return shown(out.withColumn("valid", F.col("_valid")), ["streak"]).select(*whole, "streak"), after


def opponent_quality(pm: DataFrame, order: list[str], own: str = "elo", other: str = "o_elo", digits: tuple[int, int, int] = (2, 4, 4)) -> DataFrame:
    """Adds, over the last ten valid contests: mean rating of beaten opponents, the share of wins (with both ratings) that were
    over higher-rated ones, and the share of losses (with both ratings) to lower-rated ones; each needs three such contests."""
    ten = _windows(order)[1]
    both = F.col(own).isNotNull() & F.col(other).isNotNull()
    up, down = F.col(other) > F.col(own), F.col(other) < F.col(own)

    def mean(value: Column, among: Column, digits: int) -> Column:
        v = F.when(among, value)
        return F.when(F.count(v).over(ten) >= LEAST, F.round(F.avg(v).over(ten), digits))

    won = F.col("won") == 1
    made = {
        "r10_avg_opp_elo_beaten": mean(F.col(other).cast("double"), won & F.col(other).isNotNull(), digits[0]),
        "r10_upset_win_pct": mean(up.cast("double"), both & won, digits[1]),
        "r10_bad_loss_pct": mean(down.cast("double"), both & ~won, digits[2]),
    }
    return shown(_carried(pm, made, order), list(made))


def hard_12_months(pm: DataFrame, day: str = "day", surface: str = "surface_norm", digits: int = 4, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Adds ``hard_12mo_n`` and ``hard_12mo_{metric}``: the mean over valid contests on hard courts of the 365 days before
    (inclusive; the day itself not). A contest without a day counts for none, and has 0 and nulls."""
    dated = F.col(day).isNotNull()
    year = Window.partitionBy("player_id", dated).orderBy(day).rangeBetween(-365, -1)
    hard = F.col("valid") & (F.col(surface) == "Hard")
    made = {"hard_12mo_n": F.when(dated, F.count(F.when(hard, 1)).over(year)).otherwise(F.lit(0))}
    for m in metrics:
        v = F.when(hard, F.col(m))
        made[f"hard_12mo_{m}"] = F.when(dated & (F.count(v).over(year) >= LEAST), F.round(F.avg(v).over(year), digits))
    return shown(pm.withColumns(made), list(made))


def exponential(pm: DataFrame, order: list[str], day: str = "day", own: str | None = None, other: str | None = None, digits: int = 4, edge_digits: int = 2, start: DataFrame | None = None, metrics: Sequence[str] = METRICS) -> DataFrame:
    """The contests of :func:`exponential_from`."""
    return exponential_from(pm, order, day, own, other, digits, edge_digits, start, metrics)[0]


def _averaged(day: str, rated: bool, metrics: Sequence[str]) -> scan.Terms:
    """Averages as decaying sums: a new value's share is what the others lose, and the first value has all of it."""

    def one(there: np.ndarray, value: np.ndarray, seen: np.ndarray, gap: np.ndarray, half_life: float) -> tuple[np.ndarray, np.ndarray]:
        later = there & (seen > 0)
        d = np.where(later, np.where(gap > 0, gap / half_life, 1.0)[:, None], 0.0)
        return d, np.where(there, np.where(later, value * (1 - np.exp2(-d)), value), 0.0)

    def terms(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        days = scan.floats(rows, [day, "_day", *(["_day_edge"] if rated else [])])
        made = []
        if metrics:
            value, seen = scan.floats(rows, list(metrics)), scan.floats(rows, [f"_n_{m}" for m in metrics])
            there = rows["_used"].to_numpy()[:, None] & ~np.isnan(value)
            made = [one(there, value, seen, days[:, 0] - days[:, 1], h) for h in (SHORT_DAYS, LONG_DAYS)]
        if rated:
            made.append(one(rows["_better"].to_numpy()[:, None], scan.floats(rows, ["_gain"]), scan.floats(rows, ["_n_edge"]), days[:, 0] - days[:, 2], QUALITY_DAYS))
        return tuple(np.concatenate(x, axis=1) for x in zip(*made, strict=True))

    return terms


def exponential_from(pm: DataFrame, order: list[str], day: str = "day", own: str | None = None, other: str | None = None, digits: int = 4, edge_digits: int = 2, start: DataFrame | None = None, metrics: Sequence[str] = METRICS) -> tuple[DataFrame, DataFrame]:
    """Adds, for ``metrics``, ``ema_*`` (45 days), ``ema_long_*`` (120 days; at least three values, rounded to ``digits``), and the counts
    ``ema_n`` and ``ema_long_n`` (always of the first of all metrics), ``delta_form_*``; with ratings also ``quality_ema`` over wins
    (rounded to ``edge_digits``), and its count. Also returns the state after each player's last contest (a row a player), from
    which new contests go on (``start``).

    A new value weighs 1 - 2^-(days since the last used contest / half-life), one half on the same day, and the first one 1.
    A used contest is valid and has a day; one without a value leaves that average, but the date moves on. The averages are
    decaying sums (:mod:`duelkit.operators.scan`). Rows of equal ``order`` follow each other in an order of their own."""
    rated = own is not None and other is not None
    known = pm.columns
    pm = scan.in_blocks(pm, order)
    used = F.col("valid") & F.col(day).isNotNull()
    edge = (F.col(other) - F.col(own)).cast("double") if rated else F.lit(None).cast("double")
    better = used & (F.col("won") == 1) & edge.isNotNull()
    counts = {f"_n_{m}": F.when(used & F.col(m).isNotNull(), 1).otherwise(0) for m in dict.fromkeys([METRICS[0], *metrics])} | ({"_n_edge": F.when(better, 1).otherwise(0)} if rated else {})
    lasts = {"_day": (used, F.col(day).cast("double"))} | ({"_day_edge": (better, F.col(day).cast("double"))} if rated else {})
    pm = scan.carried_in(pm, counts, lasts, start)

    names = [*[f"_{p}_{m}" for p in ("ema", "ema_long") for m in metrics], *(["_edge"] if rated else [])]
    pm, state = scan.scan(pm.withColumns({"_used": used, "_better": better, "_gain": F.when(better, edge)}), names, _averaged(day, rated, metrics), start)
    totals = pm.groupBy("player_id").agg(F.max_by(F.struct(*[(F.col(k) + v).alias(k) for k, v in counts.items()], *[F.when(rows, v).otherwise(F.col(k)).alias(k) for k, (rows, v) in lasts.items()]), "_row").alias("s"))
    state = state.join(totals.select("player_id", "s.*"), "player_id")
    out = {}
    for prefix in ("ema", "ema_long"):
        out[f"{prefix}_n"] = F.col(f"_n_{METRICS[0]}").cast("long")
        for m in metrics:
            out[f"{prefix}_{m}"] = F.when(F.col(f"_n_{m}") >= LEAST, F.round(f"_{prefix}_{m}", digits))
    for m in metrics:
        out[f"delta_form_{m}"] = F.round(out[f"ema_{m}"] - out[f"ema_long_{m}"], digits)
    if rated:
        out |= {"quality_ema": F.when(F.col("_n_edge") >= LEAST, F.round("_edge", edge_digits)), "quality_ema_n": F.col("_n_edge").cast("long")}
    return shown(pm.withColumns(out).select(*known, *out), list(out)), state
