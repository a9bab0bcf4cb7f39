"""Joining market odds on year and unordered pair of name keys."""

from __future__ import annotations

from duelkit.functions.names import extract_year, matchup, player_key_first_last, player_key_last_initial
from duelkit.sources.tables import ODDS
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def odds_keys(odds: DataFrame) -> DataFrame:
    keyed = odds.withColumns({"_w": player_key_last_initial("Winner"), "_l": player_key_last_initial("Loser")})
    return keyed.withColumns({"_year": extract_year("Date"), "matchup_id": matchup("_w", "_l"), "odds_w_key": F.col("_w")}).drop("_w", "_l")


def match_keys(matches: DataFrame, date: str = "tourney_date") -> DataFrame:
    keyed = matches.withColumns({"_w": player_key_first_last("winner_name"), "_l": player_key_first_last("loser_name")})
    return keyed.withColumns({"_year": extract_year(F.col(date).cast("string")), "matchup_id": matchup("_w", "_l"), "match_w_key": F.col("_w")}).drop("_w", "_l")


def dedup_odds(odds: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each (year, pair) in file and row order; null years are equal."""
    first = Window.partitionBy("_year", "matchup_id").orderBy(*order)
    return odds.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def merge_odds(matches: DataFrame, odds: DataFrame, order: list[str], orient: bool = False) -> DataFrame:
    """Left join of keyed contests with the first odds of their year and pair; null years match each other.

    The odds row's winner need not be this contest's: with ``orient`` the two sides' odds are swapped where they differ.
    Spark broadcasts the odds if they are small by its own threshold; blank keys are left out of them."""
    columns = [c for c in ODDS if c in odds.columns]
    first = dedup_odds(odds.where("matchup_id <> '__vs__'"), order).select(F.col("_year").alias("_y"), F.col("matchup_id").alias("_m"), "odds_w_key", *columns)
    out = matches.join(first, F.col("_year").eqNullSafe(F.col("_y")) & (F.col("matchup_id") == F.col("_m")), "left")
    if orient:
        swap = F.col("odds_w_key") != F.col("match_w_key")
        partner = {c: c[:-1] + ("L" if c.endswith("W") else "W") for c in columns}
        out = out.withColumns({c: F.when(swap, F.col(p)).otherwise(F.col(c)) for c, p in partner.items() if p in columns})
    return out.drop("_y", "_m", "odds_w_key", "match_w_key", "_year", "matchup_id")
