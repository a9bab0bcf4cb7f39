"""Checks and profiles of contest tables: counts, gaps, coverage."""

from __future__ import annotations

from duelkit.functions.values import count_sets, is_bad_date, is_decisive, normalize_indoor, parse_date
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _missing(c: str) -> Column:
    return F.col(f"`{c}`").isNull() | (F.trim(F.col(f"`{c}`").cast("string")) == "")


def _share(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits)


def count_where(c: Column) -> Column:
    return F.count(F.when(c, 1))


def _header(df: DataFrame) -> Column:
    """The columns of a row's file: ``source_columns`` where reading has noted them, else all of ``df``."""
    return F.col("source_columns") if "source_columns" in df.columns else F.lit(df.columns).cast("array<string>")


def check_files(df: DataFrame, expected: list[str], file: str = "source_file", files: DataFrame | None = None) -> DataFrame:
    """Rows, columns and missing expected columns (absent from the header) of each file; ok if it has rows and all.

    ``files`` are the names of all files, in the column ``file``: those without a row are reported then, as not ok and
    without columns. Else a file without a row has none here either."""
    out = df.groupBy(file).agg(F.count("*").alias("n_rows"), F.first(_header(df)).alias("header"))
    if files is not None:
        named = files.select(file).distinct().join(out, file, "left")
        out = named.select(file, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("header", F.array().cast("array<string>")).alias("header"))
    gone = F.array_except(F.lit(expected).cast("array<string>"), F.col("header"))
    return out.select(file, "n_rows", F.size("header").alias("n_columns"), F.array_join(gone, ",").alias("missing"), ((F.col("n_rows") > 0) & (F.size(gone) == 0)).alias("ok"))


def missing_rate(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Percentage of empty values of each column by year (or another key), in one pass. ``0`` isn't missing; a column that no
    file of the key has is null, not 100."""
    has = lambda c: F.bool_or(F.array_contains(_header(df), c))
    rate = lambda c: F.round(100 * F.avg(F.when(_missing(c), 1.0).otherwise(0.0)), 2)
    return df.groupBy(by).agg(*[F.when(has(c), rate(c)).alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns])


def clean_summary(df: DataFrame, date: str = "tourney_date_raw", file: str = "source_file") -> DataFrame:
    """Rows, bad dates and first and last date of each file."""
    day = parse_date(date)
    return df.groupBy(file).agg(F.count("*").alias("n_rows"), count_where(is_bad_date(date)).alias("bad_dates"), F.min(day).alias("first_date"), F.max(day).alias("last_date"))


def surface_counts(df: DataFrame, surface: str = "surface_norm") -> DataFrame:
    return df.groupBy(surface).agg(F.count("*").alias("n")).orderBy(F.desc("n"), surface)


def merge_report(df: DataFrame, odds: str = "B365W", low: float = 50.0) -> DataFrame:
    rate = _share(F.count(odds), F.count("*"))
    return df.agg(F.count("*").alias("total"), F.count(odds).alias("matched"), rate.alias("match_rate"), F.coalesce(rate < low, F.lit(True)).alias("low"))


def unreadable_years(matches: DataFrame, odds: DataFrame, year: str = "_year") -> DataFrame:
    """Contests and odds, as keyed for their join, whose year can't be read."""
    side = lambda df, name: df.groupBy(F.lit(name).alias("side")).agg(F.count("*").alias("n"), count_where(F.col(year).isNull()).alias("no_year"))
    return side(matches, "matches").unionByName(side(odds, "odds"))


def missing_inputs(df: DataFrame) -> DataFrame:
    """Contests without what features need: serve statistics or service games of a side, a rating of a side, minutes, sets."""
    gap = lambda *columns: count_where(F.coalesce(*[F.when(F.col(c).isNull(), True) for c in columns if c in df.columns], F.lit(False)))
    serve = [f"{s}_{c}" for s in "wl" for c in ("svpt", "1stIn", "1stWon", "2ndWon")]
    no_rating = lambda s: F.coalesce(*[F.col(f"{s}_{c}") for c in ("surface_elo_pre", "elo_pre") if f"{s}_{c}" in df.columns], F.lit(None).cast("double")).isNull()
    return df.agg(
        F.count("*").alias("n_matches"), gap(*serve).alias("no_serve_stats"), gap("w_SvGms", "l_SvGms").alias("no_service_games"), count_where(no_rating("winner") | no_rating("loser")).alias("no_rating"),
        gap("minutes").alias("no_minutes"), count_where(count_sets("score").isNull()).alias("no_sets"),
    )


def feature_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: how many rows have it, and their share."""
    counts = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"_{i}").alias("filled"), _share(F.col(f"_{i}"), F.col("n")).alias("share")) for i, c in enumerate(columns)])
    return counts.select(F.inline(cells))


def elo_stats(df: DataFrame, surfaces: tuple[str, ...] = ("Hard", "Clay", "Grass")) -> DataFrame:
    gap = F.col("winner_id").isNull() | F.col("loser_id").isNull()
    return df.agg(
        F.count("*").alias("n_matches"), count_where(gap).alias("missing_id"), count_where(~gap & ~F.coalesce("surface_norm", F.lit("")).isin(*surfaces)).alias("untracked_surface"),
        count_where(normalize_indoor("indoor") == "Unknown").alias("indoor_unknown"), count_where(is_decisive("score", "best_of")).alias("decisive"),
    )


def h2h_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), count_where(F.col("h2h_count") > 0).alias("met_before"), count_where(F.col("h2h_surface_smoothed_diff") != 0).alias("surface_uneven"), F.max("h2h_count").alias("most"))


def h2h_counts(df: DataFrame, most: int = 6) -> DataFrame:
    """The most frequent numbers of earlier meetings (ties: the lower number)."""
    return df.groupBy("h2h_count").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "h2h_count").limit(most)


def modelable_counts(df: DataFrame) -> DataFrame:
    """How many contests the modelling table keeps, and why others are skipped: first a missing id, then missing odds."""
    gap = F.col("winner_id").isNull() | F.col("loser_id").isNull()
    odds = F.col("PSW").isNull() | F.col("PSL").isNull()
    return df.agg(F.count("*").alias("n_rows"), count_where(gap).alias("missing_id"), count_where(~gap & odds).alias("missing_odds"), count_where(~gap & ~odds).alias("kept"))


def level_counts(df: DataFrame, level: str = "tourney_level") -> DataFrame:
    """Rows of each raw level code."""
    return df.groupBy(level).agg(F.count("*").alias("n")).orderBy(F.desc("n"), level)


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows, balance of player 1 and date range of each tier of a modelling table."""
    won = F.col("target_player1_won")
    return df.groupBy("tourney_tier").agg(
        F.count("*").alias("n"), _share(F.sum(won), F.count("*")).alias("player1_won"), F.count("player1_faces_lefty").alias("lefty_known"), F.min("tourney_date").alias("first_date"), F.max("tourney_date").alias("last_date")
    )
