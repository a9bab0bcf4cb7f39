"""The winner-neutral modelling table."""

from __future__ import annotations

from duelkit.functions.values import SURFACES, classify_tier, deterministic_bit, expected_score, faces_lefty
from duelkit.sources.tables import SERVE_COLUMNS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Books whose W/L odds form pairs, by exact name.
BOOKS = ["B365", "PS", "EX", "Max", "Avg"]
#: Columns that are never features; beside odds and names. And the order columns of this library.
NOT_FEATURES = ["target_player1_won", "tourney_date", "tourney_id", "match_num", "dataset_split", "minutes", "l_1stIn", "w_1stIn", "l_svpt", "w_svpt", "player1_elo_win_prob"]
ORDER_COLUMNS = ["seq", "row_no"]


def pairs(columns: list[str]) -> list[tuple[str, str, str]]:
    """(winner's column, loser's column, name) of all columns that both sides have."""
    have = set(columns)
    found = [(f"{w}_{c[len(w) + 1:]}", f"{l}_{c[len(w) + 1:]}", c[len(w) + 1 :]) for w, l in (("winner", "loser"), ("w", "l")) for c in columns if c.startswith(f"{w}_") and f"{l}_{c[len(w) + 1:]}" in have]
    return found + [(f"{b}W", f"{b}L", b.lower()) for b in BOOKS if {f"{b}W", f"{b}L"} <= have]


def drop_raw_stats(df: DataFrame) -> DataFrame:
    return df.drop(*SERVE_COLUMNS)


def filter_modelable(df: DataFrame) -> DataFrame:
    """Rows with both ids and both PS odds (odds of 0 count as there)."""
    return df.where("winner_id is not null and loser_id is not null and PSW is not null and PSL is not null")


def symmetrize(df: DataFrame, seed: list[str]) -> DataFrame:
    """Winner and loser columns become ``player1_*`` and ``player2_*`` by a bit of the row's md5 (0: the winner is player 1);
    others stay, ``elo_prob_winner`` goes. Adds ``target_player1_won`` and ``player1_elo_win_prob`` (of published ratings)."""
    found = pairs(df.columns)
    paired = {c for w, l, _ in found for c in (w, l)}
    shared = [c for c in df.columns if c not in paired and c != "elo_prob_winner"]
    df = df.withColumn("_first", deterministic_bit(*seed) == 0)
    one = [F.when(F.col("_first"), F.col(w)).otherwise(F.col(l)).alias(f"player1_{n}") for w, l, n in found]
    two = [F.when(F.col("_first"), F.col(l)).otherwise(F.col(w)).alias(f"player2_{n}") for w, l, n in found]
    out = df.select(*shared, *one, *two, F.col("_first").cast("int").alias("target_player1_won"))
    if "player1_elo_pre" in out.columns:
        out = out.withColumn("player1_elo_win_prob", F.round(expected_score("player1_elo_pre", "player2_elo_pre"), 4))
    return out


def context_flags(df: DataFrame) -> DataFrame:
    tier = classify_tier("tourney_level", "draw_size")
    level = F.upper(F.trim(F.coalesce("tourney_level", F.lit(""))))
    return df.withColumns({
        "tourney_tier": tier, "is_grand_slam": (level == "G").cast("int"), "is_masters_1000": (level == "M").cast("int"),
        "player1_faces_lefty": faces_lefty("player2_hand"), "player2_faces_lefty": faces_lefty("player1_hand"),
    } | {f"surface_{s}": (F.coalesce("surface_norm", F.lit("")) == s).cast("int") for s in SURFACES})


def temporal_split(df: DataFrame, validation: str, test: str, date: str = "tourney_date") -> DataFrame:
    """Adds ``split``: test, validation or train by date; undated rows are train."""
    d = F.col(date).cast("date")
    return df.withColumn("split", F.when(d >= F.lit(test).cast("date"), "test").when(d >= F.lit(validation).cast("date"), "validation").otherwise("train"))


def select_features(df: DataFrame, must: list[str] | None = None) -> DataFrame:
    """Numeric columns that aren't listed, odds or names (ids are text, so no features); raises if one of ``must`` is lost."""
    odds = {f"player{i}_{b.lower()}" for i in (1, 2) for b in BOOKS}
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    out = [c for c, t in df.dtypes if t in numeric and c not in NOT_FEATURES + ORDER_COLUMNS and c not in odds and c not in ("player1_name", "player2_name")]
    if lost := set(must or []) - set(out):
        raise ValueError(f"lost features: {sorted(lost)}")
    return df.select(*out)
