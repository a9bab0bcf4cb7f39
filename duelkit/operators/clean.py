"""From files as read to typed contests in their total order."""

from __future__ import annotations

from duelkit.functions.values import normalize_surface, parse_date, safe_int_text, to_number
from duelkit.operators.ordering import chronological_order
from duelkit.sources.tables import DOUBLES, INTS, MATCH_COLUMNS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_matches(raw: DataFrame) -> DataFrame:
    """Typed contests from rows of text as :func:`duelkit.sources.tables.read_matches` gives them; no row is lost.

    ``surface_norm`` from ``surface``; ``tourney_date`` a date, null if it is none, and ``tourney_date_raw`` the text (ISO where it
    is a ``YYYYMMDD`` day); ids and ``match_num_raw`` without a decimal part; numbers as numbers, null where they aren't.
    Blank text is null. Columns beside the canonical ones stay as they are."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in MATCH_COLUMNS if c not in raw.columns})
    made: dict[str, Column] = {}
    for c in MATCH_COLUMNS:
        if c == "surface_norm":
            made[c] = normalize_surface("surface")
        elif c == "tourney_date":
            made[c] = parse_date(c)
        elif c in ("winner_id", "loser_id"):
            made[c] = safe_int_text(text(c))
        elif c in INTS:
            made[c] = to_number(text(c)).try_cast("int")
        elif c in DOUBLES:
            made[c] = to_number(text(c))
        else:
            made[c] = text(c)
    day = text("tourney_date")
    made["tourney_date_raw"] = F.coalesce(F.when(day.rlike("^[0-9]{8}$"), F.date_format(F.try_to_date(day, "yyyyMMdd"), "yyyy-MM-dd")), day)
    made["match_num_raw"] = safe_int_text(text("match_num"))
    rest = [c for c in raw.columns if c not in made]
    return raw.select(*[v.alias(c) for c, v in made.items()], *[F.col(f"`{c}`") for c in rest])


def order_keys(date: str = "tourney_date_raw", number: str = "match_num_raw") -> list[Column]:
    """The keys of the total order: the date's text (not of ten characters: first of all), the number (none: -1)."""
    text = F.col(date)
    return [F.when(F.length(text) == 10, text).otherwise("0000-00-00"), F.coalesce(F.when(F.col(number).rlike("^[+-]?[0-9]+$"), F.col(number).try_cast("bigint")), F.lit(-1).cast("long"))]


def with_seq(df: DataFrame, file: str = "source_file", row: str = "row_no") -> DataFrame:
    """Adds ``seq``, unique and gapless from 0, in the order of date, number, file and row. All ordered work uses it: dates
    and numbers repeat between events."""
    return chronological_order(df, *order_keys(), file, row)
