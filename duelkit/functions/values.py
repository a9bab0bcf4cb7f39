"""Column functions over single values of a contest row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tour surfaces, spellings of the venue flag, level codes.
SURFACES = ["Hard", "Clay", "Grass", "Carpet"]
INDOOR, OUTDOOR = ["yes", "1", "true", "indoor", "i"], ["no", "0", "false", "outdoor", "o"]
TIERS = {"G": "Grand Slam", "M": "Masters 1000", "F": "Tour Finals", "250": "ATP 250", "500": "ATP 500", "D": "Davis Cup"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_surface(c: Column | str) -> Column:
    """Trimmed; the four known surfaces in their usual spelling; blank and null: ``Unknown``."""
    text = F.trim(F.coalesce(col(c), F.lit("")))
    out = F.when(text == "", "Unknown")
    for name in SURFACES:
        out = out.when(F.lower(text) == name.lower(), name)
    return out.otherwise(text)


def parse_date(c: Column | str) -> Column:
    """``YYYYMMDD`` or ISO text as a date; null if it is neither or no real day."""
    text = F.trim(col(c))
    return F.when(text.rlike("^[0-9]{8}$"), F.try_to_date(text, "yyyyMMdd")).when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def is_bad_date(c: Column | str) -> Column:
    """Not a real ``YYYYMMDD`` day (ISO text counts as bad, too)."""
    text = F.trim(F.coalesce(col(c), F.lit("")))
    return ~(text.rlike("^[0-9]{8}$") & F.try_to_date(text, "yyyyMMdd").isNotNull())


def safe_int_text(c: Column | str) -> Column:
    """``104925.0`` -> ``104925``; blank and text that is no number stay."""
    text = F.trim(col(c))
    number = text.try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 9e18), number.cast("bigint").cast("string")).otherwise(text)


def to_number(c: Column | str) -> Column:
    return F.trim(col(c).cast("string")).try_cast("double")


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; null if either is null or b is 0."""
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


def normalize_indoor(c: Column | str) -> Column:
    text = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    return F.when(text.isin(INDOOR), "Indoor").when(text.isin(OUTDOOR), "Outdoor").otherwise("Unknown")


def count_sets(score: Column | str) -> Column:
    """Sets in a score; marks of a retirement are dropped, a score without sets gives null."""
    tokens = F.split(F.regexp_replace(F.coalesce(col(score), F.lit("")), "RET|DEF", " "), r"\s+")
    return F.nullif(F.size(F.filter(tokens, lambda t: t.rlike(r"^[0-9]+-[0-9]+(\([0-9]+\))?$"))), F.lit(0))


def is_decisive(score: Column | str, best_of: Column | str) -> Column:
    """As many sets as the format allows."""
    return F.coalesce(count_sets(score) == col(best_of).cast("int"), F.lit(False))


def expected_score(a: Column | str, b: Column | str) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (col(b) - col(a)) / 400))


def dynamic_k(played: Column | str) -> Column:
    """A player's step after ``played`` contests: 250 / (played + 5)^0.4, within 16 and 50."""
    return F.greatest(F.lit(16.0), F.least(F.lit(50.0), 250 / F.pow(col(played) + 5.0, F.lit(0.4))))


def classify_tier(level: Column | str, draw: Column | str) -> Column:
    """The tier of an event; level A is split by the draw (48 and more: ATP 500)."""
    code = F.upper(F.trim(F.coalesce(col(level), F.lit(""))))
    out = F.when(code == "A", F.when(F.coalesce(to_number(draw), F.lit(0.0)) >= 48, "ATP 500").otherwise("ATP 250"))
    for name, tier in TIERS.items():
        out = out.when(code == name, tier)
    return out.otherwise("Other")


def deterministic_bit(*seed: Column | str) -> Column:
    """The first hexadecimal digit of the md5 of the values (null: empty) joined by ``_``, modulo 2."""
    text = F.concat_ws("_", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in seed])
    digit = F.substring(F.md5(text.cast("binary")), 1, 1)
    return (F.conv(digit, 16, 10).cast("int") % 2).cast("int")


def faces_lefty(opponent_hand: Column | str) -> Column:
    hand = F.upper(F.trim(col(opponent_hand)))
    return F.when(hand == "L", 1).when(hand == "R", 0)
