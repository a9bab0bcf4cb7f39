"""Keys that join contests with odds although both spell names in their own way."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col, let


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Letters whose canonical decomposition begins with an ASCII letter, and these letters."""
    source, target = [], []
    for code in range(128, 0x10000):
        first = unicodedata.normalize("NFD", chr(code))[0]
        if first.isascii() and not 0xD800 <= code < 0xE000:
            source.append(chr(code))
            target.append(first)
    return "".join(source), "".join(target)


def clean_name(c: Column | str) -> Column:
    """Accents gone, ASCII, lower case, hyphens as blanks, no full stops, single blanks; null: empty."""
    text = F.translate(F.coalesce(col(c), F.lit("")), *_folding())
    text = F.lower(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    text = F.replace(F.replace(text, F.lit("-"), F.lit(" ")), F.lit("."), F.lit(""))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def player_key_first_last(c: Column | str) -> Column:
    """``First Rest Of`` -> ``f rest of``; one word stays whole."""

    def key(words: Column) -> Column:
        return F.when(F.size(words) < 2, words[0]).otherwise(F.concat(F.substring(words[0], 1, 1), F.lit(" "), F.array_join(F.slice(words, 2, F.size(words) - 1), " ")))

    return let(F.split(clean_name(c), " "), key)


def player_key_last_initial(c: Column | str) -> Column:
    """``Rest Of F.`` -> ``f rest of``: a last word of up to three letters is initials; else as first-last (one word: its
    initial and a blank; an empty name stays empty)."""

    def key(words: Column) -> Column:
        last = F.element_at(words, -1)
        initials = (F.size(words) > 1) & (F.length(last) <= 3) & last.rlike("^[a-z]+$")
        swapped = F.concat(F.substring(last, 1, 1), F.lit(" "), F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), " "))
        plain = F.concat(F.substring(words[0], 1, 1), F.lit(" "), F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " "))
        return F.when((F.size(words) == 1) & (words[0] == ""), "").when(initials, swapped).otherwise(plain)

    return let(F.split(clean_name(c), " "), key)


def matchup(a: Column | str, b: Column | str) -> Column:
    """The same for either order of the two."""
    return F.concat(F.least(col(a), col(b)), F.lit("__vs__"), F.greatest(col(a), col(b)))


def extract_year(c: Column | str) -> Column:
    """The year of a date given as text: four leading digits, ``d/m/yy(yy)`` with ``/``, ``-`` or ``.`` at its end (two digits
    pivot at 70), a spreadsheet's day number; null outside 1990 to 2035."""
    text = F.trim(col(c).cast("string"))
    digits = F.regexp_replace(text, r"\.0+$", "")
    number = digits.try_cast("bigint")
    last = F.nullif(F.regexp_extract(text, r"[0-9]{1,2}[/\-.][0-9]{1,2}[/\-.]([0-9]{2,4})$", 1), F.lit("")).try_cast("int")
    known = lambda y: F.when(y.between(1990, 2035), y)
    return F.coalesce(
        F.when(digits.rlike("^[0-9]{5}$"), known(F.year(F.date_add(F.lit("1899-12-30").cast("date"), number.cast("int"))))),
        F.when(~digits.rlike("^[0-9]{5}$") & text.rlike("^[0-9]{4}"), known(F.substring(text, 1, 4).try_cast("int"))),
        known(F.when(last >= 100, last).when(last >= 70, last + 1900).otherwise(last + 2000)),
    )
