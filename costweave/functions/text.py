"""Text columns: folding of diacritics and whole-word search on folded text."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import functions as F


def _accented() -> dict[str, str]:
    """Lower-case Latin letters with diacritics, Vietnamese ones among them, and the plain letter that each is built on."""
    letters = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in block if chr(c).islower()}
    return {c: base for c, base in letters.items() if c != base and base.isascii()} | {"đ": "d"}


ACCENTED, PLAIN = ("".join(x) for x in zip(*_accented().items(), strict=True))
MARKS = "[\u0300-\u036f]"


def fold(column: str) -> F.Column:
    """Lower case without diacritics, whether letters are composed or followed by combining marks."""
    return F.regexp_replace(F.translate(F.lower(column), ACCENTED, PLAIN), MARKS, "")


def has_word(column: str, words: list[str]) -> F.Column:
    """Whether the folded text holds one of the words, not inside a longer run of letters or digits."""
    return fold(column).rlike("(^|[^a-z0-9])(" + "|".join(map(re.escape, words)) + ")($|[^a-z0-9])")


def fold_word(word: str) -> str:
    """``fold`` of a literal."""
    return re.sub(MARKS, "", word.lower().translate(str.maketrans(ACCENTED, PLAIN)))


def without_brackets(column) -> F.Column:
    """Brackets and parentheses taken off what they hold; runs of , ; : become one comma, runs of dashes one dash."""
    open_text = F.regexp_replace(F.regexp_replace(column, r"\[([^\]]+)\]", "$1"), r"\(([^)]+)\)", "$1")
    return F.regexp_replace(F.regexp_replace(open_text, "[,;:]{2,}", ","), "-{2,}", "-")


def three_components(column: str) -> F.Column:
    """At most three parts around ' - ': what lies between the first and the last is joined by spaces."""
    parts = F.split(column, " - ")
    n = F.size(parts)
    merged = F.concat_ws(" - ", parts[0], F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), " "), F.try_element_at(parts, F.lit(-1)))
    return F.when(n > 3, merged).otherwise(F.col(column))


#: Spellings of units of length and how many millimetres each is.
MILLIMETRES = {"mm": 1, "millimeter": 1, "milimet": 1, "milimét": 1, "cm": 10, "centimeter": 10, "centimet": 10, "centimét": 10, "m": 1000, "meter": 1000, "mét": 1000, "met": 1000}


def millimetres(value: str, unit: str) -> F.Column:
    """A length as whole millimetres, decimal comma or point; what is no number or length stays as it is written."""
    number = F.replace(value, F.lit(","), F.lit(".")).try_cast("double")
    name = F.lower(F.trim(unit))
    factor = F.coalesce(*(F.when(name == u, F.lit(float(f))) for u, f in MILLIMETRES.items()))
    return F.coalesce(F.concat((number * factor).cast("long").cast("string"), F.lit("mm")), F.concat(value, unit))
