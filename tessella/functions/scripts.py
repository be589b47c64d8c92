"""Compatibility forms of letters (ligatures, Arabic and Hebrew presentation forms), taken apart in two ranges only.

Outside of them compatibility decomposition would change signs that are no typographic variants, such as the micro sign.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ranges, and the one ligature that some fonts put after an alef which it holds already.
RANGES = ((0xFB00, 0xFDFF), (0xFE70, 0xFEFF))
ALLAH, ALEFS, WITHOUT_ALEF = "ﷲ", ("ا", "ﺍ"), "لله"
_BLANKS = "".join(map(chr, range(0x21)))


@cache
def forms() -> dict[str, str]:
    """What each sign of the ranges becomes, where that is another: its compatibility form less blanks around it."""
    every = (chr(c) for a, b in RANGES for c in range(a, b + 1))
    found = {c: unicodedata.normalize("NFKC", c).strip(_BLANKS) for c in every}
    return {c: to for c, to in found.items() if to != c}


def taken_apart(text: Column) -> Column:
    """``text`` with the signs of both ranges in their compatibility forms; null stays null."""
    inside = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in RANGES) + "]"
    table = F.create_map(*[F.lit(x) for pair in forms().items() for x in pair])
    chars = F.split(text, "")

    def one(c: Column, i: Column) -> Column:
        before = F.get(chars, i - 1)
        known = F.when((c == ALLAH) & before.isin(*ALEFS), F.lit(WITHOUT_ALEF)).otherwise(F.coalesce(F.element_at(table, c), c))
        return F.when(F.rlike(c, F.lit(inside)), known).otherwise(c)

    return F.when(F.rlike(text, F.lit(inside)), F.array_join(F.transform(chars, one), "")).otherwise(text)
