"""Spelling whole numbers in Kinyarwanda, with the noun-class prefix that the counted thing asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words, in the order of the digits 1 to 9.
HUNDREDS = ("ijana", "magana abiri", "magana atatu", "magana ane", "magana atanu", "magana atandatu", "magana arindwi", "magana inani", "magana cyenda")
TENS = ("cumi", "makumyabiri", "mirongo itatu", "mirongo ine", "mirongo itanu", "mirongo itandatu", "mirongo irindwi", "mirongo inani", "mirongo cyenda")
STEMS = ("mwe", "biri", "tatu", "ne", "tanu", "tandatu", "rindwi", "umunani", "icyenda")
WITH_ZI = ("imwe", "ebyiri", "eshatu", "enye", "eshanu", "esheshatu", "zirindwi", "umunani", "icyenda")
SINGULAR = {"ba": "u", "i": "u", "a": "ri", "bi": "ki", "tu": "ka"}
ONLY_ONE = ("ru", "ku")
BEFORE_T = {"ka": "ga", "ku": "gu", "tu": "du"}
TEN = "icumi"
#: Scale words from thousands up, with the prefix that their counts take.
SCALES = (("ibihumbi ", "bi"), ("miliyoni ", "zi"), ("miliyari ", "zi"), ("miliyaridi ", "zi"))


def unit_words(prefix: str) -> list[str | None]:
    """Words for 1 to 9 with a prefix; None where the prefix does not combine with the number."""
    if prefix == "zi":
        return list(WITH_ZI)
    words: list[str | None] = []
    for n, stem in enumerate(STEMS, 1):
        if n >= 8:
            words.append(stem)
        elif n > 1 and prefix in ONLY_ONE:
            words.append(None)
        else:
            p = SINGULAR.get(prefix, prefix) if n == 1 else prefix
            words.append((BEFORE_T.get(p, p) if stem.startswith("t") else p) + stem)
    return words


def _link(words) -> list[str | None]:
    """Each word after an "and", which is n' before a vowel."""
    return [None if w is None else (" n'" if w[0] in "aeiou" else " na ") + w for w in words]


def _pick(words, n: Column) -> Column:
    return F.element_at(words if isinstance(words, Column) else F.array(*[F.lit(w) for w in words]), n)


def units_for(prefix: Column, prefixes: tuple[str, ...]) -> tuple[Column, Column]:
    """The unit words of a prefix column that holds one of ``prefixes``, plain and after an "and"."""
    plain = linked = F
    for p in prefixes:
        words = unit_words(p)
        plain = plain.when(prefix == p, F.array(*[F.lit(w) for w in words]))
        linked = linked.when(prefix == p, F.array(*[F.lit(w) for w in _link(words)]))
    return plain, linked


def _below_thousand(units, linked_units, n: Column, linked: bool = False) -> Column:
    """Words of 1 to 999, after an "and" if ``linked``; "" for 0."""
    h, t, u = (F.floor(n / 100).cast("int"), F.floor(F.pmod(n, F.lit(100)) / 10).cast("int"), F.pmod(n, F.lit(10)).cast("int"))
    own = lambda words: _link(words) if linked else words
    hundreds = F.when(h > 0, _pick(own(HUNDREDS), h)).otherwise("")
    tens = F.when(t > 0, F.when(h > 0, _pick([" na " + w for w in TENS], t)).otherwise(_pick(own(TENS), t))).otherwise("")
    last = F.when(u > 0, F.when((h > 0) | (t > 0), _pick(linked_units, u)).otherwise(_pick(linked_units if linked else units, u))).otherwise("")
    return F.when(n == 10, own([TEN])[0]).otherwise(F.concat(hundreds, tens, last))


def spell(units: tuple[Column, Column], n: Column) -> Column:
    """The number in words, with the unit words of its prefix: "" for 0, null if the prefix cannot count it; what is above 10^15 is lost."""
    n = n.cast("bigint")
    groups = [F.pmod(F.floor(n / (1000**k)), F.lit(1000)).cast("int") for k in range(5)]
    out = F.lit("")
    for k in range(4, 0, -1):
        word, prefix = SCALES[k - 1]
        words = unit_words(prefix)
        link = F.when(F.lit(False), "") if k == 4 else F.when(n >= 1000 ** (k + 1), " n'" if k == 1 else " na ")
        said = F.concat(link.otherwise(""), F.lit(word), _below_thousand(words, _link(words), groups[k]))
        out = F.concat(out, F.when(groups[k] > 0, said).otherwise(""))
    low = F.when(n >= 1000, _below_thousand(*units, groups[0], True)).otherwise(_below_thousand(*units, groups[0]))
    return F.concat(out, F.when(groups[0] == 0, "").otherwise(low))
