"""String functions of the cleaning and post-editing steps, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that a tokenised English line may carry and that are scrubbed to a space.
SCRUBBED = ("<unk>", "<s>", "</s>", "\t")
#: What may follow a split-off "s" or "t".
AFTER_SUFFIX = (" ", ".", "?", "!", ",", ";")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def scrub(text: Column) -> Column:
    """Special marks become spaces, then white space is squeezed."""
    for mark in SCRUBBED:
        text = F.replace(text, F.lit(mark), F.lit(" "))
    return squeeze(text)


def english_postedit(text: Column) -> Column:
    """Unknown marks before a lone s or t are apostrophes; other unknown marks go."""
    for letter in ("s", "t"):
        for after in AFTER_SUFFIX:
            text = F.replace(text, F.lit(f" <unk> {letter}{after}"), F.lit(f"'{letter}{after}"))
    return squeeze(F.replace(text, F.lit("<unk>"), F.lit(" ")))


def is_latin(text: Column) -> Column:
    """Whether every letter is of the Latin script; other characters do not count."""
    return ~F.rlike(text, F.lit(r"[\p{L}&&[^\p{IsLatin}]]"))


def tokens(text: Column) -> Column:
    """White-space tokens; an empty array for null and blank text."""
    clean = squeeze(F.coalesce(text, F.lit("")))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


#: Letters that full case mapping makes several letters of, each with its own capital; with itself if it has none.
_OWN_CAPITALS = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x110000)) if len(c.upper()) > 1}


def capitalise(text: Column) -> Column:
    """The first letter as a capital, one letter for one: ß becomes ẞ and not SS."""
    first = F.substring(text, 1, 1)
    capital = F.when(first.isin(*_OWN_CAPITALS), F.translate(first, "".join(_OWN_CAPITALS), "".join(_OWN_CAPITALS.values()))).otherwise(F.upper(first))
    return F.concat(capital, F.substr(text, F.lit(2)))


def is_running_header(line: Column, opening: str = "Official Gazette n", least: int = 10) -> Column:
    """A page's running header: it opens so and has fewer than ``least`` tokens."""
    return F.startswith(line, F.lit(opening)) & (F.size(tokens(line)) < least)


def collapse_dots(words: Column) -> Column:
    """Runs of the tokens "." and of "…" become one."""
    return F.filter(words, lambda x, i: ~((x.isin(".", "…")) & (i > 0) & (x == F.try_element_at(words, i))))


def join_subwords(pieces: Column) -> Column:
    """Joins sub-words: a piece that ends in @@ glues to the next one; a leading ▁ goes."""
    line = F.array_join(F.transform(pieces, lambda x: F.regexp_replace(x, "^▁", "")), " ")
    return F.replace(line, F.lit("@@ "), F.lit(""))


def first_word(text: Column) -> Column:
    """What stands before the first space or apostrophe; one at the very start does not count."""
    space, quote = (F.nullif(F.instr(text, c) - 1, F.lit(0)) for c in (" ", "'"))
    ends = [F.when(e > 0, e) for e in (space, quote)]
    return F.substr(text, F.lit(1), F.coalesce(F.least(*ends), F.length(text)))


def headwords(entry: Column) -> Column:
    """Headwords of a lexicon line: homograph digits 1-5 dropped, split at commas, over one character long."""
    plain = F.when(F.rlike(entry, F.lit("^[a-zA-Z]{2,}[1-5]$")), F.substr(entry, F.lit(1), F.length(entry) - 1)).otherwise(entry)
    return F.filter(F.transform(F.split(plain, ","), lambda x: F.trim(x)), lambda x: F.length(x) > 1)


def meanings(line: Column, most: int = 4) -> Column:
    """Meanings of a lexicon line: a leading dot dropped, cut at the next dot, split at semicolons.

    Those of more than ``most`` words go; so do all of them if the first has more.
    """
    body = F.trim(F.regexp_replace(F.trim(line), r"^\.", ""))
    body = F.when(F.instr(body, ".") > 1, F.substring_index(body, ".", 1)).otherwise(body)
    parts = F.transform(F.split(body, ";"), lambda x: F.trim(x))
    short = F.filter(parts, lambda x: (F.size(tokens(x)) <= most) & (F.length(x) > 1))
    return F.when(F.size(tokens(F.element_at(parts, 1))) <= most, short).otherwise(F.array().cast("array<string>"))


def keyword_key(token: Column) -> Column:
    """Lower case; a trailing apostrophe of any kind stands for a dropped a."""
    low = F.lower(token)
    return F.when(F.right(low, F.lit(1)).isin("'", "’", "‘", "`"), F.concat(F.left(low, F.length(low) - 1), F.lit("a"))).otherwise(low)


def parse_flag(value: Column) -> Column:
    """Booleans as people write them; null if it is none of them."""
    low = F.lower(F.trim(value))
    return F.when(low.isin("yes", "true", "t", "y", "1"), True).when(low.isin("no", "false", "f", "n", "0"), False)
