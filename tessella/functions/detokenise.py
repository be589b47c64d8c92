"""Joining Kinyarwanda tokens back into a sentence, in array functions.

Which tokens are joined with the one after them depends on tokens alone: a token that takes the next one
along is marked, and one pass of a regular expression over the marks, a character for each token, settles
which of them still begin something of their own. What stands before a token in the sentence is the end of
the token before it, so that every other rule looks at neighbours only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import capitalise, let

#: Fixed values of the rules.
VOWELS = ("i", "u", "o", "a", "e")
CLOSING = (",", ".", ";", "?", "!", ":")
DASHES = ("-", "–", "_")
QUOTES = ("’", "‘", "`", '"', "'", "“", "”", "«", "»")
UNTOUCHED_TAGS = ("V", "N", "DE")

ALNUM = r"^[\p{L}\p{N}]+$"
DIGIT = "[0-9]"


def _contracts(token: Column, following: Column, tags: Column | None) -> Column:
    """Whether a token loses its last letter to an apostrophe before the next one."""
    short = token.endswith("a") & F.length(token).between(2, 3) & F.left(following, F.lit(1)).isin(*VOWELS)
    found = following.isNotNull() & (token.endswith("'") | short)
    if tags is not None:
        tag, after = (F.coalesce(F.try_element_at(tags, x), F.lit("")) for x in (token, following))
        found = found & ~tag.isin(*UNTOUCHED_TAGS) & ~((tag == "PO") & (after == "V"))
    return F.coalesce(found, F.lit(False))


def _joins(token: Column, before: Column, following: Column) -> Column:
    return F.coalesce(token.isin(*DASHES) & F.rlike(before, F.lit(ALNUM)) & F.rlike(following, F.lit(ALNUM)), F.lit(False))


def detokenised(tokens: Column, tags: Column | None = None) -> Column:
    """The sentence of an array of tokens; ``tags``, a map from token to part of speech, keeps some from contracting.

    Of the rules the first that fits a place decides it: contraction with the next token, a digit after a
    digit and a point or comma, % after a digit, a dash between letters or digits, and else a space
    unless the token is the first, closes something, or stands inside a quotation mark at either end.
    The first character becomes upper case if more than one piece was written; ``<unk>`` becomes a space.
    Null gives null, no tokens an empty sentence.
    """
    return F.when(F.size(tokens) == 0, "").otherwise(let(tokens, lambda t: _joined(t, tags)))


def _joined(tokens: Column, tags: Column | None) -> Column:
    """The sentence of one or more tokens. Every array is built once; a token's neighbours come with it."""
    none = F.array(F.lit(None).cast("string"))
    pairs = F.zip_with(tokens, F.slice(tokens, F.lit(2), F.size(tokens)), lambda x, after: F.struct(x.alias("x"), after.alias("after")))
    before = F.concat(none, F.slice(tokens, F.lit(1), F.size(tokens) - 1))
    near = F.zip_with(pairs, before, lambda s, y: F.struct(s["x"].alias("x"), s["after"].alias("after"), y.alias("before")))

    def marked(near: Column) -> Column:
        found = F.transform(near, lambda s: F.when(_contracts(s["x"], s["after"], tags), "c").when(_joins(s["x"], s["before"], s["after"]), "d").otherwise("."))
        return let(F.split(F.regexp_replace(F.array_join(found, ""), "([cd]).", "$1x"), ""), lambda marks: let(written(near, marks), lambda s: finished(s, marks)))

    def written(near: Column, marks: Column) -> Column:
        marks_before = F.concat(none, F.slice(marks, F.lit(1), F.size(tokens) - 1))
        second = F.concat(none, none, F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 2, F.lit(0))))
        earlier = F.zip_with(F.zip_with(marks, marks_before, lambda m, y: F.struct(m.alias("mark"), y.alias("mark_before"))), second, lambda s, y: F.struct(s["mark"].alias("mark"), s["mark_before"].alias("mark_before"), y.alias("second")))
        places = F.filter(F.zip_with(near, earlier, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda p: p["s"]["x"].isNotNull())
        return F.array_join(F.transform(places, piece), "")

    def piece(p: Column, k: Column) -> Column:
        token, following, before = p["s"]["x"], p["s"]["after"], p["s"]["before"]
        mark = p["e"]["mark"]
        first = F.left(token, F.lit(1))
        quoted = ((k == 1) & F.right(before, F.lit(1)).isin(*QUOTES)) | (following.isNull() & first.isin(*QUOTES))
        space = F.when((k == 0) | first.isin(*CLOSING) | quoted, "").otherwise(" ")
        after_digit = F.when(F.length(before) > 1, F.rlike(before, F.lit(DIGIT + ".$"))).otherwise((p["e"]["mark_before"] == ".") & F.rlike(p["e"]["second"], F.lit(DIGIT + "$")))
        decimal = (k > 1) & F.rlike(first, F.lit(DIGIT)) & F.right(before, F.lit(1)).isin(",", ".") & after_digit
        percent = (k > 1) & (token == "%") & F.rlike(before, F.lit(DIGIT + "$"))
        return (
            F.when(mark == "x", "")
            .when(mark == "c", F.concat(space, F.substr(token, F.lit(1), F.length(token) - 1), F.lit("'"), following))
            .when(mark == "d", F.concat(token, following))
            .when(F.coalesce(decimal | percent, F.lit(False)), token)
            .otherwise(F.concat(space, token))
        )

    def finished(sentence: Column, marks: Column) -> Column:
        pieces = F.aggregate(marks, F.lit(0), lambda n, m: n + F.when(m == "d", 2).when(m == "x", 0).when(m == "", 0).otherwise(1))
        cased = F.when(pieces > 1, capitalise(sentence)).otherwise(sentence)
        return F.trim(F.regexp_replace(F.replace(cased, F.lit("<unk>"), F.lit(" ")), r"\s+", " "))

    return let(near, marked)
