"""Lines with right-to-left letters in the order in which they are seen, by the published bidirectional algorithm.

Levels come from the letters' classes (weak and neutral classes resolved, no explicit embeddings, brackets unpaired), runs of
a level are reversed from the highest level down, and signs with a mirror image are mirrored in right-to-left runs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_RUN = re.compile("1+|2+")
_SWAPS = (("LEFT", "RIGHT"), ("LESS-THAN", "GREATER-THAN"))


@cache
def mirror(sign: str) -> str:
    """The sign's mirror image: that whose name has the other side in it; itself if there is none."""
    name = unicodedata.name(sign, "")
    if unicodedata.mirrored(sign):
        for a, b in _SWAPS:
            for here, there in ((a, b), (b, a)):
                if here in name:
                    try:
                        other = unicodedata.lookup(name.replace(here, there))
                    except KeyError:
                        continue
                    if unicodedata.mirrored(other):
                        return other
    return sign


#: Signs that stand for the letters' classes; blanks ("s") and all other neutrals ("o") are told apart for a line's end.
_SIGNS = {"L": "L", "R": "R", "AL": "A", "EN": "E", "AN": "N", "ES": "+", "CS": ",", "ET": "%", "NSM": "M", "WS": "s", "S": "s", "B": "s"}


class _Table(dict):
    """A table for ``str.translate`` that fills itself as letters are met."""

    def __init__(self, of: Callable[[str], str]):
        self.of = of

    def __missing__(self, code: int) -> str:
        self[code] = out = self.of(chr(code))
        return out


_CLASSES = _Table(lambda c: _SIGNS.get(unicodedata.bidirectional(c), "o"))
_MIRRORS = _Table(mirror)


def base_level(classes: str) -> int:
    """That of the first strong letter; left to right without any."""
    strong = re.search("[LRA]", classes)
    return int(strong is not None and strong[0] != "L")


def resolved(classes: str, base: int) -> str:
    """Each letter's class as L, R, E or N (European or Arabic number)."""
    edge = "LR"[base]
    out = re.sub("^M+", lambda m: edge * len(m[0]), classes)  # marks take the class of their letter
    out = re.sub("([^M])M+", lambda m: m[1] * len(m[0]), out)
    out = re.sub("A[^LRA]*", lambda m: m[0].replace("E", "N"), out).replace("A", "R")  # digits after Arabic letters are Arabic
    out = re.sub("(?<=E)[+,](?=E)", "E", out)  # one separator between two numbers belongs to them
    out = re.sub("(?<=N),(?=N)", "N", out)
    beside = lambda m: "E" in (m.string[m.start() - 1 : m.start()], m.string[m.end() : m.end() + 1])
    out = re.sub("%+", lambda m: "E" * len(m[0]) if beside(m) else m[0], out)  # terminators beside European numbers belong to them
    out = re.sub("[+,%s]", "o", out)
    # numbers in left-to-right text are like its letters
    out = re.sub("L[^R]*" if base else "(?:^|L)[^R]*", lambda m: m[0].replace("E", "L"), out)

    def neutral(m: re.Match) -> str:  # neutrals between letters of one direction take it, others that of the line
        before = m.string[m.start() - 1] if m.start() else edge
        after = m.string[m.end()] if m.end() < len(m.string) else edge
        return (edge if (before == "L") != (after == "L") else "L" if before == "L" else "R") * len(m[0])

    return re.sub("o+", neutral, out)


def _levels(line: str) -> str:
    """A digit for each letter."""
    classes = line.translate(_CLASSES)
    base = base_level(classes)
    out = resolved(classes, base).translate({76: "02"[base], 82: "1", 69: "2", 78: "2"})
    k = len(classes.rstrip("s"))  # blanks at the end are the line's
    return out[:k] + str(base) * (len(out) - k)


def levels(line: str) -> list[int]:
    return [int(c) for c in _levels(line)]


def seen(line: str) -> str:
    """The line's signs from left to right as they are seen."""
    level, out, done = _levels(line), [], 0
    for m in re.finditer("[12]+", level):  # turned as a whole; what is of level 2 is turned twice
        out.append(line[done : m.start()])
        runs = [(r.start(), r.end()) for r in _RUN.finditer(level, m.start(), m.end())]
        out += [line[a:b] if level[a] == "2" else line[a:b].translate(_MIRRORS)[::-1] for a, b in reversed(runs)]
        done = m.end()
    return "".join([*out, line[done:]])


@F.pandas_udf(StringType())
def visual_order(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: x if x is None or x.isascii() else seen(x))
