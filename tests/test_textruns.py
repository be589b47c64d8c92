"""Lines, runs and dictionary parts against plain loops."""

import random
import re

from tessella.operators import textruns

SCHEMA = "page int, id int, text string, x double, y double, h double, font_size double, font string, colour int"


def pieces(seed, n=400):
    rng = random.Random(seed)
    texts = ["ab", "c d ", " ", "", None, ":", " ° ", "é•", ".", "x  y"]
    rows = [(rng.choice([0, 1, 1, None]), k, rng.choice(texts), float(rng.randint(0, 90)), float(rng.randint(0, 300)), rng.choice([8.0, 9.5, 14.0]), rng.choice([10.0, 12.0, None]), rng.choice(["A", "B"]), rng.choice([0, 1])) for k in range(n)]
    return rows + [(2, 1000 + k, t, float(k), 5.0, 8.0, 10.0, "A", 0) for k, t in enumerate([" ", ":", None])]


def plain_lines(rows):
    """The line of each id: levels of a page from the top, each beginning a line if it is low enough."""
    out = {}
    for page in {r[0] for r in rows}:
        tallest = {}
        for r in rows:
            if r[0] == page:
                tallest[r[4]] = max(r[5], tallest.get(r[4], 0))
        line, first = -1, None
        for y in sorted(tallest):
            if first is None or y > first + 0.25 * (tallest[first] + tallest[y]):
                line, first = line + 1, y
            out.update({r[1]: line for r in rows if r[0] == page and r[4] == y})
    return out


def plain_runs(rows, lines, care, least):
    out = []
    for page in {r[0] for r in rows}:
        prev, run, number = None, [], 0

        def close(run=None, prev=None, number=0, page=page):
            if prev is not None and min(r[4] for r in run) > least:
                out.append((page, number, re.sub(r"\s+", " ", "".join(r[2] or "" for r in run)).strip(), prev[6], prev[7], prev[8], prev[3], min(r[4] for r in run), min(r[5] for r in run), len(run)))

        for r in sorted((r for r in rows if r[0] == page), key=lambda r: (lines[r[1]], r[3], r[4], r[1])):
            bare = (r[2] or "").strip()
            solid = bare != "" and bare not in textruns.SMALL
            if prev is not None and solid:
                far = prev[6] is not None and (r[4] - prev[4]) / prev[6] > 2
                if (r[6:9] != prev[6:9] or far) and not (not care and r[4] == prev[4]):
                    close(run, prev, number)
                    run, number = [], number + 1
            run.append(r)
            prev = r if solid else prev
        close(run, prev, number)
    return out


def test_lines_and_runs_equal_plain_loops(spark):
    for seed, care, least in ((1, True, 0.0), (2, False, 20.0)):
        rows = pieces(seed)
        found = textruns.with_lines(spark.createDataFrame(rows, SCHEMA), ["page"])
        lines = plain_lines(rows)
        assert {r["id"]: r["line"] for r in found.collect()} == lines
        got = textruns.text_runs(found, ["page"], ["line", "x", "y", "id"], care, least)
        columns = ["page", "run", "text", "font_size", "font", "colour", "x", "y", "h", "n"]
        assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, plain_runs(rows, lines, care, least)))


def test_no_pieces(spark):
    none = textruns.with_lines(spark.createDataFrame([], SCHEMA), ["page"])
    assert textruns.text_runs(none, ["page"], ["line", "x"]).count() == 0


def test_dictionary_by_hand(spark):
    head, body = (12.96, "VOWLNL+X", 0), (12.955, "YARFYB+Y", 7)
    said = [
        (*body, "before any entry"), (*head, "lost"), (*head, " one "), (*body, "first"), (10.0, "YARFYB", 7, "too small"), (*body, " goes on"), (*head, "•"), (*body, "second"),
        (*head, "two"), (*head, "•"), (*head, "three"), (12.96, "YARFYB", 8, "other colour"), (12.96, "ZZ", 0, "other font"), (*body, "third"), (*head, "four"),
    ]
    runs = spark.createDataFrame([(1, k, t, size, font, colour) for k, (size, font, colour, t) in enumerate(said)], "doc int, run int, text string, font_size double, font string, colour int")
    got = [(r["entry"], r["meanings"]) for r in textruns.lexicon_of_runs(runs, ["doc"], 7).orderBy("entry_no").collect()]
    assert got == [("one", ["first goes on", "second"]), ("two", []), ("three", ["third"])]


def test_runs_in_lines_equal_plain_loops(spark):
    """However small the batches are in which the pieces come; every line is broken by some, every x is another."""
    for size in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            for seed, care, least in ((3, True, 0.0), (4, False, 20.0)):
                rows = [(*r[:3], float(r[1] * 37 % 2003), *r[4:]) for r in pieces(seed, 150)]
                got = textruns.runs_in_lines(spark.createDataFrame(rows, SCHEMA), ["page"], care, least)
                columns = ["page", "run", "text", "font_size", "font", "colour", "x", "y", "h", "n"]
                assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, plain_runs(rows, plain_lines(rows), care, least)))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert textruns.runs_in_lines(spark.createDataFrame([], SCHEMA), ["page"]).count() == 0


def test_words_are_dealt_with_their_texts_only(spark):
    from tessella.plans import runs

    plan = runs.text_runs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Generate") == 2
