"""Compatibility forms, language profiles and attention against plain Python."""

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import scripts
from tessella.operators import attention, languages
from tessella.plans import catalogue

BASE = "/root/testdata/sf0.01"


def test_every_sign_of_both_ranges_and_no_other(spark):
    ranges = [*range(0xFB00, 0xFE00), *range(0xFE70, 0xFF00)]
    others = [c for c in range(0x20, 0x3000) if c not in ranges] + [0xFDFF + 1, 0xFE6F, 0xFF21, 0x1F600]
    rows = spark.createDataFrame([(c, f"a{chr(c)}b") for c in ranges + others], "c int, t string")
    got = {r["c"]: r["x"] for r in rows.select("c", scripts.taken_apart(F.col("t")).alias("x")).collect()}
    for c in ranges:
        assert got[c] == f"a{unicodedata.normalize('NFKC', chr(c)).strip(' ')}b", hex(c)
    assert all(got[c] == f"a{chr(c)}b" for c in others)


@pytest.mark.parametrize(("text", "apart"), [("ﷲ", "الله"), ("اﷲ", "الله"), ("ﺍﷲ", "الله"), ("xﷲ", "xالله"), ("", ""), (None, None), ("ﱞ", "ٌّ")])
def test_the_ligature_after_an_alef(spark, text, apart):
    assert spark.createDataFrame([(text,)], "t string").select(scripts.taken_apart(F.col("t")).alias("x")).first()["x"] == apart


def plain_grams(text):
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        w = f"_{w}_"
        out.update(w[i : i + k] for k in (1, 2, 3) for i in range(len(w) - k + 1))
    del out["_"]
    return out


def listed(counts, n):
    return {g: k for k, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:n], 1)}


def test_detection_equals_a_plain_version(spark):
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    rows = [(k, lang, " ".join(word(letters) for _ in range(rng.randint(0, 20)))) for k in range(60) for lang, letters in [rng.choice([("x", "abcde"), ("y", "cdefé"), (None, "efgh")])]]
    rows += [(100, "x", None), (101, "y", "12 34"), (102, "x", "ABC, d'e")]
    docs = spark.createDataFrame(rows, "id long, lang string, text string")
    grams = languages.ngrams(docs)
    got = {r["id"]: (r["detected"], r["gain"]) for r in languages.detect(grams, languages.profiles(grams, docs.where("id < 40").select("id", "lang"), 20), 20).collect()}
    known = {}
    for k, lang, text in rows:
        if k < 40 and lang:
            known.setdefault(lang, Counter()).update(plain_grams(text))
    known = {lang: listed(c, 20) for lang, c in known.items()}
    want = {}
    for k, _, text in rows:
        own = listed(plain_grams(text), 20)
        gains = [(-sum(20 - abs(r - p[g]) for g, r in own.items() if g in p), lang) for lang, p in known.items() if own.keys() & p.keys()]
        if gains:
            want[k] = (min(gains)[1], -min(gains)[0])
    assert got == want


def test_held_out_accuracy(spark):
    rows = [r for r in catalogue.queries()["language_detection"](spark, BASE).collect() if r["held_out"]]
    assert sum(r["detected"] == r["lang"] for r in rows) / len(rows) > 0.9


def test_texts_are_cut_into_ngrams_once(spark, monkeypatch):
    from tessella.plans import scripts as plans

    seen = []
    monkeypatch.setattr(plans, "cut", lambda df, name, cut=plans.cut: (seen.append(df), cut(df, name))[1])
    seen.append(plans.language_detection(spark, "/root/testdata/sf0.001"))
    plan = "".join(df._jdf.queryExecution().executedPlan().toString() for df in seen)
    assert plan.count("p{L}") > 0 and len(re.findall(r"(?:Project|Generate)[^\n]*p\{L\}", plan)) == 1


def test_detection_of_odd_rows_equals_the_sql(spark, tmp_path):
    import duckdb

    rows = [(k, lang, f"{a} {b}{a} {a}") for k in range(40) for lang, a, b in [[("x", "abca", "éü"), ("y", "bcdd", "𐐨𐐩"), (None, "cab", "中文")][k % 3]]]
    rows += [(5, "y", "ab ab cd"), (5, None, "xyz"), (6, "x", None), (8, "y", "zz"), (8, "y", "zz"), (None, "x", "abc"), (50, "x", ""), (51, "z", "1 2_3"), (52, None, None), (53, "y", "a"), (54, "w", "_a__b_")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalogue.queries()["language_detection"](spark, str(tmp_path)).select("doc_id", "lang", "held_out", "detected", "gain").collect()), key=repr)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(db.execute(catalogue.oracle_sql()["language_detection"]).fetchall(), key=repr)
    assert got == want and len(got) == len(rows)


@pytest.mark.parametrize("stretch", [1, 2, 3, 7, 1000])
def test_ngrams_of_stretches_are_those_of_the_text(monkeypatch, stretch):
    monkeypatch.setattr(languages, "STRETCH", stretch)
    rng = random.Random(4)
    for _ in range(40):
        words = ["".join(rng.choice("abé𐐨") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 6))]
        keys, counts = languages._counted("_" + "_".join(words) + "_")
        letters = ["".join(chr(k >> at & 0x1FFFFF) for at in (42, 21, 0) if k >> at & 0x1FFFFF) for k in keys.tolist()]
        assert dict(zip(letters, counts.tolist())) == plain_grams(" ".join(words)) and letters == sorted(letters)
    assert len(languages._counted("")[0]) == 0


@pytest.mark.parametrize(("block", "merge", "causal"), [(64, 32, True), (3, 2, True), (2, 2, False), (1, 3, True)])
def test_attention_equals_two_passes(spark, monkeypatch, block, merge, causal):
    monkeypatch.setattr(attention, "MERGE", merge)
    rng = np.random.default_rng(7)
    tokens, want = [], {}
    bias = lambda away: -0.1 * np.abs(away)
    for seq, n in (("a", 17), ("b", 1), ("c", 6)):
        v, hidden = rng.standard_normal((n, 4)) * 3, rng.random(n) < 0.3
        hidden[0] = seq == "c"
        tokens += [(seq, k, v[k].tolist(), bool(hidden[k])) for k in range(n)]
        for q in range(n):
            for h in range(2):
                seen = [k for k in range(n) if not hidden[k] and (k <= q or not causal)]
                x = np.array([v[q, 2 * h : 2 * h + 2] @ v[k, 2 * h : 2 * h + 2] / 2**0.5 - 0.1 * abs(k - q) for k in seen])
                e = np.exp(x)
                want[seq, q, h] = (np.log(e.sum()), (e[:, None] * v[seen, 2 * h : 2 * h + 2]).sum(0) / e.sum()) if seen else (None, np.zeros(2))
    df = spark.createDataFrame(tokens, "seq string, pos int, v array<double>, hidden boolean")
    got = {(r["seq"], r["pos"], r["head"]): (r["lse"], r["out"]) for r in attention.attend(df, 2, bias, causal, block).collect()}
    assert got.keys() == want.keys()
    for k, (lse, out) in want.items():
        assert got[k][0] == pytest.approx(lse, abs=1e-12) and got[k][1] == pytest.approx(out.tolist(), abs=1e-12)


def test_attention_writes_and_deals_in_proportion_to_the_tokens(spark, monkeypatch):
    """No partial results of two tiles are written, and each block of queries is one, however many keys it meets."""
    written = []
    monkeypatch.setattr(attention, "cut", lambda df, name, cut=attention.cut: (out := cut(df, name), written.append(out.count()))[0])
    for n in (100, 400):
        tokens = spark.range(n).selectExpr("'a' AS seq", "id AS pos", "array(sin(id), cos(id)) AS v", "id % 7 = 1 AS hidden")
        written.append(0)
        assert attention.attend(tokens, 1, lambda away: 0.0 * away, True, 2).count() == n
    first, second = written.index(0), len(written) - 1 - written[::-1].index(0)
    assert sum(written[second:]) <= 4 * sum(written[first:second])


@pytest.mark.parametrize(("most", "blocks", "causal"), [(4, 2, True), (5, 3, False), (1000, 1, True), (1, 64, True)])
def test_attention_by_blocks_of_any_size(spark, monkeypatch, most, blocks, causal):
    monkeypatch.setattr(attention, "MOST", most)
    monkeypatch.setattr(attention, "BLOCKS", blocks)
    monkeypatch.setattr(attention, "AT_ONCE", 2)
    tokens = spark.range(23).selectExpr("1 AS seq", "id AS pos", "array(sin(id), cos(id)) AS v", "id IN (0, 5, 6) AS hidden")
    got = {r["pos"]: (r["lse"], r["out"]) for r in attention.attend(tokens, 1, lambda away: -0.1 * np.abs(away), causal, 2).collect()}
    v = np.array([[np.sin(k), np.cos(k)] for k in range(23)])
    assert sorted(got) == list(range(23))
    for q, (lse, out) in got.items():
        seen = [k for k in range(23) if k not in (0, 5, 6) and (k <= q or not causal)]
        e = np.exp([v[q] @ v[k] / 2**0.5 - 0.1 * abs(k - q) for k in seen])
        assert lse is None and out == [0, 0] if not seen else lse == pytest.approx(np.log(e.sum()), abs=1e-12) and out == pytest.approx((e @ v[seen] / e.sum()).tolist(), abs=1e-12)


@pytest.mark.parametrize(
    ("line", "shown"),
    [
        ("abc def", "abc def"),
        ("אבג", "גבא"),
        ("abc אבג def", "abc גבא def"),
        ("אבג abc דהו", "והד abc גבא"),
        ("אב 123 גד", "דג 123 בא"),
        ("a (אב) c", "a (בא) c"),
        ("(אב) גד", "דג (בא)"),
        ("אב <ג]", "[ג> בא"),
        ("x אב, גד y", "x דג ,בא y"),
        ("אב 1,5% ג", "ג 1,5% בא"),
        ("ابج 1,5", "1,5 جبا"),
        ("car אב 5-7", "car 5-7 בא"),
        ("אב  ", "  בא"),
        ("ab אב ", "ab בא "),
        ("", ""),
        (None, None),
        ("12 - 34", "12 - 34"),
        ("\u05e9\u05b8\u05c1 b", "b \u05c1\u05b8\u05e9"),
    ],
)
def test_lines_as_they_are_seen(spark, line, shown):
    from tessella.functions.bidi import visual_order

    assert spark.createDataFrame([(line,)], "t string").select(visual_order("t").alias("x")).first()["x"] == shown


def test_seen_lines_by_recursive_reversal():
    """The same order by another way: the spans of each level, reversed from inside out."""
    from tessella.functions import bidi

    def turned(signs, level):
        if not signs:
            return []
        out, i = [], 0
        while i < len(signs):
            j = i
            while j < len(signs) and (signs[j][1] > level) == (signs[i][1] > level):
                j += 1
            part = signs[i:j]
            out.append(turned(part, level + 1) if part[0][1] > level else [c for c, _ in (part[::-1] if level % 2 else part)])
            i = j
        return [c for part in (out[::-1] if level % 2 else out) for c in part]

    rng = random.Random(8)
    for _ in range(300):
        line = "".join(rng.choice("ab אבג 12 ,.%-ابج ") for _ in range(rng.randint(0, 25)))
        levels = bidi.levels(line)
        assert bidi.seen(line) == "".join(turned(list(zip(line, levels)), 0))


def test_mirrors_come_in_pairs():
    from tessella.functions.bidi import mirror

    assert [mirror(c) for c in "()[]{}<>«»≤a∑"] == list(")(][}{><»«≥a∑")
    assert all(mirror(mirror(c)) == c for c in map(chr, range(0x3100)))


def test_letters_are_looked_up_once(monkeypatch):
    from tessella.functions import bidi

    asked, own = [], unicodedata.bidirectional
    monkeypatch.setattr(bidi.unicodedata, "bidirectional", lambda c: (asked.append(c), own(c))[1])
    assert bidi.seen("אב% ab " * 500) == bidi.seen("אב% ab " * 500)
    assert len(asked) <= 6
