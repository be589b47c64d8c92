import random
import re
from collections import Counter

import pytest

from tessella.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int"


def brute(rows, least, k):
    groups, docs = {}, {}
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        groups.setdefault((lang, source), Counter()).update(terms)
        docs.setdefault(lang, Counter()).update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}
        everything = {t: sum(c[t] for c in own.values()) for t in kept}

        def prob(counts):
            total = sum(counts.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (n + 5) // total for t, n in counts.items()}

        p, q = {s: prob(c) for s, c in own.items()}, prob(everything)
        for s in own:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            words = [(p[s][t] - q[t], t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", words, k)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdéü") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    rows = []
    for k in range(200):
        lang, source = rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", "", None])
        text = " ".join(rng.choice(words[: 20 if source == "s2" else 150]).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 60)))
        rows.append((k, text, lang, source, "x", 1))
    rows += [(900, None, "de", "s1", "x", 1), (901, "", "de", "s2", "x", 1), (902, "12 34", "de", "s9", "x", 1), (903, "only here", "it", "s1", "x", 1), (904, "", "en", "empty", "x", 1)]
    return rows + rows[:5]


@pytest.mark.parametrize("least,k", [(1, 50), (8, 5), (500, 50)])
def test_equals_brute_force(spark, least, k):
    rows = corpus(3)
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), least, k)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, k)


def test_many_ties_and_one_large_bucket(spark):
    rows = [(k, " ".join(f"w{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"), "en", "s1", "", 0) for k in range(3)] + [(9, "w", "en", "s2", "", 0)]
    rows = [(k, t.replace(" ", ". "), *r) for k, t, *r in rows]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, SCHEMA), 1, 7).collect())) == brute(rows, 1, 7)


def test_very_long_text_is_counted_in_stretches(spark):
    text = "aé bb1cc " * 30_000
    assert Counter(t for part in divergence.terms_of(text.encode(), 1_000) for t in part) == {w: 30_000 for w in ("aé".encode(), b"bb", b"cc")}
    rows = [(1, text, "en", "s1", "", 0), (2, "x" * 100_000 + " aé", "en", "s2", "", 0)]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, SCHEMA), 1, 50).collect())) == brute(rows, 1, 50)


def test_counts_beyond_what_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES_AT_ONCE", 10)
    rows = corpus(5)
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, SCHEMA).coalesce(1), 4, 9).collect())) == brute(rows, 4, 9)


def test_large_counts_are_exact(spark):
    rows = [("en", "s1", "", 0, 1), ("en", "s1", "a", 9_000_000_000_000_000_000, 50), ("en", "s2", "", 0, 1), ("en", "s2", "b", 7, 50)]
    groups, held = divergence.postings(spark.createDataFrame(rows, "lang string, source string, term string, n long, docs long"), 30)
    found = {(r["source"], r["term"]): (r["p"], r["q"]) for r in held.collect()}
    n = 9 * 10**18
    assert found["s1", "a"] == (1 + 10**9 * (n + 5) // (n + 10), 1 + 10**9 * (n + 5) // (n + 7 + 10))


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
