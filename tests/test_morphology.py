"""Words from four heads, worked by hand."""

import math
from dataclasses import fields, replace

import pytest
from pyspark.sql import functions as F

from tessella.operators import morphology
from tessella.runtime import cut

HEADS = [
    ("stem", 10, 0.6), ("stem", 11, 0.35), ("stem", 20, 0.04), ("stem", 12, 0.01),
    ("pos", 10, 0.7), ("pos", 20, 0.3),
    ("afset", 10, 0.5), ("afset", 11, 0.45), ("afset", 20, 0.05),
    ("affix", 1, 0.5), ("affix", 2, 0.4), ("affix", 3, 0.35), ("affix", 4, 0.1), ("affix", 99, 0.9),
]


@pytest.fixture(scope="module")
def tables(spark):
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    types = [(h, i, 0) for h in ("stem", "pos", "afset") for i in (10, 11, 12)] + [(h, 20, 1) for h in ("stem", "pos", "afset")] + [("affix", i, 0) for i in (1, 2, 3, 4)]
    return morphology.Tables(
        made(types, "head string, id long, wt int"),
        made([(1, 3, 0), (2, 3, 1), (3, 12, 2), (4, 5, 0), (7, 3, 9)], "affix long, slot long, idx long"),
        made([(11, 1, 7)], "afset long, nth int, affix long"),
        made([(10, 0, 3), (10, 0, 12), (11, 0, 3)], "afset long, wt int, slot long"),
        made([(10, 10), (10, 11), (20, 20)], "pos long, stem long"),
        made([(10, 10), (10, 11), (20, 20)], "pos long, afset long"),
        made([(10, 10, 0.0), (11, 10, 1.0), (10, 11, 2.0)], "afset long, stem long, corr double"),
        stem_slot=F.lit(8),
    )


def decode(spark, tables, heads, **limits):
    rows = spark.createDataFrame([(1, *h) for h in heads], "key int, head string, id long, p double")
    return {(r["wt"], r["stem"], r["pos"], r["afset"]): r for r in morphology.decode_words(rows, tables, ["key"], **limits).collect()}


def test_one_word_type(spark, tables):
    """Type 1 falls by more than delta below type 0; affix 99 has no type; slot 3 is filled once, free affixes need a slot."""
    got = decode(spark, tables, HEADS)
    scores = [sum(map(math.log, (0.6, 0.7, 0.5))), sum(map(math.log, (0.04, 0.3, 0.05)))]
    share = 1 / (1 + math.exp(scores[1] - scores[0]))
    raw = {(10, 10): 0.6 * 0.7 * 0.5, (10, 11): math.exp(0.08) * 0.6 * 0.7 * 0.45, (11, 10): math.exp(0.16) * 0.35 * 0.7 * 0.5}
    assert {(k[1], k[3]): r["prob"] for k, r in got.items()} == {k: pytest.approx(share * x / sum(raw.values()), abs=1e-8) for k, x in raw.items()}
    # set 10: affix 1 before affix 2 in slot 3, affix 3 in slot 12, and with it the doubling's slot 11; affix 4 is too unlikely
    assert got[0, 10, 10, 10]["synthesis"] == "0:3-8-11-12|0,0,0,2" and got[0, 10, 10, 10]["n_free"] == 2
    # set 11: its own affix 7 holds slot 3 against the free ones
    assert got[0, 10, 10, 11]["synthesis"] == "0:3-8|9,0" and got[0, 10, 10, 11]["n_free"] == 0


def test_cuts(spark, tables):
    """The second stem falls by 0.25 and goes with a smaller limit; a larger delta lets the second type in, which has no pairs."""
    assert {k[1] for k in decode(spark, tables, HEADS, fall=0.2)} == {10}
    assert {k[0] for k in decode(spark, tables, HEADS, delta=9.0)} == {0}
    assert decode(spark, tables, []) == {}


def test_search_ends_with_eos_or_stays_pending(spark, tables):
    """Sentence 1 ends at its first word or goes on; sentence 2 never gets a word that its tables know."""
    heads = [("stem", 10, 0.9), ("pos", 10, 0.9), ("afset", 10, 0.9)]

    def score(front):
        each = F.explode(F.array(*[F.struct(F.lit(h).alias("head"), F.lit(i).cast("long").alias("id"), F.lit(p).alias("p")) for h, i, p in heads]))
        return front.where("sentence <> 2").select("sentence", "place", each.alias("h")).select("sentence", "place", "h.*")

    sentences = spark.createDataFrame([(1,), (2,)], "sentence long")
    finish = lambda logp, n: logp / n
    got = {r["sentence"]: r for r in morphology.search(sentences, score, finish, tables, 10, 2, 1, 3).collect()}
    assert (got[1]["status"], got[1]["words"], got[1]["n_done"]) == ("complete", "10/10/10/", 1)
    assert (got[2]["status"], got[2]["words"]) == ("none", None)
    got = {r["sentence"]: r for r in morphology.search(sentences, score, finish, tables, 77, 2, 1, 2).collect()}
    assert (got[1]["status"], got[1]["words"], got[1]["n_done"]) == ("pending", "10/10/10/ 10/10/10/", 0)


def test_words_of_a_state_are_decoded_once(spark, monkeypatch):
    """Every vector is asked for by the first round already; later rounds find its words there."""
    from tessella.plans import morphs

    rows, decoded = [], morphology.decode_words

    def counted(heads, *args, **limits):
        rows.append(heads.count())
        return decoded(heads, *args, **limits)

    monkeypatch.setattr(morphology, "decode_words", counted)
    base = "/root/testdata/sf0.001"
    assert morphs.morph_beam(spark, base).count() == 500
    assert sum(rows) == 500 * len(morphs.HEADS) * morphs.SIZE


def test_ids_of_a_key_are_shuffled_once_at_most(spark, tables):
    """Heads dealt by their key stay where they are until they are words: with small tables no other exchange by the key."""
    tables = replace(tables, **{f.name: cut(getattr(tables, f.name), "test") for f in fields(tables) if f.name != "stem_slot"})
    rows = spark.createDataFrame([(k, *h) for k in range(3) for h in HEADS], "key int, head string, id long, p double").repartition(4, "key")
    plan = morphology.decode_words(rows, tables, ["key"])._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(key" in line for line in plan.splitlines()) == 1


def test_options_keep_what_a_rounding_can_make_equal(spark):
    """Words that end stay all; of the others those that may be among the two best once costs are rounded to nine digits."""
    probs = {10: 0.5, 11: 0.3, 12: 0.3 - 1e-10, 13: 0.3 - 2e-10, 14: 0.2, 15: 0.1, 16: 0.05, 17: 0.01}
    rows = [(1, k, 5, 5, p, "x") for k, p in probs.items()] + [(1, 2, 2, 2, 0.001, f"{i}") for i in range(5)] + [(2, 10, 5, 5, 0.0, "")]
    words = spark.createDataFrame(rows, "state int, stem long, pos long, afset long, prob double, synthesis string")
    got = {r["state"]: r for r in morphology._options(words, ["state"], 2, 2).collect()}
    assert len(got[1]["ends"]) == 5 and got[2]["ends"] == []
    kept = {x["stem"] for x in got[1]["goes_on"]}
    assert kept >= {10, 11, 12, 13} and 17 not in kept
    assert [(x["word"], round(x["cost"], 6)) for x in got[2]["goes_on"]] == [("10/5/5/", round(-math.log(1e-20), 6))]
