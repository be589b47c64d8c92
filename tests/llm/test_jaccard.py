import random
import re

import pytest

from tessella.llm import jaccard


@pytest.fixture(autouse=True)
def few_fragments(monkeypatch):
    monkeypatch.setattr(jaccard, "LEAST_FRAGMENTS", 4)


def brute(rows):
    """Sizes and classes by comparing all pairs of sets."""
    sets = []
    for _, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall("[^\x20\x09-\x0d]+", low)
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i if i is not None else -1, len(s), low.get(find(k), -1) if s else (i if i is not None else -1)) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def corpus(seed):
    rng = random.Random(seed)
    prose = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4))) for _ in range(n)).split()
    texts = []
    passage = prose(40)
    for _ in range(30):  # a passage that many documents share
        texts.append(prose(rng.randint(5, 25)) + passage + prose(rng.randint(1, 10)))
    for size in (60, 25, 12):  # chains of near copies, each some words away from another
        group = [prose(size)]
        for _ in range(40):
            copy = list(rng.choice(group))
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = prose(1)[0]
            group.append(copy)
        texts += group
    texts = [" ".join(t) for t in texts]
    texts += [texts[0]] * 3 + [texts[1].upper(), "a b c", "A b\tc", "a", "", None, " \n", "x " * 40, "x " * 60, "é é é é é"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SEEN_OFTEN", 3)
    rows = corpus(3) + [(None, "a b c"), (7000, "a b c"), (7000, "a b c"), (None, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int").repartition(3)
    got = sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in jaccard.jaccard_classes(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    left = {k for k in (r["doc_id"] for r in kept.collect()) if k is not None}
    assert {i for i, _, c in got if i == c and i != -1} == left


def test_empty_table(spark):
    assert jaccard.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefix_length():
    assert [jaccard.prefix_length(n) for n in (0, 1, 4, 8)] == [0, 1, 2, 3]


def test_planes_round_trip():
    for kind in ("<u8", "<i8", "<u4"):
        x = jaccard.np.arange(37).astype(kind) * 1_000_003 % 65_521
        assert (jaccard._unplanes(jaccard._planes(x), kind) == x).all()


def test_every_fragment_size_gives_the_same_classes(spark, monkeypatch):
    rows = corpus(8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(jaccard, "LEAST_FRAGMENTS", 3)
    for often in (2, 10**6):  # all shared n-grams count as frequent; none does
        monkeypatch.setattr(jaccard, "SEEN_OFTEN", often)
        got = sorted((r[0], r[1], r[2]) for r in jaccard.jaccard_classes(docs).select("doc_id", "n_shingles", "component_id").collect())
        assert got == brute(rows)


def test_keep_one_leaves_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, "x", 7), (2, "A b c", 6, "y", 8), (3, None, 7, "z", 9)], "doc_id long, text string, id int, hash string, th int")
    got = {tuple(r) for r in jaccard.keep_one(docs).collect()}
    assert got == {(1, "a b c", 5, "x", 7), (3, None, 7, "z", 9)}


def test_texts_of_one_pattern_are_told_apart(spark):
    """Words of the Thue-Morse pattern, which polynomial hashes modulo a power of two confuse."""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    patterns = {x for n in range(13) for x in (word[: 2**n], other[: 2**n])}
    assert len(set(jaccard._word_hashes([x.encode() for x in patterns]).tolist())) == len(patterns)
    rows = [(1, "one two three four " + word), (2, "one two three four " + other), (3, word), (4, other), (5, f"{word} {other} x y z"), (6, f"{other} {word} x y z")]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(k, 1, k) for k in range(1, 7)]


def test_a_set_in_very_many_pairs_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS_AT_ONCE", 3)
    rows = corpus(11)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert sorted(got) == brute(rows)
