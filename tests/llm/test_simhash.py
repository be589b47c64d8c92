import random
import re

import numpy as np
import pytest
import xxhash

from tessella.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id int"


def plain_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[k : k + 4]) for k in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, ids):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(prints))]


def check(spark, rows):
    prints = [plain_print(r[1]) for r in rows]
    want = list(zip([r[0] for r in rows], ["%016x" % p for p in prints], classes(prints, [r[0] for r in rows])))
    got = [tuple(r) for r in simhash.simhash_classes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(60)]
    for size in (400, 150, 60):  # chains of near copies
        group = [[word() for _ in range(size)]]
        for _ in range(50):
            copy = list(rng.choice(group))
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(size)] = word()
            group.append(copy)
        texts += [" ".join(g) for g in group]
    texts += [texts[0]] * 3 + [texts[1].upper(), "a b c", "A b\tc", "a", "", None, " \n", "x " * 50]
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + rows[:4] + [(None, texts[0], "x", 1), (None, "nothing like it", "x", 1)]


def test_equals_brute_force(spark):
    assert len({r[2] for r in check(spark, corpus(1))}) > 60


@pytest.mark.parametrize("bucket,cell", [(4, 4096), (512, 16), (1, 7)])
def test_buckets_and_pieces_change_nothing(spark, monkeypatch, bucket, cell):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "CELL", cell)
    check(spark, corpus(2))


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 1_000)
    rng = random.Random(4)
    text = " ".join(str(rng.randint(0, 5_000)) for _ in range(40_000))
    assert len({r[2] for r in check(spark, [(1, text, "", 0), (2, text + " more", "", 0), (3, "y" * 200_000, "", 0)])}) == 2


def test_empty_table(spark):
    assert simhash.simhash_classes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_gray_neighbours_differ_in_one_bit():
    codes = np.argsort(simhash.gray_rank(np.arange(64, dtype=np.uint64)))
    assert all((int(a) ^ int(b)).bit_count() == 1 for a, b in zip(codes, codes[1:]))


@pytest.mark.parametrize("spread", [3, 12, 64])
def test_index_finds_every_pair(spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(0, 2**64, 5, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, spread), dtype=np.uint64), initial=np.uint64(0)) for _ in range(700)], np.uint64)
    prints = np.unique(rng.choice(centres, 700) ^ flips)
    q, found = simhash.GrayIndex(prints).near(prints)
    want = np.nonzero(np.bitwise_count(prints[:, None] ^ prints) <= 4)
    assert sorted(zip(q.tolist(), found.tolist())) == sorted(zip(want[0].tolist(), want[1].tolist()))
