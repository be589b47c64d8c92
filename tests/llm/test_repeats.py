import hashlib
import random

import duckdb
import pytest

from tessella.llm import repeats


def brute(texts, least):
    """Kept bytes by comparing all windows."""
    data = [("" if t is None else t).encode() for t in texts]
    seen = {}
    for d, t in enumerate(data):
        for p in range(len(t) - least + 1):
            seen.setdefault(t[p : p + least], []).append((d, p))
    gone = [bytearray(len(t)) for t in data]
    for places in seen.values():
        if len(places) > 1:
            for d, p in places:
                gone[d][p : p + least] = b"\1" * least
    return [bytes(c for c, g in zip(t, m) if not g) for t, m in zip(data, gone)]


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, line = prose(20), prose(3)
    texts = [prose(30) for _ in range(12)]
    texts += [prose(6) + shared + prose(6) for _ in range(40)]
    texts += [texts[0]] * 3 + [texts[1].replace("a", "b", 1), None, "", "ab" * 60, "x" * 90, line * 12, "é" * 50]
    texts += [prose(2) + line * 3 + prose(2) for _ in range(10)]
    return texts


@pytest.mark.parametrize(("least", "hot"), [(40, 256), (40, 2), (12, 3)])
def test_equals_brute_force(spark, least, hot):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(docs, least, hot=hot).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, least)


def test_maximal_repeats_with_all_occurrences():
    strings = [b"xxhello worldyy", b"aahello worldbb", b"cchello wor", b"q"]
    found = {(n, tuple(sorted(at.tolist()))) for n, at in repeats.maximal_repeats(strings, 5)}
    assert (11, (2, 18)) in found
    assert (9, (2, 18, 34)) in found
    assert all(n >= 5 for n, _ in found)


def test_empty_table_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(none, 20).count() == 0
    twice = spark.createDataFrame([(None, "a long enough text, said twice"), (None, "a long enough text, said twice"), (3, "other")], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in repeats.remove_repeats(twice, 20).collect()) == [0, 30, 30]


def several_shared(seed, n=40):
    """Documents whose repeats of 400 to 1,300 bytes nest in each other's: two share more than a third does."""
    rng = random.Random(seed)
    raw = lambda k: "".join(rng.choice("abcdefghijklmnop ") for _ in range(k))
    out = []
    for _ in range(n):
        core, left, right = raw(rng.randint(380, 640)), raw(300), raw(400)
        a, b = rng.randint(0, 300), rng.randint(0, 400)
        out.append(raw(rng.randint(0, 300)) + left[a:] + core + right[:b] + raw(rng.randint(0, 90)))
        out.append(raw(rng.randint(0, 300)) + left[rng.randint(0, 300) :] + core + right[: rng.randint(0, 400)] + raw(50))
        out.append(raw(rng.randint(0, 300)) + left[rng.randint(a, 300) :] + core + right[: rng.randint(0, b)] + raw(50))
    rng.shuffle(out)
    return out


def test_long_nested_repeats_with_the_production_sizes(spark):
    texts = several_shared(11)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(docs).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, repeats.LEAST)


def test_a_third_string_does_not_shorten_what_two_share():
    rng = random.Random(3)
    raw = lambda k: bytes(rng.choice(b"abcdefgh") for _ in range(k))
    u, v = raw(520), raw(80)
    strings = [raw(11) + u + v + b"x", raw(11) + u + raw(30), raw(11) + u + v + b"y"]
    for order in ((0, 1, 2), (1, 0, 2), (2, 0, 1)):
        got = repeats.covered([strings[k] for k in order], [1, 1, 1], 400)
        assert [got[order.index(k)] for k in range(3)] == [[(11, 611)], [(11, 531)], [(11, 611)]]


def test_common_prefixes_equal_plain_ones():
    rng = random.Random(4)
    for _ in range(30):
        strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 9))] + [b"a" * 40] * rng.randint(0, 3)
        sa = repeats.SuffixArray(strings, 3)
        whole = [(k, p) for k, s in enumerate(strings) for p in range(len(s) + 1)]
        suffix = [(*strings[k][p:], 256 + k) for k, p in whole]
        assert [suffix[i] for i in sa.order] == sorted(suffix)
        for x, y, n in zip(sa.order, sa.order[1:], sa.common[1:]):
            true = next(j for j, (c, d) in enumerate(zip(suffix[x], suffix[y])) if c != d)
            assert n == (true if true >= 3 else 0)


def test_query_equals_its_sql(spark, tmp_path):
    texts = [*several_shared(7, 12), None, "", "short", "é" * 500, "ab" * 1500, "x" * 400]
    docs = spark.createDataFrame([(k, t, [1]) for k, t in enumerate(texts)], "doc_id long, text string, spans array<int>")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(repeats.ORACLE)
    columns = [d[0] for d in want.description]
    got = repeats.op10_suffix_array_dedup(spark, str(tmp_path))
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(want.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == rows
    digests = {r[0]: r[columns.index("kept_sha256")] for r in rows}
    assert [digests[k] for k in range(len(texts))] == [hashlib.sha256(t).hexdigest() for t in brute(texts, repeats.LEAST)]
