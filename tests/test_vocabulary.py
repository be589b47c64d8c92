"""Listed words meet their figures where they are; only the others are dealt to theirs."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.operators import vocabulary
from tessella.plans import sequences, texts


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    rng = random.Random(6)
    rows = [(k, " ".join(f"w{min(int(rng.expovariate(0.1)), 60)}x" for _ in range(rng.randint(0, 30)))) for k in range(60)] + [(60, None), (61, " ")]
    path = str(tmp_path_factory.mktemp("vocabulary"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path, rows


@pytest.mark.parametrize("listed", [0, 3, 1000])
def test_any_length_of_the_list_gives_the_same(spark, monkeypatch, base, listed):
    path, rows = base
    monkeypatch.setattr(vocabulary.with_listed, "__defaults__", (listed,))
    terms = {k: Counter((t or "").split()) for k, t in rows}
    docs = Counter(w for c in terms.values() for w in c)
    want = []
    for k, c in terms.items():
        scores = sorted((-round((0.5 + 0.5 * f / max(c.values())) * math.log(1e6 / (1 + docs[w])), 9), w) for w, f in c.items())
        want += [(k, i + 1, w, -s) for i, (s, w) in enumerate(scores[:3])]
    got = [tuple(r) for r in sequences.tfidf_keywords(spark, path).collect()]
    assert [x[:3] for x in sorted(got)] == [x[:3] for x in sorted(want)]
    good = {r["doc_id"]: (r["n_tokens"], r["n_known"]) for r in texts.section_quality(spark, path).collect()}
    plain = {}
    for k, c in terms.items():
        if k % 2:  # texts without added dots
            known = sum(n for w, n in c.items() if docs[w] >= 10)
            if c.total() >= 8 and known / c.total() >= 0.4:
                plain[k] = (c.total(), known)
    assert {k: v for k, v in good.items() if k % 2} == plain


def test_words_of_the_list_are_not_dealt(spark, base):
    """Beside the texts, and the counts by term of every part, only unlisted words travel: here none."""
    left = []
    cut = sequences.cut
    try:
        sequences.cut = lambda df, name: (out := cut(df, name), left.append((name, out)))[0]
        sequences.tfidf_keywords(spark, base[0]).count()
    finally:
        sequences.cut = cut
    kept = dict(left)["tfidf-left"]
    assert kept.where("score IS NULL").count() == 0 and kept.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_words_of_names_are_counted_where_their_text_is(spark):
    from tessella.plans import records

    plan = records.name_list(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert not any("doc_id#" in by and by.count("#") > 1 for by in dealt)
