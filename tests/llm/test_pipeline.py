"""The pipeline's rows against a plain version of every stage, with nulls, repeats and clashing columns."""

import hashlib
import re
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import bpe, jaccard, quality, secrets

BASE = "/root/testdata/sf0.001"


@pytest.fixture()
def folder(spark, tmp_path, monkeypatch):
    """documents with null and empty texts, repeated rows, a null id, and columns named as the stages' own."""
    monkeypatch.setattr(jaccard, "LEAST_FRAGMENTS", 4)
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    item = spark.read.parquet(f"{BASE}/benchmark.parquet").first()["text"]
    mean = docs.where("length(text) between 200 and 900").orderBy("doc_id").first()["text"]
    odd = [(10_001, None), (10_002, ""), (None, mean + " and quite some other words after it"), (10_003, mean + " " + item), (10_004, item), (10_005, mean + " api_key = abcd1234EFGH"), (10_005, mean + " api_key = abcd1234EFGH")]
    more = spark.createDataFrame(odd, "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    for k, name in enumerate(("quality_score", "spans", "n_words", "hit_spans", "hit_items", "others", "id", "hash", "score")):
        docs = docs.withColumn(name, F.lit(k))
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        shutil.copy(f"{BASE}/{name}.parquet", tmp_path / f"{name}.parquet")
    return str(tmp_path)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def one_of_each(rows):
    sets = []
    for _, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", lowered(text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    home = list(range(len(rows)))

    def root(x):
        while home[x] != x:
            x = home[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                home[root(i)] = root(j)
    first = {}
    for k, row in enumerate(rows):
        if sets[k]:
            key = (row[0] is None, row[0] or 0)
            first[root(k)] = min(first.get(root(k), (key, k)), (key, k))
    kept = {k for _, k in first.values()}
    return [r for k, r in enumerate(rows) if not sets[k] or k in kept]


def without_benchmark(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for text in items:
        w = word.findall(lowered(text or ""))
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)} if w else set()
    sizes = {len(w) for w in windows}
    out = []
    for i, text in rows:
        found = list(word.finditer(lowered(text))) if text else []
        w = [m[0] for m in found]
        hit = [False] * len(w)
        for size in sizes:
            for a in range(len(w) - size + 1):
                if tuple(w[a : a + size]) in windows:
                    hit[a : a + size] = [True] * size
        if sum(hit) > corpus_pipeline.MOST_BENCHMARK * max(len(w), 1):
            continue
        if any(hit):
            parts, end, k = [], 0, 0
            while k < len(w):
                if hit[k]:
                    last = k
                    while last + 1 < len(w) and hit[last + 1]:
                        last += 1
                    parts.append(text[end : found[k].start()])
                    end, k = found[last].end(), last
                k += 1
            text = "".join([*parts, text[end:]])
        out.append((i, text))
    return out


def masked(text):
    hidden = set()
    for rule in secrets.BASE + secrets.ADDED:
        for m in re.finditer(rule.pattern, text):
            if len(m[rule.group]) >= rule.least:
                hidden.update(range(*m.span()))
    return "".join("█" if k in hidden else c for k, c in enumerate(text))


def test_run_equals_a_plain_version(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    good = [r for r, s in zip(rows, model.scores([t or "" for _, t in rows])) if s >= quality.ACCEPT]
    assert 0 < len(good) < len(rows)
    left = without_benchmark(one_of_each(good), [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    assert len(left) < len(good)
    lib = Tokenizer.from_file(bpe.vocabulary())
    lib.no_truncation()
    lib.no_padding()
    want = []
    for i, text in left:
        text = masked(text or "")
        ids = lib.encode(text, add_special_tokens=False).ids
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, folder).select(F.coalesce("doc_id", F.lit(-1)), "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_stages_keep_all_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.select("quality_score", "spans", "n_words", "hit_spans", "hit_items", "others", "id", "hash", "score").distinct().collect() == [tuple(range(9))], name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "bpe"]


def test_empty_documents_give_no_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
