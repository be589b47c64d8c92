"""Encoding, chat, secrets, decontamination, sharding, classifiers and neighbours on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe, chat, contamination, neighbours, secrets, sharding, subword

ODD = [None, "", " ", "a" * 3000, "plain words, twice. plain words, twice.", "it's 12,345 <|endoftext|> x", "日本語 ñandú é\r\n\n end ", "\x1c\x85​😀😀", "a<|endoftext|>", "zq" * 700]


def odd_docs(spark, extra="spans"):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(3, ODD[3], "x"), (None, "no id", "x")]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra} string")


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary())
    got = bpe.encode_documents(odd_docs(spark, "ids")).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        text = "no id" if r["doc_id"] is None else ODD[r["doc_id"]] or ""
        ids = lib.encode(text, add_special_tokens=False).ids
        assert list(r["ids"]) == ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(odd_docs(spark, "y").limit(0)).count() == 0


def test_bpe_pair_rule_equals_merging():
    enc = bpe.encoder(bpe.vocabulary())
    rng = random.Random(1)
    tokens = [*enc.byte_id, *enc.parts]
    for _ in range(3000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        ids = [enc.byte_id[c] for c in enc.of_id[a] + enc.of_id[b]]
        while True:
            ranked = [(enc.rank[p], k) for k, p in enumerate(a << 20 | b for a, b in zip(ids, ids[1:])) if p in enc.rank]
            if not ranked:
                break
            rank, k = min(ranked)
            ids[k : k + 2] = [enc.merged[rank]]
        assert enc.compatible(a, b) == (ids == [a, b])


def test_bpe_forgets_texts_and_keeps_no_long_pieces():
    enc = bpe.encoder(bpe.vocabulary())
    before = enc.encode("a" * 5000 + " word")
    assert all(len(x) <= bpe.LONGEST_KEPT for x in enc.known)
    enc.forget()
    assert not enc.known and not enc.pairs and enc.encode("a" * 5000 + " word") == before
    enc.forget()


def test_escapes_are_reversible():
    rng = random.Random(2)
    parts = [*chat.CONTROL, "\\", ".", "<", "|", "s>", "x"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(c in e for c in chat.CONTROL)


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok \\ [/INST]"), (1, 0, "user", "<|turn|>é"), (2, 0, None, None), (2, 1, "assistant", ""), (None, 0, "user", "a"), (3, 0, "user", "x" * 9000), (3, 0, "user", "x" * 9000)]
    said = spark.createDataFrame([(*r, [1]) for r in rows], "conv_id long, turn long, role string, text string, ids array<int>")
    turns = chat.format_turns(said)
    got = {r["conv_id"]: r for r in chat.read_back(turns).collect()}
    assert set(got) == {1, 2, 3, None}
    want = "user\n<|turn|>é\nassistant\n</s>[INST] ok \\ [/INST]\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(rows[0][3].encode()).hexdigest()
    assert got[1]["loss_chars"] == len(rows[0][3])
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\n\nassistant\n\n").hexdigest()
    assert got[3]["n_turns"] == 2
    assert chat.read_back(chat.format_turns(said.limit(0))).count() == 0


def brute_spans(text):
    text = text or ""
    out = []
    for order, rule in enumerate(secrets.BASE + secrets.ADDED):
        p = rule.pattern
        for m in re.finditer(p, text, re.ASCII):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), order, m.end(), rule.kind))
    return sorted(out)


def test_secrets_equal_brute_force(spark):
    rng = random.Random(3)
    parts = ["password", "PassWD", "secret", "toKen", "api_key", "APIKEY", "=", ": ", '"', "'", " ", "abcdef12", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeefcafe", "é", "😀", "ghp_" + "a" * 36, "xoxb-1234567890", "eyJhbGci.eyJzdWIi.sig_1", "-----BEGIN RSA PRIVATE KEY-----", "token=token:abcdefgh"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)] + ODD + ["token=ab:secret=abcdef", "x" * 20000 + "AKIA" + "Z" * 16]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(0, texts[0], 1)], "doc_id long, text string, spans int")
    got = secrets.scan(docs).collect()
    assert len(got) == len(texts) + 1
    assert sum(len(r["spans"]) for r in got) > 100
    for r in got:
        assert [tuple(s) for s in r["spans"]] == brute_spans(r["text"]), r["text"]
    masked = secrets.redact(secrets.scan(docs))
    for r in masked.where("size(spans) > 0").collect():
        assert len(r["text"]) == len(texts[r["doc_id"]])
        assert all(set(r["text"][s["start"] : s["end"]]) == {"█"} for s in r["spans"])
    assert secrets.scan(docs.limit(0)).count() == 0


def test_trigram_queries_are_necessary():
    for rule in secrets.BASE + secrets.ADDED:
        ways = secrets.trigram_query(rule.pattern)
        assert bool(ways) == (rule.kind != "hex")
    assert {"tok", "oke", "ken"} in secrets.trigram_query(secrets.BASE[0].pattern)
    assert secrets.trigram_query("[a-z]+x") == []


def brute_hits(text, items, window):
    words = [w.decode() for w in contamination.words_of(text)]
    hit, found = set(), set()
    for k, item in items:
        ws = [w.decode() for w in contamination.words_of(item)]
        if not ws:
            continue
        n = min(window, len(ws))
        grams = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(k)
    return len(words), hit, found


@pytest.mark.parametrize("block_words", [400_000, 40])
def test_contamination_equals_brute_force(spark, block_words):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice("ab cd Éf g1 h".split()) for _ in range(n))
    items = [(k, prose(rng.choice((1, 2, 5, 9, 14)) + (3 if k else 0))) for k in range(25)] + [(30, ""), (31, None), (32, "!!"), (5, prose(8))]
    texts = [prose(rng.randint(0, 40)) + ", " + (rng.choice(items)[1] or "") + "; " + prose(4) for _ in range(60)] + ODD
    docs = spark.createDataFrame([(k, t, "q") for k, t in enumerate(texts)], "doc_id long, text string, hit_items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.find_contamination(docs, bench, window=6, block_words=block_words).collect()
    for r in got:
        n, hit, found = brute_hits(r["text"], items, 6)
        assert r["n_words"] == n
        assert {i for s in r["hit_spans"] for i in range(s["start"], s["end"])} == hit
        assert set(r["hit_items"]) == found
    clean = contamination.remove_spans(contamination.find_contamination(docs, bench, window=6)).select("doc_id", "text")
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in got:
        words = [w for w in contamination.words_of(r["text"])]
        hit = {i for s in r["hit_spans"] for i in range(s["start"], s["end"])}
        assert Counter(contamination.words_of(left[r["doc_id"]])) == Counter(w for i, w in enumerate(words) if i not in hit)
    assert contamination.find_contamination(docs, bench.limit(0)).where("size(hit_items) > 0").count() == 0
    assert contamination.find_contamination(docs.limit(0), bench).count() == 0


def test_sharding(spark):
    docs = spark.range(1003).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("é"), (F.col("id") % 3).cast("string"))).alias("text"), F.lit("s").alias("shard"))
    got = sharding.shuffle_into_shards(docs, 40).collect()
    assert len(got) == 1003
    counts = Counter(r["shard"] for r in got)
    assert len(counts) == 40 and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert {r["size"] for r in got} == {16, 19}
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order != sorted(order)
    assert sharding.shuffle_into_shards(docs.limit(0)).count() == 0


def test_sharding_writes_whole_rows(spark, tmp_path):
    docs = spark.range(90).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit(1).alias("bucket"))
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 90 and back.select("shard").distinct().count() == 4
    assert sorted(r["text"] for r in back.collect()) == sorted(map(str, range(90)))


def test_sharding_counts_buckets_by_the_texts_bytes(spark, monkeypatch):
    asked = []
    count = sharding.bucket_count
    monkeypatch.setattr(sharding, "bucket_count", lambda n, size, *a: asked.append((n, size)) or count(n, size, *a))
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), 5000).alias("text"))
    assert sharding.shuffle_into_shards(docs, 4).count() == 20
    assert asked[0][0] == 20 and asked[0][1] >= 20 * 10_000


def test_op6_reads_back_the_shards_it_wrote(spark, tmp_path, monkeypatch):
    texts = [None, "", "é", *(f"text {k} " * k for k in range(1, 200))]
    spark.createDataFrame([(k // 2, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "in/documents.parquet"))
    monkeypatch.setattr(sharding, "shared_dir", lambda s: str(tmp_path / "shared"))
    got = sharding.op6_sharding(spark, str(tmp_path / "in")).collect()
    whole = spark.read.parquet(str(tmp_path / "shared/shards-*")).collect()
    assert Counter((r["doc_id"], r["text"], r["lang"]) for r in whole) == Counter((k // 2, t, "x") for k, t in enumerate(texts))
    digests = lambda t: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    placed = sorted((r["shard"], r["slot"], r["doc_id"], *digests(r["text"])) for r in whole)
    assert sorted((r["shard"], r["slot"], r["doc_id"], r["size"], r["text_crc32"]) for r in got) == placed
    assert sorted(r[:2] for r in placed) == [(s, k) for s in range(40) for k in range(len(texts) // 40 + (s < len(texts) % 40))]


def labelled(n, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("tha", "ne", "ri", "os", "um", "el")) for _ in range(rng.randint(1, 4)))
    bad = ["grotzik", "grotzak", "grotzel", "blarvik", "blarvon"]
    texts, y = [], []
    for _ in range(n):
        words = [word() for _ in range(rng.randint(20, 200))]
        label = rng.random() < 0.4
        if label:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        y.append(int(label))
    return texts, y


def test_windows_find_few_and_misspelt_words():
    spec = subword.Spec(window=6, bag_epochs=4, window_epochs=15, buckets=1 << 16)
    texts, y = labelled(250)
    model = subword.train(texts, y, spec)
    held, truth = labelled(120, seed=6)
    predicted = model.scores(held) >= 0.7
    assert np.mean(predicted == (np.array(truth) == 1)) > 0.95
    clean = [t for t, label in zip(held, truth) if not label][0]
    assert model.scores([clean + " grotzuk and blarvil"])[0] > model.scores([clean])[0]
    assert 0 <= model.scores([""])[0] <= 1


def test_features_count_words_alike_alone_and_in_a_batch():
    spec = subword.Spec(pairs=True, fold=False)
    texts = ["one two two", "", "  é!! Ab1 ", "one"]
    model = subword.Model(spec, np.random.default_rng(0).standard_normal(spec.buckets).astype(np.float32), 0.1)
    together = model.scores(texts)
    alone = [model.scores([t])[0] for t in texts]
    assert np.allclose(together, alone)


def test_training_without_both_classes():
    assert subword.train([], [], subword.Spec()).scores(["x"])[0] == pytest.approx(0.5)
    assert subword.train(["a", "b"], [1, 1], subword.Spec()).scores(["x"])[0] > 0.9


def test_classifier_queries_on_odd_rows(spark):
    docs = odd_docs(spark, "score")
    model = subword.train(*labelled(40), subword.Spec(bag_epochs=1, buckets=1 << 12))
    got = subword.score(docs, model).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in got)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    texts, y = subword.labelled_sample(docs, labels, "quality", 1, 2, subword.Spec())
    assert (texts, y) == ([""], [1])


def test_neighbours_recall_and_exact_scores(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 24)).astype(np.float32)
    x[100:1100] = x[50]  # a hot vector
    x[2000] = 0
    rows = [(k, v.tolist(), k) for k, v in enumerate(x)] + [(5000, None, 0), (5001, [float("nan")] * 24, 0), (5002, [1.0], 0), (5003, [None] * 24, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank long").repartition(3)
    usable, dim = neighbours.usable(table)
    assert dim == 24 and usable.count() == 2999
    index, books = neighbours.build_index(usable)
    queries = usable.where("vec_id % 60 = 0")
    got = {}
    for r in neighbours.search(index, books, queries, 10, query_block=20, rerank=40).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    exact = x.astype(float) @ x.astype(float).T
    hits = 0
    assert len(got) == queries.count()
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        score = exact[q].copy()
        score[[q, 2000]] = -np.inf
        want = np.lexsort((np.arange(len(score)), -score))[:10]
        hits += len(set(want.tolist()) & {f[1] for f in found})
        assert all(abs(f[2] - exact[q, f[1]]) < 1e-9 for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
    assert hits / (10 * len(got)) >= 0.9
    none, _ = neighbours.usable(table.limit(0))
    assert neighbours.search(*neighbours.build_index(none), none).count() == 0


def test_sharding_depends_on_rows_and_seed_alone(spark):
    import zlib

    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("é"), (F.col("id") % 50).cast("string"))).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(None, "x"), (None, "x"), (5000, None), (5000, None)], "doc_id long, text string"))
    found = []
    for parts, shuffles in ((1, "3"), (7, "11")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        got = sharding.shuffle_into_shards(docs.repartition(parts), 6).collect()
        found.append(sorted((r["shard"], r["slot"], r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]
    other = sharding.shuffle_into_shards(docs, 6, seed=1).collect()
    assert sorted((r["shard"], r["slot"], r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in other) != found[0]
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert all(r["size"] == len(text[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in other)
    # rows that are equal in id and text beyond what a bucket holds are spread by position
    same = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.lit("y").alias("text"))
    got = sharding.shuffle_into_shards(same, 6, bucket_rows=16).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(6) for k in range(50)]


def test_written_shards_keep_clashing_columns_in_several_files(spark, tmp_path):
    docs = spark.range(90).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.lit(7).alias("slot"), F.lit("s").alias("size"))
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3, file_bytes=200)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("slot_", "size_").distinct().collect() == [(7, "s")]
    files = [p for p in (tmp_path / "out").glob("shard=0/*.parquet")]
    assert len(files) > 1
    ranges = sorted((r[0], r[1]) for r in back.where("shard = 0").groupBy(F.input_file_name()).agg(F.min("slot"), F.max("slot")).select("min(slot)", "max(slot)").collect())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_classifier_queries_equal_plain_scores(spark, tmp_path):
    """held_out by its definition, scores by adding up the model's weights word by word, null ids and texts as any other."""
    import zlib

    from tessella.llm import quality, toxicity

    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, "a few words"), (90_001, None), (90_002, "")], "doc_id long, text string"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{base}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    for query, module, modulus, fold in ((quality.op1_quality_classifier, quality, 4, 2), (toxicity.op8_toxicity, toxicity, 3, 1)):
        rows = query(spark, str(tmp_path)).collect()
        assert len(rows) == docs.count()
        model = module.fit(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
        text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        for r in rows:
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == fold)
            assert r["predicted"] == int(r["score"] >= 0.7)
            bucket, owner, counts = subword.features([text[r["doc_id"]]], model.spec)
            words = [[] for _ in range(int(counts[0]))]
            for b, w in zip(bucket.tolist(), owner.tolist()):
                words[w].append(float(model.weight[b]))
            means = [sum(w) / len(w) for w in words]
            size = model.spec.window or len(means)
            windows = [means[k : k + size] for k in range(max(len(means) - size + 1, 1))] if means else []
            logit = model.bias + (max(sum(w) / len(w) for w in windows) if windows else 0)
            assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(logit, -50, 50)))) < 1e-6
