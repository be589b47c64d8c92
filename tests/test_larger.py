"""What only larger tables hold, in small ones: queries against their SQL on tables made for it."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tessella.plans import catalogue
from tests.test_oracles import BASE, plain


def both(spark, folder, name, **tables):
    """Rows of the query and of its SQL over the small tables, some of them replaced."""
    os.makedirs(folder, exist_ok=True)
    con = duckdb.connect()
    for f in os.listdir(BASE):
        table, path = f.removesuffix(".parquet"), f"{folder}/{f}"
        if table in tables:
            pq.write_table(tables[table], path)
        else:
            os.symlink(f"{BASE}/{f}", path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    want = con.execute(catalogue.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    got = catalogue.queries()[name](spark, str(folder))
    return sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()), theirs


def documents(texts):
    n = len(texts)
    return pa.table({"doc_id": list(range(n)), "text": texts, "lang": ["de"] * n, "source": ["src0"] * n, "n_chars": [len(t or "") for t in texts]})


def test_composite_keys_of_long_numbers(spark, tmp_path):
    keys = [0, 7, 99_999, 999_999, 1_000_000, 1_000_050, 9_000_000, 9_000_001]
    n = len(keys)
    items = pa.table({"l_orderkey": keys, "l_partkey": [1] * n, "l_suppkey": [1] * n, "l_linenumber": pa.array([1, 2, 3, 7, 1, 1, 12, 123], pa.int32()), "l_returnflag": ["A"] * n, "l_linestatus": ["F"] * n})
    ours, theirs = both(spark, tmp_path / "t", "composite_keys", lineitem=items)
    assert ours == theirs


CAPITALS = ["ßab c", "ŉab c", "ᾳb c", "ﬁb c", "éa b", "ßab", "a ß", "", None]


def test_detokenise_keeps_one_letter_for_one(spark, tmp_path):
    ours, theirs = both(spark, tmp_path / "t", "detokenise", documents=documents(CAPITALS))
    assert ours == theirs
    assert "ẞab c" in [r[1] for r in ours]


def test_detokenise_marked_keeps_one_letter_for_one(spark, tmp_path):
    ours, theirs = both(spark, tmp_path / "t", "detokenise_marked", documents=documents(CAPITALS * 4))
    assert ours == theirs


def test_token_stats_at_the_share_itself(spark, tmp_path):
    # 63 of 90 and 126 of 180 are 0.7 exactly, and no more than it
    texts = [" ".join(["Abc"] * 21 + ["abc"] * 9 + ["Def"] * 42 + ["def"] * 18)] * 3 + ["ghi abc"] + ["Abc Def"] * 0 + ["x"]
    texts += [" ".join(["Jkl"] * 16 + ["jkl"] * 6 + ["Mno"] * 63 + ["mno"] * 27)] + [" ".join(["Jkl"] * 16 + ["jkl"] * 7)] * 3 + ["Jkl jkl", "Mno mno"]
    texts += [" ".join(["Pqr"] * 21 + ["pqr"] * 9)] * 2 + [" ".join(["Pqr"] * 20 + ["pqr"] * 9), "Pqr"]
    ours, theirs = both(spark, tmp_path / "t", "token_stats", documents=documents(texts))
    assert ours == theirs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ngrams_are_counted_where_they_arise(spark):
    from tessella.operators import languages

    docs = spark.createDataFrame([(i, "le la de und", "fr") for i in range(20)], "id long, text string, lang string")
    grams = languages.ngrams(docs, 3)
    assert plan(grams).count("Exchange") == 1
    assert plan(languages.detect(grams, languages.profiles(grams, docs).localCheckpoint())).count("Exchange hashpartitioning") == 1


def test_multi_hot_computes_its_ids_once(spark):
    from pyspark.sql import functions as F

    from tessella.functions import sequences

    made = spark.createDataFrame([([3, 1, 3],), ([],)], "v array<int>").select(sequences.multi_hot(F.col("v"), 4).alias("hot"))
    assert [r["hot"] for r in made.collect()] == [[0.0, 1.0, 0.0, 1.0], [0.0] * 4]
    # the ids themselves stand outside of what is done for each place
    assert "array_contains(v" not in plan(made)


def test_a_packed_token_is_split_once(spark):
    from pyspark.sql import functions as F

    from tessella.functions import sequences

    made = spark.createDataFrame([("1,2,3,4,2,7,8,1,9|Ab",)], "t string").select(sequences.parse_token(F.col("t")).alias("p"))
    p = made.first()["p"]
    assert (p["lm_stem"], p["stem"], p["extra"], p["affixes"], p["surface"]) == (1, 4, [7, 8], [9], "ab")
    assert plan(made).count("split(") == 1


def test_copied_words_come_from_asked_texts_only(spark):
    from tessella.plans import models

    assert "LeftSemi" in plan(models.copy_choice(spark, BASE))


def test_followed_words_come_from_asked_texts_only(spark):
    from tessella.plans import models

    assert "LeftSemi" in plan(models.copy_extension(spark, BASE))


def test_ngrams_are_counted_where_their_pair_is(spark):
    from tessella.functions import metrics

    pairs = spark.createDataFrame([("a", ["x", "y", "x"], ["x", "x", "x"]), ("b", [], ["x"]), ("a", ["z"], ["z"])], "key string, h array<string>, r array<string>").repartition(3, "key")
    found = metrics.clipped_counts(pairs, "key", "h", "r")
    assert plan(found).count("Exchange") == 2  # the pairs by key, the sums by order
    assert {r["n"]: (r["matched"], r["total"]) for r in found.collect()} == {1: (3, 4), 2: (0, 2), 3: (0, 1)}
