"""Hand-worked cases of the functions and operators."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import metrics, numbers, sequences, text
from tessella.functions.detokenise import detokenised
from tessella.operators import batching
from tessella.operators.translate import lexicon_model, translate
from tessella.sources.tables import line_scan
from tessella.streaming import ingest


@pytest.mark.parametrize(
    ("prefix", "n", "words"),
    [("a", 1, "rimwe"), ("ka", 3, "gatatu"), ("a", 10, "icumi"), ("a", 13, "cumi n'atatu"), ("a", 21, "makumyabiri na rimwe"), ("a", 110, "ijana na cumi"), ("a", 1000, "ibihumbi kimwe"), ("a", 2005, "ibihumbi bibiri n'atanu"), ("a", 1000000, "miliyoni imwe"), ("a", 0, ""), ("ru", 2, None)],
)
def test_speller(spark, prefix, n, words):
    units = numbers.units_for(F.lit(prefix), (prefix,))
    assert spark.range(1).select(numbers.spell(units, F.lit(n)).alias("w")).first()["w"] == words


def test_line_scan_drops_four_trailing_blanks(spark):
    rows = spark.createDataFrame([(1, "a\n\nb\n"), (2, "a" + "\n" * 7), (3, ""), (4, None)], "id int, text string")
    got = {}
    for r in line_scan(rows).orderBy("id", "line_no").collect():
        got.setdefault(r["id"], []).append(r["line"])
    assert got == {1: ["a", "", "b"], 2: ["a", "", ""]} | ({3: got[3]} if 3 in got else {})


def test_tokens_parse_unroll_and_format(spark):
    line = "10,20,7,100,2,101,102,1,9;11,21,8,103,0,0"
    row = spark.createDataFrame([(line,)], "line string").select(sequences.parse_sentence(F.col("line")).alias("s"))
    got = row.select(*[v.alias(k) for k, v in sequences.unroll(F.col("s")).items()], F.array_join(F.transform("s", sequences.format_token), ";").alias("line")).first()
    assert got["stems"] == [3, 101, 102, 103, 4]
    assert got["tags"] == [3, 7, 7, 8, 4]
    assert got["affix_counts"] == [0, 1, 1, 0, 0]
    assert got["line"] == line


def test_truncate_and_masks(spark):
    ids = F.array(*map(F.lit, (0, 5, 6, 7, 2)))
    got = spark.range(1).select(sequences.truncate(ids, 4).alias("t"), sequences.padding_mask(F.lit(2), F.lit(3)).alias("m"), sequences.padding_mask(F.lit(2), F.lit(3), True).alias("i")).first()
    assert got["t"] == [0, 5, 6, 2]
    assert got["m"] == [False, False, True]
    assert got["i"] == [False, True, True]


def test_budget_batches(spark):
    rows = spark.createDataFrame([(1, k, n) for k, n in enumerate([4, 4, 4, 4, 20, 1])], "key int, id int, n int")
    got = [r["batch"] for r in batching.token_budget_batches(rows, "key", "n", ["id"], 8).orderBy("id").collect()]
    assert got == [0, 0, 1, 1, 2, 3]
    assert batching.token_budget_batches(rows, "key", "n", ["id"], 8, drop_last=True).count() == 5


DETOKENISED = {
    "ya abana beza .": "Y'abana beza.",
    "ya abana": "y'abana",
    '" ya abana beza': "\"y'abana beza",
    "« abana beza »": "«abana beza»",
    "a 3, 5": "A 3,5",
    "a 3 , 5 % .": "A 3,5%.",
    "3 , 5": "3,5",
    "x a.b - c": "X a.b - c",
    "x - y": "X-y",
    "x - - y": "X - - y",
    "a b 'tis": "A b'tis",
    'umwe" abana .': 'Umwe"abana.',
    "n ' abana": "N 'abana",
    "n' abana d": "N'abana d",
    "n' abana": "n'abana",
    "ba ba abana": "Ba b'abana",
    "ba abana ba abana": "B'abana b'abana",
    "beza abana": "Beza abana",
    "a abana": "A abana",
    "ya": "ya",
    "ya beza": "Ya beza",
    "a 5 . 5 . 5": "A 5.5.5",
    "a b . 5": "A b. 5",
    "a ya abana , 5": "A y'abana, 5",
    "5 %": "5 %",
    "a <unk> b": "A b",
    "": "",
    "é x": "É x",
}


def test_detokenise(spark):
    rows = spark.createDataFrame(list(DETOKENISED.items()), "line string, want string")
    got = rows.select("line", "want", detokenised(text.tokens(F.col("line"))).alias("got")).collect()
    assert {r["line"]: r["got"] for r in got} == DETOKENISED


def test_detokenise_keeps_tagged_words_apart(spark):
    tags = F.create_map(*map(F.lit, ("ya", "PO", "abana", "V", "ba", "N")))
    lines = {"ya abana x": "Ya abana x", "ya inka x": "Y'inka x", "ba inka x": "Ba inka x", "wa inka x": "W'inka x"}
    rows = spark.createDataFrame([(k,) for k in lines], "line string")
    got = {r["line"]: r["got"] for r in rows.select("line", detokenised(text.tokens(F.col("line")), tags).alias("got")).collect()}
    assert got == lines


def test_metrics(spark):
    assert metrics.chrf_score("the same line.", "the same line.") == pytest.approx(1.0)
    assert metrics.chrf_score("abc", "xyz") == 0
    assert spark.range(1).select(text.join_subwords(F.array(*map(F.lit, ("▁am@@", "a", "▁be")))).alias("s")).first()["s"] == "ama be"


def test_post_edit(spark):
    got = spark.range(1).select(text.english_postedit(F.lit("a <unk> s <unk> s.")).alias("s")).first()["s"]
    assert got == "a's's."


def test_translate_marks_failures(spark):
    rows = spark.createDataFrame([(1, "the cat"), (2, "xyz"), (3, None)], "id int, text string")
    got = {r["id"]: (r["translation"], r["ok"]) for r in translate(rows, lexicon_model({"the": "iki"})).collect()}
    assert got == {1: ("iki cat", True), 2: ("xyz", False), 3: ("", False)}


def test_stream_appends_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "uri int, x string")
    rows.write.parquet(source)
    for _ in range(2):
        q = ingest.append_new(ingest.stream_files(spark, source, rows.schema), "uri", target, mark)
        q.awaitTermination(120)
        spark.createDataFrame([(2, "c"), (3, "d")], "uri int, x string").write.mode("append").parquet(source)
    assert sorted(r["uri"] for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_resume_and_replay(spark):
    todo = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    done = spark.createDataFrame([(1, "A")], "k int, y string")
    assert [r["k"] for r in ingest.resume(todo, done, "k").collect()] == [2]
    made = ingest.replay(todo, done, "k", "y", lambda d: d.withColumn("y", F.upper("x")))
    assert {(r["k"], r["y"]) for r in made.collect()} == {(1, "A"), (2, "B")}
