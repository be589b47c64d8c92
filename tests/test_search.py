"""Beam search against plain Python, surface keys by hand, and line files read back."""

import math

from pyspark.sql import functions as F

from tessella.functions import beam, legal, records
from tessella.sources import sinks


def logits_of(seq):
    return [((len(seq) * 5 + seq[-1] * 7 + k * k * 3) % 11) / 3.0 for k in range(6)]


def plain_search(bos, eos, width, enough, longest, steps):
    pending, done = [(0.0, [bos])], []
    for _ in range(steps):
        if len(done) >= enough or not pending:
            break
        grown = []
        for neg, seq in pending:
            top = sorted((-x, k) for k, x in enumerate(logits_of(seq)))[:width]
            norm = math.log(sum(math.exp(-x) for x, _ in top))
            grown += [(round(neg + x + norm, 9), [*seq, k]) for x, k in top]
        full = [h for h in grown if h[1][-1] == eos or len(h[1]) >= longest]
        done += full
        pending = sorted(h for h in grown if h not in full)[:width]
    return pending, done


def test_beam_search_equals_plain_search(spark):
    def options(seq):
        return beam.best_options(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: ((F.size(seq) * 5 + F.element_at(seq, -1) * 7 + k * k * 3) % 11) / 3.0), 3)

    for enough, longest, steps in ((4, 6, 8), (100, 5, 8), (100, 9, 2), (1, 9, 4)):
        row = spark.range(1).select(beam.search(options, 0, 2, 3, enough, longest, steps).alias("b")).first()["b"]
        pending, done = plain_search(0, 2, 3, enough, longest, steps)
        for got, want in ((row["pending"], pending), (row["done"], done)):
            assert [list(h["seq"]) for h in got] == [s for _, s in want]
            assert all(abs(h["neg"] - n) < 1e-8 for h, (n, _) in zip(got, want))


def test_surface_keys_by_hand(spark):
    kind = "array<struct<slot:bigint,idx:bigint>>"
    key = lambda wt, stem, affixes: spark.sql(f"SELECT cast({affixes} as {kind}) AS a").select(beam.synthesis_key(F.lit(wt), F.lit(stem), F.col("a")).alias("k")).first()["k"]
    assert key(0, 13, "array(struct(12, 4), struct(3, 2))") == "0:3-11-12-13|2,0,4,0"
    assert key(1, 7, "array(struct(12, 4), struct(7, 2))") == "1:7-12|2,4"
    assert key(0, 13, "array(struct(11, 1), struct(12, 4))") == "0:11-12-13|1,4,0"
    assert key(0, 13, "array()") is None


def test_titles_in_a_row_count_only_if_numbered_on(spark):
    lines = ["Article 4", "Article 5", "Article 9", "plain text", "Article premier", ": more", "goes on", "14"]
    facts = F.array(*[legal.line_facts(F.lit(k).cast("bigint"), F.lit(x), F.lit(x.startswith("Article")), F.lit(k == 7)) for k, x in enumerate(lines)])
    got = [(r["class"], r["number"], r["lang"]) for r in spark.range(1).select(F.inline(legal.linked(facts))).collect()]
    assert got == [("title", 4, "fe"), ("title", 5, "fe"), ("unknown", 5, "fe"), ("unknown", 0, "fe"), ("title", 1, "fr"), ("title", 1, "fr"), ("paragraph", 1, "fr"), ("page", 0, "fr")]


def test_line_files_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(k, None if k == 5 else f"line {k}\nmore") for k in range(25)], "place long, line string")
    sinks.write_lines(rows, str(tmp_path / "lines"))
    got = sorted(r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect())
    assert got == sorted("" if k == 5 else f"line {k} more" for k in range(25))
    sinks.write_shards(rows, str(tmp_path / "shards"), 10)
    assert sorted(p.name for p in (tmp_path / "shards").glob("shard=*")) == ["shard=0_0_10", "shard=1_10_20", "shard=2_20_30"]
    assert spark.read.text(str(tmp_path / "shards" / "shard=2_20_30")).count() == 5
    sinks.write_ids(spark.sql("SELECT array(1, 22, 3) AS ids"), str(tmp_path / "ids"))
    assert spark.read.text(str(tmp_path / "ids")).first()["value"] == "1\t22\t3"
    sinks.write_pairs(spark.sql("SELECT 'a\tb' AS x, cast(null AS string) AS y"), str(tmp_path / "pairs"), "x", "y")
    assert spark.read.text(str(tmp_path / "pairs")).first()["value"] == "a b\t"
    sinks.write_lines(rows.where("place < 0"), str(tmp_path / "lines"))
    assert spark.read.schema("value string").text(str(tmp_path / "lines")).count() == 0


def test_aligned_files_keep_lines_together(spark, tmp_path):
    rows = spark.createDataFrame([(k, None if k % 7 == 0 else f"a {k}", f"b {k}\r\nmore" if k % 5 else "") for k in range(60, -1, -1)], "place long, left string, right string")
    sinks.write_aligned(rows.repartition(5), str(tmp_path / "two"), ["left", "right"], 20)
    for side in ("left", "right"):
        assert sorted(p.name for p in (tmp_path / "two" / side).glob("shard=*")) == [f"shard={k}" for k in range(4)]
        assert all(len(list(p.glob("part-*"))) == 1 for p in (tmp_path / "two" / side).glob("shard=*"))
    got = {(r["shard"] * 20 + r["line_no"]): (r["left"], r["right"]) for r in sinks.read_aligned(spark, str(tmp_path / "two"), ["left", "right"]).collect()}
    assert got == {k: ("" if k % 7 == 0 else f"a {k}", f"b {k} more" if k % 5 else "") for k in range(61)}


def test_ids_and_casing_records(spark, tmp_path):
    sinks.write_ids(spark.sql("SELECT explode(array(array(5, 1), cast(array() AS array<int>), null)) AS ids"), str(tmp_path / "ids"))
    assert sorted(r["ids"] for r in sinks.read_ids(spark, str(tmp_path / "ids")).collect()) == [[], [], [5, 1]]
    lines = [("a\t3\t1",), ("a\t3",), ("a\t3\t1\tx",), ("",), (None,), ("a\tmany\t1",), ("\t0\t0",)]
    got = [r["r"] for r in spark.createDataFrame(lines, "line string").select(records.casing_record(F.col("line")).alias("r")).collect()]
    assert [g and tuple(g) for g in got] == [("a", 3, 1), None, None, None, None, None, ("", 0, 0)]
