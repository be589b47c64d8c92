"""Queries without SQL take part with all of their rows and words."""

from tessella.plans import catalogue


def test_detokenise_joins_every_token(spark, tmp_path):
    words = [f"ijambo{k}" for k in range(100)]
    rows = [(1, " ".join([*words, "ya", "abana", "."])), (2, "mu 1 , 5 %"), (3, ""), (4, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["sentence"] for r in catalogue.queries()["detokenise"](spark, str(tmp_path)).collect()}
    assert got[1] == "I" + " ".join(words)[1:] + " y'abana."
    assert got[2] == "Mu 1,5%"
    assert got[3] == "" and got[4] in (None, "")
