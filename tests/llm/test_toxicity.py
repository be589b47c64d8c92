"""Held-out accuracy of the toxicity scores on the provided labels."""

from pyspark.sql import functions as F

from tessella.llm import toxicity
from tessella.llm.common import table

BASE = "/root/testdata/sf0.1"
#: Words that stand in labelled toxic texts alone; a third of the toxic rows are in other languages and carry none.
TERMS = r"(?i)\b(trash|pathetic|idiot|worthless|disgusting|stupid|clown|scum|loser|moron)\b"


def test_held_out_documents_with_toxic_terms_are_found_and_clean_ones_left_alone(spark):
    scored = toxicity.op8_toxicity(spark, BASE)
    rows = scored.join(table(spark, BASE, "labels"), "doc_id").join(table(spark, BASE, "documents").select("doc_id", "text"), "doc_id").where("held_out")
    kind = F.when(F.col("toxic") == 0, "clean").when(F.rlike("text", F.lit(TERMS)), "terms").otherwise("bare")
    got = {r["kind"]: (r["n"], r["found"]) for r in rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("predicted").alias("found")).collect()}
    print(got)
    assert got["terms"][0] > 50 and got["terms"][1] >= 0.9 * got["terms"][0]
    assert got["clean"][1] <= 0.01 * got["clean"][0]
