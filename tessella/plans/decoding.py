"""Decoding-step queries: ranking, cut-offs, slots, correlations, votes and copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import scoring, text
from tessella.sources.tables import table

DIGITS = 9


def _vectors(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _entries(spark: SparkSession, base: str) -> DataFrame:
    """One row for each vector and vocabulary id, with its probability."""
    v = _vectors(spark, base).select("vec_id", "label", F.posexplode(scoring.softmax(F.col("v"))).alias("id", "p"))
    return v.select("vec_id", "label", F.col("id").cast("bigint").alias("id"), F.round("p", 12).alias("p"))


def hypothesis_score(spark: SparkSession, base: str) -> DataFrame:
    v = _vectors(spark, base).select("vec_id", F.transform(F.slice("v", 1, 63), lambda x: F.abs(x) * 4 + 0.1).alias("mass"), (-F.abs(F.element_at("v", 64)) * 10).alias("logp"), (F.col("vec_id") % 20 + 1).alias("n"))
    return v.select("vec_id", F.round(scoring.hypothesis_score(F.col("logp"), F.col("n"), F.col("mass"), F.lit(63), F.col("n")), DIGITS).alias("score"))


def topk_logsoftmax(spark: SparkSession, base: str) -> DataFrame:
    """The four best ids of each row, with log probabilities among themselves alone."""
    pairs = F.transform("v", lambda x, i: F.struct((-x).alias("key"), i.cast("bigint").alias("id")))
    top = _vectors(spark, base).select("vec_id", F.slice(F.array_sort(pairs), 1, 4).alias("top"))
    logs = scoring.log_softmax(F.transform("top", lambda t: -t["key"]))
    each = top.select("vec_id", F.posexplode(F.arrays_zip(F.transform("top", lambda t: t["id"]).alias("id"), logs.alias("lp"))).alias("rank", "x"))
    return each.select("vec_id", (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("x.id").alias("id"), F.round("x.lp", DIGITS).alias("logp"))


def prob_gap_cut(spark: SparkSession, base: str) -> DataFrame:
    """Candidates up to the first drop of ``gap`` or the first probability below a least one."""
    w = Window.partitionBy("vec_id").orderBy(F.desc("p"), "id")
    e = _entries(spark, base).withColumn("drop", F.lag("p").over(w) - F.col("p"))
    stop = F.when((F.coalesce("drop", F.lit(0.0)) >= 0.0012) | (F.col("p") < 0.014), 1).otherwise(0)
    kept = e.withColumn("stop", stop).withColumn("stopped", F.max("stop").over(w)).where("stopped = 0")
    return kept.groupBy("vec_id").agg(F.count("*").cast("bigint").alias("n"), F.min("p").alias("least"))


def unk_cap(spark: SparkSession, base: str) -> DataFrame:
    """The unknown id (0) may have no more than the best of the others."""
    best = F.max(F.when(F.col("id") != 0, F.col("p"))).over(Window.partitionBy("vec_id"))
    e = _entries(spark, base).withColumn("capped", F.when(F.col("id") == 0, F.least("p", best)).otherwise(F.col("p")))
    return e.select("vec_id", "id", "capped")


def _items(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def slot_resolution(spark: SparkSession, base: str) -> DataFrame:
    """One affix for each slot: own ones before extra ones, then the likelier; ties by all columns."""
    own = F.when(F.col("l_partkey") % 3 == 0, 0).otherwise(1)
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(own, F.desc("l_quantity"), "l_partkey", "l_suppkey", "l_extendedprice")
    return _items(spark, base).withColumn("r", F.row_number().over(order)).where("r = 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def corr_joint(spark: SparkSession, base: str) -> DataFrame:
    """Joint probability of (order, part, supplier) candidates whose three pair tables all hold the pair."""
    cand = _items(spark, base).select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).distinct()
    pairs = lambda a, b, mod: cand.where((F.col(a) + F.col(b)) % mod != 0).groupBy(a, b).agg(F.count("*").alias(f"c_{a}{b}"))
    kept = cand.join(pairs("o", "p", 5), ["o", "p"]).join(pairs("o", "s", 7), ["o", "s"]).join(pairs("p", "s", 11), ["p", "s"])
    logs = sum(((F.log(1.0 / (2 + F.col(c) % 5))) for c in ("o", "p", "s")), F.lit(0.0))
    raw = F.exp(0.08 * (F.col("c_op") + F.col("c_os") + F.col("c_ps")) + logs)
    joint = kept.withColumn("raw", raw).withColumn("joint", F.round(F.col("raw") / F.sum("raw").over(Window.partitionBy("o")), DIGITS))
    return joint.select("o", "p", "s", "joint")


def type_vote(spark: SparkSession, base: str) -> DataFrame:
    """Each word type's best log probability in three heads, summed and normalised; -100 where a head has none."""
    e = _entries(spark, base).withColumn("head", F.col("id") % 3).withColumn("type", F.floor(F.col("id") / 3) % 5).where("p > 0.0155")
    best = e.groupBy("vec_id", "type").agg(*[F.coalesce(F.max(F.when(F.col("head") == h, F.log("p"))), F.lit(-100.0)).alias(f"h{h}") for h in range(3)])
    summed = best.withColumn("s", F.col("h0") + F.col("h1") + F.col("h2"))
    w = Window.partitionBy("vec_id")
    shifted = F.exp(F.col("s") - F.max("s").over(w))
    return summed.withColumn("e", shifted).select("vec_id", "type", F.round(F.col("e") / F.sum("e").over(w), DIGITS).alias("p"))


def beam_step(spark: SparkSession, base: str) -> DataFrame:
    """Hypotheses of a sentence (label) extended by every id, the best four kept."""
    e = _entries(spark, base).withColumn("lprob", F.round(scoring.safe_log(F.col("p")) - F.col("vec_id") % 7, DIGITS))
    r = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("lprob"), "vec_id", "id")).cast("bigint")
    return e.withColumn("rank", r).where("rank <= 4").select("label", "rank", "vec_id", "id", "lprob")


def best_hypothesis(spark: SparkSession, base: str) -> DataFrame:
    """The best completed hypothesis of each order, else the best pending one, else none."""
    done = F.col("l_linenumber") % 2 == 0
    key = F.struct(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_partkey"), F.col("l_suppkey"))
    best = _items(spark, base).groupBy("l_orderkey").agg(F.max(F.when(done, key)).alias("a"), F.max(F.when(~done, key)).alias("b"))
    orders = table(spark, base, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    out = orders.join(best, "l_orderkey", "left").withColumn("x", F.coalesce("a", "b"))
    status = F.when(F.col("a").isNotNull(), "complete").when(F.col("b").isNotNull(), "pending").otherwise("source")
    return out.select("l_orderkey", status.alias("status"), F.coalesce("x.l_partkey", "o_custkey").alias("chosen"))


def copy_ratio(spark: SparkSession, base: str) -> DataFrame:
    """Share of each document's distinct words among the words of the document before it."""
    words = table(spark, base, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    before = words.select((F.col("doc_id") + 1).alias("doc_id"), F.col("w").alias("before"))
    own = F.array_distinct("w")
    return words.join(before, "doc_id").where(F.size("w") > 0).select("doc_id", F.round(F.size(F.array_intersect(own, F.col("before"))) / F.size(own), DIGITS).alias("ratio"))


QUERIES = {f.__name__: f for f in (hypothesis_score, topk_logsoftmax, prob_gap_cut, unk_cap, slot_resolution, corr_joint, type_vote, beam_step, best_hypothesis, copy_ratio)}

_E = """
WITH x AS (SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
e AS (SELECT vec_id, label, id, x, round(exp(x - max(x) OVER w) / (sum(exp(x)) OVER w / exp(max(x) OVER w)), 12) AS p FROM x WINDOW w AS (PARTITION BY vec_id))
"""
_W = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
ORACLE = {
    "hypothesis_score": """
WITH v AS (SELECT vec_id, vec_id % 20 + 1 AS n, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, round(-abs(v[64]) * 10 / pow((n + 5) / 6.0, 0.2) + 0.8 * list_sum(list_transform(v[1:63], lambda x: ln(least(abs(x) * 4 + 0.1, 1.0)))) + 0.2 * 63 / n, 9) AS score FROM v
""",
    "topk_logsoftmax": _E
    + """, t AS (SELECT vec_id, id, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, id) AS rank FROM e)
SELECT vec_id, rank, id, round(x - ln(sum(exp(x)) OVER (PARTITION BY vec_id)), 9) AS logp FROM t WHERE rank <= 4""",
    "prob_gap_cut": _E
    + """, d AS (SELECT vec_id, id, p, CASE WHEN coalesce(lag(p) OVER w - p, 0) >= 0.0012 OR p < 0.014 THEN 1 ELSE 0 END AS stop FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY p DESC, id)),
s AS (SELECT *, max(stop) OVER (PARTITION BY vec_id ORDER BY p DESC, id) AS stopped FROM d)
SELECT vec_id, count(*) AS n, min(p) AS least FROM s WHERE stopped = 0 GROUP BY vec_id""",
    "unk_cap": _E
    + """, c AS (SELECT vec_id, id, CASE WHEN id = 0 THEN least(p, max(p) FILTER (id <> 0) OVER (PARTITION BY vec_id)) ELSE p END AS capped FROM e)
SELECT vec_id, id, capped FROM c""",
    "slot_resolution": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 1 END, l_quantity DESC, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1
""",
    "corr_joint": """
WITH c AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_suppkey AS s FROM lineitem),
op AS (SELECT o, p, count(*) AS n FROM c WHERE (o + p) % 5 <> 0 GROUP BY ALL),
os AS (SELECT o, s, count(*) AS n FROM c WHERE (o + s) % 7 <> 0 GROUP BY ALL),
ps AS (SELECT p, s, count(*) AS n FROM c WHERE (p + s) % 11 <> 0 GROUP BY ALL),
r AS (SELECT c.o, c.p, c.s, exp(0.08 * (op.n + os.n + ps.n) + ln(1.0 / (2 + c.o % 5)) + ln(1.0 / (2 + c.p % 5)) + ln(1.0 / (2 + c.s % 5))) AS raw
  FROM c JOIN op USING (o, p) JOIN os ON os.o = c.o AND os.s = c.s JOIN ps ON ps.p = c.p AND ps.s = c.s)
SELECT o, p, s, round(raw / sum(raw) OVER (PARTITION BY o), 9) AS joint FROM r
""",
    "type_vote": _E
    + """, h AS (SELECT vec_id, id // 3 % 5 AS type, id % 3 AS head, ln(p) AS lp FROM e WHERE p > 0.0155),
b AS (SELECT vec_id, type, coalesce(max(lp) FILTER (head = 0), -100) + coalesce(max(lp) FILTER (head = 1), -100) + coalesce(max(lp) FILTER (head = 2), -100) AS s FROM h GROUP BY ALL),
x2 AS (SELECT vec_id, type, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM b)
SELECT vec_id, type, round(e / sum(e) OVER (PARTITION BY vec_id), 9) AS p FROM x2""",
    "beam_step": _E
    + """, l AS (SELECT label, vec_id, id, round(ln(CASE WHEN p > 0 THEN p ELSE 1e-20 END) - vec_id % 7, 9) AS lprob FROM e)
SELECT * FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY lprob DESC, vec_id, id) AS rank, vec_id, id, lprob FROM l) WHERE rank <= 4""",
    "best_hypothesis": """
WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber % 2 AS pending, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2, l_quantity DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) AS k FROM lineitem)
SELECT o_orderkey AS l_orderkey, CASE WHEN pending = 0 THEN 'complete' WHEN pending = 1 THEN 'pending' ELSE 'source' END AS status, coalesce(l_partkey, o_custkey) AS chosen
FROM orders LEFT JOIN r ON l_orderkey = o_orderkey AND k = 1
""",
    "copy_ratio": f"""
WITH w AS (SELECT doc_id, {_W} AS w FROM documents)
SELECT a.doc_id, round(len(list_intersect(list_distinct(a.w), b.w)) / len(list_distinct(a.w)), 9) AS ratio
FROM w a JOIN w b ON a.doc_id = b.doc_id + 1 WHERE len(a.w) > 0
""",
}
