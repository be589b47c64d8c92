"""Evaluation and training-arithmetic queries over ``conversations``, ``embeddings`` and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import metrics, scoring, text
from tessella.runtime import bytes_of
from tessella.sources.tables import table

DIGITS = 9
PART_BYTES = 1_000_000  # of conversations as they are stored, in one part


def _pairs(spark: SparkSession, base: str) -> DataFrame:
    """Each user turn as a hypothesis with the assistant turn after it as its reference."""
    said = table(spark, base, "conversations")
    user = said.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("hyp"))
    reply = said.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref"))
    return user.join(reply, ["conv_id", "turn"])


def chrf_sentence(spark: SparkSession, base: str) -> DataFrame:
    return _pairs(spark, base).select("conv_id", "turn", F.round(metrics.chrf("hyp", "ref"), DIGITS).alias("chrf"))


def chrf_macro(spark: SparkSession, base: str) -> DataFrame:
    """Mean of the sentence scores, for each benchmark and over all (benchmark null)."""
    scored = _pairs(spark, base).select((F.col("conv_id") % 6).alias("benchmark"), metrics.chrf("hyp", "ref").alias("s"))
    return scored.rollup("benchmark").agg(F.round(100 * F.avg("s"), 6).alias("chrf"), F.count("*").cast("bigint").alias("n"))


def bleu_corpus(spark: SparkSession, base: str) -> DataFrame:
    """Corpus BLEU and the mean hypothesis length."""
    pairs = _pairs(spark, base).select(F.concat_ws("_", "conv_id", "turn").alias("key"), text.tokens(F.col("hyp")).alias("h"), text.tokens(F.col("ref")).alias("r"))
    lengths = pairs.agg(F.sum(F.size("h")).alias("n_h"), F.sum(F.size("r")).alias("n_r"), F.avg(F.size("h")).alias("mean"))
    # a pair's n-grams are many times its texts: parts are small, and n-grams stay in theirs
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-bytes_of(table(spark, base, "conversations")) // PART_BYTES))
    logs = metrics.clipped_counts(pairs.repartition(parts, "key"), "key", "h", "r").agg(F.avg(F.log(F.col("matched") / F.col("total"))).alias("logs"))
    brevity = F.least(F.lit(0.0), 1 - F.col("n_r") / F.col("n_h"))
    return logs.crossJoin(lengths).select(F.round(100 * F.exp(F.col("logs") + brevity), 6).alias("bleu"), F.round("mean", 4).alias("gen_len"))


def system_compare(spark: SparkSession, base: str) -> DataFrame:
    """Word overlap of two systems in both directions, for each benchmark and system and pooled."""
    words = _pairs(spark, base).select((F.col("conv_id") % 3).alias("benchmark"), text.tokens(F.col("hyp")).alias("h"), text.tokens(F.col("ref")).alias("r"))
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    systems = F.array(*[F.struct(F.lit(s).alias("system"), F.lit(d).alias("direction"), a.alias("a"), b.alias("b")) for s, h, r in (("cased", F.col("h"), F.col("r")), ("lower", low(F.col("h")), low(F.col("r")))) for d, a, b in (("fwd", h, r), ("bwd", r, h))])
    each = words.select("benchmark", F.explode(systems).alias("x")).select("benchmark", "x.*")
    share = F.size(F.array_intersect("a", "b")) / F.greatest(F.size(F.array_distinct("a")), F.lit(1))
    return each.groupBy("system", "direction", "benchmark").agg(F.count("*").cast("bigint").alias("n"), F.round(F.avg(share), DIGITS).alias("score"))


def _vectors(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def label_smoothed_nll(spark: SparkSession, base: str) -> DataFrame:
    logs = _vectors(spark, base).select("vec_id", "label", scoring.log_softmax(F.col("v")).alias("lp"))
    return logs.select("vec_id", F.round(scoring.label_smoothed_nll(F.col("lp"), F.col("label") + 1, 0.1, 64), DIGITS).alias("loss"))


def lr_schedule(spark: SparkSession, base: str) -> DataFrame:
    """Rates at the step of every event, 100 steps after the one before it."""
    step = table(spark, base, "events").select((F.col("event_id") * 100 % 80_000 + 100).alias("step")).distinct()
    shapes = [F.round(scoring.annealed_rate(F.col("step"), 0.001, 4000, 36000, s, 1e-5), 12).alias(s) for s in ("linear", "cosine", "exponential", "constant")]
    return step.select("step", F.round(scoring.inverse_sqrt_rate(F.col("step"), 0.001, 8000), 12).alias("inverse_sqrt"), *shapes)


def relpos_bucket(spark: SparkSession, base: str) -> DataFrame:
    """Buckets of the distances between the items' part and supplier numbers, and how many items have each."""
    away = table(spark, base, "lineitem").groupBy((F.col("l_partkey") - F.col("l_suppkey")).cast("bigint").alias("distance")).agg(F.count("*").cast("bigint").alias("n"))
    return away.select("distance", scoring.relative_bucket(F.col("distance")).cast("bigint").alias("bucket"), "n")


def adamw_step(spark: SparkSession, base: str) -> DataFrame:
    """Vector k as parameters, vector k + 1 as their gradient, one step from zero moments."""
    v = _vectors(spark, base).select("vec_id", "v")
    grad = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("g"))
    zero = F.array_repeat(F.lit(0.0), 64)
    new, m, s = scoring.adamw(F.col("v"), F.col("g"), zero, zero, 1, 0.001)
    return v.join(grad, "vec_id").select("vec_id", *[F.round(scoring.total(c), DIGITS).alias(n) for n, c in (("param", new), ("first", m), ("second", s))])


def grad_vaccine(spark: SparkSession, base: str) -> DataFrame:
    v = _vectors(spark, base).select("vec_id", "v")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("o"))
    turned = scoring.vaccinated(F.col("v"), F.col("o"), F.lit(0.1))
    return v.join(other, "vec_id").select("vec_id", F.round(scoring.total(turned), 8).alias("s"), F.round(scoring.norm(turned), 8).alias("norm"))


def finite_losses(spark: SparkSession, base: str) -> DataFrame:
    """Batches with a finite loss, and the mean over them."""
    loss = F.when(F.col("vec_id") % 7 == 0, F.lit(float("nan"))).when(F.col("vec_id") % 11 == 0, F.lit(float("inf"))).otherwise(scoring.total(F.col("v")))
    rows = _vectors(spark, base).select("label", loss.alias("loss")).where(~F.isnan("loss") & (F.abs("loss") < float("inf")))
    return rows.groupBy("label").agg(F.count("*").cast("bigint").alias("n"), F.round(F.avg("loss"), DIGITS).alias("mean_loss"))


QUERIES = {f.__name__: f for f in (chrf_sentence, chrf_macro, bleu_corpus, system_compare, label_smoothed_nll, lr_schedule, relpos_bucket, adamw_step, grad_vaccine, finite_losses)}

_W = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"
_PAIRS = """
p AS (SELECT a.conv_id, a.turn, a.text AS hyp, b.text AS ref FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant')
"""
_MARK = "[!-/:-@\\[-`{-~]"
_CHRF = f"""
WITH {_PAIRS},
sides AS (SELECT conv_id, turn, 'h' AS side, hyp AS t FROM p UNION ALL SELECT conv_id, turn, 'r', ref FROM p),
units AS (
  SELECT conv_id, turn, side, 'c' AS kind, string_split(regexp_replace(t, '\\s+', '', 'g'), '') AS u FROM sides
  UNION ALL
  SELECT conv_id, turn, side, 'w', flatten(list_transform({_W.format("t")}, lambda w: CASE
    WHEN length(w) > 1 AND regexp_matches(w, '{_MARK}$') THEN [left(w, -1), right(w, 1)]
    WHEN length(w) > 1 AND regexp_matches(w, '^{_MARK}') THEN [left(w, 1), substr(w, 2)] ELSE [w] END)) FROM sides),
orders AS (SELECT 'c' AS kind, unnest(range(1, 7)) AS n UNION ALL SELECT 'w', unnest(range(1, 3))),
grams AS (SELECT conv_id, turn, side, kind, n, array_to_string(u[i:i + n - 1], chr(1)) AS g FROM (
  SELECT *, unnest(range(1, CAST(len(u) - n + 2 AS BIGINT))) AS i FROM units JOIN orders USING (kind))),
counts AS (SELECT conv_id, turn, kind, n, g, count(*) FILTER (side = 'h') AS h, count(*) FILTER (side = 'r') AS r FROM grams GROUP BY ALL),
f AS (SELECT conv_id, turn, kind, n, sum(least(h, r)) AS hit, sum(h) AS nh, sum(r) AS nr FROM counts GROUP BY ALL),
s AS (SELECT conv_id, turn, sum(CASE WHEN hit > 0 THEN 5 * (hit / nh) * (hit / nr) / (4 * hit / nh + hit / nr) ELSE 0 END) / 8 AS s FROM f GROUP BY ALL)
"""
_V = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
ORACLE = {
    "chrf_sentence": _CHRF + "SELECT conv_id, turn, round(s, 9) AS chrf FROM s",
    "chrf_macro": _CHRF + "SELECT conv_id % 6 AS benchmark, round(100 * avg(s), 6) AS chrf, count(*) AS n FROM s GROUP BY ROLLUP (conv_id % 6)",
    "bleu_corpus": f"""
WITH {_PAIRS}, w AS (SELECT conv_id, turn, {_W.format("hyp")} AS h, {_W.format("ref")} AS r FROM p),
sides AS (SELECT conv_id, turn, 'h' AS side, h AS u FROM w UNION ALL SELECT conv_id, turn, 'r', r FROM w),
grams AS (SELECT conv_id, turn, side, n, array_to_string(u[i:i + n - 1], ' ') AS g FROM (
  SELECT *, unnest(range(1, CAST(len(u) - n + 2 AS BIGINT))) AS i FROM (SELECT *, unnest(range(1, 5)) AS n FROM sides))),
c AS (SELECT n, least(count(*) FILTER (side = 'h'), count(*) FILTER (side = 'r')) AS hit, count(*) FILTER (side = 'h') AS h FROM grams GROUP BY conv_id, turn, n, g),
o AS (SELECT n, sum(hit) / sum(h) AS p FROM c GROUP BY n),
l AS (SELECT sum(len(h)) AS nh, sum(len(r)) AS nr, avg(len(h)) AS mean FROM w)
SELECT round(100 * exp((SELECT avg(ln(p)) FROM o) + least(0, 1 - nr / nh)), 6) AS bleu, round(mean, 4) AS gen_len FROM l
""",
    "system_compare": f"""
WITH {_PAIRS}, w AS (SELECT conv_id % 3 AS benchmark, {_W.format("hyp")} AS h, {_W.format("ref")} AS r FROM p),
l AS (SELECT benchmark, 'cased' AS system, h, r FROM w UNION ALL SELECT benchmark, 'lower', list_transform(h, lambda x: lower(x)), list_transform(r, lambda x: lower(x)) FROM w),
d AS (SELECT benchmark, system, 'fwd' AS direction, h AS a, r AS b FROM l UNION ALL SELECT benchmark, system, 'bwd', r, h FROM l)
SELECT system, direction, benchmark, count(*) AS n, round(avg(len(list_distinct(list_intersect(a, b))) / greatest(len(list_distinct(a)), 1)), 9) AS score FROM d GROUP BY ALL
""",
    "label_smoothed_nll": f"""
WITH v AS ({_V}), e AS (SELECT vec_id, label, v, ln(list_sum(list_transform(v, lambda x: exp(x)))) AS z FROM v)
SELECT vec_id, round(-(1.0 - 0.1 - 0.1 / 63) * (v[label + 1] - z) - (0.1 / 63) * (list_sum(v) - 64 * z), 9) AS loss FROM e
""",
    "lr_schedule": """
WITH s AS (SELECT DISTINCT event_id * 100 % 80000 + 100 AS step FROM events)
SELECT step, round(CASE WHEN step <= 8000 THEN 0.001 * step / 8000 ELSE 0.001 * sqrt(8000) / sqrt(step) END, 12) AS inverse_sqrt,
  round(CASE WHEN step <= 4000 THEN 0.001 * step / 4000 ELSE greatest(0.001 * (36000 - least(step, 36000)) / 32000.0, 1e-5) END, 12) AS linear,
  round(CASE WHEN step <= 4000 THEN 0.001 * step / 4000 ELSE greatest(0.0005 * (cos(pi() * (least(step, 36000) - 4000) / 32000.0) + 1), 1e-5) END, 12) AS cosine,
  round(CASE WHEN step <= 4000 THEN 0.001 * step / 4000 ELSE greatest(0.001 * exp(-0.693 * (least(step, 36000) - 4000) / 32000.0), 1e-5) END, 12) AS exponential,
  round(CASE WHEN step <= 4000 THEN 0.001 * step / 4000 ELSE 0.001 END, 12) AS constant FROM s
""",
    "relpos_bucket": """
WITH d AS (SELECT CAST(l_partkey - l_suppkey AS BIGINT) AS distance, count(*) AS n FROM lineitem GROUP BY 1)
SELECT distance, CAST(CASE WHEN distance > 0 THEN 16 ELSE 0 END + CASE WHEN abs(distance) < 8 THEN abs(distance)
  ELSE least(8 + floor(ln(greatest(abs(distance), 1) / 8.0) / ln(16.0) * 8), 15) END AS BIGINT) AS bucket, n FROM d
""",
    "adamw_step": f"""
WITH v AS ({_V}), j AS (SELECT a.vec_id, a.v AS p, b.v AS g FROM v a JOIN v b ON b.vec_id = a.vec_id + 1),
x AS (SELECT vec_id, list_transform(range(1, 65), lambda i: p[i] * (1 - 0.001 * 0.01) - 0.001 / (1 - 0.9) * (1 - 0.9) * g[i] / (sqrt((1 - 0.98) * g[i] * g[i]) / sqrt(1 - 0.98) + 1e-6)) AS n, g FROM j)
SELECT vec_id, round(list_sum(n), 9) AS param, round(list_sum(list_transform(g, lambda y: (1 - 0.9) * y)), 9) AS first, round(list_sum(list_transform(g, lambda y: (1 - 0.98) * y * y)), 9) AS second FROM x
""",
    "grad_vaccine": f"""
WITH v AS ({_V}), j AS (SELECT a.vec_id, a.v AS a, b.v AS b, list_inner_product(a.v, b.v) AS d, sqrt(list_inner_product(a.v, a.v)) AS na, sqrt(list_inner_product(b.v, b.v)) AS nb FROM v a JOIN v b ON b.vec_id = a.vec_id + 1),
c AS (SELECT *, d / (na * nb) AS cos FROM j),
t AS (SELECT vec_id, CASE WHEN cos < 0.1 THEN list_transform(range(1, 65), lambda i: a[i] + na * (0.1 * sqrt(1 - cos * cos) - cos * sqrt(1 - 0.1 * 0.1)) / (nb * sqrt(1 - 0.1 * 0.1)) * b[i]) ELSE a END AS x FROM c)
SELECT vec_id, round(list_sum(x), 8) AS s, round(sqrt(list_inner_product(x, x)), 8) AS norm FROM t
""",
    "finite_losses": f"""
WITH l AS (SELECT label, list_sum(v) AS loss FROM ({_V}) WHERE vec_id % 7 <> 0 AND vec_id % 11 <> 0)
SELECT label, count(*) AS n, round(avg(loss), 9) AS mean_loss FROM l GROUP BY label
""",
}
