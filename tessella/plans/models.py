"""Queries of models' arithmetic: words copied from the source, activations, gradients of several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import activations, scoring, text
from tessella.operators import copying, vaccine
from tessella.runtime import bytes_of
from tessella.sources.tables import table

DIGITS = 9
POSITIONS, LONGEST, BEAM = 64, 16, 4
TASKS, BETA = 3, 0.1
PART_BYTES = 4_000_000  # of texts as they are stored, in one part


def _vectors(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("v"))


def _choice(spark: SparkSession, base: str) -> DataFrame:
    """A vector gives the copy probabilities of 64 positions; the words of the document of its number stand at them, place after place."""
    probs = _vectors(spark, base).select(F.col("vec_id").alias("n"), F.posexplode(F.transform("v", lambda x: F.round(1 / (1 + F.exp(-x)), 12))).alias("pos", "p"))
    # only texts that have a vector are taken apart, dealt whole by their number, so that their words are counted where they arise
    docs = table(spark, base, "documents").select(F.col("doc_id").alias("n"), "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-bytes_of(docs) // PART_BYTES))
    asked = docs.join(_vectors(spark, base).select(F.col("vec_id").alias("n")), "n", "left_semi").repartition(parts, "n")
    placed = asked.select("n", F.posexplode(text.tokens(F.col("text"))).alias("place", "word"))
    words = placed.groupBy("n", "word", (F.col("place") % POSITIONS).cast("int").alias("pos")).agg(F.min("place").alias("place"))
    return copying.copy_choice(probs, words)


def copy_choice(spark: SparkSession, base: str) -> DataFrame:
    """The source word that each hypothesis copies, with the logarithm of its share of all copy probability."""
    return _choice(spark, base).select(F.col("n").alias("vec_id"), "word", F.round("logp", DIGITS).alias("logp"))


def copy_extension(spark: SparkSession, base: str) -> DataFrame:
    """What follows each hypothesis: the ids (characters' codes) of the word that it copies, or its four best options."""
    v = _vectors(spark, base)
    top = F.slice(F.sort_array(F.transform("v", lambda x, i: F.struct(F.round(x, 9).alias("x"), (-i).alias("i"))), asc=False), 1, BEAM)
    best = v.select(F.col("vec_id").alias("n"), (F.col("vec_id") % 12 + 1).alias("length"), (-(F.col("vec_id") % 7) / 2).alias("logp0"), top.alias("top"))
    best = best.withColumn("lp", scoring.log_softmax(F.transform("top", lambda t: t["x"])))
    options = best.select("n", "length", "logp0", F.transform("top", lambda t, i: F.struct((-t["i"]).alias("id"), F.get("lp", i).alias("lp"))).alias("options"))
    ids = F.transform(F.filter(F.split("word", ""), lambda c: c != ""), lambda c: F.ascii(c))
    found = copying.extended(_choice(spark, base), options, ids, LONGEST)
    return found.select(F.col("n").alias("vec_id"), "kind", F.col("rank").cast("bigint").alias("rank"), F.array_join("added", " ").alias("added"), F.round("logp", DIGITS).alias("logp"))


def activation_sums(spark: SparkSession, base: str) -> DataFrame:
    """Sums of every activation over all components of each vector, ten times as large; a component's bias is a tenth of its place."""
    x = _vectors(spark, base).select("vec_id", F.transform("v", lambda z: z * 10).alias("x"))
    total = lambda f: F.round(scoring.total(F.transform("x", f)), 6)
    shapes = {
        "gelu": lambda z, i: activations.gelu(z),
        "bias_gelu": lambda z, i: activations.bias_gelu(z, i / 10.0),
        "bias_tanh": lambda z, i: activations.bias_tanh(z, i / 10.0),
        "swish": lambda z, i: activations.swish(z),
        "relu": lambda z, i: activations.relu(z),
    }
    return x.select("vec_id", *[total(f).alias(name) for name, f in shapes.items()])


def gradient_steps(spark: SparkSession, base: str) -> DataFrame:
    """Merged gradients step by step: a label is a run, and each three of its vectors the gradients of three tasks at one step. Every
    fifth component is none of a task's."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    grad = F.transform("v", lambda x, i: F.when((F.col("vec_id") + i) % 5 == 0, 0.0).otherwise(x))
    rows = _vectors(spark, base).select(F.col("label").alias("run"), F.floor(place / TASKS).alias("step"), (place % TASKS).cast("bigint").alias("task"), grad.alias("grad"))
    merged = vaccine.merged_gradients(rows, BETA)
    return merged.select("run", "step", "turns", F.round(scoring.total(F.col("grad")), 8).alias("total"), F.round(scoring.norm(F.col("grad")), 8).alias("norm"))


QUERIES = {f.__name__: f for f in (copy_choice, copy_extension, activation_sums, gradient_steps)}

_W = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
_CHOICE = f"""
WITH RECURSIVE x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
p AS (SELECT vec_id AS n, i AS pos, round(1 / (1 + exp(-x)), 12) AS p FROM x),
w AS (SELECT doc_id AS n, generate_subscripts(ws, 1) - 1 AS place, unnest(ws) AS word FROM (SELECT doc_id, {_W} AS ws FROM documents)),
s AS (SELECT n, word, place % {POSITIONS} AS pos, min(place) AS place FROM w GROUP BY ALL),
t AS (SELECT n, sum(p) AS total FROM p GROUP BY n),
c AS (SELECT n, word, round(sum(p) / any_value(total), 12) AS share, min(place) AS place FROM s JOIN p USING (n, pos) JOIN t USING (n) GROUP BY n, word HAVING count(*) FILTER (p > 0.5) > 0.5 * count(*)),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY n ORDER BY share DESC, place) = 1),
choice AS (SELECT t.n, word, ln(coalesce(share, 0) + 1e-36) AS logp FROM t LEFT JOIN b USING (n))
"""
#: The error function as Simpson's integral over 1,600 steps.
_ERF = "(2 / sqrt(pi()) * ({0}) / 4800 * list_sum(list_transform(range(1601), lambda k: (CASE WHEN k IN (0, 1600) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(({0}) * k / 1600, 2)))))"
ORACLE = {
    "copy_choice": _CHOICE + "SELECT n AS vec_id, word, round(logp, 9) AS logp FROM choice",
    "copy_extension": _CHOICE
    + f""", o AS (SELECT vec_id, i, round(x, 9) AS x, row_number() OVER (PARTITION BY vec_id ORDER BY round(x, 9) DESC, i) AS k FROM x),
l AS (SELECT vec_id, i, k, x - ln(sum(exp(x)) OVER (PARTITION BY vec_id)) AS lp FROM o WHERE k <= {BEAM})
SELECT n AS vec_id, CASE WHEN n % 12 + 1 + length(word) >= {LONGEST} THEN 'completed' ELSE 'copied' END AS kind, CAST(0 AS BIGINT) AS rank,
  array_to_string(list_transform(string_split(word, ''), lambda c: unicode(c)), ' ') AS added, round(logp - (n % 7) / 2, 9) AS logp FROM choice WHERE word IS NOT NULL
UNION ALL SELECT vec_id, 'beam', k - 1, CAST(i AS VARCHAR), round(lp - (vec_id % 7) / 2, 9) FROM l JOIN choice ON n = vec_id WHERE word IS NULL
""",
    "activation_sums": f"""
WITH x AS (SELECT vec_id, 10 * CAST(unnest(embedding) AS DOUBLE) AS x, (generate_subscripts(embedding, 1) - 1) / 10 AS b FROM embeddings)
SELECT vec_id, round(sum(x * 0.5 * (1 + {_ERF.format("x / sqrt(2)")})), 6) AS gelu, round(sum((x + b) * 0.5 * (1 + {_ERF.format("(x + b) / 1.41421")})), 6) AS bias_gelu,
  round(sum(1 - 2 / (exp(2 * (x + b)) + 1)), 6) AS bias_tanh, round(sum(x / (1 + exp(-x))), 6) AS swish, round(sum(greatest(x, 0)), 6) AS relu FROM x GROUP BY vec_id
""",
    "gradient_steps": f"""
WITH RECURSIVE v AS (SELECT label AS run, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT CAST(run AS BIGINT) AS run, k // {TASKS} AS step, k % {TASKS} AS task, list_transform(e, lambda x, i: CASE WHEN (vec_id + i - 1) % 5 = 0 THEN 0.0::DOUBLE ELSE x END) AS g FROM v),
m AS (SELECT a.run, a.step, a.task, b.task AS other, a.g AS own, b.g AS theirs, row_number() OVER (PARTITION BY a.run, a.task ORDER BY a.step, md5('0:' || a.step || ':' || a.task || ':' || b.task), b.task) AS ev,
    row_number() OVER (PARTITION BY a.run, a.step, a.task ORDER BY md5('0:' || a.step || ':' || a.task || ':' || b.task), b.task) AS nth,
    count(*) OVER (PARTITION BY a.run, a.step, a.task) AS among
  FROM g a JOIN g b ON a.run = b.run AND a.step = b.step AND a.task <> b.task),
r AS (SELECT run, task, CAST(0 AS BIGINT) AS ev, CAST(-1 AS BIGINT) AS step, true AS last, CAST([] AS DOUBLE[]) AS pc, [0.0::DOUBLE, 0.0, 0.0] AS target, CAST(0 AS BIGINT) AS turns FROM m GROUP BY run, task
  UNION ALL
  SELECT run, task, ev, step, nth = among, CASE WHEN cos < t THEN list_transform(base, lambda x, i: x + theirs[i] * w) ELSE base END,
    CASE WHEN cos < t THEN list_transform(target, lambda x, i: CASE WHEN i = other + 1 THEN (1 - {BETA}) * t + {BETA} * cos ELSE x END) ELSE target END, CASE WHEN nth = 1 THEN 0 ELSE turns END + CASE WHEN cos < t THEN 1 ELSE 0 END
  FROM (SELECT *, na * (t * sqrt(1 - cos * cos) - cos * sqrt(1 - t * t)) / (nb * sqrt(1 - t * t)) AS w
    FROM (SELECT *, list_inner_product(base, theirs) / (na * nb) AS cos FROM (SELECT *, sqrt(list_inner_product(base, base)) AS na, sqrt(list_inner_product(theirs, theirs)) AS nb
      FROM (SELECT m.run, m.task, m.ev, m.step, m.nth, m.among, m.other, m.theirs, r.turns, r.target, r.target[m.other + 1] AS t, CASE WHEN m.nth = 1 THEN m.own ELSE r.pc END AS base FROM r JOIN m ON m.run = r.run AND m.task = r.task AND m.ev = r.ev + 1))))),
done AS (SELECT run, step, task, pc, turns FROM r WHERE last AND step >= 0 UNION ALL SELECT run, step, task, g, 0 FROM g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.run = g.run AND m.step = g.step)),
c AS (SELECT run, step, turns, generate_subscripts(pc, 1) AS i, unnest(pc) AS x, unnest(g) AS g FROM done JOIN g USING (run, step, task)),
s AS (SELECT run, step, i, CASE WHEN bool_and(g <> 0) THEN avg(x) ELSE sum(x) END AS x FROM c GROUP BY run, step, i)
SELECT run, step, CAST((SELECT sum(turns) FROM done d WHERE d.run = s.run AND d.step = s.step) AS BIGINT) AS turns, round(sum(x), 8) AS total, round(sqrt(sum(x * x)), 8) AS norm FROM s GROUP BY run, step
""",
}
