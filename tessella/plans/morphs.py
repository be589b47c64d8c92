"""Four-head decoding: words of every vector, and a beam search that reads vectors as the heads' scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scoring
from tessella.operators.morphology import Tables, decode_words, search
from tessella.runtime import cut
from tessella.sources.tables import table

HEADS = ("stem", "pos", "afset", "affix")
SIZE, SPREAD = 16, 12.0  # ids of each head; how far components lie apart as logits
EOS, BEAM, ENOUGH, STEPS = 2, 4, 3, 3
PART = 1000  # vectors in a task

_TYPES = """SELECT DISTINCT h.head, l_partkey % 16 AS id, CASE WHEN l_partkey % 16 % 4 = 3 THEN -1 ELSE l_partkey % 16 % 4 END AS wt
  FROM lineitem, (VALUES ('stem'), ('pos'), ('afset'), ('affix')) AS h(head) WHERE l_partkey % 16 >= 5 OR h.head = 'affix'"""
_AFFIXES = "SELECT DISTINCT l_partkey % 16 AS affix, l_partkey % 16 * 5 % 14 + 1 AS slot, l_partkey % 16 % 6 AS idx FROM lineitem"
_OWN = "SELECT l_orderkey % 16 AS afset, l_linenumber AS nth, min(l_partkey % 16) AS affix FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 16 % 3 <> 1 GROUP BY l_orderkey % 16, l_linenumber"
_SLOTS = "SELECT DISTINCT o_orderkey % 16 AS afset, o_custkey % 3 AS wt, o_orderkey * 3 % 14 + 1 AS slot FROM orders WHERE (o_orderkey + o_custkey) % 3 <> 0"
_POS_STEM = "SELECT DISTINCT l_partkey % 16 AS pos, l_suppkey % 16 AS stem FROM lineitem WHERE (l_partkey % 16 * 7 + l_suppkey % 16 * 5) % 4 <> 1"
_POS_AFSET = "SELECT DISTINCT l_partkey % 16 AS pos, l_suppkey % 16 AS afset FROM lineitem WHERE (l_partkey % 16 + l_suppkey % 16 * 2) % 5 <> 0"
_AFSET_STEM = "SELECT l_partkey % 16 AS afset, l_suppkey % 16 AS stem, CAST(count(*) % 5 AS DOUBLE) AS corr FROM lineitem WHERE (l_partkey % 16 * 3 + l_suppkey % 16) % 3 <> 1 GROUP BY l_partkey % 16, l_suppkey % 16"


def _tables(spark: SparkSession, base: str) -> Tables:
    """Stand-in dictionaries: ids are remainders of the items' keys. Written out, as every use would read the items again."""
    made = lambda sql: cut(spark.sql(sql.replace("lineitem", "{lineitem}").replace("FROM orders", "FROM {orders}"), lineitem=table(spark, base, "lineitem"), orders=table(spark, base, "orders")), "morph-table")
    return Tables(*map(made, (_TYPES, _AFFIXES, _OWN, _SLOTS, _POS_STEM, _POS_AFSET, _AFSET_STEM)), stem_slot=F.lit(13) - F.col("wt") * 3)


def _heads(vectors: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each id of each head, with its probability among the head's."""
    part = lambda k: scoring.softmax(F.transform(F.slice("v", k * SIZE + 1, SIZE), lambda x: x * SPREAD))
    each = F.array(*[F.struct(F.lit(h).alias("head"), part(k).alias("p")) for k, h in enumerate(HEADS)])
    rows = vectors.select(*keep, F.explode(each).alias("h")).select(*keep, "h.head", F.posexplode("h.p").alias("id", "p"))
    return rows.select(*keep, "head", F.col("id").cast("bigint").alias("id"), F.round("p", 12).alias("p"))


def _dealt(vectors: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows at most, in parts of about ``PART`` by their key, as one vector becomes some hundred words."""
    return vectors.repartition(-(-n // PART) or 1, key)


def _vectors(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def word_decode(spark: SparkSession, base: str) -> DataFrame:
    """All words of every vector's heads: type vote, cuts, slots, correlation, synthesis key."""
    vectors = _vectors(spark, base)
    words = decode_words(_heads(_dealt(vectors, "vec_id", vectors.count()), ["vec_id"]), _tables(spark, base), ["vec_id"])
    return words.select("vec_id", F.col("wt").cast("bigint").alias("wt"), "stem", "pos", "afset", F.col("n_free").cast("bigint").alias("n_free"), "prob", "synthesis")


def _state(n: int) -> Column:
    """The vector that scores a hypothesis: another for each sentence, last stem and length."""
    last = F.coalesce(F.try_element_at("stems", F.lit(-1)), F.lit(0))
    return (F.col("sentence") + last * 31 + F.size("stems") * 17) % n


def morph_beam(spark: SparkSession, base: str) -> DataFrame:
    """Each sentence's best hypothesis over the four heads; the attention of its first vector pays for coverage."""
    vectors = _vectors(spark, base)
    n = vectors.count()
    mass = F.transform(F.slice("v", 1, 4), lambda x: F.abs(x) * 4 + 0.1)
    sentences = vectors.select(F.col("vec_id").alias("sentence"), mass.alias("mass"))

    def score(states: DataFrame) -> DataFrame:
        return _heads(_dealt(states.join(vectors.withColumnRenamed("vec_id", "state"), "state"), "state", n), ["state"])

    finish = lambda logp, length: scoring.hypothesis_score(logp, length, F.col("mass"), F.lit(4), length)
    return search(sentences, score, finish, _tables(spark, base), EOS, BEAM, ENOUGH, STEPS, state=_state(n))


QUERIES = {"word_decode": word_decode, "morph_beam": morph_beam}

_SIZES = {h: k * SIZE for k, h in enumerate(HEADS)}
_WORDS = f"""
types AS ({_TYPES}), affixes AS ({_AFFIXES}), own AS ({_OWN}), slots AS ({_SLOTS}), pos_stem AS ({_POS_STEM}), pos_afset AS ({_POS_AFSET}), afset_stem AS ({_AFSET_STEM}),
x AS ({" UNION ALL ".join(f"SELECT vec_id, '{h}' AS head, unnest(range({SIZE})) AS id, exp({SPREAD} * CAST(unnest(embedding[{k} + 1:{k} + {SIZE}]) AS DOUBLE)) AS e FROM embeddings" for h, k in _SIZES.items())}),
heads AS (SELECT vec_id, head, id, round(e / sum(e) OVER (PARTITION BY vec_id, head), 12) AS p FROM x),
typed AS (SELECT h.*, coalesce(wt, -1) AS wt FROM heads h LEFT JOIN types USING (head, id) WHERE wt IS NOT NULL OR head <> 'affix'),
votes AS (SELECT vec_id, wt, round(coalesce(max(ln(p)) FILTER (head = 'stem'), -100) + coalesce(max(ln(p)) FILTER (head = 'pos'), -100) + coalesce(max(ln(p)) FILTER (head = 'afset'), -100), 9) AS score
  FROM typed WHERE head <> 'affix' GROUP BY ALL),
falls AS (SELECT *, exp(score - max(score) OVER (PARTITION BY vec_id)) AS e, coalesce(lag(score) OVER w - score > 2.0, false) AS falls FROM votes WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, wt = -1, wt)),
voted AS (SELECT vec_id, wt, e / sum(e) OVER (PARTITION BY vec_id) AS wt_p, max(falls) OVER (PARTITION BY vec_id ORDER BY score DESC, wt = -1, wt) AS stopped FROM falls),
d AS (SELECT t.*, wt_p, coalesce(lag(p) OVER w - p, -1) AS gap FROM typed t JOIN voted v USING (vec_id, wt) WHERE NOT stopped WINDOW w AS (PARTITION BY vec_id, wt, head ORDER BY p DESC, id)),
s AS (SELECT *, max(gap >= 0.3 OR (head = 'affix' AND p < 0.3)) OVER (PARTITION BY vec_id, wt, head ORDER BY p DESC, id) AS stopped FROM d),
kept AS (SELECT * FROM s WHERE NOT stopped),
a AS (SELECT vec_id, wt, id AS afset, p FROM kept WHERE head = 'afset'),
f AS (
  SELECT vec_id, wt, afset, slot, idx, 0 AS free, CAST(nth AS DOUBLE) AS rank, affix FROM a JOIN own USING (afset) JOIN affixes USING (affix)
  UNION ALL SELECT a.vec_id, a.wt, a.afset, x.slot, x.idx, 1, -k.p, x.affix FROM a JOIN kept k ON k.vec_id = a.vec_id AND k.wt = a.wt AND k.head = 'affix' JOIN affixes x ON x.affix = k.id
    JOIN slots o ON o.afset = a.afset AND o.wt = a.wt AND o.slot = x.slot),
g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY vec_id, wt, afset, slot ORDER BY free, rank, affix) = 1),
every AS (SELECT vec_id, wt, afset, slot, idx FROM g
  UNION ALL SELECT vec_id, wt, afset, 13 - wt * 3, 0 FROM g GROUP BY vec_id, wt, afset HAVING count(*) FILTER (slot = 13 - wt * 3) = 0
  UNION ALL SELECT vec_id, wt, afset, 11, 0 FROM g WHERE wt = 0 GROUP BY vec_id, wt, afset HAVING count(*) FILTER (slot = 12) > 0 AND count(*) FILTER (slot = 11) = 0),
keys AS (SELECT vec_id, wt, afset, wt || ':' || string_agg(slot, '-' ORDER BY slot, idx) || '|' || string_agg(idx, ',' ORDER BY slot, idx) AS synthesis FROM every GROUP BY vec_id, wt, afset),
free AS (SELECT vec_id, wt, afset, sum(free) AS n_free FROM g GROUP BY ALL),
m AS (SELECT st.vec_id, st.wt, st.id AS stem, t.id AS pos, a.afset, st.wt_p, exp(0.08 * corr + ln(st.p) + ln(t.p) + ln(a.p)) AS raw
  FROM kept st JOIN a USING (vec_id, wt) JOIN kept t ON t.vec_id = st.vec_id AND t.wt = st.wt AND t.head = 'pos' AND st.head = 'stem'
  JOIN afset_stem c ON c.afset = a.afset AND c.stem = st.id JOIN pos_stem ps ON ps.pos = t.id AND ps.stem = st.id JOIN pos_afset pa ON pa.pos = t.id AND pa.afset = a.afset),
words AS (SELECT m.vec_id, m.wt, stem, pos, m.afset, coalesce(n_free, 0) AS n_free, round(raw / sum(raw) OVER (PARTITION BY m.vec_id, m.wt) * wt_p, 9) AS prob, coalesce(synthesis, '') AS synthesis
  FROM m LEFT JOIN keys k ON k.vec_id = m.vec_id AND k.wt = m.wt AND k.afset = m.afset LEFT JOIN free n ON n.vec_id = m.vec_id AND n.wt = m.wt AND n.afset = m.afset)
"""


def _beam_sql() -> str:
    """The search, some common tables for each step: g grown, d done, p pending."""
    sql = f"WITH {_WORDS}, sent AS (SELECT vec_id AS s, (SELECT count(*) FROM embeddings) AS n, list_transform(embedding[1:4], lambda x: abs(CAST(x AS DOUBLE)) * 4 + 0.1) AS mass FROM embeddings),"
    sql += "p0 AS (SELECT s, CAST([] AS VARCHAR[]) AS words, CAST(0 AS BIGINT) AS last, CAST(0 AS DOUBLE) AS neg FROM sent), d0 AS (SELECT s, words, neg FROM p0 WHERE false)"
    cover = "0.8 * list_sum(list_transform(mass, lambda m: ln(least(m, 1.0))))"
    for i in range(1, STEPS + 1):
        sql += f""",
g{i} AS MATERIALIZED (SELECT p.s, mass, list_append(p.words, concat_ws('/', w.stem, w.pos, w.afset, w.synthesis)) AS words, w.stem AS last, round(p.neg - ln(CASE WHEN prob > 0 THEN prob ELSE 1e-20 END), 9) AS neg, stem = {EOS} AND pos = {EOS} AND afset = {EOS} AS ends
  FROM p{i - 1} p JOIN sent USING (s) JOIN words w ON w.vec_id = (p.s + p.last * 31 + {i - 1} * 17) % n),
d{i} AS MATERIALIZED (SELECT * FROM d{i - 1} UNION ALL SELECT s, words, round(-(-neg / pow((len(words) + 5) / 6.0, 0.2) + {cover} + 0.2 * 4 / len(words)), 9) FROM g{i} WHERE ends),
p{i} AS MATERIALIZED (SELECT s, words, last, neg FROM (SELECT * FROM g{i} WHERE NOT ends QUALIFY row_number() OVER (PARTITION BY s ORDER BY neg, words) <= {BEAM}) WHERE s NOT IN (SELECT s FROM d{i} GROUP BY s HAVING count(*) >= {ENOUGH}))"""
    return (
        sql
        + f""",
e AS (SELECT s, 0 AS open, neg, words FROM d{STEPS} UNION ALL SELECT s, 1, neg, words FROM p{STEPS}),
b AS (SELECT *, count(*) FILTER (open = 0) OVER (PARTITION BY s) AS n_done FROM e QUALIFY row_number() OVER (PARTITION BY s ORDER BY open, neg, words) = 1)
SELECT sent.s AS sentence, CASE open WHEN 0 THEN 'complete' WHEN 1 THEN 'pending' ELSE 'none' END AS status, coalesce(n_done, 0) AS n_done, array_to_string(words, ' ') AS words, neg AS cost
FROM sent LEFT JOIN b USING (s)"""
    )


ORACLE = {
    "word_decode": f"WITH {_WORDS} SELECT vec_id, wt, stem, pos, afset, CAST(n_free AS BIGINT) AS n_free, prob, synthesis FROM words",
    "morph_beam": _beam_sql(),
}
