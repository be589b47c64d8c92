"""Letters, languages and attention: compatibility forms, detection of languages, masked attention with a bias."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scripts
from tessella.functions.bidi import visual_order
from tessella.operators import attention, languages
from tessella.operators.ranking import with_running
from tessella.runtime import bytes_of, cut, ship_code
from tessella.sources.tables import line_scan, table

DIGITS = 9
PART_BYTES = 4_000_000  # of texts as they are stored, in one part
HEADS, NEAR, SLOPE = 4, 8, 0.05

_SIGNS = "".join(c for c in (chr(k) for a, b in scripts.RANGES for k in range(a, b + 1)) if scripts.unicodedata.category(c) != "Cn")
_LIGATURES = (("ffi", "ﬃ"), ("ff", "ﬀ"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("st", "ﬆ"))


def compat_forms(spark: SparkSession, base: str) -> DataFrame:
    """Texts with ligatures and a sign of the presentation forms, taken apart again."""
    set_ = F.col("text")
    for letters, sign in _LIGATURES:
        set_ = F.replace(set_, F.lit(letters), F.lit(sign))
    sign = F.substring(F.lit(_SIGNS), (F.col("doc_id") % len(_SIGNS) + 1).cast("int"), F.lit(1))
    made = table(spark, base, "documents").select("doc_id", F.concat(set_, F.lit(" "), sign, F.lit("ﺍ" + scripts.ALLAH + scripts.ALLAH), sign).alias("t"))
    apart = scripts.taken_apart(F.col("t"))
    return made.select("doc_id", F.md5(apart.cast("binary")).alias("digest"), F.length(apart).cast("bigint").alias("n_chars"))


_HEBREW = ("aeioubdfglmnrst", "אהיועבדפגלמנרסת")


def bidi_lines(spark: SparkSession, base: str) -> DataFrame:
    """Every line, with each third word in Hebrew letters, in the order in which it is seen."""
    words = F.transform(F.split("line", " "), lambda w, i: F.when((i + F.col("doc_id")) % 3 == 0, F.translate(w, *_HEBREW)).otherwise(w))
    ship_code(spark)
    lines = line_scan(table(spark, base, "documents").select("doc_id", "text"))
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), visual_order(F.array_join(words, " ")).alias("shown"))


def language_detection(spark: SparkSession, base: str) -> DataFrame:
    """The language of every document by profiles of those outside of its fold (a quarter of the ids is held out)."""
    docs = table(spark, base, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    held_out = F.col("id") % 4 == 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-bytes_of(docs) // PART_BYTES))
    learned = docs.withColumn("lang", F.when(~held_out, F.col("lang")))
    grams = cut(languages.ngrams(learned, parts), "language-ngrams")
    known = cut(languages.profiles(grams), "language-profiles")
    found = docs.select("id", "lang", held_out.alias("held_out")).join(languages.detect(grams, known), "id", "left")
    return found.select(F.col("id").alias("doc_id"), "lang", "held_out", "detected", "gain")


def masked_attention(spark: SparkSession, base: str) -> DataFrame:
    """Causal attention of the vectors of each label in four heads, nearer ones favoured, every eleventh hidden."""
    v = table(spark, base, "embeddings").select("vec_id", F.col("label").alias("seq"), F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 11 == 0).alias("hidden"))
    placed = cut(with_running(v, ["vec_id"], ["seq"], name="pos").withColumn("pos", F.col("pos") - 1), "attention-tokens")
    bias = lambda away: -SLOPE * np.minimum(np.abs(away), NEAR)
    found = attention.attend(placed.select("seq", "pos", "v", "hidden"), HEADS, bias)
    each = found.join(placed.select("seq", "pos", "vec_id"), ["seq", "pos"]).select("vec_id", "head", F.round("lse", DIGITS).alias("lse"), F.posexplode("out").alias("dim", "value"))
    return each.select("vec_id", "head", "lse", F.col("dim").cast("bigint").alias("dim"), F.round("value", DIGITS).alias("value"))


QUERIES = {f.__name__: f for f in (compat_forms, bidi_lines, language_detection, masked_attention)}

_SET = "text"
for _letters, _sign in _LIGATURES:
    _SET = f"replace({_SET}, '{_letters}', '{_sign}')"
_FORMS = ", ".join(f"('{c}', '{to}')" for c, to in scripts.forms().items())
ORACLE = {
    "compat_forms": f"""
WITH f(c, t) AS (VALUES {_FORMS}),
m AS (SELECT doc_id, concat({_SET}, ' ', s, 'ﺍ{scripts.ALLAH}{scripts.ALLAH}', s) AS t FROM (SELECT doc_id, text, substr('{_SIGNS}', doc_id % {len(_SIGNS)} + 1, 1) AS s FROM documents)),
e AS (SELECT doc_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM m),
b AS (SELECT doc_id, i, c, lag(c) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM e),
j AS (SELECT doc_id, string_agg(CASE WHEN b.c = '{scripts.ALLAH}' AND before IN ('ا', 'ﺍ') THEN '{scripts.WITHOUT_ALEF}' ELSE coalesce(f.t, b.c) END, '' ORDER BY i) AS t FROM b LEFT JOIN f USING (c) GROUP BY doc_id)
SELECT doc_id, md5(t) AS digest, length(t) AS n_chars FROM j
""",
    "language_detection": f"""
WITH w AS (SELECT id, concat('_', w, '_') AS w, count(*) AS n FROM (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL),
k AS (SELECT unnest([1, 2, 3]) AS k),
g AS (SELECT id, gram, CAST(sum(n) AS BIGINT) AS n FROM (SELECT id, n, unnest(list_transform(range(1, length(w) - k + 2), lambda i: substr(w, i, k))) AS gram FROM w, k) WHERE gram <> '_' GROUP BY ALL),
p AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) AS rank FROM g JOIN documents ON doc_id = id WHERE id % 4 <> 0 AND lang IS NOT NULL GROUP BY lang, gram QUALIFY rank <= {languages.LISTED}),
o AS (SELECT id, gram, row_number() OVER (PARTITION BY id ORDER BY n DESC, gram) AS own FROM g QUALIFY own <= {languages.LISTED}),
s AS (SELECT id, p.lang, CAST(sum({languages.LISTED} - abs(own - rank)) AS BIGINT) AS gain FROM o JOIN p USING (gram) GROUP BY ALL),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY gain DESC, lang) = 1)
SELECT doc_id, d.lang, doc_id % 4 = 0 AS held_out, b.lang AS detected, gain FROM documents d LEFT JOIN b ON b.id = doc_id
""",
    "masked_attention": f"""
WITH v AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos, vec_id % 11 = 0 AS hidden, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
h AS (SELECT vec_id, label, pos, hidden, head, v[head * 16 + 1:head * 16 + 16] AS v FROM v, (SELECT unnest(range({HEADS})) AS head)),
s AS (SELECT q.vec_id, q.head, k.v, list_inner_product(q.v, k.v) / 4.0 - {SLOPE} * least(abs(q.pos - k.pos), {NEAR}) AS x
  FROM h q JOIN h k ON q.label = k.label AND q.head = k.head AND k.pos <= q.pos AND NOT k.hidden),
m AS (SELECT *, max(x) OVER (PARTITION BY vec_id, head) AS top FROM s),
e AS (SELECT vec_id, head, v, exp(x - top) AS e, top + ln(sum(exp(x - top)) OVER (PARTITION BY vec_id, head)) AS lse, sum(exp(x - top)) OVER (PARTITION BY vec_id, head) AS z FROM m),
d AS (SELECT vec_id, head, lse, e / z AS w, unnest(v) AS y, generate_subscripts(v, 1) - 1 AS dim FROM e),
o AS (SELECT vec_id, head, dim, round(any_value(lse), 9) AS lse, round(sum(w * y), 9) AS value FROM d GROUP BY ALL)
SELECT vec_id, head, lse, dim, coalesce(value, 0) AS value FROM (SELECT vec_id, head, dim FROM h, (SELECT unnest(range(16)) AS dim)) LEFT JOIN o USING (vec_id, head, dim)
""",
}
