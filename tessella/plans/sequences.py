"""Sequence, packing, batching and statistics queries over ``documents``, ``lineitem`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import sequences, text
from tessella.operators import batching, vocabulary
from tessella.operators.ranking import with_running
from tessella.runtime import cut
from tessella.sources.tables import table

EPOCH = 7  # seed of the registered epoch


def _ids() -> Column:
    """Stand-in token ids of a whole text: word lengths, spread by place."""
    return F.transform(text.tokens(F.col("text")), lambda x, i: (F.length(x) * 7 + i).cast("int"))


def _docs(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents")


def wrap_truncate(spark: SparkSession, base: str) -> DataFrame:
    wrapped = sequences.wrap(_ids(), sequences.EN_BOS, sequences.EN_EOS)
    return _docs(spark, base).select("doc_id", F.array_join(sequences.truncate(wrapped, 16), " ").alias("ids"))


def pad_mask(spark: SparkSession, base: str) -> DataFrame:
    docs = _docs(spark, base).select("doc_id", F.slice(_ids(), F.lit(1), (F.col("doc_id") % 12 + 1).cast("int")).alias("ids"))
    mask = sequences.padding_mask(F.size("ids"), F.lit(12), True)
    return docs.select("doc_id", F.array_join(sequences.pad(F.col("ids"), F.lit(12), sequences.EN_PAD), " ").alias("padded"), F.array_join(F.transform(mask, lambda m: m.cast("int")), "").alias("mask"))


def causal_mask(spark: SparkSession, base: str) -> DataFrame:
    rows = sequences.causal_mask((F.col("doc_id") % 6 + 1).cast("int"))
    flat = F.array_join(F.transform(F.flatten(rows), lambda v: F.when(v == 0, "0").otherwise("-")), "")
    return _docs(spark, base).select("doc_id", flat.alias("mask"))


def multi_hot(spark: SparkSession, base: str) -> DataFrame:
    hot = sequences.multi_hot(F.transform(_ids(), lambda x: x % 32), 32)
    return _docs(spark, base).select("doc_id", F.array_join(F.transform(hot, lambda v: v.cast("int")), "").alias("hot"))


def ragged_split(spark: SparkSession, base: str) -> DataFrame:
    docs = _docs(spark, base).select("doc_id", _ids().alias("v"))
    lengths = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: ((F.col("doc_id") + k) % 4).cast("int"))
    pieces = sequences.ragged_split(F.col("v"), lengths)
    return docs.select("doc_id", F.array_join(F.transform(pieces, lambda p: F.array_join(p, ",")), "|").alias("pieces"))


def token_roundtrip(spark: SparkSession, base: str) -> DataFrame:
    """Packed tokens parsed, unrolled into parallel arrays and packed again."""
    packed = F.concat_ws(";", F.transform(_ids(), lambda x, i: F.concat_ws(",", x, x + 1, x % 7, x + 2, F.when(i == 1, F.concat_ws(",", F.lit(2), x + 3, x + 4)).otherwise("0"), F.lit(1), x % 5)))
    docs = _docs(spark, base).select("doc_id", packed.alias("line"))
    docs = docs.select("doc_id", "line", sequences.parse_sentence(F.col("line")).alias("s"))
    arrays = sequences.unroll(F.col("s"))
    return docs.select("doc_id", F.array_join(F.transform("s", sequences.format_token), ";").alias("line"), *[F.array_join(v, " ").alias(k) for k, v in arrays.items()])


def pack_offsets(spark: SparkSession, base: str) -> DataFrame:
    """Half-open ranges of each document in the packed ids of its source."""
    docs = _docs(spark, base).select("doc_id", "source", F.size(text.tokens(F.col("text"))).cast("bigint").alias("n"))
    ended = with_running(docs, ["doc_id"], ["source"], F.col("n"), "end")
    return ended.select("doc_id", "source", (F.col("end") - F.col("n")).alias("start"), "end")


def _lengths(spark: SparkSession, base: str) -> DataFrame:
    return _docs(spark, base).select("doc_id", "source", F.size(text.tokens(F.col("text"))).cast("bigint").alias("n"))


def token_budget_batches(spark: SparkSession, base: str) -> DataFrame:
    rows = batching.token_budget_batches(_lengths(spark, base), "source", "n", ["n", "doc_id"], 2048)
    return rows.groupBy("source", "batch").agg(F.count("*").cast("bigint").alias("n_rows"), F.sum("n").cast("bigint").alias("n_tokens"))


def bucket_mark(spark: SparkSession, base: str) -> DataFrame:
    rows = batching.mark_buckets(_lengths(spark, base), "source", "n", ["n", "doc_id"], 5)
    return rows.groupBy("source", "bucket").agg(F.count("*").cast("bigint").alias("n_rows"), F.min("n").cast("bigint").alias("least"), F.max("n").cast("bigint").alias("most"))


def shuffled_batches(spark: SparkSession, base: str) -> DataFrame:
    """One epoch: five buckets by length in each source, shuffled inside; batches of them, shuffled; the open last one goes."""
    rows = batching.shuffled_batches(_lengths(spark, base), "source", "n", "doc_id", 5, 2048, EPOCH)
    return rows.groupBy("source", "place", "batch").agg(F.count("*").cast("bigint").alias("n_rows"), F.sum("n").cast("bigint").alias("n_tokens"), F.min("bucket").alias("first_bucket"), F.min("doc_id").alias("least"))


def corpus_union_repeat(spark: SparkSession, base: str) -> DataFrame:
    """Training rows with the lexical source three times; a source repeated 0 times goes."""
    repeat = F.when(F.col("source") == "src1", 3).when(F.col("source") == "src2", 0).otherwise(1)
    rows = _docs(spark, base).select("source", "doc_id", repeat.alias("k")).where("k > 0")
    rows = rows.select("source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("copy"))
    return rows.groupBy("source").agg(F.count("*").cast("bigint").alias("n_rows"), F.count_distinct("doc_id").cast("bigint").alias("n_docs"))


def _stats(spark: SparkSession, base: str) -> DataFrame:
    each = _docs(spark, base).select("doc_id", F.explode(text.tokens(F.col("text"))).alias("w"))
    low = F.lower("w")
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    by_doc = each.groupBy(low.alias("token"), "doc_id").agg(
        F.count("*").alias("n"),
        flag((F.upper("w") == F.col("w")) & (low != F.col("w"))).alias("up"),
        flag(low == F.col("w")).alias("low"),
        flag(F.rlike("w", F.lit("^[A-Z]"))).alias("first"),
    )
    return by_doc.groupBy("token").agg(F.sum("n").cast("bigint").alias("total"), F.count("*").cast("bigint").alias("docs"), F.sum("up").cast("bigint").alias("all_up"), F.sum("low").cast("bigint").alias("all_low"), F.sum("first").cast("bigint").alias("first_up"))


def token_stats(spark: SparkSession, base: str) -> DataFrame:
    """Counts of each token, and its form by the proper-noun rule (null: not kept)."""
    s = _stats(spark, base)
    noun = (F.col("docs") > 3) & (F.col("total") > 6) & (10 * F.col("first_up") > 7 * F.col("total"))  # in whole numbers: 0.7 is no double
    form = F.when(noun, text.capitalise(F.col("token"))).when(F.rlike("token", F.lit("^[0-9]+$")), F.col("token"))
    return s.withColumn("form", form)


def token_pct_rank(spark: SparkSession, base: str) -> DataFrame:
    """The percentile of each token, most frequent first, as the order of a statistics file gives it."""
    s = cut(_stats(spark, base).select("token", (-F.col("total")).alias("down")), "token-counts")
    share = 100 * (F.col("rank") - 1) / F.lit(s.count())
    return with_running(s, ["down", "token"]).select("token", F.floor(share).cast("bigint").alias("pct_rank"))


def tfidf_keywords(spark: SparkSession, base: str) -> DataFrame:
    """The three best keywords of each document: augmented tf times ln(1e6 / (1 + docs))."""
    docs = vocabulary.dealt_whole(_docs(spark, base).select("doc_id", "text"), "doc_id")
    each = docs.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("w"))
    tf = each.groupBy("doc_id", text.keyword_key(F.col("w")).alias("term")).agg(F.count("*").alias("f"))
    idf = cut(tf.groupBy("term").agg(F.count_if(F.col("f") > 0).alias("docs")), "tfidf-terms")
    score = F.round((0.5 + 0.5 * F.col("f") / F.col("top")) * F.log(1e6 / (1 + F.col("docs"))), 9)
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "term")).cast("bigint")
    met = vocabulary.with_listed(tf.withColumn("top", F.max("f").over(Window.partitionBy("doc_id"))), idf, "term", "docs").withColumn("score", score)
    # of a document's listed terms the best three, which come before the nulls of all others, whose scores are still to come
    left = cut(met.withColumn("rank", best).where("rank <= 3 OR score IS NULL").select("doc_id", "term", "f", "top", "score"), "tfidf-left")
    others = left.where("score IS NULL").drop("score").join(idf, "term").withColumn("score", score)
    scored = left.where("score IS NOT NULL").unionByName(others.select(left.columns))
    return scored.withColumn("rank", best).where("rank <= 3").select("doc_id", "rank", "term", "score")


def shard_ranges(spark: SparkSession, base: str) -> DataFrame:
    """Rows per shard when ceil(total / 7) consecutive orders go to each."""
    orders = table(spark, base, "orders").select("o_orderkey")
    size = max(1, -(-orders.count() // 7))
    numbered = with_running(orders, ["o_orderkey"], name="row")
    shard = F.floor((F.col("row") - 1) / size).cast("bigint")
    return numbered.groupBy(shard.alias("shard")).agg(F.count("*").cast("bigint").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


def resume_antijoin(spark: SparkSession, base: str) -> DataFrame:
    """Orders without any output row yet."""
    done = table(spark, base, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, base, "orders").join(done, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


QUERIES = {f.__name__: f for f in (wrap_truncate, pad_mask, causal_mask, multi_hot, ragged_split, token_roundtrip, pack_offsets, token_budget_batches, bucket_mark, shuffled_batches, corpus_union_repeat, token_stats, token_pct_rank, tfidf_keywords, shard_ranges, resume_antijoin)}

_W = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
_V = f"list_transform({_W}, lambda x, i: length(x) * 7 + i - 1)"


_STATS = f"""
WITH each AS (SELECT doc_id, unnest({_W}) AS w FROM documents),
s AS (SELECT lower(w) AS token, count(*) AS total, count(DISTINCT doc_id) AS docs,
  count(*) FILTER (upper(w) = w AND lower(w) <> w) AS all_up, count(*) FILTER (lower(w) = w) AS all_low,
  count(*) FILTER (regexp_matches(w, '^[A-Z]')) AS first_up FROM each GROUP BY 1)
"""
_FOLD = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, n, row_number() OVER (PARTITION BY source ORDER BY n, doc_id) AS k, sum(n) OVER (PARTITION BY source) AS total
  FROM (SELECT doc_id, source, len({_W}) AS n FROM documents)
), fold AS (
  SELECT source, k, n, CAST(0 AS BIGINT) AS batch, CAST(n AS BIGINT) AS held FROM r WHERE k = 1
  UNION ALL
  SELECT r.source, r.k, r.n, CASE WHEN held > 0 AND held + r.n > {{size}} THEN batch + 1 ELSE batch END,
         CASE WHEN held > 0 AND held + r.n > {{size}} THEN r.n ELSE held + r.n END
  FROM fold f JOIN r ON r.source = f.source AND r.k = f.k + 1
)
"""
ORACLE = {
    "wrap_truncate": f"""
WITH v AS (SELECT doc_id, {_V} AS v FROM documents),
a AS (SELECT doc_id, CASE WHEN v[1] = 0 THEN v ELSE list_prepend(0, v) END AS v FROM v),
b AS (SELECT doc_id, CASE WHEN v[-1] = 2 THEN v ELSE list_append(v, 2) END AS v FROM a)
SELECT doc_id, array_to_string(CASE WHEN len(v) > 16 THEN list_append(v[1:15], v[-1]) ELSE v END, ' ') AS ids FROM b
""",
    "pad_mask": f"""
WITH v AS (SELECT doc_id, ({_V})[1:doc_id % 12 + 1] AS v FROM documents)
SELECT doc_id, array_to_string(list_resize(v, 12, 1), ' ') AS padded,
       array_to_string(list_transform(range(1, 13), lambda i: CASE WHEN i >= len(v) THEN 1 ELSE 0 END), '') AS mask FROM v
""",
    "causal_mask": """
SELECT doc_id, array_to_string(list_transform(range(0, (doc_id % 6 + 1) * (doc_id % 6 + 1)),
  lambda p: CASE WHEN p % (doc_id % 6 + 1) <= p // (doc_id % 6 + 1) THEN '0' ELSE '-' END), '') AS mask FROM documents
""",
    "multi_hot": f"""
WITH v AS (SELECT doc_id, list_transform({_V}, lambda y: y % 32) AS v FROM documents)
SELECT doc_id, array_to_string(list_transform(range(0, 32), lambda i: CASE WHEN list_contains(v, i) THEN 1 ELSE 0 END), '') AS hot FROM v
""",
    "ragged_split": f"""
WITH v AS (SELECT doc_id, {_V} AS v FROM documents)
SELECT doc_id, array_to_string(list_transform(range(1, 7), lambda k: coalesce(array_to_string(
  v[1 + CAST(list_sum(list_transform(range(1, k + 1), lambda j: (doc_id + j) % 4)) - (doc_id + k) % 4 AS BIGINT) :
    CAST(list_sum(list_transform(range(1, k + 1), lambda j: (doc_id + j) % 4)) AS BIGINT)], ','), '')), '|') AS pieces FROM v
""",
    "token_roundtrip": f"""
WITH v AS (SELECT doc_id, {_V} AS v FROM documents),
t AS (SELECT doc_id, v, list_transform(v, lambda x, i: CASE WHEN i = 2 THEN [x + 3, x + 4] ELSE [x + 2] END) AS s FROM v)
SELECT doc_id,
  array_to_string(list_transform(v, lambda x, i: concat_ws(',', x, x + 1, x % 7, x + 2, CASE WHEN i = 2 THEN concat_ws(',', 2, x + 3, x + 4) ELSE '0' END, 1, x % 5)), ';') AS line,
  array_to_string(list_concat([3], flatten(s), [4]), ' ') AS stems,
  array_to_string(list_concat([3], flatten(list_transform(v, lambda x, i: CASE WHEN i = 2 THEN [x % 7, x % 7] ELSE [x % 7] END)), [4]), ' ') AS tags,
  array_to_string(list_concat([3], flatten(list_transform(v, lambda x, i: CASE WHEN i = 2 THEN [x + 1, x + 1] ELSE [x + 1] END)), [4]), ' ') AS morphs,
  array_to_string(list_concat([0], list_transform(flatten(s), lambda y: 1), [0]), ' ') AS affix_counts,
  array_to_string(flatten(list_transform(v, lambda x, i: CASE WHEN i = 2 THEN [x % 5, x % 5] ELSE [x % 5] END)), ' ') AS affixes
FROM t
""",
    "pack_offsets": f"""
WITH n AS (SELECT doc_id, source, len({_W}) AS n FROM documents)
SELECT doc_id, source, CAST(sum(n) OVER w - n AS BIGINT) AS start, CAST(sum(n) OVER w AS BIGINT) AS "end" FROM n WINDOW w AS (PARTITION BY source ORDER BY doc_id)
""",
    "token_budget_batches": _FOLD.format(size=2048) + "SELECT source, batch, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_tokens FROM fold GROUP BY ALL",
    "bucket_mark": _FOLD.format(size="(r.total // 5 + 1)")
    + """, ended AS (SELECT *, greatest(max(batch) OVER (PARTITION BY source) - 1, 0) AS last FROM fold)
SELECT source, least(batch, last) AS bucket, count(*) AS n_rows, min(n) AS least, max(n) AS most FROM ended GROUP BY ALL""",
    "shuffled_batches": f"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, n, row_number() OVER (PARTITION BY source ORDER BY n, doc_id) AS k, sum(n) OVER (PARTITION BY source) // 5 + 1 AS size
  FROM (SELECT doc_id, source, len({_W}) AS n FROM documents)
), fold AS (
  SELECT source, doc_id, k, n, CAST(0 AS BIGINT) AS batch, CAST(n AS BIGINT) AS held FROM r WHERE k = 1
  UNION ALL
  SELECT r.source, r.doc_id, r.k, r.n, CASE WHEN held > 0 AND held + r.n > size THEN batch + 1 ELSE batch END, CASE WHEN held > 0 AND held + r.n > size THEN r.n ELSE held + r.n END
  FROM fold f JOIN r ON r.source = f.source AND r.k = f.k + 1
), marked AS (SELECT source, doc_id, n, least(batch, greatest(max(batch) OVER (PARTITION BY source) - 1, 0)) AS bucket FROM fold),
s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bucket, md5(concat_ws(':', '{EPOCH}', CAST(doc_id AS VARCHAR))), doc_id) AS k FROM marked),
again AS (
  SELECT source, doc_id, k, n, bucket, CAST(0 AS BIGINT) AS batch, CAST(n AS BIGINT) AS held FROM s WHERE k = 1
  UNION ALL
  SELECT s.source, s.doc_id, s.k, s.n, s.bucket, CASE WHEN held > 0 AND held + s.n > 2048 THEN batch + 1 ELSE batch END, CASE WHEN held > 0 AND held + s.n > 2048 THEN s.n ELSE held + s.n END
  FROM again f JOIN s ON s.source = f.source AND s.k = f.k + 1
), b AS (
  SELECT source, batch, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_tokens, min(bucket) AS first_bucket, min(doc_id) AS least, max(batch) OVER (PARTITION BY source) AS last
  FROM again GROUP BY source, batch
)
SELECT source, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws(':', '{EPOCH}', source, CAST(batch AS VARCHAR))), batch) AS place, batch, n_rows, n_tokens, first_bucket, least
FROM b WHERE batch < last
""",
    "corpus_union_repeat": """
SELECT source, count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs FROM (
  SELECT source, doc_id FROM documents WHERE source <> 'src2' UNION ALL
  SELECT source, doc_id FROM documents WHERE source = 'src1' UNION ALL SELECT source, doc_id FROM documents WHERE source = 'src1') GROUP BY source
""",
    "token_stats": _STATS
    + """SELECT *, CASE WHEN docs > 3 AND total > 6 AND first_up > 0.7 * total THEN upper(left(token, 1)) || substr(token, 2)
  WHEN regexp_full_match(token, '[0-9]+') THEN token END AS form FROM s""",
    "token_pct_rank": _STATS + "SELECT token, 100 * (row_number() OVER (ORDER BY total DESC, token) - 1) // count(*) OVER () AS pct_rank FROM s",
    "tfidf_keywords": f"""
WITH each AS (SELECT doc_id, regexp_replace(lower(w), '[''’‘`]$', 'a') AS term FROM (SELECT doc_id, unnest({_W}) AS w FROM documents)),
tf AS (SELECT doc_id, term, count(*) AS f, max(count(*)) OVER (PARTITION BY doc_id) AS top, count(*) OVER (PARTITION BY term) AS docs FROM each GROUP BY doc_id, term),
scored AS (SELECT doc_id, term, round((0.5 + 0.5 * f / top) * ln(1e6 / (1 + docs)), 9) AS score FROM tf)
SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank, term, score FROM scored) WHERE rank <= 3
""",
    "shard_ranges": """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row, CAST(ceil(count(*) OVER () / 7) AS BIGINT) AS size FROM orders)
SELECT (row - 1) // size AS shard, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM r GROUP BY 1
""",
    "resume_antijoin": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 2)",
}
