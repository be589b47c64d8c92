"""Pages and words put together: glyphs to lines and paragraphs, law paragraphs to sections, rare words, lexicon pairs, losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import glyphs, text
from tessella.operators.ranking import with_running
from tessella.runtime import cut
from tessella.sources.tables import table

#: Stand-ins that Spark and DuckDB read alike once ``div`` is written as each of them writes it.
_GLYPHS = """SELECT o_orderkey AS id, CAST(o_orderkey div 256 AS BIGINT) AS page, o_orderkey % 32 * 2 + o_custkey % 3 AS x, o_orderkey % 256 div 32 * 12 + o_custkey % 4 AS y,
  o_custkey % 5 + 7 AS h, o_custkey % 2 * 4 + 8 AS w, chr(CAST(97 + o_custkey % 3 AS INT)) AS letter, o_custkey % 7 = 0 AS mark FROM {orders}"""
_TEXT_LINES = """SELECT o_orderkey AS id, CAST(o_orderkey div 1024 AS BIGINT) AS page, 40 + CASE o_custkey % 7 WHEN 0 THEN 20 WHEN 1 THEN -6 WHEN 2 THEN 12 WHEN 3 THEN 1 ELSE 0 END AS x,
  o_orderkey % 1024 * 3 + CASE WHEN o_custkey % 11 = 0 THEN 20 ELSE 0 END AS y, 10 AS h, 4 AS space, 8 AS w, CASE WHEN o_orderkey % 5 < 3 THEN o_custkey % 2 END AS shape FROM {orders}"""
_LEGAL = """SELECT o_orderkey AS id, CAST(o_orderkey div 2048 AS BIGINT) AS page, CAST(o_orderkey % 2048 div 512 AS BIGINT) AS col, CAST(o_orderkey % 512 div 64 % 5 AS BIGINT) AS article,
  CAST(o_orderkey div 2 AS BIGINT) AS y, 't' || o_custkey AS line, o_custkey % 3 = 0 AS ended FROM {orders}"""


def _made(spark: SparkSession, base: str, sql: str) -> DataFrame:
    return spark.sql(sql, orders=table(spark, base, "orders"))


def glyph_duplicates(spark: SparkSession, base: str) -> DataFrame:
    """Glyphs of each page and letter that are not drawn over one of the same letter."""
    g = _made(spark, base, _GLYPHS).groupBy("page", "letter").agg(F.array_sort(F.collect_list(F.struct("id", *[F.col(c).cast("bigint").alias(c) for c in ("x", "y", "w")]))).alias("g"))
    kept = g.withColumn("kept", glyphs.kept_glyphs(F.col("g")))
    return kept.select("page", "letter", F.size("g").cast("bigint").alias("n"), F.size("kept").cast("bigint").alias("n_kept"), F.array_join(F.col("kept").cast("array<string>"), " ").alias("kept"))


def glyph_lines(spark: SparkSession, base: str) -> DataFrame:
    """Lines of each page, as its glyphs come."""
    g = _made(spark, base, _GLYPHS).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("id", F.col("y").cast("bigint").alias("y"), F.col("h").cast("bigint").alias("h"), "letter"))).alias("g"))
    each = g.select("page", F.explode(F.arrays_zip("g", glyphs.line_numbers(F.col("g")).alias("line"))).alias("z")).select("page", "z.line", "z.g.*")
    return each.groupBy("page", "line").agg(F.count("*").cast("bigint").alias("n"), F.min("id").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "letter"))), lambda t: t["letter"]), "").alias("line_text"))


def diacritic_merge(spark: SparkSession, base: str) -> DataFrame:
    """A mark that stands within the width of the glyph just before it joins it; a mark just before a letter that covers it joins that."""
    w = Window.partitionBy("page").orderBy("id")
    g = _made(spark, base, _GLYPHS)
    over = lambda c, a, b: (c("mark") & ~F.col("mark") if a else F.col("mark") & ~c("mark")) & b
    before = lambda c: F.lag(c).over(w)
    onto_letter = over(before, False, (F.col("x") >= before("x")) & (F.col("x") <= before("x") + before("w")))
    covers_mark = over(before, True, (before("x") >= F.col("x")) & (before("x") <= F.col("x") + F.col("w")))
    g = g.withColumn("onto", F.coalesce(onto_letter, F.lit(False))).withColumn("covers", F.coalesce(covers_mark, F.lit(False)))
    # a mark that has joined the letter before it is not there any more for the letter after it
    g = g.withColumn("free", ~F.coalesce(F.lag("onto").over(w), F.lit(False)))
    opens = F.when(F.col("onto") | (F.col("covers") & F.col("free")), 0).otherwise(1)
    g = g.withColumn("cluster", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    clusters = g.groupBy("page", "cluster").agg(F.count("*").alias("n"))
    return clusters.groupBy("page").agg(F.count("*").cast("bigint").alias("n_clusters"), F.count_if(F.col("n") > 1).cast("bigint").alias("n_merged"), F.max("n").cast("bigint").alias("most"))


def paragraph_breaks(spark: SparkSession, base: str) -> DataFrame:
    """The lines of each page that open a paragraph, by distance, indent and list marks."""
    lines = F.struct("id", *[F.col(c).cast("bigint").alias(c) for c in ("x", "y", "h", "space", "w", "shape")])
    pages = _made(spark, base, _TEXT_LINES).groupBy("page").agg(F.array_sort(F.collect_list(lines)).alias("g"))
    each = pages.select("page", F.explode(F.arrays_zip("g", glyphs.paragraph_starts(F.col("g")).alias("starts"))).alias("z"))
    return each.where("z.starts").select("page", F.col("z.g.id").alias("id"))


def paragraph_sections(spark: SparkSession, base: str) -> DataFrame:
    """Paragraphs of articles: a line goes on with the one before it if that is of the same article and not at its end, or at
    the same height; a line of no article begins the numbers anew. The first paragraph of an article 1 in the first column
    begins a section."""
    w = Window.partitionBy("page", "col").orderBy("id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    e = _made(spark, base, _LEGAL)
    before = lambda c: F.lag(c).over(w)
    joins = (F.col("article") > 0) & (before("article") == F.col("article")) & (~before("ended") | (before("y") == F.col("y")))
    e = e.withColumn("opens", F.when(F.col("article") == 0, 0).otherwise(F.when(joins, 0).otherwise(1)))
    e = e.withColumn("island", F.sum(F.when(F.col("article") == 0, 1).otherwise(0)).over(upto)).where("article > 0")
    number = F.sum("opens").over(Window.partitionBy("page", "col", "island").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("paragraph", number.cast("bigint"))
    p = e.groupBy("page", "col", "island", "paragraph").agg(F.min("id").alias("id"), F.min_by("article", "id").alias("article"), F.count("*").cast("bigint").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda t: t["line"]), "").alias("paragraph_text"))
    begins = F.when((F.col("col") == 0) & (F.col("paragraph") == 1) & (F.col("article") == 1), 1).otherwise(0)
    counted = with_running(p, ["page", "col", "id"], weight=begins, name="section")
    return counted.select("id", "section", "page", "col", "article", "paragraph", "n_lines", "paragraph_text")


def _counted(spark: SparkSession, base: str) -> DataFrame:
    """Every token and its count, written once: the total, the ranks and the queries themselves read it."""
    words = table(spark, base, "documents").select(F.explode(text.tokens(F.col("text"))).alias("w"))
    return cut(words.groupBy(F.lower("w").alias("token")).agg(F.count("*").cast("bigint").alias("n")), "token-counts")


def _vocabulary(counted: DataFrame) -> DataFrame:
    """Tokens seen twice or more, with their percentile, most frequent first."""
    known = counted.where("n >= 2").select("token", (-F.col("n")).alias("down"))
    share = 100 * (F.col("rank") - 1) / F.lit(known.count())
    return cut(with_running(known, ["down", "token"]).select("token", F.floor(share).cast("bigint").alias("pct")), "token-ranks")


def _rare(length, pct):
    """Stand-in parses by length: of a fifth the spelling is not valid, a quarter has no part of speech, a quarter is nouns."""
    return (length % 5 != 0) & ((length % 4 == 3) | ((length % 4 == 1) & (pct.isNull() | (pct > 80))))


def rare_tokens(spark: SparkSession, base: str) -> DataFrame:
    """Every token and whether it is rare: without part of speech, or a noun that the statistics lack or rank low."""
    counted = _counted(spark, base)
    return _rated(counted, _vocabulary(counted))


def _rated(counted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return counted.join(vocabulary, "token", "left").select("token", "n", "pct", F.coalesce(_rare(F.length("token"), F.col("pct")), F.lit(False)).alias("rare"))


def word_split_variants(spark: SparkSession, base: str) -> DataFrame:
    """The best split of each rare word: after a vowel as it stands; before a word that ends in a vowel with an apostrophe, or
    with the a (or the i of ni) that it stands for. No part may be rare; unknown parts rank 100, the word itself 10,000."""
    counted = _counted(spark, base)
    vocabulary = _vocabulary(counted)
    words = _rated(counted, vocabulary).where("rare AND token RLIKE '^[a-z]+$'").select("token")
    cuts = words.where("length(token) > 1").select("token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("k"))
    cuts = cuts.select("token", "k", F.left("token", F.col("k")).alias("a"), F.expr("substring(token, k + 1)").alias("b"))
    vowel = lambda c: F.right(c, F.lit(1)).isin(*"aeiou")
    variants = F.when(vowel(F.col("a")), F.array("a")).when(vowel(F.col("b")), F.array(F.concat("a", F.lit("'")), F.when(F.col("a") == "n", "ni"), F.concat("a", F.lit("a"))))
    cuts = cuts.select("token", "k", "b", F.posexplode(variants).alias("variant", "a")).where("a IS NOT NULL")
    left = vocabulary.select(F.col("token").alias("a"), F.col("pct").alias("pa"))
    right = vocabulary.select(F.col("token").alias("b"), F.col("pct").alias("pb"))
    met = cuts.join(left, "a", "left").join(right, "b", "left").where(~_rare(F.length("a"), F.col("pa")) & ~_rare(F.length("b"), F.col("pb")))
    score = F.coalesce("pa", F.lit(100)) + F.coalesce("pb", F.lit(100))
    best = met.groupBy("token").agg(F.min(F.struct(score.alias("score"), "k", "variant", "a", "b")).alias("m"))
    found = words.join(best, "token", "left")
    return found.select("token", F.coalesce("m.score", F.lit(10000)).cast("bigint").alias("score"), F.when(F.col("m").isNull(), F.col("token")).otherwise(F.concat_ws(" ", "m.a", "m.b")).alias("split"))


_ENTRY = "concat(element_at(array('', '. ', 'good; '), CAST(doc_id % 3 + 1 AS INT)), replace(text, ' ', CASE WHEN doc_id % 2 = 0 THEN '; ' ELSE ' (BrE); ' END))"


def lexicon_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Headwords with meanings, in both directions; tags of dialects go, and so do words of one character."""
    entry = table(spark, base, "documents").select("doc_id", F.expr("concat(split(text, ' ')[0], ', ', doc_id, 'x')").alias("head"), F.expr(_ENTRY).alias("line"))
    pairs = entry.select("doc_id", F.explode(text.headwords(F.col("head"))).alias("head"), text.meanings(F.col("line")).alias("m")).select("doc_id", "head", F.explode("m").alias("m"))
    clean = F.trim(F.replace(F.trim(F.replace(F.trim(F.replace("m", F.lit("\t"), F.lit(" "))), F.lit("(BrE)"), F.lit(""))), F.lit("(AmE)"), F.lit("")))
    pairs = pairs.withColumn("m", clean).where("length(m) > 1")
    there = pairs.select(F.lit("rw_en").alias("direction"), "doc_id", F.col("head").alias("source"), F.col("m").alias("target"))
    return there.unionAll(pairs.select(F.lit("en_rw"), "doc_id", "m", "head"))


def loss_reduce(spark: SparkSession, base: str) -> DataFrame:
    """The mean loss over four workers, each of which takes as many steps as the one with the fewest rows."""
    events = table(spark, base, "events").select("event_id", F.col("event_type").alias("task"), (F.col("user_id") % 4).alias("worker"), F.round("value", 6).cast("decimal(18,6)").alias("loss"))
    least = events.groupBy("task", "worker").agg(F.count("*").alias("n")).groupBy("task").agg(F.min("n").alias("steps"), F.count("*").alias("world"))
    each = with_running(events, ["event_id"], ["task", "worker"], name="step").join(least, "task").where("step <= steps")
    return each.groupBy("task").agg(F.max("steps").cast("bigint").alias("steps"), F.max("world").cast("bigint").alias("world"), F.round(F.sum("loss").cast("double") / F.count("*"), 6).alias("loss"))


QUERIES = {f.__name__: f for f in (glyph_duplicates, glyph_lines, diacritic_merge, paragraph_breaks, paragraph_sections, rare_tokens, word_split_variants, lexicon_pairs, loss_reduce)}

_duck = lambda sql: sql.replace(" div ", " // ").replace("{orders}", "orders").replace("chr(CAST(97 + o_custkey % 3 AS INT))", "chr(CAST(97 + o_custkey % 3 AS INTEGER))")
_G = f"g AS ({_duck(_GLYPHS)})"
_TOKENS = """t AS (SELECT lower(w) AS token, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM documents) GROUP BY 1),
v AS (SELECT token, 100 * (row_number() OVER (ORDER BY n DESC, token) - 1) // count(*) OVER () AS pct FROM t WHERE n >= 2)"""
_RARE = "(length({0}) % 5 <> 0 AND (length({0}) % 4 = 3 OR (length({0}) % 4 = 1 AND ({1} IS NULL OR {1} > 80))))"
_HEADS = "list_filter(list_transform(string_split(head, ','), lambda x: trim(x)), lambda x: length(x) > 1)"
_WORDS = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda y: y <> ''))"
ORACLE = {
    "glyph_duplicates": f"""
WITH RECURSIVE {_G}, r AS (SELECT *, row_number() OVER (PARTITION BY page, letter ORDER BY id) AS k FROM g),
f AS (SELECT page, letter, k, [{{'x': x, 'y': y}}] AS spots, [id] AS ids FROM r WHERE k = 1 UNION ALL
  SELECT r.page, r.letter, r.k, CASE WHEN hidden THEN spots ELSE list_append(spots, {{'x': r.x, 'y': r.y}}) END, CASE WHEN hidden THEN ids ELSE list_append(ids, r.id) END
  FROM (SELECT r.*, f.spots, f.ids, len(list_filter(f.spots, lambda p: p.x * 3 >= r.x * 3 - r.w AND p.x * 3 < r.x * 3 + r.w AND p.y * 3 >= r.y * 3 - r.w AND p.y * 3 < r.y * 3 + r.w)) > 0 AS hidden
    FROM f JOIN r ON r.page = f.page AND r.letter = f.letter AND r.k = f.k + 1) r)
SELECT page, letter, k AS n, len(ids) AS n_kept, array_to_string(ids, ' ') AS kept FROM (SELECT *, max(k) OVER (PARTITION BY page, letter) AS last FROM f) WHERE k = last
""",
    "glyph_lines": f"""
WITH RECURSIVE {_G}, r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY id) AS k FROM g),
f AS (SELECT page, k, id, letter, CAST(0 AS BIGINT) AS line, y, h FROM r WHERE k = 1 UNION ALL
  SELECT page, k, id, letter, CASE WHEN meets THEN line ELSE line + 1 END, CASE WHEN meets THEN greatest(fy, y) ELSE y END, CASE WHEN meets THEN greatest(fh, h) ELSE h END
  FROM (SELECT r.*, f.line, f.y AS fy, f.h AS fh, (r.y >= f.y - f.h AND r.y <= f.y) OR (f.y >= r.y - r.h AND f.y <= r.y) AS meets FROM f JOIN r ON r.page = f.page AND r.k = f.k + 1))
SELECT page, line, count(*) AS n, min(id) AS first, string_agg(letter, '' ORDER BY id) AS line_text FROM f GROUP BY page, line
""",
    "diacritic_merge": f"""
WITH {_G}, a AS (SELECT *, lag(mark) OVER p AS m, lag(x) OVER p AS bx, lag(w) OVER p AS bw FROM g WINDOW p AS (PARTITION BY page ORDER BY id)),
b AS (SELECT *, coalesce(mark AND NOT m AND x >= bx AND x <= bx + bw, false) AS onto, coalesce(m AND NOT mark AND bx >= x AND bx <= x + w, false) AS covers FROM a),
c AS (SELECT *, CASE WHEN onto OR (covers AND NOT coalesce(lag(onto) OVER (PARTITION BY page ORDER BY id), false)) THEN 0 ELSE 1 END AS opens FROM b),
d AS (SELECT page, sum(opens) OVER (PARTITION BY page ORDER BY id) AS cluster FROM c),
e AS (SELECT page, cluster, count(*) AS n FROM d GROUP BY ALL)
SELECT page, count(*) AS n_clusters, count(*) FILTER (n > 1) AS n_merged, max(n) AS most FROM e GROUP BY page
""",
    "paragraph_breaks": f"""
WITH RECURSIVE l AS ({_duck(_TEXT_LINES)}), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY id) AS k FROM l),
f AS (SELECT page, k, id, x, y, shape, true AS starts, false AS hangs FROM r WHERE k = 1 UNION ALL
  SELECT page, k, id, x, y, shape,
    CASE WHEN far THEN true WHEN dx > 2 * space OR dx < -space THEN NOT ps WHEN abs(dx) < 0.25 * w AND NOT ph THEN ps AND coalesce(pshape = shape, false) ELSE false END,
    CASE WHEN far THEN false WHEN dx > 2 * space THEN ps WHEN dx >= -space AND abs(dx) < 0.25 * w THEN ph ELSE false END
  FROM (SELECT r.*, r.x - f.x AS dx, abs(r.y - f.y) > 2.5 * r.h AS far, f.starts AS ps, f.hangs AS ph, f.shape AS pshape FROM f JOIN r ON r.page = f.page AND r.k = f.k + 1))
SELECT page, id FROM f WHERE starts
""",
    "paragraph_sections": f"""
WITH e AS ({_duck(_LEGAL)}), a AS (SELECT *, lag(article) OVER w AS pa, lag(ended) OVER w AS pe, lag(y) OVER w AS py, count(*) FILTER (article = 0) OVER (PARTITION BY page, col ORDER BY id) AS island FROM e WINDOW w AS (PARTITION BY page, col ORDER BY id)),
b AS (SELECT *, sum(CASE WHEN coalesce(pa = article AND (NOT pe OR py = y), false) THEN 0 ELSE 1 END) OVER (PARTITION BY page, col, island ORDER BY id) AS paragraph FROM a WHERE article > 0),
p AS (SELECT page, col, island, CAST(paragraph AS BIGINT) AS paragraph, min(id) AS id, arg_min(article, id) AS article, count(*) AS n_lines, string_agg(line, '' ORDER BY id) AS paragraph_text FROM b GROUP BY ALL)
SELECT id, CAST(sum(CASE WHEN col = 0 AND paragraph = 1 AND article = 1 THEN 1 ELSE 0 END) OVER (ORDER BY page, col, id) AS BIGINT) AS section, page, col, article, paragraph, n_lines, paragraph_text FROM p
""",
    "rare_tokens": f"WITH {_TOKENS} SELECT token, n, pct, {_RARE.format('token', 'pct')} AS rare FROM t LEFT JOIN v USING (token)",
    "word_split_variants": f"""
WITH {_TOKENS}, words AS (SELECT token FROM t LEFT JOIN v USING (token) WHERE {_RARE.format('token', 'pct')} AND regexp_full_match(token, '[a-z]+')),
c AS (SELECT token, k, left(token, k) AS a, substr(token, k + 1) AS b FROM (SELECT token, unnest(range(1, length(token))) AS k FROM words)),
s AS (SELECT token, k, 0 AS variant, a, b FROM c WHERE right(a, 1) IN ('a', 'e', 'i', 'o', 'u') UNION ALL
  SELECT token, k, u.variant, CASE u.variant WHEN 0 THEN a || chr(39) WHEN 1 THEN 'ni' ELSE a || 'a' END, b FROM c, (SELECT unnest([0, 1, 2]) AS variant) u
  WHERE right(a, 1) NOT IN ('a', 'e', 'i', 'o', 'u') AND right(b, 1) IN ('a', 'e', 'i', 'o', 'u') AND (u.variant <> 1 OR a = 'n')),
m AS (SELECT s.*, coalesce(va.pct, 100) + coalesce(vb.pct, 100) AS score FROM s LEFT JOIN v va ON va.token = s.a LEFT JOIN v vb ON vb.token = s.b
  WHERE NOT {_RARE.format('s.a', 'va.pct')} AND NOT {_RARE.format('s.b', 'vb.pct')}),
o AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score, k, variant) AS r FROM m)
SELECT words.token, coalesce(score, 10000) AS score, coalesce(a || ' ' || b, words.token) AS split FROM words LEFT JOIN o ON o.token = words.token AND r = 1
""",
    "lexicon_pairs": f"""
WITH e AS (SELECT doc_id, concat(string_split(text, ' ')[1], ', ', doc_id, 'x') AS head,
  trim(list_extract(['', '. ', 'good; '], doc_id % 3 + 1) || replace(text, ' ', CASE WHEN doc_id % 2 = 0 THEN '; ' ELSE ' (BrE); ' END), ' ') AS line FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, CASE WHEN regexp_full_match(head, '[a-zA-Z]{{2,}}[1-5]') THEN left(head, length(head) - 1) ELSE head END AS head, trim(regexp_replace(line, '^\\.', ''), ' ') AS body FROM e),
b AS (SELECT doc_id, head, list_transform(string_split(CASE WHEN instr(body, '.') > 1 THEN left(body, instr(body, '.') - 1) ELSE body END, ';'), lambda x: trim(x, ' ')) AS parts FROM h),
m AS (SELECT doc_id, unnest({_HEADS}) AS head, CASE WHEN {_WORDS.format('parts[1]')} <= 4 THEN list_filter(parts, lambda x: {_WORDS.format('x')} <= 4 AND length(x) > 1) ELSE [] END AS m FROM b),
p AS (SELECT doc_id, head, trim(replace(trim(replace(trim(replace(unnest(m), chr(9), ' '), ' '), '(BrE)', ''), ' '), '(AmE)', ''), ' ') AS m FROM m),
k AS (SELECT * FROM p WHERE length(m) > 1)
SELECT 'rw_en' AS direction, doc_id, head AS source, m AS target FROM k UNION ALL SELECT 'en_rw', doc_id, m, head FROM k
""",
    "loss_reduce": """
WITH e AS (SELECT event_type AS task, user_id % 4 AS worker, CAST(round(value, 6) AS DECIMAL(18, 6)) AS loss, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id) AS step FROM events),
l AS (SELECT task, min(n) AS steps, count(*) AS world FROM (SELECT task, worker, count(*) AS n FROM e GROUP BY ALL) GROUP BY task)
SELECT task, steps, world, round(CAST(sum(loss) AS DOUBLE) / count(*), 6) AS loss FROM e JOIN l USING (task) WHERE step <= steps GROUP BY ALL
""",
}
