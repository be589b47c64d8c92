"""Searches and folds: beam search to the end, surface keys, lexicon entries, blanks between glyphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import beam, legal
from tessella.sources.tables import line_scan, table

VOCABULARY, BOS, EOS = 8, 0, 2
BEAM, ENOUGH, LONGEST, STEPS = 4, 3, 7, 5
COPY, COPY_LP = (5, 1), -0.7


def _following(seq):
    """Stand-in for the model: logits from sentence, length and last token; some states copy two tokens instead."""
    last, n = F.element_at(seq, -1), F.size(seq)
    logits = F.transform(F.sequence(F.lit(0), F.lit(VOCABULARY - 1)), lambda k: ((F.col("vec_id") * 31 + n * 17 + last * 13 + k * k * 7 + k * 5) % 23) / 4.0)
    copy = F.array(F.struct(F.lit(COPY_LP).alias("lp"), F.array(*[F.lit(t).cast("bigint") for t in COPY]).alias("ids")))
    return F.when((F.col("vec_id") + last) % 11 == 3, copy).otherwise(beam.best_options(logits, BEAM))


def beam_search(spark: SparkSession, base: str) -> DataFrame:
    """Each sentence's best done hypothesis, else its best pending one, by length-normalised log probability."""
    found = table(spark, base, "embeddings").select("vec_id", beam.search(_following, BOS, EOS, BEAM, ENOUGH, LONGEST, STEPS).alias("b"))
    ranked = lambda c: F.array_sort(F.transform(c, lambda h: F.struct(F.round(h["neg"] / F.pow((F.size(h["seq"]) + 5) / 6.0, F.lit(0.2)), 9).alias("cost"), h["seq"].alias("seq"))))
    some = F.size("b.done") > 0
    best = F.get(F.when(some, ranked(F.col("b.done"))).otherwise(ranked(F.col("b.pending"))), F.lit(0))
    out = found.select("vec_id", F.when(some, "complete").otherwise("pending").alias("status"), F.size("b.done").cast("bigint").alias("n_done"), best.alias("x"))
    return out.select("vec_id", "status", "n_done", F.array_join(F.col("x.seq").cast("array<string>"), " ").alias("tokens"), F.col("x.cost").alias("cost"))


def surface_synthesis(spark: SparkSession, base: str) -> DataFrame:
    """The synthesis key and bare stem of each order's word: its items are the affixes."""
    affixes = table(spark, base, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.expr("named_struct('slot', CAST(l_partkey % 14 + 1 AS BIGINT), 'idx', CAST(l_suppkey % 6 AS BIGINT))")).alias("affixes"))
    words = table(spark, base, "orders").selectExpr("o_orderkey", "o_orderkey AS l_orderkey", "o_custkey % 3 AS wt", "CASE o_orderkey % 4 WHEN 0 THEN 'v:' || o_custkey || ':x' WHEN 1 THEN ':' || o_custkey ELSE 'w' || o_custkey END AS stem")
    joined = words.join(affixes, "l_orderkey", "left").withColumn("affixes", F.expr("filter(coalesce(affixes, array()), a -> o_orderkey % 5 <> 0)"))
    key = beam.synthesis_key(F.col("wt"), F.lit(13) - F.col("wt") * 3, F.col("affixes"))
    return joined.select("o_orderkey", F.coalesce(key, F.lit("")).alias("key"), beam.stem_text(F.col("stem"), F.size("affixes") > 0).alias("stem"))


_KIND = "CASE (doc_id + line_no) % 7 WHEN 0 THEN 'head' WHEN 3 THEN 'bullet' WHEN 5 THEN 'other' ELSE 'meaning' END"


def lexicon_entries(spark: SparkSession, base: str) -> DataFrame:
    """Headwords with their meanings: a bullet ends a meaning, a head ends an entry, other runs are passed over.

    A head that is followed by another head at once is replaced by it; runs before the first head do not
    count; the last entry is kept.
    """
    lines = line_scan(table(spark, base, "documents").select("doc_id", "text")).withColumn("line_no", F.col("line_no").cast("bigint")).withColumn("kind", F.expr(_KIND)).where("kind <> 'other'")
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).over(upto)
    numbered = lines.select("doc_id", "line_no", "kind", F.trim("line").alias("line"), count("head").alias("entry"), count("bullet").alias("part")).where("entry > 0")
    ordered = F.array_sort(F.collect_list(F.when(F.col("kind") == "meaning", F.struct("line_no", "line"))))
    parts = numbered.groupBy("doc_id", "entry", "part").agg(F.max(F.when(F.col("kind") == "head", F.col("line"))).alias("head"), F.count_if(F.col("kind") != "head").alias("n"), ordered.alias("lines"))
    meaning = F.when(F.size("lines") > 0, F.struct("part", F.array_join(F.transform("lines", lambda x: x["line"]), " ").alias("meaning")))
    entries = parts.groupBy("doc_id", "entry").agg(F.max("head").alias("head"), F.sum("n").alias("n"), F.array_sort(F.collect_list(meaning)).alias("m")).where("n > 0")
    return entries.select("doc_id", "entry", "head", F.size("m").cast("bigint").alias("n_meanings"), F.md5(F.array_join(F.transform("m", lambda x: x["meaning"]), "|").cast("binary")).alias("digest"))


SPACE_TOLERANCE, CHAR_TOLERANCE = 0.5, 0.3  # fixed values


def word_spaces(spark: SparkSession, base: str) -> DataFrame:
    """Which glyphs of a line have a blank before them: a gap over the smaller of two expected widths.

    One comes from the blank's own width (with that of the glyph before), the other from an average
    character width in which every glyph halves the weight of those before it. Items stand for glyphs.
    """
    at = "named_struct('no', l_linenumber, 'x', CAST(l_linenumber * 12 + l_partkey % 9 AS DOUBLE), 'w', CAST(l_suppkey % 7 + 4 AS DOUBLE), 'b', CAST(l_quantity % 8 + 1 AS DOUBLE))"
    lines = table(spark, base, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.expr(at))).alias("g"))
    zero = F.expr("named_struct('end', CAST(NULL AS DOUBLE), 'avg', CAST(NULL AS DOUBLE), 'b', CAST(NULL AS DOUBLE), 'out', CAST(array() AS array<struct<no:int,blank:boolean>>))")

    def glyph(a, g):
        avg = F.coalesce((a["avg"] + g["w"]) / 2, g["w"])
        blank = F.coalesce((a["b"] + g["b"]) / 2, g["b"]) * SPACE_TOLERANCE
        found = F.coalesce(g["x"] > a["end"] + F.least(blank, avg * CHAR_TOLERANCE), F.lit(False))
        return F.struct((g["x"] + g["w"]).alias("end"), avg.alias("avg"), g["b"].alias("b"), F.concat(a["out"], F.array(F.struct(g["no"].cast("int").alias("no"), found.alias("blank")))).alias("out"))

    found = lines.select("l_orderkey", F.explode(F.aggregate("g", zero, glyph)["out"]).alias("o"))
    return found.select("l_orderkey", F.col("o.no").cast("bigint").alias("no"), F.col("o.blank").cast("int").alias("blank"))


_LEGAL = """CASE WHEN line_no = 0 AND doc_id % 3 = 0 THEN 'Official Gazette no 4 of 12/03/2004' ELSE CASE (doc_id + line_no) % 13
  WHEN 0 THEN CASE WHEN line_no % 3 = 0 THEN 'Ingingo ya mbere: ' ELSE 'Ingingo ya ' || (line_no % 3 + 1) || '. ' END || line
  WHEN 1 THEN 'Article ' || (line_no % 4 + 1) WHEN 2 THEN CASE WHEN line_no % 2 = 0 THEN 'Article one: ' ELSE 'Article 3' END WHEN 3 THEN 'Article premier.'
  WHEN 4 THEN ': ' || line WHEN 5 THEN 'UMUTWE WA II' WHEN 6 THEN 'Section two' WHEN 7 THEN 'Kigali, on 12/03/2004' WHEN 8 THEN '(Sé)' WHEN 9 THEN '14'
  WHEN 10 THEN 'HEREBY ORDERS' ELSE line END END"""
_BOLD = "(doc_id + line_no * 3) % 5 <> 0"


def legal_lines(spark: SparkSession, base: str) -> DataFrame:
    """Class, article number and language of every line of each document, read as one column of a gazette."""
    lines = line_scan(table(spark, base, "documents").select("doc_id", "text")).withColumn("line_no", F.col("line_no").cast("bigint"))
    last = F.col("line_no") == F.max("line_no").over(Window.partitionBy("doc_id"))
    facts = legal.line_facts(F.col("line_no"), F.col("line"), F.expr(_BOLD), F.col("last"))
    each = lines.select("doc_id", "line_no", F.expr(_LEGAL).alias("line"), last.alias("last")).select("doc_id", facts.alias("x"))
    columns = each.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("lines"))
    return columns.select("doc_id", F.inline(legal.linked(F.col("lines"))))


QUERIES = {f.__name__: f for f in (beam_search, surface_synthesis, lexicon_entries, word_spaces, legal_lines)}


def _beam_sql() -> str:
    """The search, a step for each common table: g still going, k scored, e grown, p pending, d done."""
    sql = "WITH p0 AS (SELECT vec_id AS s, [CAST(0 AS BIGINT)] AS seq, CAST(0 AS DOUBLE) AS neg FROM embeddings), d0 AS (SELECT * FROM p0 WHERE false)"
    full = f"(seq[-1] = {EOS} OR len(seq) >= {LONGEST})"
    for i in range(1, STEPS + 1):
        sql += f""",
c{i} AS (SELECT p.*, coalesce(n, 0) < {ENOUGH} AS going FROM p{i - 1} p LEFT JOIN (SELECT s, count(*) AS n FROM d{i - 1} GROUP BY s) USING (s)),
g{i} AS (SELECT s, seq, neg, (s + seq[-1]) % 11 = 3 AS copies FROM c{i} WHERE going),
l{i} AS (SELECT *, ((s * 31 + len(seq) * 17 + seq[-1] * 13 + k * k * 7 + k * 5) % 23) / 4.0 AS x FROM g{i}, (SELECT unnest(range({VOCABULARY})) AS k) WHERE NOT copies),
t{i} AS (SELECT * FROM l{i} QUALIFY row_number() OVER (PARTITION BY s, seq ORDER BY x DESC, k) <= {BEAM}),
m{i} AS (SELECT *, max(x) OVER (PARTITION BY s, seq) AS top FROM t{i}),
e{i} AS (SELECT s, list_append(seq, k) AS seq, round(neg - (x - top - ln(sum(exp(x - top)) OVER (PARTITION BY s, seq))), 9) AS neg FROM m{i}
  UNION ALL SELECT s, list_concat(seq, [CAST({COPY[0]} AS BIGINT), CAST({COPY[1]} AS BIGINT)]), round(neg + {-COPY_LP}, 9) FROM g{i} WHERE copies),
d{i} AS (SELECT * FROM d{i - 1} UNION ALL SELECT * FROM e{i} WHERE {full}),
p{i} AS (SELECT s, seq, neg FROM c{i} WHERE NOT going
  UNION ALL (SELECT * FROM e{i} WHERE NOT {full} QUALIFY row_number() OVER (PARTITION BY s ORDER BY neg, seq) <= {BEAM}))"""
    return (
        sql
        + f""",
a AS (SELECT s, seq, neg, 0 AS kind FROM d{STEPS} UNION ALL SELECT s, seq, neg, 1 FROM p{STEPS}),
r AS (SELECT s, seq, kind, round(neg / pow((len(seq) + 5) / 6.0, 0.2), 9) AS cost, count(*) FILTER (kind = 0) OVER (PARTITION BY s) AS n_done FROM a)
SELECT s AS vec_id, CASE WHEN kind = 0 THEN 'complete' ELSE 'pending' END AS status, n_done, array_to_string(seq, ' ') AS tokens, cost
FROM r QUALIFY row_number() OVER (PARTITION BY s ORDER BY kind, cost, seq) = 1"""
    )


def _legal_sql() -> str:
    """Line by line down every document, by recursion."""
    has = lambda c, *patterns: "(" + " OR ".join(f"regexp_matches({c}, '{p}')" for p in patterns) + ")"
    found = "coalesce(" + ", ".join(f"nullif(regexp_extract(low, '{p}', 2), '')" for _, p in legal.ARTICLES) + ")"
    return f"""
WITH RECURSIVE parts AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents),
every AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line, len(l) AS n FROM parts),
ends AS (SELECT doc_id, coalesce(max(line_no) FILTER (line <> ''), -1) AS full_no FROM every GROUP BY doc_id),
raw_lines AS (SELECT doc_id, line_no, line FROM every JOIN ends USING (doc_id) WHERE line_no <= greatest(full_no, n - 4 - 1)),
t AS (SELECT doc_id, line_no, trim({_LEGAL}) AS x, {_BOLD} AS bold, line_no = max(line_no) OVER (PARTITION BY doc_id) AS is_last FROM raw_lines),
w AS (SELECT *, lower(x) AS low, len(regexp_split_to_array(x, '\\s+')) AS tokens FROM t),
n AS (SELECT *, bold AND {has("low", *[p for _, p in legal.ARTICLES])} AS is_raw, {found} AS found FROM w),
f AS (SELECT doc_id, line_no, bold, is_raw, starts_with(x, ':') AS colon,
  CASE WHEN is_raw THEN CASE WHEN found IN ('mbere', 'one', 'premier') THEN 1 ELSE coalesce(TRY_CAST(found AS INTEGER), 0) END END AS num,
  CASE WHEN is_raw THEN CASE found WHEN 'mbere' THEN 'rw' WHEN 'one' THEN 'en' WHEN 'premier' THEN 'fr' ELSE CASE WHEN {has("low", legal.ARTICLE_KINYARWANDA)} THEN 'rw' ELSE 'fe' END END END AS lang,
  CASE WHEN line_no = 0 AND {has("low", legal.GAZETTE)} AND {has("low", legal.NUMBER_MARK)} AND ({has("low", legal.DATE)} OR ({has("low", legal.MONTH_ENGLISH)} AND {has("low", legal.YEAR)})) THEN 'gazette'
    WHEN bold AND {has("low", legal.SECTION_KINYARWANDA, legal.SECTION_ENGLISH, legal.SECTION_FRENCH)} THEN 'section'
    WHEN bold AND {has("x", legal.CHAPTER_KINYARWANDA, legal.CHAPTER_ENGLISH, legal.CHAPTER_FRENCH)} THEN 'chapter'
    WHEN bold AND tokens < {legal.ORDER_TOKENS} AND {has("x", legal.ORDER_KINYARWANDA, legal.ORDER_ENGLISH, legal.ORDER_FRENCH)} THEN 'order'
    WHEN tokens < {legal.DONE_TOKENS} AND ({has("low", legal.DONE_DATE)} OR ({has("low", legal.DONE_ON)} AND {has("low", legal.MONTH_ANY)} AND {has("low", legal.YEAR)})) THEN 'done'
    WHEN {has("low", legal.SIGNATURE)} THEN 'signature' WHEN is_last AND {has("x", legal.PAGE)} THEN 'page' END AS other FROM n),
r AS (
  SELECT doc_id, line_no, is_raw AS title, false AS para, coalesce(num, 0) AS num, lang, CASE WHEN is_raw THEN 'title' ELSE coalesce(other, 'unknown') END AS class FROM f WHERE line_no = 0
  UNION ALL
  SELECT doc_id, line_no, title0 OR (goes_on AND ptitle AND colon), goes_on AND NOT (ptitle AND (colon OR bold)),
    CASE WHEN goes_on THEN pnum ELSE coalesce(num, 0) END, CASE WHEN goes_on OR NOT is_raw OR takes THEN plang ELSE lang END,
    CASE WHEN title0 OR (goes_on AND ptitle AND colon) THEN 'title' WHEN goes_on AND NOT (ptitle AND (colon OR bold)) THEN 'paragraph' ELSE coalesce(other, 'unknown') END
  FROM (SELECT *, other IS NULL AND NOT title0 AND (ptitle OR ppara) AS goes_on FROM (
    SELECT f.*, r.title AS ptitle, r.para AS ppara, r.num AS pnum, r.lang AS plang, f.is_raw AND NOT (r.title AND coalesce(f.num, 0) <> r.num + 1) AS title0,
      coalesce(f.lang = 'fe' AND f.num <> 1 AND r.lang IN ('fr', 'en'), false) AS takes
    FROM r JOIN f ON f.doc_id = r.doc_id AND f.line_no = r.line_no + 1)))
SELECT doc_id, line_no, class, num AS number, lang FROM r"""


ORACLE = {
    "legal_lines": _legal_sql(),
    "beam_search": _beam_sql(),
    "surface_synthesis": """
WITH w AS (SELECT o_orderkey, o_custkey % 3 AS wt, 13 - o_custkey % 3 * 3 AS stem_slot,
  CASE o_orderkey % 4 WHEN 0 THEN 'v:' || o_custkey || ':x' WHEN 1 THEN ':' || o_custkey ELSE 'w' || o_custkey END AS stem FROM orders),
a AS (SELECT l_orderkey AS o_orderkey, l_partkey % 14 + 1 AS slot, l_suppkey % 6 AS idx FROM lineitem JOIN w ON l_orderkey = o_orderkey WHERE l_orderkey % 5 <> 0),
h AS (SELECT o_orderkey, list(slot) AS slots FROM a GROUP BY o_orderkey),
every AS (SELECT * FROM a
  UNION ALL SELECT o_orderkey, stem_slot, 0 FROM w JOIN h USING (o_orderkey) WHERE NOT list_contains(slots, stem_slot)
  UNION ALL SELECT o_orderkey, 11, 0 FROM w JOIN h USING (o_orderkey) WHERE wt = 0 AND list_contains(slots, 12) AND NOT list_contains(slots, 11)),
k AS (SELECT o_orderkey, string_agg(slot, '-' ORDER BY slot, idx) AS slots, string_agg(idx, ',' ORDER BY slot, idx) AS ids FROM every GROUP BY o_orderkey)
SELECT o_orderkey, CASE WHEN k.slots IS NULL THEN '' ELSE wt || ':' || k.slots || '|' || ids END AS key,
  CASE WHEN k.slots IS NOT NULL THEN CASE WHEN instr(stem, ':') > 1 THEN split_part(stem, ':', 2) ELSE stem END
    WHEN instr(stem, ':') > 0 AND length(stem) > 2 AND instr(stem, ':') < length(stem) THEN substr(stem, instr(stem, ':') + 1) ELSE stem END AS stem
FROM w LEFT JOIN k USING (o_orderkey)
""",
    "lexicon_entries": f"""
WITH parts AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents),
every AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line, len(l) AS n FROM parts),
last AS (SELECT doc_id, coalesce(max(line_no) FILTER (line <> ''), -1) AS full_no FROM every GROUP BY doc_id),
raw AS (SELECT doc_id, line_no, trim(line) AS line, {_KIND} AS kind FROM every JOIN last USING (doc_id) WHERE line_no <= greatest(full_no, n - 4 - 1)),
i AS (SELECT *, sum(CASE WHEN kind = 'head' THEN 1 ELSE 0 END) OVER w AS entry, sum(CASE WHEN kind = 'bullet' THEN 1 ELSE 0 END) OVER w AS part
  FROM raw WHERE kind <> 'other' WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
m AS (SELECT doc_id, entry, part, max(line) FILTER (kind = 'head') AS head, count(*) FILTER (kind <> 'head') AS n,
  string_agg(line, ' ' ORDER BY line_no) FILTER (kind = 'meaning') AS meaning FROM i WHERE entry > 0 GROUP BY ALL)
SELECT doc_id, CAST(entry AS BIGINT) AS entry, max(head) AS head, count(meaning) AS n_meanings, md5(coalesce(string_agg(meaning, '|' ORDER BY part), '')) AS digest
FROM m GROUP BY doc_id, entry HAVING sum(n) > 0
""",
    "word_spaces": """
WITH g AS (SELECT l_orderkey, l_linenumber AS no, CAST(l_linenumber * 12 + l_partkey % 9 AS DOUBLE) AS x, CAST(l_suppkey % 7 + 4 AS DOUBLE) AS w, CAST(l_quantity % 8 + 1 AS DOUBLE) AS b,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linenumber * 12 + l_partkey % 9, l_suppkey % 7, l_quantity % 8) AS i FROM lineitem),
a AS (SELECT *, sum(CASE WHEN i = 1 THEN w ELSE w * pow(2, i - 2) END) OVER o / pow(2, i - 1) AS avg, lag(x + w) OVER o AS before, coalesce((b + lag(b) OVER o) / 2, b) AS blank
  FROM g WINDOW o AS (PARTITION BY l_orderkey ORDER BY i))
SELECT l_orderkey, CAST(no AS BIGINT) AS no, CASE WHEN before IS NOT NULL AND x > before + least(blank * 0.5, avg * 0.3) THEN 1 ELSE 0 END AS blank FROM a
""",
}
