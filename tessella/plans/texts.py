"""Cleaning, post-editing and lexicon queries over ``documents``, ``orders`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import generate, numbers, text
from tessella.functions.detokenise import detokenised
from tessella.operators import vocabulary
from tessella.operators.ranking import with_running
from tessella.operators.translate import lexicon_model, translate
from tessella.runtime import cut
from tessella.sources.tables import line_scan, table


def _docs(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents")


def line_scan_query(spark: SparkSession, base: str) -> DataFrame:
    lines = line_scan(_docs(spark, base).select("doc_id", "text"))
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


def min_length_filter(spark: SparkSession, base: str) -> DataFrame:
    """Lines with more than two ids once wrapped, that is, with any token at all."""
    lines = line_scan(_docs(spark, base).select("doc_id", "text")).withColumn("n_ids", F.size(text.tokens(F.col("line"))) + 2)
    return lines.where("n_ids > 2").groupBy("doc_id").agg(F.count("*").cast("bigint").alias("n_lines"), F.sum("n_ids").cast("bigint").alias("n_ids"))


_MARKED = "CASE WHEN doc_id % 3 = 0 THEN '<s> ' || text || chr(9) || '</s> <unk>  ' ELSE text END"


def squeeze_scrub(spark: SparkSession, base: str) -> DataFrame:
    marked = _docs(spark, base).select("doc_id", F.expr(_MARKED.replace("chr(9)", "'\\t'")).alias("raw"))
    return marked.select("doc_id", text.squeeze(F.col("raw")).alias("squeezed"), text.scrub(F.col("raw")).alias("scrubbed"))


_POST = "CASE doc_id % 4 WHEN 0 THEN 'it <unk> s; a <unk> s <unk> s. ' WHEN 1 THEN 'don <unk> t, <unk> t ' WHEN 2 THEN '<unk> s' ELSE '' END || text"


def english_postedit(spark: SparkSession, base: str) -> DataFrame:
    raw = _docs(spark, base).select("doc_id", F.expr(_POST).alias("raw"))
    return raw.select("doc_id", text.english_postedit(F.col("raw")).alias("edited"))


def latin_only_filter(spark: SparkSession, base: str) -> DataFrame:
    words = _docs(spark, base).select("doc_id", F.explode(text.tokens(F.concat(F.col("text"), F.when(F.col("doc_id") % 5 == 0, " Ωmega слово x漢 12-3").otherwise("")))).alias("word"))
    return words.where(text.is_latin(F.col("word"))).groupBy("doc_id").agg(F.count("*").cast("bigint").alias("n_words"))


_HEADED = "CASE doc_id % 6 WHEN 0 THEN 'Official Gazette no 12 of 2020' WHEN 1 THEN 'Official Gazette no ' || text ELSE text END"


def running_header_filter(spark: SparkSession, base: str) -> DataFrame:
    lines = _docs(spark, base).select("doc_id", F.expr(_HEADED).alias("line"))
    return lines.where(~text.is_running_header(F.col("line"))).select("doc_id", F.length("line").cast("bigint").alias("n_chars"))


_DOTTED = "CASE WHEN doc_id % 2 = 0 THEN '. . . … … ' || text || ' . .' ELSE text END"


def section_quality(spark: SparkSession, base: str) -> DataFrame:
    """Sections of 8 tokens or more, at least 0.4 of them known; known: seen in ten documents or more."""
    docs = vocabulary.dealt_whole(_docs(spark, base).select("doc_id", "text"), "doc_id")
    words = docs.select("doc_id", text.collapse_dots(text.tokens(F.expr(_DOTTED))).alias("words"))
    each = words.select("doc_id", F.explode("words").alias("word"))
    counts = each.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    known = cut(counts.groupBy("word").agg(F.count_if(F.col("n") > 0).alias("score")).where("score >= 10"), "section-known")
    met = vocabulary.with_listed(counts, known, "word", "score")
    # a document's sum of all listed words in one row without a word, and its other words
    part = met.groupBy("doc_id", F.when(F.col("score").isNull(), F.col("word")).alias("word")).agg(F.sum("n").alias("n"))
    part = cut(part, "section-words")
    others = part.where("word IS NOT NULL").join(known.select("word", F.lit(1).alias("known")), "word", "left")
    rows = part.where("word IS NULL").withColumn("known", F.lit(1)).unionByName(others)
    n_known = F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0))
    good = rows.groupBy("doc_id").agg(F.sum("n").cast("bigint").alias("n_tokens"), n_known.cast("bigint").alias("n_known"))
    return good.where("n_tokens >= 8 AND n_known / n_tokens >= 0.4")


def subword_join(spark: SparkSession, base: str) -> DataFrame:
    pieces = F.transform(text.tokens(F.col("text")), lambda x, i: F.when(i % 3 == 0, F.concat(x, F.lit("@@"))).when(i % 3 == 1, F.concat(F.lit("▁"), x)).otherwise(x))
    return _docs(spark, base).select("doc_id", text.join_subwords(pieces).alias("joined"))


def first_word_casing(spark: SparkSession, base: str) -> DataFrame:
    """The first word's case by how often its lower-cased form is capitalised elsewhere."""
    docs = _docs(spark, base)
    words = docs.select(F.explode(text.tokens(F.col("text"))).alias("w"))
    lexicon = words.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"), F.sum(F.when(F.rlike("w", F.lit("^[A-Z]")), 1).otherwise(0)).alias("n_up"))
    first = docs.select("doc_id", text.first_word(F.col("text")).alias("first"))
    ratio = F.col("n_up") / F.col("n")
    cased = F.when(ratio > 0.8, text.capitalise(F.col("first"))).when(ratio < 0.2, F.lower("first")).otherwise(F.col("first"))
    return first.join(lexicon, F.lower("first") == F.col("word"), "left").select("doc_id", "first", cased.alias("cased"))


def headword_split(spark: SparkSession, base: str) -> DataFrame:
    entry = F.expr("CASE doc_id % 3 WHEN 0 THEN 'cyiza' || (doc_id % 7) WHEN 1 THEN element_at(split(text, ' '), 1) || ', ' || element_at(split(text, ' '), 2) || ',x' ELSE 'ab2c3' END")
    return _docs(spark, base).where("size(split(text, ' ')) > 1").select("doc_id", F.array_join(text.headwords(entry), "|").alias("heads"))


_MEANING = "CASE doc_id % 4 WHEN 0 THEN '. good; fine. more' WHEN 1 THEN 'one two three four five; short' WHEN 2 THEN 'a; to go; be; x y z w v' ELSE text END"


def meaning_clean(spark: SparkSession, base: str) -> DataFrame:
    return _docs(spark, base).select("doc_id", F.array_join(text.meanings(F.expr(_MEANING)), "|").alias("meanings"))


def dictionary_product(spark: SparkSession, base: str) -> DataFrame:
    """Every headword with every meaning of its entry: the first two words with each of the others."""
    words = text.tokens(F.col("text"))
    entry = _docs(spark, base).select("doc_id", F.slice(words, 1, 2).alias("heads"), F.slice(words, F.lit(3), F.greatest(F.size(words), F.lit(1))).alias("means"))
    return entry.select("doc_id", F.explode("heads").alias("head"), "means").select("doc_id", "head", F.explode("means").alias("meaning"))


PREFIXES = ("ba", "i", "a", "bi", "tu", "ka", "zi", "ha", "gu")


def number_speller(spark: SparkSession, base: str) -> DataFrame:
    n = table(spark, base, "orders").select(F.inline(F.array(F.struct("o_orderkey", (F.col("o_orderkey") * 7919 % 1000000007).alias("n")))))
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), (F.col("o_orderkey") % len(PREFIXES) + 1).cast("int"))
    return n.select("o_orderkey", "n", numbers.spell(numbers.units_for(prefix, PREFIXES), F.col("n")).alias("words"))


def uri_idempotent(spark: SparkSession, base: str) -> DataFrame:
    pages = table(spark, base, "pages").select("page_id", "url")
    done = pages.where("page_id % 3 = 0").select("url")
    return pages.join(done, "url", "left_anti").select("page_id", "url")


def word_split_candidates(spark: SparkSession, base: str) -> DataFrame:
    """For each long word the split into two known words with the lowest sum of ranks."""
    words = _docs(spark, base).select(F.explode(text.tokens(F.col("text"))).alias("w")).where(F.rlike("w", F.lit("^[a-z]+$")))
    ranked = words.groupBy("w").agg(F.count("*").alias("n")).where("n >= 5")
    ranked = with_running(ranked.select("w", (-F.col("n")).alias("down")), ["down", "w"]).select("w", "rank")
    cut = ranked.where(F.length("w") >= 4).select("w", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("k"))
    cut = cut.select("w", "k", F.expr("substring(w, 1, k)").alias("a"), F.expr("substring(w, k + 1)").alias("b"))
    left = ranked.select(F.col("w").alias("a"), F.col("rank").alias("ra"))
    right = ranked.select(F.col("w").alias("b"), F.col("rank").alias("rb"))
    both = cut.join(left, "a").join(right, "b")
    best = both.groupBy("w").agg(F.min(F.struct((F.col("ra") + F.col("rb")).alias("score"), "k", "a", "b")).alias("m"))
    return best.select("w", F.col("m.score").alias("score"), F.concat_ws(" ", "m.a", "m.b").alias("split"))


def detokenise(spark: SparkSession, base: str) -> DataFrame:
    """All tokens of each document, joined back into a sentence."""
    return _docs(spark, base).select("doc_id", detokenised(text.tokens(F.col("text"))).alias("sentence"))


#: Expressions that Spark and DuckDB read alike.
_INJECTED = """concat(CASE doc_id % 5 WHEN 0 THEN '« ' WHEN 1 THEN 'ya ya abana ' WHEN 2 THEN 'na ' ELSE '' END, text,
  CASE doc_id % 7 WHEN 0 THEN ' ya abana 3 , 5 % .' WHEN 1 THEN ' x - y – z »' WHEN 2 THEN ' a 3, 5 b 2 . x <unk> c'
  WHEN 3 THEN concat(' a.b - c', concat_ws(chr(39), ' n', ' abana d', ' na e')) WHEN 4 THEN concat(' b ', chr(39), 'tis 7 .5 7 %') WHEN 5 THEN ' umwe" ba ba ba abana "' ELSE '' END)"""


def detokenise_marked(spark: SparkSession, base: str) -> DataFrame:
    """The same with contractions, quotation marks, decimals, dashes and unknown tokens put in by the number of the document."""
    docs = _docs(spark, base).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))  # null text is empty, as it is to DuckDB's concat
    return docs.select("doc_id", detokenised(text.tokens(F.expr(_INJECTED))).alias("sentence"))


def numeric_pairs(spark: SparkSession, base: str) -> DataFrame:
    """A generated number with its prefix and format for every order's key."""
    return generate.numeric_pairs(table(spark, base, "orders").select(F.col("o_orderkey").alias("row"))).select("row", "n", "prefix", "format", F.length("rw").cast("bigint").alias("n_chars"))


def translate_fallback(spark: SparkSession, base: str) -> DataFrame:
    """Benchmark items through a lexicon model; what it cannot translate stays itself and is marked."""
    made = translate(table(spark, base, "benchmark"), lexicon_model({"the": "iki", "and": "na"}))
    return made.select("item_id", "translation", "ok")


QUERIES = {
    "detokenise": detokenise,
    "detokenise_marked": detokenise_marked,
    "numeric_pairs": numeric_pairs,
    "translate_fallback": translate_fallback,
    "line_scan": line_scan_query,
    "min_length_filter": min_length_filter,
    "squeeze_scrub": squeeze_scrub,
    "english_postedit": english_postedit,
    "latin_only_filter": latin_only_filter,
    "running_header_filter": running_header_filter,
    "section_quality": section_quality,
    "subword_join": subword_join,
    "first_word_casing": first_word_casing,
    "headword_split": headword_split,
    "meaning_clean": meaning_clean,
    "dictionary_product": dictionary_product,
    "number_speller": number_speller,
    "uri_idempotent": uri_idempotent,
    "word_split_candidates": word_split_candidates,
}


def _words(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, '\\s+'), lambda x: x <> '')"


_SQUEEZED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_LINES = """
WITH parts AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line, len(l) AS n FROM parts),
last AS (SELECT doc_id, coalesce(max(line_no) FILTER (line <> ''), -1) AS full_no FROM lines GROUP BY doc_id),
kept AS (SELECT doc_id, line_no, line FROM lines JOIN last USING (doc_id) WHERE line_no <= greatest(full_no, n - 4 - 1))
"""


def _spell_sql() -> str:
    """The speller as a macro-free CASE: each group of three digits by list lookups."""
    q = lambda words: "[" + ", ".join("NULL" if w is None else "'" + w.replace("'", "''") + "'" for w in words) + "]"

    def group(units: str, n: str) -> str:
        h, t, u = f"({n} // 100)", f"({n} % 100 // 10)", f"({n} % 10)"
        unit = f"{units}[{u}]"
        return (
            f"CASE WHEN {n} = 10 THEN 'icumi' ELSE coalesce({q(numbers.HUNDREDS)}[{h}], '') || "
            f"CASE WHEN {t} > 0 THEN CASE WHEN {h} > 0 THEN ' na ' ELSE '' END || {q(numbers.TENS)}[{t}] ELSE '' END || "
            f"CASE WHEN {u} > 0 THEN CASE WHEN {h} > 0 OR {t} > 0 THEN CASE WHEN regexp_matches({unit}, '^[aeiou]') THEN ' n''' ELSE ' na ' END ELSE '' END || {unit} ELSE '' END END"
        )

    cases = " ".join(f"WHEN {k} THEN {q(numbers.unit_words(p))}" for k, p in enumerate(PREFIXES))
    bi, zi = q(numbers.unit_words("bi")), q(numbers.unit_words("zi"))
    return f"""
WITH base AS (SELECT o_orderkey, o_orderkey * 7919 % 1000000007 AS n FROM orders),
g AS (SELECT *, n % 1000 AS g0, n // 1000 % 1000 AS g1, n // 1000000 % 1000 AS g2, n // 1000000000 % 1000 AS g3,
             CASE o_orderkey % {len(PREFIXES)} {cases} END AS own FROM base),
w AS (SELECT *, {group("own", "g0")} AS w0, {group(bi, "g1")} AS w1, {group(zi, "g2")} AS w2, {group(zi, "g3")} AS w3 FROM g)
SELECT o_orderkey, n,
  CASE WHEN g3 > 0 THEN 'miliyari ' || w3 ELSE '' END ||
  CASE WHEN g2 > 0 THEN CASE WHEN g3 > 0 THEN ' na ' ELSE '' END || 'miliyoni ' || w2 ELSE '' END ||
  CASE WHEN g1 > 0 THEN CASE WHEN g3 > 0 OR g2 > 0 THEN ' n''' ELSE '' END || 'ibihumbi ' || w1 ELSE '' END ||
  CASE WHEN g0 > 0 THEN CASE WHEN n >= 1000 THEN CASE WHEN regexp_matches(w0, '^[aeiou]') THEN ' n''' ELSE ' na ' END ELSE '' END || w0 ELSE '' END AS words
FROM w
"""


def _nested(column: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        column = f"replace({column}, '{a}', '{b}')"
    return column


_AFTER = [(f" <unk> {c}{e}", f"''{c}{e}") for c in "st" for e in text.AFTER_SUFFIX]

#: Sentences of the tokens of ``table``, by windows over one row for each token.
_DETOKENISE = r"""
WITH t AS (SELECT {id} AS doc_id, {tokens} AS t FROM {table}),
e AS (SELECT doc_id, len(t) AS n, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM t),
w AS (SELECT *, lag(x) OVER d AS b, lag(x, 2) OVER d AS bb, lead(x) OVER d AS a FROM e WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT *, CASE
  WHEN i < n AND (right(x, 1) = '''' OR (right(x, 1) = 'a' AND length(x) BETWEEN 2 AND 3 AND left(a, 1) IN ('i', 'u', 'o', 'a', 'e'))) THEN 'c'
  WHEN i > 1 AND i < n AND x IN ('-', '–', '_') AND regexp_full_match(b, '[\pL\pN]+') AND regexp_full_match(a, '[\pL\pN]+') THEN 'd' ELSE '.' END AS f FROM w),
g AS (SELECT *, coalesce(max(i) FILTER (f = '.') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS plain FROM f),
m AS (SELECT *, CASE WHEN (i - plain) % 2 = 0 THEN 'x' ELSE f END AS m FROM g),
o AS (SELECT *, lag(m) OVER (PARTITION BY doc_id ORDER BY i) AS bm FROM m),
p AS (SELECT doc_id, i, m, x, CASE
  WHEN m = 'x' THEN ''
  WHEN m = 'd' THEN x || a
  WHEN m = '.' AND i > 2 AND ((x = '%' AND regexp_matches(b, '[0-9]$')) OR (regexp_matches(x, '^[0-9]') AND right(b, 1) IN (',', '.')
    AND CASE WHEN length(b) > 1 THEN regexp_matches(b, '[0-9].$') ELSE bm = '.' AND regexp_matches(bb, '[0-9]$') END)) THEN x
  ELSE CASE WHEN i = 1 OR left(x, 1) IN (',', '.', ';', '?', '!', ':') OR (i = 2 AND contains({quotes}, right(b, 1))) OR (i = n AND contains({quotes}, left(x, 1))) THEN '' ELSE ' ' END
    || CASE WHEN m = 'c' THEN left(x, -1) || '''' || a ELSE x END END AS s FROM o),
s AS (SELECT doc_id, string_agg(s, '' ORDER BY i) AS s, count(*) FILTER (m IN ('.', 'c')) + 2 * count(*) FILTER (m = 'd') AS k FROM p GROUP BY doc_id)
SELECT t.doc_id AS {id}, coalesce(trim(regexp_replace(replace(CASE WHEN k > 1 THEN upper(left(s, 1)) || substr(s, 2) ELSE s END, '<unk>', ' '), '\s+', ' ', 'g')), '') AS sentence FROM t LEFT JOIN s USING (doc_id)
"""


def detokenise_sql(tokens: str, table: str = "documents", key: str = "doc_id") -> str:
    return _DETOKENISE.format(tokens=tokens, table=table, id=key, quotes="""'’‘`"''“”«»'""")


ORACLE = {
    "detokenise": detokenise_sql(_words("text")),
    "detokenise_marked": detokenise_sql(_words(_INJECTED)),
    "line_scan": _LINES + "SELECT doc_id, line_no, line FROM kept",
    "min_length_filter": _LINES
    + f"SELECT doc_id, count(*) AS n_lines, CAST(sum(len({_words('line')}) + 2) AS BIGINT) AS n_ids FROM kept WHERE len({_words('line')}) > 0 GROUP BY doc_id",
    "squeeze_scrub": f"SELECT doc_id, {_SQUEEZED.format('raw')} AS squeezed, {_SQUEEZED.format(_nested('raw', [(m, ' ') for m in ('<unk>', '<s>', '</s>')]))} AS scrubbed FROM (SELECT doc_id, {_MARKED} AS raw FROM documents)",
    "english_postedit": f"SELECT doc_id, {_SQUEEZED.format(_nested('raw', [*_AFTER, ('<unk>', ' ')]))} AS edited FROM (SELECT doc_id, {_POST} AS raw FROM documents)",
    "latin_only_filter": f"""
SELECT doc_id, count(*) AS n_words FROM (
  SELECT doc_id, unnest({_words("text || CASE WHEN doc_id % 5 = 0 THEN ' Ωmega слово x漢 12-3' ELSE '' END")}) AS word FROM documents)
WHERE NOT regexp_matches(regexp_replace(word, '\\p{{Latin}}', '', 'g'), '\\p{{L}}') GROUP BY doc_id
""",
    "running_header_filter": f"""
SELECT doc_id, length(line) AS n_chars FROM (SELECT doc_id, {_HEADED} AS line FROM documents)
WHERE NOT (starts_with(line, 'Official Gazette n') AND len({_words("line")}) < 10)
""",
    "section_quality": f"""
WITH w AS (SELECT doc_id, {_words(_DOTTED)} AS a FROM documents),
each AS (SELECT doc_id, unnest(list_filter(a, lambda x, i: NOT (x IN ('.', '…') AND i > 1 AND x = a[i - 1]))) AS word FROM w),
known AS (SELECT word, count(DISTINCT doc_id) AS score FROM each GROUP BY word HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_tokens, count(score) AS n_known FROM each LEFT JOIN known USING (word) GROUP BY doc_id
HAVING count(*) >= 8 AND count(score) / count(*) >= 0.4
""",
    "subword_join": f"""
SELECT doc_id, replace(array_to_string(list_transform(list_transform({_words("text")},
  lambda x, i: CASE i % 3 WHEN 1 THEN x || '@@' WHEN 2 THEN '▁' || x ELSE x END), lambda y: regexp_replace(y, '^▁', '')), ' '), '@@ ', '') AS joined FROM documents
""",
    "first_word_casing": f"""
WITH words AS (SELECT unnest({_words("text")}) AS w FROM documents),
lexicon AS (SELECT lower(w) AS word, count(*) AS n, count(*) FILTER (regexp_matches(w, '^[A-Z]')) AS n_up FROM words GROUP BY 1),
f AS (SELECT doc_id, left(text, coalesce(least(nullif(greatest(instr(text, ' ') - 1, 0), 0), nullif(greatest(instr(text, '''') - 1, 0), 0)), length(text))) AS first FROM documents)
SELECT doc_id, first, CASE WHEN n_up / n > 0.8 THEN upper(left(first, 1)) || substr(first, 2) WHEN n_up / n < 0.2 THEN lower(first) ELSE first END AS cased
FROM f LEFT JOIN lexicon ON lower(first) = word
""",
    "headword_split": """
WITH e AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'cyiza' || (doc_id % 7) WHEN 1 THEN string_split(text, ' ')[1] || ', ' || string_split(text, ' ')[2] || ',x' ELSE 'ab2c3' END AS entry
  FROM documents WHERE len(string_split(text, ' ')) > 1)
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(CASE WHEN regexp_full_match(entry, '[a-zA-Z]{2,}[1-5]') THEN left(entry, -1) ELSE entry END, ','),
  lambda x: trim(x)), lambda y: length(y) > 1), '|') AS heads FROM e
""",
    "meaning_clean": f"""
WITH m AS (SELECT doc_id, trim(regexp_replace(trim({_MEANING}), '^\\.', '')) AS body FROM documents),
p AS (SELECT doc_id, list_transform(string_split(CASE WHEN instr(body, '.') > 1 THEN string_split(body, '.')[1] ELSE body END, ';'), lambda x: trim(x)) AS parts FROM m)
SELECT doc_id, array_to_string(CASE WHEN len({_words("parts[1]")}) <= 4 THEN
  list_filter(parts, lambda y: len(list_filter(regexp_split_to_array(y, '\\s+'), lambda z: z <> '')) <= 4 AND length(y) > 1) ELSE [] END, '|') AS meanings FROM p
""",
    "dictionary_product": f"""
WITH w AS (SELECT doc_id, {_words("text")} AS a FROM documents)
SELECT doc_id, head, unnest(a[3:]) AS meaning FROM (SELECT doc_id, a, unnest(a[1:2]) AS head FROM w)
""",
    "number_speller": _spell_sql(),
    "uri_idempotent": "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)",
    "word_split_candidates": f"""
WITH words AS (SELECT unnest({_words("text")}) AS w FROM documents),
ranked AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS rank FROM words WHERE regexp_full_match(w, '[a-z]+') GROUP BY w HAVING count(*) >= 5),
cuts AS (SELECT w, unnest(range(1, length(w))) AS k FROM ranked WHERE length(w) >= 4),
both_known AS (SELECT c.w, k, a.w AS a, b.w AS b, a.rank + b.rank AS score FROM cuts c JOIN ranked a ON a.w = left(c.w, k) JOIN ranked b ON b.w = substr(c.w, k + 1))
SELECT w, score, a || ' ' || b AS split FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY score, k) AS r FROM both_known) WHERE r = 1
""",
}
