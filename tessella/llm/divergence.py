"""Source divergence audit: how far each source's use of words lies from its language and from other sources.

Words are counted in streams and summed once by (lang, source, term). Each group's terms then fall into
buckets of similar counts; with the lowest probability that the language gives to any term of a bucket, the
bucket's largest count bounds every difference in it. The search takes buckets best bound first until they
hold k terms, which gives a k-th value, and then those whose bound is not strictly below it: only their
terms are ranked. Distances between sources come from postings: what a pair would have if it shared no term is
summed from histograms of counts, and the terms that both hold correct it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, map_batches, table

LEAST_DOCS = 30
TOP = 50
PRIOR = 5  # added to every count
UNIT = 1_000_000_000  # probabilities are whole multiples of 1 / UNIT
ENTRIES_AT_ONCE = 200_000  # counts that a task holds before it sends them on
BYTES_AT_ONCE = 4_000_000  # of one text

_TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes, stretch: int = BYTES_AT_ONCE) -> Iterator[list[bytes]]:
    """Runs of letters a-z and code points from 128 on, A-Z lower-cased, some stretch of the text at a time."""
    at = 0
    while at < len(text):
        end = at + stretch
        while end < len(text) and _TO_TERMS[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_TO_TERMS).split()
        at = end


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it) of every group; the empty term stands for
    the group itself, with its number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (total, documents) in held.items():
                n = len(documents)
                columns = [[lang] * n, [source] * n, [t.decode() for t in documents], [total[t] for t in documents], list(documents.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                total, documents = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = {b""}
                for terms in terms_of(text.encode()):
                    total.update(terms)
                    seen.update(terms)
                documents.update(seen)
                if sum(len(d) for _, d in held.values()) > ENTRIES_AT_ONCE:
                    yield from sent()
        yield from sent()

    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = map_batches(read, run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _probability(count: str, total: str) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * V)), exactly."""
    wide = "decimal(20,0)"
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * (cast({count} as {wide}) + {PRIOR})) div (cast({total} as {wide}) + {PRIOR} * cast(v as {wide}))")


def _bucket(count: Column) -> Column:
    """Counts of one bucket share their binary logarithm's whole part and the next two binary places."""
    log = F.length(F.bin(count)) - 1
    low = F.greatest(log - 2, F.lit(0))
    return (log * 8 + F.call_function("shiftright", count, low)).cast("int")


def postings(counts: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, v, z) and postings (lang, source, term, n, p, q, z) of the kept terms.

    v is the number of kept terms of the language, z the group's p of a term that it does not hold, p the
    group's and q the language's probability of the term.
    """
    terms = counts.where("term <> ''")
    kept = cut(terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= least_docs).drop("docs"), "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    held = cut(terms.drop("docs").join(kept, ["lang", "term"]), "divergence-held")
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total_lang", F.lit(0)).alias("total_lang"))
    groups = groups.withColumn("z", F.when(F.col("v") > 0, _probability("0", "total")).otherwise(F.lit(0)).cast("long"))
    groups = cut(groups, "divergence-groups")
    full = held.join(groups.where("v > 0"), ["lang", "source"])
    full = full.select("lang", "source", "term", "n", _probability("n", "total").cast("long").alias("p"), _probability("n_lang", "total_lang").cast("long").alias("q"), "z")
    return groups.drop("total", "total_lang"), cut(full, "divergence-postings")


def top_terms(held: DataFrame, k: int = TOP) -> DataFrame:
    """lang, source, term, f and rank of each group's ``k`` terms whose probability most exceeds the language's."""
    more = held.where("p > q").select("lang", "source", "term", (F.col("p") - F.col("q")).alias("f"), "p", "q", _bucket(F.col("n")).alias("bucket"))
    group = ["lang", "source"]
    buckets = more.groupBy(*group, "bucket").agg(F.count("*").alias("n"), (F.max("p") - F.min("q")).alias("bound"))
    buckets = cut(buckets, "divergence-buckets")
    ordered = Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket")
    before = F.coalesce(F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = buckets.withColumn("before", before).where(F.col("before") < k)
    best = Window.partitionBy(*group).orderBy(F.desc("f"), "term")
    taken = more.join(first.select(*group, "bucket"), [*group, "bucket"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    kth = taken.groupBy(*group).agg(F.when(F.count("*") == k, F.min("f")).otherwise(F.lit(1)).alias("kth"))
    # no term of a bucket whose bound is strictly below the k-th value can be among the k
    open_ = buckets.join(kth, group).where(F.col("bound") >= F.col("kth")).select(*group, "bucket", "kth")
    found = more.join(open_, [*group, "bucket"]).where(F.col("f") >= F.col("kth"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(*group, "term", "f", "rank")


def source_distances(groups: DataFrame, held: DataFrame) -> DataFrame:
    """lang, source, item and value of every two sources of a language: the sum of |p - p'| over its kept terms."""
    to = F.struct(F.col("source").alias("item"), F.col("z").alias("z_b"))
    pairs = groups.select("lang", "source", "v", F.col("z").alias("z_a")).join(groups.select("lang", to.alias("b")), "lang").select("lang", "source", "v", "z_a", "b.item", "b.z_b").where("source <> item")
    # if no term were shared: z against z for all terms, and for those that either holds its p in place of its z
    alone = held.groupBy("lang", "source", "z", "p").agg(F.count("*").alias("k"))
    over = alone.join(groups.select("lang", to.alias("b")), "lang").where(F.col("source") != F.col("b.item"))
    change = F.sum(F.col("k") * (F.abs(F.col("p") - F.col("b.z_b")) - F.abs(F.col("z") - F.col("b.z_b"))))
    own = over.groupBy("lang", "source", F.col("b.item").alias("item")).agg(change.alias("own"))
    # terms that both hold, met in the postings
    a = held.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p_a"), F.col("z").alias("z_a"))
    b = held.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("z").alias("z_b"))
    fix = F.abs(F.col("p_a") - F.col("p_b")) - F.abs(F.col("p_a") - F.col("z_b")) - F.abs(F.col("p_b") - F.col("z_a")) + F.abs(F.col("z_a") - F.col("z_b"))
    shared = cut(a.join(b, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(fix).alias("both")), "divergence-shared")
    both = shared.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "both").unionAll(shared.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "both"))
    own = cut(own, "divergence-own")
    back = own.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("own").alias("back"))
    key = ["lang", "source", "item"]
    met = pairs.join(own, key, "left").join(back, key, "left").join(both, key, "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    return met.select(*key, (F.col("v") * F.abs(F.col("z_a") - F.col("z_b")) + none("own") + none("back") + none("both")).cast("long").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, k: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: each source's distances to the others of its language (part ``pair``)
    and the ``k`` terms that it uses most above the language (part ``term``).

    Null text, lang and source count as ''. Groups whose documents have no terms are groups; a language without
    kept terms has distances of 0. Repeated rows count each; ties go by the item's bytes; texts of any length are
    counted in stretches; other columns are ignored; an empty table gives no rows.
    """
    counts = cut(count_terms(docs), "divergence-counts")
    groups, held = postings(counts, least_docs)
    each = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = source_distances(groups, held).withColumn("rank", F.row_number().over(each))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    terms = top_terms(held, k).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("f").alias("value"), "rank")
    return pairs.unionAll(terms)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between sources and outstanding terms of all (lang, source) groups of ``documents``."""
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (SELECT row_no, lang, source, term, count(*) AS n FROM (SELECT row_no, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n_lang FROM t GROUP BY ALL HAVING count(*) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT s.lang, s.source, coalesce(any_value(v), 0) AS v, coalesce(any_value(total_lang), 0) AS total_lang, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS total
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN langs USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source GROUP BY s.lang, s.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (total + 5 * v) AS p, 1 + (1000000000 * (k.n_lang + 5)) // (total_lang + 5 * v) AS q
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
) WHERE part = 'pair' OR rank <= 50
"""
