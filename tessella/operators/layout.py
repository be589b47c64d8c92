"""Page geometry and legal text structure: histograms over intervals, runs, labels, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_histogram(rows: DataFrame, key: str, start: str, end: str, cell: int) -> DataFrame:
    """key, cell, n: how many intervals contain the centre of each cell.

    Each interval lists its own cells, so this is a counting aggregation and no range join.
    """
    half = cell / 2
    first = F.ceil((F.col(start) - half) / cell).cast("bigint")
    last = F.floor((F.col(end) - half) / cell).cast("bigint")
    cells = rows.withColumn("_a", first).withColumn("_b", last).where("_a <= _b")
    return cells.select(key, F.explode(F.sequence("_a", "_b")).alias("cell")).groupBy(key, "cell").agg(F.count("*").cast("bigint").alias("n"))


def with_slopes(cells: DataFrame, key: str) -> DataFrame:
    """Adds counts to the left and right of each cell (without it) and the absolute steps to its neighbours (0 at the edge)."""
    order = Window.partitionBy(key).orderBy("cell")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    n = F.col("n")
    return (
        cells.withColumn("left_n", F.coalesce(F.sum("n").over(upto), F.lit(0)).cast("bigint"))
        .withColumn("right_n", F.coalesce(F.sum("n").over(after), F.lit(0)).cast("bigint"))
        .withColumn("left_step", F.abs(n - F.lag("n", 1).over(order)))
        .withColumn("right_step", F.abs(n - F.lead("n", 1).over(order)))
        .fillna(0, ["left_step", "right_step"])
    )


def rank_borders(cells: DataFrame, key: str, columns: int) -> DataFrame:
    """The 4 x ``columns`` best border cells: those with a steep step first, then by step over (count + 0.1)."""
    steep = F.avg("left_step").over(Window.partitionBy(key)) + F.stddev_pop("left_step").over(Window.partitionBy(key))
    rank = F.col("left_step") / (F.col("n") + 0.1)
    scored = cells.withColumn("good", F.col("left_step") > steep).withColumn("rank_value", F.round(rank, 9))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("good"), F.desc("rank_value"), "cell"))
    return scored.withColumn("place", place.cast("bigint")).where(F.col("place") <= 4 * columns)


def runs(rows: DataFrame, key: str, order: str | list[str], breaks: Column, name: str = "run") -> DataFrame:
    """Numbers the runs of each key: a new one begins at each row where ``breaks`` holds (null: it does not)."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_break", F.when(breaks, 1).otherwise(0)).withColumn(name, F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_break")


# Opening words of the line classes, in Kinyarwanda, English and French.
ARTICLE = r"^(ingingo ya|article|article premier)\s*"
ARTICLE_NUMBER = r"^(?:ingingo ya|article)\s+(mbere|one|premier|[0-9]+)\b"
FIRST_ARTICLE = ("mbere", "one", "premier")
CHAPTER = r"^(UMUTWE|CHAPTER|CHAPITRE)\b"
PAGE_NUMBER = r"^[0-9]{1,4}$"


def label_line(line: Column) -> Column:
    """Class of a line of a legal text: title, chapter, page or text."""
    low = F.lower(line)
    return (
        F.when(F.rlike(low, F.lit(ARTICLE_NUMBER)), "article")
        .when(F.rlike(line, F.lit(CHAPTER)), "chapter")
        .when(F.rlike(F.trim(line), F.lit(PAGE_NUMBER)), "page")
        .otherwise("text")
    )


def article_number(line: Column) -> Column:
    """Number that an article's title names; the words for "first" are 1; 0 if it has none."""
    found = F.regexp_extract(F.lower(line), ARTICLE_NUMBER, 1)
    return F.when(found.isin(*FIRST_ARTICLE), 1).otherwise(F.coalesce(F.try_to_number(found, F.lit("9999")).cast("int"), F.lit(0)))


def title_language(line: Column) -> Column:
    """Language that a title gives away: rw, en, fr, or fe where it can be either of the last two."""
    low = F.lower(line)
    return (
        F.when(F.startswith(low, F.lit("ingingo")), "rw")
        .when(F.rlike(low, F.lit(r"^article\s+one\b")), "en")
        .when(F.rlike(low, F.lit(r"^article\s+premier\b")), "fr")
        .when(F.startswith(low, F.lit("article")), "fe")
    )


def prune_and_merge(parts: DataFrame) -> DataFrame:
    """(section, article, paragraph, lang, text) after pruning and merging.

    A first paragraph stays if it has two languages or more, Kinyarwanda among them, and none that is
    ambiguous. Another stays if its first one does, it is not ambiguous and has as many languages; with
    fewer it goes, and its text joins the nearest paragraph before it, with no number missing between,
    that has as many languages as the first.
    """
    key = ["section", "article"]
    each = parts.groupBy(*key, "paragraph").agg(F.count_distinct("lang").alias("n"), F.max(F.when(F.col("lang") == "rw", 1).otherwise(0)).alias("rw"), F.max(F.when(F.col("lang") == "fe", 1).otherwise(0)).alias("fe"))
    own = Window.partitionBy(*key)
    head = lambda c: F.max(F.when(F.col("paragraph") == 1, c)).over(own)
    good = F.when((F.col("n") >= 2) & (F.col("rw") == 1) & (F.col("fe") == 0), 1).otherwise(0)
    each = each.withColumn("head_n", head(F.col("n"))).withColumn("head_ok", F.coalesce(head(good), F.lit(0)))
    each = each.withColumn("stretch", F.col("paragraph") - F.row_number().over(own.orderBy("paragraph")))
    before = Window.partitionBy(*key, "stretch").orderBy("paragraph").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("anchor", F.last(F.when(F.col("n") == F.col("head_n"), F.col("paragraph")), True).over(before))
    usable = (F.col("head_ok") == 1) & (F.col("fe") == 0)
    kept = each.where(usable & ((F.col("paragraph") == 1) | (F.col("n") >= F.col("head_n")))).select(*key, "paragraph")
    moved = each.where(usable & (F.col("paragraph") > 1) & (F.col("n") < F.col("head_n")) & F.col("anchor").isNotNull()).select(*key, "paragraph", "anchor")
    stay = parts.join(kept, [*key, "paragraph"]).select(*key, "paragraph", F.col("paragraph").alias("at"), "lang", "text")
    come = parts.join(moved, [*key, "paragraph"]).select(*key, F.col("anchor").alias("paragraph"), F.col("paragraph").alias("at"), "lang", "text")
    come = come.join(stay.select(*key, "paragraph", "lang"), [*key, "paragraph", "lang"], "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("at", "text")))
    return stay.unionByName(come).groupBy(*key, "paragraph", "lang").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))
