"""Classes of the lines of legal gazettes in Kinyarwanda, English and French, and the fold that links them.

The classes of one line are plain expressions. What a line takes over from the one before it (language,
article number, whether a title or paragraph goes on) is a fold over the lines of a column in order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the line classes.
GAZETTE = r"(official\s+gazette)|(o\.g\.)"
NUMBER_MARK = r"(nº)|(no)|(n°)|(nᵒ)"
DATE = r"\d{1,2}/\d{1,2}/\d{4}"
MONTH_ENGLISH = r"(jan(?:uary)?)|(feb(?:ruary)?)|(mar(?:ch)?)|(apr(?:il)?)|(may)|(jun(?:e)?)|(jul(?:y)?)|(aug(?:ust)?)|(sep(?:tember)?)|(oct(?:ober)?)|(nov(?:ember)?)|(dec(?:ember)?)"
MONTH_KINYARWANDA = r"(mutarama)|(gashyantare)|(werurwe)|(mata)|(gicurasi)|(kamena)|(nyakanga)|(kanama)|(nze[lr]i)|(ukwakira)|(ugushyingo)|(ukuboza)"
MONTH_FRENCH = r"(janvier)|(f(é|e)vrier)|(mars)|(avril)|(mai)|(juin)|(juillet)|(ao(û|u)t)|(septembre)|(octobre)|(novembre)|(d(é|e)cembre)"
YEAR = r"\d{4}"
ARTICLE_KINYARWANDA = r"^ing[ie]n?go?\s?\.?\s?(ya)?\s?(mbere|\d+)"
ARTICLE_ENGLISH = r"^article?s?\s?\.?\s?(ya)?\s?(one|\d+)"
ARTICLE_FRENCH = r"^article?s?\s?\.?\s?(ya)?\s?(premier|\d+)"
SECTION_KINYARWANDA = r"^i((((cy)|k)iciro?)|(gice?))\s?\.?\s?(cya)?\s?((mbere)|([mdclxvi0-9]+))"
SECTION_ENGLISH = r"^section?\s?\.?\s?((one)|(two)|(three)|(four)|(five)|([mdclxvi0-9]+))"
SECTION_FRENCH = r"^section?\s?\.?\s?((premi(è|e)re)|(deuxi(è|e)me)|(troisi(è|e)me)|(quatri(è|e)me)|(cinqu?i(è|e)me)|([mdclxvi0-9]+))"
CHAPTER_KINYARWANDA = r"^[UI]M[UI]?TW?E?\s?([WY]A)?\s?\.?\s?[MDCLXVI0-9]+"
CHAPTER_ENGLISH = r"^CHA?PI?TERS?\s?\.?\s?[MDCLXVI0-9]+"
CHAPTER_FRENCH = r"^CHA?PI?TRES?\s?\.?\s?[MDCLXVI0-9]+"
ORDER_KINYARWANDA = r"^(B?ATEGETSE)|([BY]?EMEJE)"
ORDER_ENGLISH = r"^(HEREBY\s?)?((ORDERS?)|(ADOPTS?))"
ORDER_FRENCH = r"^(ARRETE(NT)?)|(ADOPTE(NT)?)"
DONE_ON = r"(ku\s?wa\s?\.?\s?)|(on\s?\.?\s?)|(le\s?\.?\s?)"
DONE_DATE = r"((ku\s?wa)|(on)|(le))\s?\.?\s?(\d{1,2}\s?[/.\-]\s?\d{1,2}\s?[/.\-]\s?\d{4})\s?\.?\s?$"
SIGNATURE = r"^\s?\(\s?s(e|é)\s?\)\s?"
PAGE = r"^\d+$"
ORDER_TOKENS, DONE_TOKENS = 5, 10  # fewer than these

MONTH_ANY = f"{MONTH_ENGLISH}|{MONTH_KINYARWANDA}|{MONTH_FRENCH}"
ARTICLES = (("rw", ARTICLE_KINYARWANDA), ("fe", ARTICLE_ENGLISH), ("fe", ARTICLE_FRENCH))
FIRST = {"mbere": "rw", "one": "en", "premier": "fr"}

LINE = "struct<line_no:bigint,raw:boolean,num:int,lang:string,other:string,colon:boolean,bold:boolean>"


def line_facts(line_no: Column, line: Column, bold: Column, last: Column) -> Column:
    """What the fold needs of a line: (line_no, raw title, its number, its language, other class, colon, bold).

    ``last`` says whether it is the last line, where alone a number is a page's.
    """
    text = F.trim(line)
    low = F.lower(text)
    has = lambda c, *patterns: F.rlike(c, F.lit("|".join(f"({p})" for p in patterns)))
    tokens = F.size(F.split(text, r"\s+"))
    raw = bold & has(low, ARTICLE_KINYARWANDA, ARTICLE_ENGLISH, ARTICLE_FRENCH)
    found = F.coalesce(*[F.nullif(F.regexp_extract(low, p, 2), F.lit("")) for _, p in ARTICLES])
    family = F.when(has(low, ARTICLE_KINYARWANDA), "rw").otherwise("fe")
    lang = F.coalesce(*[F.when(found == word, of) for word, of in FIRST.items()], family)
    num = F.when(found.isin(*FIRST), 1).otherwise(F.coalesce(found.try_cast("int"), F.lit(0)))
    other = (
        F.when((line_no == 0) & has(low, GAZETTE) & has(low, NUMBER_MARK) & (has(low, DATE) | (has(low, MONTH_ENGLISH) & has(low, YEAR))), "gazette")
        .when(bold & has(low, SECTION_KINYARWANDA, SECTION_ENGLISH, SECTION_FRENCH), "section")
        .when(bold & has(text, CHAPTER_KINYARWANDA, CHAPTER_ENGLISH, CHAPTER_FRENCH), "chapter")
        .when(bold & has(text, ORDER_KINYARWANDA, ORDER_ENGLISH, ORDER_FRENCH) & (tokens < ORDER_TOKENS), "order")
        .when((has(low, DONE_DATE) | (has(low, DONE_ON) & has(low, MONTH_ANY) & has(low, YEAR))) & (tokens < DONE_TOKENS), "done")
        .when(has(low, SIGNATURE), "signature")
        .when(has(text, PAGE) & last, "page")
    )
    return F.struct(line_no.alias("line_no"), raw.alias("raw"), F.when(raw, num).alias("num"), F.when(raw, lang).alias("lang"), other.alias("other"), F.startswith(text, F.lit(":")).alias("colon"), bold.alias("bold")).cast(LINE)


def linked(lines: Column) -> Column:
    """(line_no, class, number, lang) of every line of an array of ``line_facts`` in order.

    A title right after a title counts only if its number is the next one. A line of no other class goes
    on with the title or paragraph before it, with its number and language: as a title if it begins with a
    colon, not at all if it is bold. An ambiguous title (fe) takes a known fr or en over unless it is the first.
    """
    empty = F.expr("named_struct('title', false, 'para', false, 'num', 0, 'lang', cast(null as string), 'out', cast(array() as array<struct<line_no:bigint,class:string,number:int,lang:string>>))")

    def step(s: Column, x: Column) -> Column:
        title = x["raw"] & ~(s["title"] & (x["num"] != s["num"] + 1))
        takes = (x["lang"] == "fe") & (x["num"] != 1) & F.coalesce(s["lang"].isin("fr", "en"), F.lit(False))
        lang = F.when(x["raw"] & ~takes, x["lang"]).otherwise(s["lang"])
        goes_on = x["other"].isNull() & ~title & (s["title"] | s["para"])
        is_title = title | (goes_on & s["title"] & x["colon"])
        is_para = goes_on & ~(s["title"] & (x["colon"] | x["bold"]))
        num = F.when(goes_on, s["num"]).otherwise(F.coalesce(x["num"], F.lit(0)))
        lang = F.when(goes_on, s["lang"]).otherwise(lang)
        kind = F.when(is_title, "title").when(is_para, "paragraph").otherwise(F.coalesce(x["other"], F.lit("unknown")))
        row = F.struct(x["line_no"].alias("line_no"), kind.alias("class"), num.alias("number"), lang.alias("lang"))
        return F.struct(is_title.alias("title"), is_para.alias("para"), num.alias("num"), lang.alias("lang"), F.concat(s["out"], F.array(row)).alias("out"))

    return F.aggregate(lines, empty, step, lambda s: s["out"])
