"""Secret scanning with a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams (an OR of ANDs) that every text
with a match satisfies. The index holds a posting (trigram, row key) for each trigram that some query
needs; postings of a row are intersected by OR-ing their bits, and rows that satisfy a rule's query
are its candidates, which the rule's expression then verifies. Rules without a mandatory trigram
(long hexadecimal runs) scan every text.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

try:
    import re._parser as sre
except ImportError:  # before Python 3.11
    import sre_parse as sre

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut, table

MOST_STRINGS = 64
MOST_GRAMS = 8  # of one AND; fewer trigrams ask for less, so no match is lost


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches; those whose ``group`` has fewer than ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False  # ASCII letters of the pattern's keyword match in either case


#: The base rules, in the order in which ties are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: What the method adds: other well-known credential formats.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)


def trigram_query(pattern: str) -> list[set[str]]:
    """Lower-cased trigrams that a match must contain, as an OR of ANDs; an empty list: no such trigram.

    Walks the parsed expression and keeps the set of strings that each stretch can be, as long as it
    is small; a stretch that can be too many strings closes the run, and the trigrams inside the
    closed runs are mandatory.
    """
    # every alternative: (closed runs, open run)
    ways = [((), "")]
    for op, arg in _flat(sre.parse(pattern)):
        strings = _strings(op, arg)
        if strings is None or len(strings) * len(ways) > MOST_STRINGS:
            ways = [(*runs, run) for runs, run in ways]
            ways = [(w, "") for w in ways]
        else:
            ways = [(runs, run + s) for (runs, run), s in itertools.product(ways, sorted(strings))]
    grams = []
    for runs, run in ways:
        found = {r[i : i + 3].lower() for r in (*runs, run) for i in range(len(r) - 2)}
        if not found:
            return []
        grams.append(set(sorted(found)[:MOST_GRAMS]))
    # a way that asks for all that another asks for, and more, adds nothing
    return [g for k, g in enumerate(grams) if not any(o < g or (o == g and i < k) for i, o in enumerate(grams))]


def _flat(parsed) -> list:
    out = []
    for op, arg in parsed:
        if op is sre.SUBPATTERN:
            out += _flat(arg[3])
        else:
            out.append((op, arg))
    return out


def _strings(op, arg) -> set[str] | None:
    """The strings that a node matches, if they are few."""
    if op is sre.LITERAL:
        return {chr(arg)}
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
        return {chr(a) for _, a in arg}
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is sre.MAX_REPEAT and arg[1] <= 2:
        one = _sequence(arg[2])
        if one is None:
            return None
        return {"".join(p) for n in range(arg[0], arg[1] + 1) for p in itertools.product(sorted(one), repeat=n)}
    return None


def _sequence(parsed) -> set[str] | None:
    found = {""}
    for op, arg in _flat(parsed):
        strings = _strings(op, arg)
        if strings is None or len(strings) * len(found) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in strings}
    return found


def postings(rows: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index over the given trigrams: a (gram number, row key) row for each that a text contains."""
    present = F.filter(F.array(*map(F.lit, range(len(grams)))), lambda k: F.contains(F.col("_low"), F.element_at(F.array(*map(F.lit, grams)), k + 1)))
    return rows.select("_key", F.lower("text").alias("_low")).select("_key", F.explode(present).alias("gram"))


def candidates(index: DataFrame, queries: dict[str, list[set[str]]], grams: list[str]) -> DataFrame:
    """Row key and the set of rules (as bits) whose trigram query it satisfies."""
    bit = {g: 1 << k for k, g in enumerate(grams)}
    held = index.groupBy("_key").agg(F.bit_or(F.expr("shiftleft(1L, gram)")).alias("_bits"))
    flags = F.lit(0)
    for n, ways in enumerate(queries.values()):
        met = F.lit(False)
        for way in ways:
            mask = F.lit(sum(bit[g] for g in way)).cast("bigint")
            met = met | (F.col("_bits").bitwiseAND(mask) == mask)
        flags = flags + F.when(met, F.lit(1 << n)).otherwise(F.lit(0))
    return held.select("_key", flags.alias("_rules")).where("_rules > 0")


def matches(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind): leftmost non-overlapping matches, in code points, end exclusive.

    The pieces between matches and the matches themselves come from two passes of the same
    expression; running sums of their lengths are the offsets.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    parts = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("b"), found.alias("m"), value.alias("v"))
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """All columns of ``docs`` plus ``spans``: array of (start, ord, end, kind) sorted by start, then rule order.

    Null text counts as empty and has no spans. Rows are told apart by a hash of their text, so
    repeated rows and copies share their postings (which a partial aggregation folds before the
    shuffle) and each gets the full result; an empty table gives no rows. Other columns pass through,
    whatever their names, except a column called ``spans``, which is replaced.
    """
    docs = docs.drop("spans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # copies share a key; the few candidate keys are written out, so the join meets each key once on their side
    rows = rows.withColumn("_key", F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), F.col("text")).alias("b")))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for way in q for g in way})
    if len(grams) > 62:
        raise ValueError("the rules need more trigrams than one row of bits holds; scan in two passes")
    found = cut(candidates(postings(rows, grams), queries, grams), "secret-candidates")
    joined = rows.join(found.hint("shuffle_hash"), "_key", "left")
    nothing = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    spans = []
    for n, rule in enumerate(rules):
        if rule.kind in queries:
            asked = F.coalesce(F.col("_rules"), F.lit(0)).bitwiseAND(F.lit(1 << list(queries).index(rule.kind))) != 0
            asked = asked & F.rlike("text", F.lit(rule.pattern))
        else:
            asked = F.rlike("text", F.lit(_long(rule)))
        spans.append(F.when(asked, matches(F.col("text"), rule, n)).otherwise(nothing))
    return joined.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns], F.array_sort(F.concat(*spans)).alias("spans"))


def _long(rule: Rule) -> str:
    """A test that says whether a whole-match rule of the form [class]+ has any match of the least length."""
    return rule.pattern[:-1] + f"{{{rule.least},}}" if rule.group == 0 and re.fullmatch(r"\[[^\]]*\]\+", rule.pattern) else rule.pattern


def redact(scanned: DataFrame, mask: str = "█") -> DataFrame:
    """Replaces each span of ``text`` by as many mask characters; overlapping spans are masked once."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        start = F.greatest(acc["at"], s["start"])
        end = F.greatest(acc["at"], s["end"])
        out = F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, start - acc["at"]), F.repeat(F.lit(mask), end - start))
        return F.struct(end.alias("at"), out.alias("out"))

    hidden = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, F.length("text"))))
    return scanned.withColumn("text", F.when(F.size("spans") > 0, hidden).otherwise(F.col("text")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: counts of the base kinds, their digest, and all spans."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in BASE]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    """The same spans in DuckDB: pieces and matches of each rule, running sums for the offsets."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    either = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    parts = []
    for n, rule in enumerate(BASE + ADDED):
        p = quote(either if rule.kind == "assign" else rule.pattern)
        parts.append(
            f"""SELECT row_no, {n} AS ord, '{rule.kind}' AS kind, unnest(range(len(m))) AS k, m, v, b, {rule.least} AS least FROM (
  SELECT row_no, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, {rule.group}) AS v,
         string_split_regex(text, {p}) AS b FROM d WHERE regexp_matches(text, {p}))"""
        )
    union = "\nUNION ALL\n".join(parts)
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({union}),
spans AS (
  SELECT row_no, ord, kind,
         CAST(list_sum(list_transform(b[1:k+1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k], lambda x: length(x))), 0) AS BIGINT) AS s,
         length(m[k+1]) AS n
  FROM found WHERE length(v[k+1]) >= least
),
per AS (
  SELECT row_no, {counts},
         coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, ord) FILTER (kind IN ({base})), '') AS base,
         string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, ord) AS spans
  FROM spans GROUP BY row_no
)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (row_no)
"""


ORACLE = _oracle()
