"""Quality rules: a threshold table compiled into one projection.

Everything is built-in functions on single rows: no shuffle, no Python. Measures are columns of the
text; RULES name a measure, a relation and a bound; `verdict` turns the table into one boolean.

Defined results: a null text counts as the empty text (no words, so base_failed). Repeated rows give
repeated results. An empty table gives an empty table. Input columns are never referred to by the
names that are added: the measures are computed from a projection of doc_id and text alone, so extra
or clashing columns don't matter.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import BLANKS, WORD, let, text_of

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages (fixed values).
STOP_WORDS = (
    "the of and to in is that was for it with as on be by at this have from or an are not but "
    "le la les de des du et un une est que qui dans en pour pas sur au avec se ce "
    "der die das und zu den von ist mit ein eine nicht auf im dem sich des als auch "
    "el los las y del que en por con una para se es al lo su no"
).split()


class Rule(NamedTuple):
    name: str
    measure: str
    relation: str  # ">=" or "<=": what a good text satisfies
    bound: float


#: Base rules decide base_failed; the method's rules decide kept for what is left.
BASE_RULES = (
    Rule("enough words", "n_words", ">=", 50),
    Rule("few repeated windows", "repeat_ratio", "<=", 0.5),
)
RULES = (
    Rule("not endless", "n_words", "<=", 10_000_000),
    Rule("words are not fragments", "mean_word", ">=", 2.0),
    Rule("words are not blobs", "mean_word", "<=", 14.0),
    Rule("few symbols", "symbol_ratio", "<=", 0.05),
    Rule("has function words", "stop_ratio", ">=", 0.02),
    Rule("few repeated lines", "dup_line_ratio", "<=", 0.5),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)


def repeated_words(words: Column, k: int = 3) -> Column:
    """How many words stand in windows of k words that occur twice or more in the array.

    Windows are compared by 64-bit hash. Starts of repeated windows come out of one sort; then
    the covered words are summed over the starts in order: O(n log n) for any text.
    """
    n = F.size(words)
    index = F.sequence(F.lit(0), n - k)
    hashed = F.transform(index, lambda i: F.struct(F.xxhash64(*[words[i + j] for j in range(k)]).alias("h"), i.alias("i")))

    def starts(s: Column) -> Column:
        last = F.size(s) - 1
        same = F.filter(s, lambda x, at: ((at > 0) & (s[F.greatest(at - 1, F.lit(0))]["h"] == x["h"])) | ((at < last) & (s[F.least(at + 1, last)]["h"] == x["h"])))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    covered = F.aggregate(
        let(F.array_sort(hashed), starts),
        F.struct(F.lit(-k).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(k), i - acc["at"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(n >= k + 1, covered).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and the measures of each whole text, one row for each row of docs."""
    t = text_of(text)
    base = docs.select(*keep, t.alias("_text"))
    row = base.select(
        *keep,
        let(words_of(F.col("_text")), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
            repeated_words(w).alias("n_repeat_words"),
        )).alias("_w"),
        F.length(F.translate(F.col("_text"), BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate(F.col("_text"), SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(_lines(F.col("_text")), lambda ls: F.struct(F.size(ls).cast("long").alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup"))).alias("_l"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    flat = row.select(*keep, "_w.*", "word_chars", "n_symbols", F.col("_l.n").alias("n_lines"), F.col("_l.dup").alias("n_dup_lines"))
    return flat.select(
        "*",
        ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word"),
        ratio(F.col("n_symbols"), F.col("word_chars")).alias("symbol_ratio"),
        ratio(F.col("n_stop"), F.col("n_words")).alias("stop_ratio"),
        ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        ratio(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_ratio"),
    )


def _holds(rule: Rule) -> Column:
    c, bound = F.col(rule.measure), F.lit(rule.bound)
    if rule.relation == ">=":
        return c >= bound
    if rule.relation == "<=":
        return c <= bound
    raise ValueError(f"no such relation: {rule.relation}")


def verdict(rules) -> Column:
    """True if every rule holds; no rules: true."""
    return reduce(lambda a, b: a & b, map(_holds, rules), F.lit(True))


def broken(rules) -> Column:
    """The names of the rules that a text breaks, in the table's order."""
    return F.filter(F.array(*[F.when(~_holds(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())


def apply_rules(docs: DataFrame, rules=RULES, base_rules=BASE_RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measures, base_failed, kept, and which rules each text breaks."""
    m = measures(docs, text, keep)
    return m.select("*", (~verdict(base_rules)).alias("base_failed"), (verdict(base_rules) & verdict(rules)).alias("kept"), broken((*base_rules, *rules)).alias("broken_rules"))


def op1_quality_rules(docs: DataFrame) -> DataFrame:
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop", "base_failed", "kept")


def _sql_rule(rule: Rule) -> str:
    part = {
        "n_words": "n_words", "mean_word": "CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END",
        "symbol_ratio": "CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END",
        "stop_ratio": "CASE WHEN n_words > 0 THEN n_stop::DOUBLE / n_words ELSE 0 END",
        "dup_line_ratio": "CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END",
    }[rule.measure]
    return f"({part}) {rule.relation} {rule.bound}"


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i+1], ws[i+2]) AS n
      FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
c AS (SELECT r, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT r, unnest([i, i+1, i+2]) AS p FROM g WHERE n >= 2) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))})))::BIGINT AS n_stop,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop, base_failed,
       (NOT base_failed AND {" AND ".join(map(_sql_rule, RULES))}) AS kept
FROM b
"""
