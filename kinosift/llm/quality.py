"""Operator 9: quality rules as a threshold table, compiled into DataFrame expressions only.

Every measure is a column expression over the text; the table names a measure and the bounds it has to
keep, and is folded into one boolean.  Windows of eight words are compared by 64-bit hashes inside
their own document, so nothing is shuffled and no row leaves its task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Frequent function words of the languages that the tables hold, lower case.
STOP_WORDS = (
    "the of and to in is that for it as with on by this be at are from was an "
    "le la les de des du et un une en que qui dans pour est par sur au "
    "der die das und den von mit ist im zu ein eine auf für dem nicht "
    "el los las y un una es por con para del se su lo"
).split()


@dataclass(frozen=True)
class Rule:
    """Bounds, both inclusive, on a measure; None: no bound."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The method's own thresholds, beside the base rules.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("stop_word_share", 0.01, None),
    Rule("dup_line_share", None, 0.5),
)
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts and shares that the rules read; the columns that were there stay as they are.

    A null text counts as empty.  All new names start with an underscore, and so must not be there yet.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    cut = docs.withColumns(
        {
            "_words": F.filter(F.split(content, SPACE + "+"), lambda w: w != ""),
            "_lines": F.filter(F.split(content, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "_word_chars": F.length(F.translate(content, SPACES, "")).cast("long"),
            "_n_symbols": (F.length(content) - F.length(F.translate(content, SYMBOLS, ""))).cast("long"),
        }
    )
    cut = cut.withColumns(
        {
            "_n_words": F.size("_words").cast("long"),
            "_n_lines": F.size("_lines").cast("long"),
            "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_n_stop": F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            "_hashes": F.when(F.size("_words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_words") - WINDOW + 1), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")),
        }
    )
    # Only documents that repeat a window are sorted: equal hashes become neighbours, their places come back in order.
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    cut = cut.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, at: F.coalesce(F.get("_sorted", at)["h"] == x["h"], F.lit(False))
    cut = cut.withColumn("_starts", F.sort_array(F.transform(F.filter("_sorted", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])))
    gain = F.transform("_starts", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", i + 1) - p, F.lit(WINDOW))))
    cut = cut.withColumn("_n_repeat_words", F.coalesce(F.aggregate(gain, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    return cut.withColumns(
        {
            "_mean_word_chars": _share(F.col("_word_chars"), F.col("_n_words")),
            "_symbols_per_word": _share(F.col("_n_symbols"), F.col("_n_words")),
            "_stop_word_share": _share(F.col("_n_stop"), F.col("_n_words")),
            "_dup_line_share": _share(F.col("_n_dup_lines"), F.col("_n_lines")),
        }
    ).drop("_words", "_lines", "_hashes", "_sorted", "_starts")


def base_failed() -> Column:
    return (F.col("_n_words") < LEAST_WORDS) | (100 * F.col("_n_repeat_words") > MOST_REPEATED_PERCENT * F.col("_n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean over measured columns."""
    kept = F.lit(True)
    for rule in rules:
        value = F.col(f"_{rule.measure}")
        if rule.least is not None:
            kept = kept & (value >= rule.least)
        if rule.most is not None:
            kept = kept & (value <= rule.most)
    return kept


def scored(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed and kept.

    Null or empty texts have no words and fail the base; null doc_ids and repeated rows are kept as rows.
    """
    found = measured(docs.select("doc_id", "text"))
    counts = [F.col(f"_{n}").alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select("doc_id", *counts, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def filtered(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with the columns of docs.

    The row number keeps the optimizer from pushing the filter below the measures, where it would repeat each of them.
    """
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_document"), docs["text"].alias("_text"))
    found = measured(whole, "_text").withColumns({"_passed": ~base_failed() & verdict(rules), "_row": F.monotonically_increasing_id()})
    return found.filter(F.col("_passed") & (F.col("_row") >= 0)).select("_document.*")


def _sql_verdict(rules: tuple[Rule, ...]) -> str:
    terms = []
    for rule in rules:
        terms += [f"{rule.measure} >= {rule.least}"] if rule.least is not None else []
        terms += [f"{rule.measure} <= {rule.most}"] if rule.most is not None else []
    return " AND ".join(terms)


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
cut AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '{SPACE}+'), lambda w: w <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (SELECT doc_id, i, words[i : i + {WINDOW - 1}] AS win FROM cut, unnest(range(1, len(words) - {WINDOW - 2})) AS r(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, {WINDOW})) AS r(k) GROUP BY doc_id),
counted AS (
  SELECT cut.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda w: lower(w) IN ({_STOPS})))::BIGINT AS n_stop
  FROM cut LEFT JOIN repeated ON cut.doc_id = repeated.doc_id),
shares AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
    CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
    CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_word_share,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
    (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words) AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND {_sql_verdict(RULES)}) AS kept FROM shares
"""
