"""Line-first quality rules, in DataFrame functions only.

Each line is judged by itself (end punctuation, navigation, boilerplate); lines that fail are removed; a document that
loses too much of its text, or fails the base rules, is rejected.

Defined results: a null or empty text has no words, fails the base rules and keeps an empty text. Null in any other column and
repeated rows have no effect: the operator reads only the text column and adds one struct column, in place of a column of that
name. Lines without a word are neither kept nor lost. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copresence.llm.common import let, quoted, table, words_of

SYMBOLS = "[#*$%&|<>]"
#: Phrases of web furniture. A line of at most `boilerplate_words` words that holds one is boilerplate.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "javascript is disabled", "lorem ipsum", "sign up for our newsletter", "subscribe to our",
    "click here to", "skip to content", "skip to main content", "share on facebook", "share on twitter",
)


@dataclass(frozen=True)
class LineRules:
    min_words: int = 50  # base: fewer words fail
    max_repeat_percent: int = 50  # base: more words in repeated windows fail
    line_symbol_percent: int = 10  # of a line's characters
    line_shout_percent: int = 15  # of a line's characters that are exclamation or question marks
    boilerplate_words: int = 30
    max_lost_percent: int = 30  # of the characters of lines with a word


BLANK = " \t\n\x0b\x0c\r"


def symbol_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS))


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK)) != ""


def line_fails(line: Column, flags: Column, rules: LineRules) -> Column:
    """True where a line with a word fails a rule. flags: what the whole text holds at all, so that clean texts skip most rules."""
    chars = F.char_length(line)
    navigation = F.regexp_count(line, F.lit(r"\||»|›|•")) * 24 > chars
    symbols = symbol_count(line) * 100 > chars * rules.line_symbol_percent
    shouts = F.regexp_count(line, F.lit("[!?]")) * 100 > chars * rules.line_shout_percent
    last = F.right(F.rtrim(line, F.lit(BLANK)), F.lit(1))
    unended = (last != ".") & ~F.rlike(last, F.lit(r"[!?…:;,。！？\"'”’)\]\p{L}\p{N}]"))
    short = F.size(F.split(line, " ")) <= rules.boilerplate_words
    boilerplate = short & F.rlike(F.lower(line), F.lit("|".join(BOILERPLATE)))
    braces = line.contains("{") | line.contains("}")
    return (
        unended | (flags["symbols"] & symbols) | (flags["bars"] & navigation) | (flags["shouts"] & shouts)
        | (flags["phrases"] & boilerplate) | (flags["braces"] & braces)
    )


def _any(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(x) for x in parts])


def repeated_window_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more, the first occurrence included.

    Windows are 64-bit hashes. Where they are not all distinct they are sorted with their positions; equal neighbours are
    repeats. The union of [i, i+2] over the sorted repeated starts is the sum of min(3, gap to the next)."""

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0))),
            lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)),
        )

    def starts(ordered: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(ordered, j)["w"] == x["w"], F.lit(False))
        hit = F.filter(ordered, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        parts = F.transform(at, lambda a, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - a, F.lit(3))))
        return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def count(window: Column) -> Column:
        placed = F.transform(window, lambda h, i: F.struct(h.alias("w"), i.alias("i")))
        return F.when(F.size(F.array_distinct(window)) == F.size(window), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(placed), lambda ordered: let(starts(ordered), covered))
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: let(windows(hashes), count))


def judge(docs: DataFrame, text: str = "text", out: str = "quality", rules: LineRules = LineRules()) -> DataFrame:
    """docs (out may not be the text's own name) with a struct column `out`: the counts, base_failed, kept, lost_chars, line_chars, n_lines_removed, clean_text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    total = lambda lines: F.char_length(F.array_join(lines, "")).cast("long")

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_window_words(words).alias("n_repeat_words"),
        )

    def of_lines(lines: Column, worded: Column, flags: Column) -> Column:
        """Where no line fails, nothing is built anew."""
        good = F.filter(worded, lambda x: ~line_fails(x, flags, rules))
        return let(
            good,
            lambda g: F.struct(
                (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
                total(worded).alias("line_chars"),
                (total(worded) - total(g)).alias("lost_chars"),
                (F.size(worded) - F.size(g)).cast("long").alias("n_lines_removed"),
                F.when(F.size(worded) == F.size(g), whole)
                .otherwise(F.array_join(F.filter(lines, lambda x: ~has_word(x) | ~line_fails(x, flags, rules)), "\n"))
                .alias("clean_text"),
            ),
        )

    def of_text(lines: Column) -> Column:
        n_symbols = symbol_count(whole)
        lowered = F.lower(whole)
        flags = F.struct(
            n_symbols.cast("long").alias("n_symbols"),
            (n_symbols > 0).alias("symbols"),
            _any(whole, "|»›•").alias("bars"),
            _any(whole, "!?").alias("shouts"),
            let(lowered, lambda low: _any(low, BOILERPLATE)).alias("phrases"),
            _any(whole, "{}").alias("braces"),
        )
        return let(flags, lambda f: F.struct(f["n_symbols"].alias("n_symbols"), let(F.filter(lines, has_word), lambda worded: of_lines(lines, worded, f)).alias("l")))

    # a generator of one row: filters on the verdict stay above it, so the rules are evaluated once
    found = F.struct(let(words_of(F.col(text)), of_words).alias("w"), let(F.split(whole, "\n"), of_text).alias("t"))
    parts = docs.select(*(F.col(quoted(c)) for c in docs.columns if c != out), F.explode_outer(F.array(found)).alias(out))
    w, t = F.col(out)["w"], F.col(out)["t"]
    l = t["l"]
    failed = (w["n_words"] < rules.min_words) | (w["n_repeat_words"] * 100 > w["n_words"] * rules.max_repeat_percent)
    keeps = l["lost_chars"] * 100 <= l["line_chars"] * rules.max_lost_percent
    return parts.withColumn(
        out,
        F.struct(
            w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), t["n_symbols"].alias("n_symbols"),
            l["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"),
            (~failed & keeps).alias("kept"), l["lost_chars"].alias("lost_chars"), l["line_chars"].alias("line_chars"),
            l["n_lines_removed"].alias("n_lines_removed"), l["clean_text"].alias("clean_text"),
        ),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the line-first verdict for every document."""
    judged = judge(table(spark, sf_dir, "documents", "doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", "line_chars", "n_lines_removed"]
    return judged.select("doc_id", *(F.col("quality")[n].alias(n) for n in names))


_PHRASES = "|".join(BOILERPLATE)
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
tok AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
win AS (
  SELECT rid, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM tok WINDOW o AS (PARTITION BY rid ORDER BY i)
),
rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x, y, z) AS n FROM win WHERE z IS NOT NULL) WHERE n > 1
),
cov AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS i FROM rep, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY rid),
li AS (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d),
lw AS (SELECT rid, x, length(x) AS c FROM li WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
lf AS (
  SELECT rid, x, c,
    len(regexp_extract_all(x, '\||»|›|•')) * 24 > c
    OR len(regexp_extract_all(x, '{SYMBOLS}')) * 100 > c * 10
    OR len(regexp_extract_all(x, '[!?]')) * 100 > c * 15
    OR NOT regexp_matches(x, '[.!?…:;,。！？"''”’)\]\p{{L}}\p{{N}}][\x20\x09-\x0D]*$')
    OR (len(string_split(x, ' ')) <= 30 AND regexp_matches(lower(x), '{_PHRASES}'))
    OR regexp_matches(x, '[{{}}]') AS bad
  FROM lw
),
la AS (
  SELECT rid, count(*) - count(DISTINCT x) AS n_dup_lines, sum(c) AS line_chars, coalesce(sum(c) FILTER (bad), 0) AS lost_chars,
    count(*) FILTER (bad) AS n_lines_removed
  FROM lf GROUP BY rid
),
j AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
    len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    coalesce(lost_chars, 0) AS lost_chars, coalesce(line_chars, 0) AS line_chars, coalesce(n_lines_removed, 0) AS n_lines_removed
  FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN la USING (rid)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars * 100 <= line_chars * 30 AS kept,
  CAST(lost_chars AS BIGINT) AS lost_chars, CAST(line_chars AS BIGINT) AS line_chars, CAST(n_lines_removed AS BIGINT) AS n_lines_removed
FROM j
"""
