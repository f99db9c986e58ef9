"""URL filters: host and path rules first, then naive Bayes over segmented host and path tokens.

Names are split into words by a unigram Viterbi search; the unigrams are counted in the texts of all pages, less the domains that pages
print, in the labels that several hosts share, and in what hyphens and paths part in their urls. With `compounds`, a word that much more
frequent words make up is no entry, or else a name that some text has as one word would never split; a name that does split is a
token of its own beside its words. Urls that a rule fits are labelled with its verdict, others as blocked where a
hyphen, dot or slash parts an unwanted word off (`seeded`); a multinomial naive Bayes model over their words, with more prior weight for
words that are known to be unwanted, judges every url that no rule fits.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and has no token, so the class prior
decides; without labelled urls the classes are even. Equal scores give `allow`. A null text counts nothing. Rows are judged one by one:
repeated rows and null ids change nothing but the counts. Extra columns of any names pass through, but for those that the results replace.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copresence.llm.common import packed_row, quoted, table, unpacked_row, written

#: Fixed values: (verdict, host and path) of the rules; the first slash ends the host.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Words that are known to be unwanted. In the block class each counts as this share of its words, and PRIOR times at least.
SEEDS = (
    "ads", "adult", "bet", "bets", "betting", "casino", "cheap", "dating", "escort", "gambling", "jackpot", "loans", "pharmacy", "pills",
    "poker", "porn", "replica", "sex", "slots", "spam", "viagra", "warez", "xxx",
)
PRIOR, PRIOR_SHARE = 20, 0.01
#: A word is a compound if words so many times as frequent as itself make it up.
COMPOUND = 10
#: A label of so many hosts is a word.
SHARED = 3
#: Copies of the dictionary that names are dealt to when they look up the words in them.
COPIES = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key with more than this share of all rows is joined by broadcast, so there are at most 1000 such keys.
HOT_SHARE = 1000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _rules_by_length(rules):
    """(verdict, rule, host, path), the longest rule first."""
    ordered = sorted(rules, key=lambda x: (-len(x[1]), x[1]))
    return [(verdict, rule, rule[: rule.index("/")], rule[rule.index("/") :]) for verdict, rule in ordered]


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits and its verdict, or nulls."""
    rule = verdict = None
    for v, r, h, p in _rules_by_length(rules):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, r) if rule is None else rule.when(fits, r)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def raw_tokens(host: Column, path: Column) -> Column:
    """Lower-case runs of letters of the host without its last label, and of the path."""
    named = F.regexp_replace(host, r"(:\d+)?$|\.[^.]*(:\d+)?$", "")
    return F.regexp_extract_all(F.concat_ws("/", named, F.lower(path)), F.lit(r"(\p{L}+)"))


def parted_words(host: Column, path: Column) -> Column:
    labels = F.regexp_extract_all(host, F.lit(r"([^.]*-[^.]*)"))
    return F.regexp_extract_all(F.concat_ws("/", F.concat_ws("/", labels), F.lower(path)), F.lit(r"(\p{L}+)"))


def text_words(html: Column) -> Column:
    """Lower-case words of letters of a page's text: what is outside scripts, styles, comments, tags, entities and names of domains."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&\w+;", " ")
    bare = F.regexp_replace(bare, r"[\p{L}\d-]++(?:\.[\p{L}\d-]++)*\.[a-z]{2,24}\b", " ")
    return F.regexp_extract_all(F.lower(bare), F.lit(r"(\p{L}+)"))


class Segmenter:
    """Unigram Viterbi: the most probable split of a name into words; a letter outside words costs more than any word, and letters
    outside words next to each other make one token. Of equal splits the one whose last word is longest counts."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = total or sum(counts.values()) or 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.lengths = sorted({len(w) for w in counts}, reverse=True)
        self.unknown = math.log(total) + 5

    def split(self, name: str) -> list[str]:
        best, last = [0.0] * (len(name) + 1), [0] * (len(name) + 1)
        for end in range(1, len(name) + 1):
            least, at = math.inf, end - 1
            for n in self.lengths:
                c = self.cost.get(name[end - n : end]) if n <= end else None
                if c is not None and best[end - n] + c < least:
                    least, at = best[end - n] + c, end - n
            if best[end - 1] + self.unknown < least:
                least, at = best[end - 1] + self.unknown, end - 1
            best[end], last[end] = least, at
        parts, end = [], len(name)
        while end:
            parts.append(name[last[end] : end])
            end = last[end]
        out, unknown = [], ""
        for part in reversed(parts):
            if part in self.cost:
                out += [unknown, part] if unknown else [part]
                unknown = ""
            else:
                unknown += part
        return [*out, unknown] if unknown else out


def elementary(counts: dict[str, int], factor: int = COMPOUND) -> dict[str, int]:
    """counts without compounds: words that two or more words of counts make up, each `factor` times as frequent or more."""

    def compound(word: str, n: int) -> bool:
        reached = [True] + [False] * len(word)
        for end in range(1, len(word) + 1):
            reached[end] = any(reached[at] and end - at < len(word) and counts.get(word[at:end], 0) >= factor * n for at in range(end))
        return reached[-1]

    return {w: n for w, n in counts.items() if not compound(w, n)}


def unigrams(texts: DataFrame | None, tokens: DataFrame, seeds=SEEDS, prior: int = PRIOR) -> tuple[DataFrame, int]:
    """(part, n): every word of two letters or more of texts(text), of the hyphened names and of the paths of tokens(host, path), and the seed
    words, with counts; and the sum of the counts."""
    words = tokens.select(F.explode(parted_words(F.col("host"), F.col("path"))).alias("part"))
    if texts is not None:
        words = words.unionAll(texts.select(F.explode(text_words(F.col("text"))).alias("part")))
    # labels that many hosts share, such as blog and shop, are words whether texts have them or not: as many as there are such hosts
    labels = tokens.select("host", F.explode(F.split("host", r"\.")).alias("part")).filter(F.rlike("part", F.lit(r"^\p{L}+$"))).distinct()
    shared = labels.groupBy("part").agg(F.count("*").alias("hosts")).filter(F.col("hosts") >= SHARED)
    words = words.unionAll(labels.join(shared, "part", "left_semi").select("part")).filter(F.char_length("part") > 1)
    seeded = tokens.sparkSession.createDataFrame([(s, prior) for s in seeds], "part string, n long")
    counted = words.groupBy("part").agg(F.count("*").alias("n")).unionByName(seeded)
    counts = written(counted.groupBy("part").agg(F.sum("n").alias("n")))
    return counts, counts.agg(F.sum("n")).first()[0]


def joined_by(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with facts(key, n, ...), n the number of rows with a key. Keys of very many rows are few and go by broadcast."""
    most = (facts.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    hot, cold = facts.filter(F.col("n") > most).drop("n"), facts.filter(F.col("n") <= most).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def _parts(lengths: list[int], rows: int = 50_000):
    """(t, token) -> (t, h): hashes of the token's strings of so many letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ts, hs = [], []
        for b in batches:
            for t, token in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n in lengths:
                    if n > len(token):
                        break
                    h = {xxhash.xxh64_intdigest(token[i : i + n].encode(), 42) for i in range(len(token) - n + 1)}
                    ts += [t] * len(h)
                    hs += h
                    if len(hs) >= rows:
                        yield pa.RecordBatch.from_arrays([pa.array(ts, pa.int64()), pa.array(np.array(hs, np.uint64).view(np.int64))], ["t", "h"])
                        ts, hs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ts, pa.int64()), pa.array(np.array(hs, np.uint64).view(np.int64))], ["t", "h"])

    return run


def segmented(tokens: DataFrame, counts: DataFrame, total: int, compounds: int | None = None) -> DataFrame:
    """tokens(row, raw) -> (row, words, at): the words of all names, and the places of the names that split. compounds: how many times as frequent
    words that make up another must be for it to be no entry. Each distinct name is split once, with the dictionary words that are in it: strings of the name and
    words of the dictionary meet by hash, and are compared as strings when the name is split."""
    places = tokens.select("row", F.posexplode("raw").alias("at", "token")).withColumn("t", F.xxhash64("token"))
    names = written(places.groupBy("token").agg(F.count("*").alias("n"), F.first("t").alias("t")))
    lengths = sorted(r.x for r in counts.select(F.char_length("part").alias("x")).distinct().collect())
    inside = names.select("t", "token").mapInArrow(_parts(lengths), "t long, h long")
    # a short word is in very many names: those meet copies of the dictionary, each name one of them
    inside = inside.withColumn("copy", F.pmod("t", F.lit(COPIES)))
    copies = counts.withColumns({"h": F.xxhash64("part"), "copy": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COPIES - 1).cast("long")))})
    met = inside.join(copies, ["h", "copy"]).groupBy("t").agg(F.map_from_entries(F.collect_set(F.struct("part", "n"))).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = []
            for t, known in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
                inside = {w: n for w, n in known or () if w in t}
                split.append(Segmenter(elementary(inside, compounds) if compounds else inside, total).split(t))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(split, pa.list_(pa.string()))], ["t", "n", "split"])

    splits = written(names.join(met, "t", "left").select("t", "n", "token", "known").mapInArrow(run, "t long, n long, split array<string>"))
    found = joined_by(places.select("row", "at", "t"), splits, "t").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "split"))).alias("found"))
    apart = F.transform(F.filter("found", lambda x: F.size(x["split"]) > 1), lambda x: x["at"])
    return found.select("row", F.flatten("found.split").alias("words"), apart.alias("at"))


def bayes(words: DataFrame, seeds=SEEDS, prior: int = PRIOR) -> tuple[float, DataFrame]:
    """words(words, label) -> log prior odds, and (w, n, ratio): log likelihood ratios of block over allow of every word, with add-one
    smoothing and the seeds' prior. n counts the word in all urls, labelled or not."""
    bad, good = F.coalesce(F.col("label") == "block", F.lit(False)), F.coalesce(F.col("label") == "allow", F.lit(False))
    n = words.agg(F.count_if(bad).alias("b"), F.count_if(good).alias("g")).first()
    each = words.select(F.explode("words").alias("w"), bad.cast("long").alias("b"), good.cast("long").alias("g"), F.lit(1).cast("long").alias("n"))
    counted = written(each.groupBy("w").agg(*(F.sum(c).alias(c) for c in "bgn")))
    prior = max(prior, round(PRIOR_SHARE * (counted.agg(F.sum("b")).first()[0] or 0)))
    counted = counted.unionByName(words.sparkSession.createDataFrame([(s, prior, 0, 0) for s in seeds], "w string, b long, g long, n long"))
    counted = written(counted.groupBy("w").agg(*(F.sum(c).alias(c) for c in "bgn")))
    sums = counted.agg(F.sum("b").alias("b"), F.sum("g").alias("g"), F.count("*").alias("words")).first()
    ratio = F.log((F.col("b") + 1) / F.lit(float(sums.b + sums.words))) - F.log((F.col("g") + 1) / F.lit(float(sums.g + sums.words)))
    return math.log((n.b + 1) / (n.g + 1)), counted.select("w", "n", ratio.alias("ratio"))


def judge(pages: DataFrame, url: str = "url", html: str | None = "html", rules=RULES, learn: Column | None = None, texts: DataFrame | None = None, compounds: int | None = None, seeded: bool = False) -> DataFrame:
    """pages with host, path, rule, words, block_score (log odds of block) and verdict, in place of any columns of those names. learn: which
    of the pages that a rule fits are learned from; all as a rule. texts: what the dictionary is counted in, a table with the column html;
    pages as a rule. compounds: see segmented(). seeded: whether urls without a rule that part an unwanted word off are learned from as blocked. Columns of pages go through exchanges, so large ones that are not needed are better left out of it."""
    learns = F.coalesce(learn, F.lit(False)) if learn is not None else F.lit(True)
    read = pages.select(packed_row(pages).alias("page"), host_of(F.col(quoted(url))).alias("host"), path_of(F.col(quoted(url))).alias("path"), learns.alias("learns"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    counts, total = unigrams((texts if texts is not None else pages).select(F.col(quoted(html)).alias("text")) if html else None, read)
    tokens = read.withColumns({"raw": raw_tokens(F.col("host"), F.col("path")), "rule": rule, "ruled": verdict, "row": F.monotonically_increasing_id()})
    tokens = written(tokens)
    found = segmented(tokens, counts, total, compounds)
    words = written(tokens.join(found, "row", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>"))))
    if compounds:
        names = F.transform(F.coalesce("at", F.array().cast("array<int>")), lambda i: F.get(F.col("raw"), i))
        words = words.withColumn("scored", F.concat("words", names))
    else:
        words = words.withColumn("scored", F.col("words"))
    unwanted = F.arrays_overlap("raw", F.array(*map(F.lit, SEEDS)))
    label = F.coalesce("ruled", F.when(unwanted, "block")) if seeded else F.col("ruled")
    odds, ratio = bayes(words.select(F.col("scored").alias("words"), F.when(F.col("learns"), label).alias("label")))
    # sorted, so that the sum does not depend on the order in which rows arrive
    ratios = joined_by(words.select("row", F.explode("scored").alias("w")), ratio, "w").groupBy("row").agg(F.array_sort(F.collect_list("ratio")).alias("ratios"))
    score = F.aggregate(F.coalesce("ratios", F.array().cast("array<double>")), F.lit(float(odds)), lambda s, x: s + x)
    scored = words.join(ratios, "row", "left").withColumn("block_score", score)
    judged = F.when(F.col("block_score") > 0, "block").otherwise("allow")
    new = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("rule"), "words": F.col("words"), "block_score": F.col("block_score"), "verdict": F.coalesce("ruled", judged)}
    return scored.select(*unpacked_row(F.col("page"), [c for c in pages.columns if c not in new]), *(v.alias(k) for k, v in new.items()))


def held_out_accuracy(pages: DataFrame, page_id: str = "page_id", rules=RULES, **options) -> DataFrame:
    """One row: how many of the urls that a rule fits were kept from learning (by a hash of the id), and the share on which the model agrees with
    the rule."""
    kept = F.crc32(F.col(page_id).cast("string")) % 4 != 2
    found = judge(pages.drop("html"), rules=rules, learn=kept, texts=pages, **options).filter(~kept & F.col("rule").isNotNull())
    agrees = F.when(F.col("block_score") > 0, "block").otherwise("allow") == F.col("verdict")
    return found.agg(F.count("*").alias("n"), F.avg(agrees.cast("double")).alias("accuracy"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages.select("page_id", "url"), texts=pages.select("html"), compounds=COMPOUND, seeded=True).select("page_id", "host", "path", "rule", "verdict", "words", "block_score")


def split_url(url: str | None) -> tuple[str, str]:
    """Plain version of host and path, for tests."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
