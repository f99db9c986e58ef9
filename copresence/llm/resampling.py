"""Quality classifier by importance resampling.

Two bags of hashed word 1-grams and 2-grams, one of target texts and one of all raw texts, are generative models; a text's log weight is
the log ratio of its probability under them, over the whole text. Adding Gumbel noise to the log weights and taking the top k samples k
texts without replacement in proportion to weight.

Defined results: null or empty text has weight 0. Exactly ceil(share * n) rows are kept: ties in the key go to the smaller id, null ids
last, then to the smaller hash of the text, and among rows equal in all of these it does not matter which. Noise is a hash of the id and
the seed, so results can be repeated; rows whose id is null or not their own draw noise of their own, by their place in the table. Without
target texts all weights are 0. Extra columns of any names are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copresence.llm.common import table, written

BUCKETS = 10_000
TOKEN = re.compile(r"\w+|[^\w\s]")
_PAIR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """Hash of each distinct word, kept in a table of bounded size."""

    def __missing__(self, word: str) -> int:
        out = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 7)
        return out

    def of(self, words: list[str], limit: int = 500_000) -> np.ndarray:
        if len(self) > limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_WORDS = WordHashes()


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of each word and word pair."""
    h = _WORDS.of(TOKEN.findall((text or "").lower()))
    pairs = (h[:-1] * _PAIR) ^ (h[1:] + _MIX)
    pairs = (pairs ^ (pairs >> np.uint64(29))) * _MIX
    return (np.concatenate([h, pairs ^ (pairs >> np.uint64(32))]) % np.uint64(buckets)).astype(np.int64)


def bag(docs: DataFrame, text: str, buckets: int) -> np.ndarray:
    """Counts of all features of all docs: each task sums its own before they are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                total += np.bincount(features(t, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in counted:
        out[r.bucket] = r.n
    return out


def log_ratios(raw: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket's probability, with add-one smoothing; zeros without target texts."""
    if not wanted.any():
        return np.zeros(len(raw))
    return np.log((wanted + 1) / (wanted.sum() + len(raw))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def weights(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, th, weight): the log weight of each row, and a hash of its text."""
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(bag(docs, text, buckets), bag(target, text, buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [float(shared.value[features(t, buckets)].sum()) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(out, pa.float64())], ["doc_id", "th", "weight"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), F.col(text).alias("text"))
    return given.mapInArrow(run, "doc_id long, th long, weight double")


def keep_top(rows: DataFrame, key: str, share: float, most_tied: int = 100_000) -> DataFrame:
    """rows(doc_id, th, ...) with `kept`: true for exactly ceil(share * n) rows, the largest by key, then smallest by id (null last) and th.
    The order is turned into whole numbers one after another, and the kth of each is found by narrowing ranges with a thousand counts at
    a time; so no task ever sorts more than the rows that are equal in all of them, in salted parts."""
    n = rows.count()
    k = int(np.ceil(share * n))
    if k >= n:
        return rows.withColumn("kept", F.lit(True))
    last = F.lit((1 << 63) - 1)
    edge, above = F.lit(True), 0
    wins = F.lit(False)
    for column in (-F.col(key), F.coalesce(F.col("doc_id"), last), F.col("th")):
        tied = rows.filter(edge).select(column.alias("x"))
        value, before = _kth(tied, k - above)
        wins = wins | (edge & (column < F.lit(value)))
        edge = edge & (column == F.lit(value))
        above += before
    same = rows.filter(edge).count()
    if above + same == k:
        return rows.withColumn("kept", wins | edge)
    # equal in all: so many of each part of them, by their place in it
    parts = max(1, -(-same // most_tied))
    marked = rows.withColumns({"edge": edge, "wins": wins, "part": F.when(edge, F.pmod(F.monotonically_increasing_id(), F.lit(parts)))})
    marked = written(marked)
    sizes = {r.part: r.n for r in marked.filter("edge").groupBy("part").agg(F.count("*").alias("n")).collect()}
    need, quota = k - above, {}
    for part, size in sorted(sizes.items()):
        quota[part] = min(size, need)
        need -= quota[part]
    limit = F.create_map(*(F.lit(x) for pair in sorted(quota.items()) for x in pair))[F.col("part")]
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.lit(0)))
    chosen = marked.filter("edge").withColumn("kept", place <= limit)
    return chosen.unionByName(marked.filter("NOT edge").withColumn("kept", F.col("wins"))).drop("edge", "wins", "part")


def _kth(rows: DataFrame, k: int, cells: int = 1000):
    """The kth smallest x of rows(x), and how many are smaller."""
    low, high = rows.agg(F.min("x"), F.max("x")).first()
    before = 0
    while low < high:
        # by doubles, so that ranges of whole numbers of 64 bits do not overflow
        width = (float(high) - float(low)) / cells
        x = F.col("x").cast("double")
        cell = F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor((x - F.lit(float(low))) / F.lit(width)))) if width > 0 else F.lit(0)
        inside = rows.filter((F.col("x") >= F.lit(low)) & (F.col("x") <= F.lit(high))).select("x", cell.alias("cell"))
        counts = inside.groupBy("cell").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("cell").collect()
        for r in counts:
            if before + r.n >= k:
                break
            before += r.n
        if (r.low, r.high) == (low, high):  # doubles tell no more apart: by halves
            middle = (low + high) // 2 if isinstance(low, int) else low
            n = rows.filter((F.col("x") >= F.lit(low)) & (F.col("x") <= F.lit(middle))).count()
            if before + n >= k:
                high = middle
            else:
                before += n
                low = rows.filter(F.col("x") > F.lit(middle)).agg(F.min("x")).first()[0]
        else:
            low, high = r.low, r.high
    return low, before


def noise(doc_id, own, place, seed: int):
    """Gumbel noise from a hash of the id; of rows without an id of their own, from that of their place too."""
    unit = (F.pmod(F.when(own, F.xxhash64(doc_id, F.lit(seed))).otherwise(F.xxhash64(doc_id, place, F.lit(seed))), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    return -F.log(-F.log(unit))


def resample(docs: DataFrame, target: DataFrame, share: float = 0.85, seed: int = 17) -> DataFrame:
    """(doc_id, weight, key, kept) of each row of docs(doc_id, text): a sample of exactly ceil(share * n) rows."""
    weighed = written(weights(docs, target).withColumn("place", F.monotonically_increasing_id()))
    shared = weighed.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("of"))
    own = F.col("doc_id").isNotNull() & F.col("of").isNull()
    marked = weighed.join(shared, F.col("doc_id") == F.col("of"), "left")
    keyed = marked.withColumn("key", F.col("weight") + noise(F.col("doc_id"), own, F.col("place"), seed)).select("doc_id", "th", "weight", "key")
    return keep_top(written(keyed), "key", share).drop("th")


def bounded_sample(ids: DataFrame, most: int, seed: int = 5) -> DataFrame:
    """About `most` of ids(doc_id) at most, by a hash of the id; all of them if there are no more."""
    n = ids.count()
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return ids.filter(chance < F.lit(most / max(n, 1)))


def op7_quality_resampling(spark: SparkSession, sf_dir: str, target_rows: int = 20_000) -> DataFrame:
    """Weight, noisy key and verdict of every document. The target model is fitted on documents labelled as good, about `target_rows`
    at most: their ids are few enough to broadcast, so no text is shuffled. The raw model counts every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    good = table(spark, sf_dir, "labels", "doc_id", "quality").filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return resample(docs, docs.join(F.broadcast(bounded_sample(good, target_rows)), "doc_id", "left_semi"))
