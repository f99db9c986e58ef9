"""Near-duplicate documents by SimHash fingerprints, found with Golay-code fuzzy keys.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits. Of two errors or fewer, at least one segment has none, and in
any other segment there are at most two; so fingerprints that link share the key (segment without error, Golay index of another
segment), see golay.keys. Distinct fingerprints are joined on those keys and verified; keys with very many fingerprints are
handled by bit flips instead, which is exact too and bounds every group by 65.

Defined results: null or empty text, or text without a word, has fingerprint zero and is linked like any other. Rows with a null id
link others like any row and get their component's id, which is null where no row of the component has one. Repeated rows and
repeated ids count once and are returned each. Extra columns do not matter: only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copresence.llm import golay
from copresence.llm.common import table, written
from copresence.llm.components import components

SEED, WIDTH, MOST_BITS = 42, 3, 2
#: A key with more distinct fingerprints than this goes the way of bit flips.
HEAVY_KEY = 128


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 of each shingle of a text in order, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -width] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(shingle_hashes(t.as_py())) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _segments(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u = fp.view(np.uint64)
    low = np.uint64((1 << golay.BITS) - 1)
    return tuple(x.astype(np.int64) for x in (u & low, (u >> np.uint64(23)) & low, u >> np.uint64(46)))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, fp) -> (key, first, fp) for each fuzzy key."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            b = whole.slice(at, 2000)
            first, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
            a, m, c = _segments(fp)
            ga, gm = golay.keys(a), golay.keys(m)
            for kind, (exact, fuzzy) in enumerate(((a, gm), (m, ga), (c, ga))):
                row, column = np.nonzero(fuzzy >= 0)
                key = (np.int64(kind) << 60) | (exact[row] << 12) | fuzzy[row, column]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(first[row]), pa.array(fp[row])], ["key", "first", "fp"])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, for links a[i] - b[i] among n nodes."""
    root = np.arange(n)
    while True:
        old = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, old[a], low)
        np.minimum.at(root, old[b], low)
        root = root[root]
        if np.array_equal(root, old):
            return root


def _linked(keys: np.ndarray, first: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    """Star links of each group of equal (sorted) keys: pairs are tested at growing distance and merged before they are given out."""
    at, a, b, distance = np.arange(len(keys)), [], [], 0
    while len(at):
        distance += 1
        at = at[at + distance < len(keys)]
        at = at[keys[at] == keys[at + distance]]
        near = np.bitwise_count(fp[at].view(np.uint64) ^ fp[at + distance].view(np.uint64)) <= MOST_BITS
        a.append(at[near])
        b.append(at[near] + distance)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    root = _roots(len(keys), a, b)
    member = np.flatnonzero(root != np.arange(len(keys)))
    return pa.RecordBatch.from_arrays([pa.array(first[root[member]]), pa.array(first[member])], ["a", "b"])


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> links. The last group of a batch waits for the next one."""
    rest = None
    for b in batches:
        now = [c.to_numpy() for c in b.columns]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        if not len(now[0]):
            continue
        cut = np.searchsorted(now[0], now[0][-1])
        rest = [c[cut:] for c in now]
        if cut:
            yield _linked(*(c[:cut] for c in now))
    if rest is not None:
        yield _linked(*rest)


def _flip_links(heavy: DataFrame) -> DataFrame:
    """heavy(first, fp): fingerprints within 2 bits share a value within 1 bit of both. Each value has 65 fingerprints at most."""
    flips = F.array(F.lit(0).cast("long"), *(F.expr(f"shiftleft(1L, {i})") for i in range(64)))
    near = heavy.select("first", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("v"))
    met = near.groupBy("v").agg(F.collect_set("first").alias("m")).filter(F.size("m") > 1)
    return met.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).filter("a <> b")


def links(distinct: DataFrame) -> DataFrame:
    """distinct(first, fp), one row a fingerprint -> (a, b): links between `first` values whose components are those of all pairs."""
    keyed = distinct.mapInArrow(_keyed, "key long, first long, fp long")
    heavy_keys = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HEAVY_KEY).select("key")
    light = keyed.join(heavy_keys, "key", "left_anti").repartition("key").sortWithinPartitions("key").select("key", "first", "fp")
    heavy = keyed.join(heavy_keys, "key", "left_semi").select("first", "fp").distinct()
    return light.mapInArrow(_link_groups, "a long, b long").unionAll(_flip_links(heavy))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of each row."""
    prints = written(fingerprints(docs, doc_id, text))
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    # rows without ids link others too, so that fingerprints are the nodes, and ids only name the components
    found = components(links(distinct.select(F.col("fp").alias("first"), "fp")))
    classes = written(distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"))
    named = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(classes.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
