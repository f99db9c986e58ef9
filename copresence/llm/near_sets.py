"""Near-duplicate documents by the Jaccard similarity of their sets of word shingles.

Texts with equal sets are one node. Candidates are found in two ways and verified on the sets themselves. SimHash fingerprints of the
same shingles are linked by their Golay keys, as in the operator on fingerprints: copies with few edits. Two bits miss most pairs of
similarity 0.8, so nodes that share one of BANDS keys of ROWS minimal hashes each are candidates too: a pair misses all
keys with probability (1 - s ** ROWS) ** BANDS at similarity s, which is 0.00007 at 0.8 and less above. First the neighbours in each
key's order are tested, which connects groups of copies without their pairs; large keys are tested in runs, and the runs' heads with
each other. Of keys that then still hold several components, the texts are joined again by prefixes: shingles are ordered by how rare
they are, and sets of similarity 0.8 share one of the rarest fifth of each. This loses no pair, and passages that many texts share, which
make keys large, are no prefixes. Which shingles are rare is told by a table of hashed counts of fixed size; its collisions cost time,
never a pair. Texts of a token's commonest component are not paired with each other, and no pair whose marks (the parity of the number
of shingles that fall on each of 1,024 bits) differ in more bits than sets of that similarity differ in shingles is given out. A token of
more than GRID texts is split: by bands of sizes, of which similar sets lie in the same or the next one, and within a band into the cells
of a grid, so that each pair meets in one cell and no task has to hold a common token whole.

Rows are told apart by id and a hash of their text, ordered by both, null ids last; so rows of one id with different texts are documents
of their own, and rows equal in both are copies.

Defined results: texts without a word have equal, empty sets; a text of fewer words than a shingle is one shingle. Rows with a null id
link like any other; a component without an id has the id null. near_duplicates() returns repeated rows each, keep_first() one of them.
Other columns, of any names, are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copresence.llm.common import packed_row, unpacked_row, written
from copresence.llm.components import components
from copresence.llm.simhash import SEED, fingerprint, shingle_hashes
from copresence.llm.simhash import links as fingerprint_links

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 24, 5
BUCKETS = 1 << 20  # hashed counts of shingles
RUN = 256  # nodes of a key that are put in order together, on average
MARKS = 16  # 64-bit words of a set's marks
GRID = 2048  # texts of a token, on average, on either side of a cell

_random = np.random.default_rng(SEED)
_FLIP, _ODD, _MIX = (_random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1) for _ in range(3))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    return np.unique(shingle_hashes(text, width))


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[at : at + 1024] ^ _FLIP[:, None]) * _ODD[:, None]).min(1), out=least)
    return (least * _MIX).reshape(BANDS, ROWS).sum(1, dtype=np.uint64)


LAST = (1 << 63) - 1  # stands for null ids


def _keyed(docs: DataFrame, doc_id: str, text: str) -> list:
    """Columns did, th: the row's identity; and text."""
    body = F.col(text).cast("string")
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("did"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("th"), body.alias("text")]


def _prints(docs: DataFrame, width: int) -> DataFrame:
    """(did, th, node, fp, keys) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, fps, keys = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64), []
            for i, t in enumerate(b.column(2)):
                every = shingle_hashes(t.as_py(), width)
                hashes = np.unique(every)
                nodes[i], fps[i] = node_of(hashes), fingerprint(every)
                keys.append(band_keys(hashes).view(np.int64))
            nodes, fps = (pa.array(c.view(np.int64)) for c in (nodes, fps))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], nodes, fps, pa.array(keys, pa.list_(pa.int64()))], ["did", "th", "node", "fp", "keys"])

    return docs.mapInArrow(run, "did long, th long, node long, fp long, keys array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, hashes) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                sets = [shingle_set(t.as_py(), width) for t in whole.slice(at, 100).column(0)]
                nodes = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"])

    return docs.select("text").mapInArrow(run, "node long, hashes binary")


def _ordered(a: str, b: str) -> list:
    """A pair as columns a and b, the smaller node first."""
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """nodes(node, fp) -> (a, b): stars of nodes whose fingerprints are equal or that Golay keys link."""
    firsts = written(nodes.groupBy("fp").agg(F.min("node").alias("first")).select("first", "fp"))
    equal = nodes.join(firsts, "fp").filter("node <> first").select(*_ordered("first", "node"))
    return equal.unionAll(fingerprint_links(firsts).select(*_ordered("a", "b"))).distinct()


def neighbours(keyed: DataFrame) -> DataFrame:
    """keyed(key, run, node) -> (a, b): neighbours in each run of a key, and the heads of its runs that are neighbours."""
    before = lambda *by: F.lag("node").over(Window.partitionBy(*by).orderBy("node"))
    inside = keyed.select("node", before("key", "run").alias("a"))
    heads = keyed.groupBy("key", "run").agg(F.min("node").alias("node")).select("node", before("key").alias("a"))
    return inside.unionAll(heads).filter("a IS NOT NULL").select("a", F.col("node").alias("b")).distinct()


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs(a, b) whose sets have a Jaccard similarity of `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both / (len(x) + len(y) - both) >= least)
            yield b.select([0, 1]).filter(pa.array(near, pa.bool_()))

    one, two = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _counts(sets: DataFrame) -> np.ndarray:
    """How many of the sets hold a shingle of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 100):
                hashes = np.concatenate([np.frombuffer(v.as_buffer(), np.uint64) for v in b.column(0).slice(at, 100)])
                total += np.bincount((hashes % BUCKETS).astype(np.int64), minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    counted = sets.select("hashes").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.float32)
    counts[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return counts


def prefix(hashes: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The rarest shingles of a set: so many that sets of similarity `least` share one of each other's."""
    size = len(hashes) - math.ceil(least * len(hashes) - 1e-9) + 1
    return hashes[np.lexsort((hashes, counts[hashes % BUCKETS]))][: size if len(hashes) else 0]


def marks(hashes: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles on each bit. Those of two sets differ in no more bits than the sets do in shingles."""
    parity = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % (64 * MARKS), minlength=64 * MARKS) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


MEETING = ["token", "band", "row", "col"]


def in_grid(tokens: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """tokens(token, node, size, cells, ...) as two sides with the columns of MEETING: every pair of a token's rows whose sizes allow a
    similarity of `least` is equal on them exactly once."""
    # a little wider than the ratio of sizes, so that rounding parts no pair by two bands
    band = F.when(F.col("cells") > 1, F.floor(F.log("size") / F.lit(1e-9 - math.log(least)))).otherwise(F.lit(0)).cast("long")
    own, every = F.pmod("node", "cells"), F.explode(F.expr("sequence(0L, cells - 1)"))
    near = F.when(F.col("cells") > 1, F.array(*(band + i for i in (-1, 0, 1)))).otherwise(F.array(band))
    one = tokens.withColumns({"band": band, "row": own}).withColumn("col", every)
    return one, tokens.withColumns({"band": F.explode(near), "col": own}).withColumn("row", every)


def by_prefix(sets: DataFrame, least: float) -> DataFrame:
    """sets(node, root, hashes) -> the pairs(a, b) of different roots that can have a similarity of `least` by a shingle of both
    prefixes, their sizes and what is left of each set there."""
    counts, names = _counts(sets), [f"m{i}" for i in range(MARKS)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [marks(np.frombuffer(v.as_buffer(), np.uint64)) for v in b.column(1)]
            words = np.array(found, np.int64).reshape(-1, MARKS).T
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(w)) for w in words)], ["node", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                hashes = np.frombuffer(b.column(2)[i].as_buffer(), np.uint64)
                first = prefix(hashes, counts, least)
                n = len(first)
                left = len(hashes) - np.arange(n, dtype=np.int64)
                same = [pa.array(np.full(n, v, np.int64)) for v in (b.column(0)[i].as_py(), b.column(1)[i].as_py(), len(hashes))]
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(left), *same], ["token", "left", "node", "root", "size"])

    tokens = written(sets.select("node", "root", "hashes").mapInArrow(run, "token long, left long, node long, root long, size long"))
    marked = written(sets.select("node", "hashes").mapInArrow(mark, ", ".join(f"{c} long" for c in ["node", *names])))
    parts = tokens.groupBy("token", "root").agg(F.count("*").alias("n"))
    commonest = parts.groupBy("token").agg(
        F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("roots"), F.ceil(F.sum("n") / GRID).alias("cells")
    )
    tokens = tokens.join(commonest.filter("roots > 1").drop("roots"), "token").join(marked, "node")
    one, two = in_grid(tokens.withColumn("top", F.col("root") == F.col("most")), least)
    one, two = (
        side.select(*MEETING, *(F.col(c).alias(f"{n}_{c}") for c in ("left", "node", "root", "size", "top", *names)))
        for n, side in (("a", one.filter("NOT top")), ("b", two))
    )
    both = F.col("a_size") + F.col("b_size")
    enough = F.least("a_left", "b_left") * (1 + least) >= both * least - 1e-6
    differ = sum((F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}"))) for m in names), F.lit(0))
    close = differ * (1 + least) <= both * (1 - least) + 1e-6
    once = F.col("b_top") | (F.col("a_node") < F.col("b_node"))
    return one.join(two, MEETING).filter("a_root <> b_root").filter(once & enough & close).select(*_ordered("a_node", "b_node")).distinct()


def _classes(docs: DataFrame, width: int, least: float) -> tuple[DataFrame, DataFrame]:
    """docs(did, th, text) -> (did, th, node) of each row, and (node, first) with the (did, th) that comes first in the node's component."""
    prints = written(_prints(docs, width))
    nodes = written(prints.groupBy("node").agg(F.min(F.struct("did", "th")).alias("first"), F.min("fp").alias("fp"), F.first("keys").alias("keys")))
    near = written(by_fingerprint(nodes.select("node", "fp")))
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = written(keyed.join(shared, "key").select("key", F.expr(f"pmod(node, CEIL(n / {RUN}))").alias("run"), "node"))
    met = keyed.select("node").unionAll(near.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = docs.join(nodes.join(met, "node", "left_semi").select("first.did", "first.th"), ["did", "th"], "left_semi")
    sets = written(_sets(wanted, width).dropDuplicates(["node"]))

    tested = written(neighbours(keyed).unionAll(near).distinct())
    links = written(similar(tested, sets, least))
    found = components(links)
    rooted = keyed.join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    still = rooted.join(open_keys, "key", "left_semi").select("node", "root").distinct()
    apart = by_prefix(written(sets.join(still, "node")), least).join(tested, ["a", "b"], "left_anti")
    found = components(links.unionAll(similar(apart, sets, least)))

    joined = nodes.join(found, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    firsts = joined.groupBy("root").agg(F.min("first").alias("of_all"))
    return prints.select("did", "th", "node"), joined.join(firsts, "root").select("node", F.col("of_all").alias("first"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """(doc_id, component_id) of each row: the smallest id of the documents that similar ones connect."""
    prints, classes = _classes(docs.select(*_keyed(docs, doc_id, text)), width, least)
    found = prints.join(classes, "node", "left")
    null = lambda c: F.nullif(F.col(c), F.lit(LAST))
    return found.select(null("did").alias("doc_id"), null("first.did").alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """One row, the first, of each component."""
    keyed = docs.select(packed_row(docs, text).alias("row"), *_keyed(docs, doc_id, text))
    prints, classes = _classes(keyed.select("did", "th", "text"), width, least)
    firsts = written(classes.select("first.did", "first.th").distinct())
    kept = keyed.join(firsts, ["did", "th"], "left_semi")
    if not prints.join(firsts, ["did", "th"], "left_semi").groupBy("did", "th").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        kept = kept.dropDuplicates(["did", "th"])
    return kept.select(*unpacked_row(F.col("row"), docs.columns, **{text: F.col("text")}))
