"""Removal of benchmark passages from training texts by a suffix automaton of the test items.

A shard of items becomes one generalised suffix automaton over word numbers: every run of words of an item is a path from its root. A
task streams the words of its documents through the automaton and follows the longest run that ends at each word and also stands in an
item. Where that run has as many words as a window, or ends with all words of a shorter item, the words under it are hit, and the state
tells which items hold it. Shards are bounded by bytes, whatever the number of items, so what is broadcast is bounded; with several
shards each streams over the documents and their spans are united by document. No document or word is shuffled but those that are hit.

Defined results: null and empty text, and text without a word, has no words and is never hit. Items without a word match nothing. Rows with
equal item ids are one item; an item with a null id hits words and is not listed. Repeated documents and ids are judged row by
row. Texts of any length are streamed whole. Of documents any column is carried along, those named like the result's are replaced. Empty
tables of documents give no rows, empty tables of items leave all documents clean.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copresence.llm.common import packed_row, quoted, table, unpacked_row, written

WINDOW = 10
#: Bytes of normalised items that one automaton holds, which takes some 100 MB; words of a piece that a long item is cut into.
SHARD_BYTES, PIECE_WORDS = 1 << 20, 20_000
#: Bytes of words as they are, A-Z in lower case, all others as spaces.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
A_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SPANS = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("matched", "integer"))
NAMES = T.ArrayType(T.StringType())


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class Automaton:
    """Suffix automaton of several word sequences, and what it takes to name the items under a match."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.number = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(i, w) for i, w in items if w]
        coded = [(i, [self.number.setdefault(x, len(self.number)) for x in w]) for i, w in items]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        # the state of each window of an item, and of each item shorter than one, with the items that it names
        self.named: dict[int, set[str]] = {}
        self.whole: dict[int, dict[int, set[str]]] = {}
        for item, codes in coded:
            state = 0
            for k, c in enumerate(codes, 1):
                state = self.next[state][c]
                if k >= window:
                    state = self._cut(state, window)
                    self._name(self.named.setdefault(state, set()), item)
            if len(codes) < window:
                self._name(self.whole.setdefault(state, {}).setdefault(len(codes), set()), item)
        # the nearest state at or above each that holds a short item
        self.above = [-1] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.above[v] = v if v in self.whole else self.above[self.link[v]]
        self.least = min([window] * any(len(c) >= window for _, c in coded) + [len(c) for _, c in coded if len(c) < window], default=0)

    @staticmethod
    def _name(names: set[str], item: str | None) -> None:
        if item is not None:
            names.add(item)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state of its own for the runs of q that end p's."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        """The state of what `last` stands for and c behind it."""
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _cut(self, state: int, length: int) -> int:
        """The state of the last `length` words of a run of state."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], set[str]]:
        """(first word, end, longest match) of each stretch of hit words, and the items in it."""
        found: list[tuple[int, int, int]] = []
        names: set[str] = set()
        if not self.least or len(words) < self.least:
            return [], names
        codes = list(map(self.number.get, words))
        following, link, length, window, above = self.next, self.link, self.length, self.window, self.above
        state = matched = 0
        for k, c in enumerate(codes, 1):
            if c is None:
                state = matched = 0
                continue
            to = following[state].get(c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = following[state].get(c)
            state, matched = to, matched + 1  # the root knows every word of the items
            hit = 0
            if matched >= window:
                hit = window
                names |= self.named[self._cut(state, window)]
            v = above[state]
            while v > 0:
                for size, items in self.whole[v].items():
                    if size <= matched:
                        hit = max(hit, size)
                        names |= items
                v = above[link[v]]
            if hit:
                start, longest = k - hit, min(matched, k)
                while found and found[-1][1] >= start:
                    before = found.pop()
                    start, longest = min(start, before[0]), max(longest, before[2])
                found.append((start, k, longest))
        return found, names


def _pieces(window: int):
    """(item, text) -> normalised pieces: a long item is cut into pieces that overlap by a window less a word, which keeps its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items, texts = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(text)
                for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    if piece := words[at : at + PIECE_WORDS + window - 1]:
                        items.append(item)
                        texts.append(b" ".join(piece))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.binary())], ["item", "words"])

    return run


def shards(items: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text", most_bytes: int = SHARD_BYTES) -> list[Broadcast]:
    """Normalised items in broadcasts of at most most_bytes, or one piece; the driver takes one shard at a time."""
    context = items.sparkSession.sparkContext
    read = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    pieces = written(read.mapInArrow(_pieces(window), "item string, words binary").distinct())
    size = F.octet_length("words")
    total = pieces.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n"), F.coalesce(F.max(size), F.lit(0)).alias("most")).first()
    parts, bound = max(1, -(-total.n // most_bytes)), max(most_bytes, total.most)
    while True:
        dealt = pieces.withColumn("part", F.pmod(F.xxhash64("item", "words"), F.lit(parts)))
        sizes = {r.part: r.n for r in dealt.groupBy("part").agg(F.sum(size).alias("n")).collect()}
        if max(sizes.values(), default=0) <= bound:
            break
        parts *= 2
    return [context.broadcast([(r.item, bytes(r.words)) for r in dealt.filter(F.col("part") == p).toLocalIterator()]) for p in sorted(sizes)]


_BUILT: list = [None, 0, None]


def _automaton(shard: Broadcast, window: int) -> Automaton:
    """The automaton of a shard; a worker keeps one."""
    if _BUILT[0] is not shard or _BUILT[1] != window:
        _BUILT[:] = shard, window, Automaton([(i, w.split()) for i, w in shard.value], window)
    return _BUILT[2]


def _united(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for a, b, m in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), max(m, out[-1][2]))
        else:
            out.append((a, b, m))
    return out


def matched(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", most_bytes: int = SHARD_BYTES) -> DataFrame:
    """(row, text, n_words, spans, items): row has the columns of docs but the text; spans are stretches of hit words (first, end, longest
    match), items the sorted ids of the items with windows in the text."""
    kept = docs.select(packed_row(docs, text).alias("row") if len(docs.columns) > 1 else F.struct(F.lit(1).alias("_")).alias("row"), F.col(quoted(text)).cast("string").alias("text"))
    rows = kept.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast(SPANS), "items": F.array().cast(NAMES)})
    parts = shards(items, window, item_id, item_text, most_bytes) or [docs.sparkSession.sparkContext.broadcast([])]
    for k, shard in enumerate(parts):

        def run(batches: Iterator[pa.RecordBatch], shard=shard) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shard, window)
            for b in batches:
                counts, spans, names = [], b.column(3).to_pylist(), b.column(4).to_pylist()
                for i, t in enumerate(b.column(1).cast(pa.binary())):
                    words = words_of(t.as_py())
                    counts.append(len(words))
                    found, named = automaton.spans(words)
                    if found:
                        before = [(s["start"], s["end"], s["matched"]) for s in spans[i]]
                        spans[i] = [{"start": x, "end": y, "matched": m} for x, y, m in _united(before + found)]
                        names[i] = sorted(named.union(names[i]))
                new = [pa.array(counts, pa.int64()), pa.array(spans, b.column(3).type), pa.array(names, b.column(4).type)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *new], b.schema.names)

        rows = rows.mapInArrow(run, rows.schema)
        if k + 1 < len(parts):
            rows = written(rows)
    return rows


def n_hit(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, n_words, spans, items) -> (row, text): the bytes from the first to the last word of each span go."""
    for b in batches:
        texts = b.column(1).cast(pa.binary()).to_pylist()
        for i, spans in enumerate(b.column(3).to_pylist()):
            if spans:
                at = [m.span() for m in A_WORD.finditer(texts[i])]
                kept, after = [], 0
                for s in spans:
                    kept.append(texts[i][after : at[s["start"]][0]])
                    after = at[s["end"] - 1][1]
                texts[i] = b"".join([*kept, texts[i][after:]])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["row", "text"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = 0.5, text: str = "text", **names) -> DataFrame:
    """docs without the spans that match a window of an item or a whole shorter item; documents of whose words such spans cover over
    `coverage` go whole."""
    found = matched(docs, items, window, text, **names).filter(n_hit() <= F.col("n_words") * F.lit(coverage))
    schema = T.StructType([f for f in found.schema.fields if f.name in ("row", "text")])
    return found.mapInArrow(_without, schema).select(*unpacked_row(F.col("row"), docs.columns, **{text: F.col("text")}))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    found = matched(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "row.doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH normal AS (
  SELECT 'd' AS kind, doc_id::VARCHAR AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'i', item_id::VARCHAR, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), worded AS (
  SELECT kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM normal
), windows AS (
  SELECT DISTINCT id AS item, n, array_to_string(w[i : i + n - 1], ' ') AS words
  FROM (SELECT id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM worded WHERE kind = 'i' AND len(w) > 0)
), runs AS (
  SELECT id, i, n, array_to_string(w[i : i + n - 1], ' ') AS words
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM worded, (SELECT DISTINCT n FROM windows) WHERE kind = 'd' AND len(w) >= n)
), met AS (
  SELECT id, i, n, item FROM runs JOIN windows USING (n, words)
), hits AS (
  SELECT id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT id, unnest(range(i, i + n)) AS k FROM met) GROUP BY id
), named AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT id, item FROM met) GROUP BY id
)
SELECT id::BIGINT AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN hits USING (id) LEFT JOIN named USING (id) WHERE kind = 'd'
"""
