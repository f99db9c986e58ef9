"""Spelling variants: words one inserted, deleted or replaced letter apart, found by Aho-Corasick over halves of words.

Of two words one edit apart, the edit misses one half of the one: its first half starts the other, or its second half ends it. Shards
of the vocabulary hold both halves of every word in an automaton; every word is scanned by the shards it can match, a match must stand at
the offset of its half in a word whose length differs by one at most, and the distance is verified. Since many words share a half, what
an automaton holds at a half is keyed by a part of the other half as well: one edit misses one part of that too. Words are dealt
to shards by the hash of half and part, so words that share a half spread over many tasks, and a task gets a word some 16 times at most.

Words are counted in the tasks first, so that a frequent word costs a row a task. Vocabulary, links and forms stay distributed; forms are
followed to their roots by doubling joins, as many as the largest count allows, since each form is used five times as often.

Defined results: null and empty texts have no words. A null doc_id counts as an empty string in the hash that says which letters are
dropped; repeated rows and ids count each. Texts of any length are read whole. Ties of counts go to the smaller word in code-point order.
Extra columns are not read. An empty table, or one without frequent words, gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copresence.llm.common import table, written

LEAST_LETTERS, LEAST_COUNT, FACTOR, DROP_ONE_IN = 6, 5, 5, 199
#: Distinct words that a task counts before it gives them out; rows of the words that a shard holds or scans.
HELD, SHARD_ROWS = 500_000, 200_000
#: Letters of Latin-1 as they are, A-Z in lower case, all else as spaces.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters up to U+00FF, a byte a letter (Latin-1)."""
    return (text or "").encode("latin-1", "replace").translate(LETTERS).split()


def dropped(word: bytes, start: int, one_in: int) -> bytes:
    """The word, or where one_in divides its hash, the word without a letter. start: the CRC-32 of what stands before it."""
    h = crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _counted(least_letters: int, one_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def given_out() -> Iterator[pa.RecordBatch]:
            words, n = [w.decode("latin-1") for w in counts], list(counts.values())
            counts.clear()
            for at in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.string()), pa.array(n[at : at + 50_000], pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # a shorter run only gets shorter
                for word, n in Counter(w for w in words_of(text) if len(w) >= least_letters).items():
                    word = dropped(word, start, one_in)
                    if len(word) >= least_letters:
                        counts[word] += n
                if len(counts) > HELD:
                    yield from given_out()
        yield from given_out()

    return run


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, one_in: int = DROP_ONE_IN) -> DataFrame:
    """(word, n): words of at least so many letters that occur so often."""
    read = docs.select(F.col(doc_id).cast("string"), F.col(text).cast("string"))
    return read.mapInArrow(_counted(least_letters, one_in), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def parts(word: str, length: int | None = None, tail: bool = False) -> Iterator[tuple[int, str, str]]:
    """(kind, half, part) of a word as one of `length` letters would be cut. Kinds: the first half and the part behind it, the first half and
    the part that ends the word, the second half and the part before it, the second half and the part that starts the word."""
    length = len(word) if length is None else length
    half = length // 2  # letters of the first half
    rest = length - half
    c, e = rest // 2, half // 2  # letters of the first part of either half
    n = len(word)
    yield 0, word[:half], word[half : half + c]
    yield 1, word[:half], word[n - (rest - c) :]
    yield 2, word[n - rest :], word[n - rest - (half - e) : n - rest]
    yield 3, word[n - rest :], word[:e]


def one_apart(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter makes a into b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _dealt(least_letters: int):
    """(word, n) -> (deal, held, kind, word, n): a row for each key of a held word, and for each key that a word has as one that is scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(key, True, kind, word, n) for kind, key in _keys(word, len(word))]
                scanned = {key for k in (-1, 0, 1) if len(word) + k >= least_letters for _, key in _keys(word, len(word) + k)}
                rows += [(key, False, None, word, n) for key in scanned]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.bool_(), pa.int8(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["deal", "held", "kind", "word", "n"])

    return run


def _keys(word: str, length: int) -> list[tuple[int, int]]:
    return [(kind, crc32(f"{kind}/{length}/{half}/{part}".encode())) for kind, half, part in parts(word, length)]


class Shard:
    """An automaton over halves of words. At a half: (kind, length of the word, part of the other half) -> words and counts."""

    def __init__(self, held: list[tuple[int, str, int]]):
        from ahocorasick import Automaton

        self.automaton = Automaton()
        halves: dict[str, dict] = defaultdict(dict)
        for kind, word, n in held:
            _, half, part = next(x for x in parts(word) if x[0] == kind)
            halves[half].setdefault((kind, len(word), part), []).append((word, n))
        for half, words in halves.items():
            self.automaton.add_word(half, (len(half), words))
        if halves:
            self.automaton.make_automaton()

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Words one edit from this one, each once: by the first kind of key that they share."""
        if not len(self.automaton):
            return
        last = len(word) - 1
        for end, (size, words) in self.automaton.iter(word):
            starts, ends = end + 1 == size, end == last
            if not (starts or ends):
                continue
            for length in (last, last + 1, last + 2):
                if length // 2 != size and length - length // 2 != size:
                    continue
                keys = list(parts(word, length))
                for kind, half, part in keys:
                    if len(half) == size and (starts if kind < 2 else ends):
                        for other, n in words.get((kind, length, part), ()):
                            if one_apart(word, other) and not any(x == y for x, y in zip(keys[:kind], parts(other), strict=False)):
                                yield other, n


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by deal -> (word, near, near_n). A shard is a stretch of deals."""

    def links(held: list, scanned: set[str]) -> pa.RecordBatch:
        shard = Shard(held)
        found = [(word, other, n) for word in scanned for other, n in shard.near(word)]
        columns = list(zip(*found, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "near", "near_n"])

    held, scanned, rows, last = [], set(), 0, None
    for b in batches:
        for deal, is_held, kind, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if deal != last and rows >= SHARD_ROWS:
                yield links(held, scanned)
                held, scanned, rows = [], set(), 0
            last, rows = deal, rows + 1
            if is_held:
                held.append((kind, word, n))
            else:
                scanned.add(word)
    yield links(held, scanned)


def near_words(words: DataFrame, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """words(word, n), a row a word -> (word, near, near_n): every pair of words one edit apart, both ways."""
    dealt = words.mapInArrow(_dealt(least_letters), "deal long, held boolean, kind byte, word string, n long")
    return dealt.repartition("deal").sortWithinPartitions("deal").mapInArrow(_linked, "word string, near string, near_n long")


def roots(forms: DataFrame, most_steps: int) -> DataFrame:
    """forms(word, form) without cycles -> (word, root): the last form of each. most_steps: of the longest way."""
    now = forms.select("word", F.col("form").alias("root"))
    reached = 1
    while reached < most_steps:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("on"))
        now = written(now.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("on", "root").alias("root")))
        reached *= 2
    return now


def variants(words: DataFrame, factor: int = FACTOR, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """words(word, n) -> (word, n, n_near, form, form_n, root)."""
    best = F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best")
    near = near_words(words, least_letters).groupBy("word").agg(F.count("*").alias("n_near"), best)
    usual = -F.col("best.k") >= factor * F.col("n")
    judged = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(usual, F.col("best.near")).alias("form"), F.when(usual, -F.col("best.k")).alias("form_n"),
    ))
    span = judged.filter("form IS NOT NULL").agg(F.min("n").alias("a"), F.max("form_n").alias("b")).first()
    steps, n = 0, span.a
    while n is not None and (n := n * factor) <= span.b:
        steps += 1
    last = roots(judged.filter("form IS NOT NULL"), steps)
    return judged.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all words of all documents."""
    return variants(written(vocabulary(table(spark, sf_dir, "documents", "doc_id", "text"))))
