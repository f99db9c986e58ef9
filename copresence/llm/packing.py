"""Packing of tokenised documents into as few sequences as possible: linear grouping, then best fit.

Lengths are whole numbers below the capacity, so a histogram describes any corpus, and packing is planned on counts:

1. Documents over the capacity are cut into full pieces, behind a first piece with the rest; full pieces are sequences of their own.
2. Large lengths are put into groups of equal cardinality and rounded up to their group's largest.
3. Configurations of the few rounded sizes are optimised by column generation (linear program over fillings of a sequence), rounded
   down, and what is left over is filled first-fit.
4. Actual lengths take the places of rounded ones, the longest first; what that saves stays free.
5. Small lengths go best-fit into what is free, then into new sequences.

The plan is a table of runs (length, ranks from-to -> sequences, offset), whose size depends on the capacity and the number of groups but
not on the corpus. Pieces find their rank within their length by counting, and their place in the plan by search.

Defined results: null is the empty text, with the end id only. Repeated rows and ids are packed each; rows of a document are told apart
by their pieces only. Extra columns do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copresence.llm.common import table, written

CAPACITY, END_ID = 2048, 0
#: Fixed value: the one special token of the vocabulary, which the library finds inside texts.
SPECIAL = "<|endoftext|>"
#: White space other than spaces and line feeds; and a space next to white space, which joins tokens over the border of words.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
BESIDE_SPACE = re.compile(r"[\s\x1c-\x1f\x85] | [\s\x1c-\x1f\x85]")
#: Characters that any version of Unicode puts into the same classes.
PLAIN = re.compile("[ -~\n\xa1-\xac\xae-\u024f]*")


class WordTable:
    """Distinct word -> little-endian ids, of bounded size; words after the first of a text are kept without their leading space.

    The pre-tokeniser always cuts between a character and a space before another character, so such words are segmented apart. With
    `ranks`, the same vocabulary as a file of ranks, plain words are segmented by the library that reads those; it must agree in all
    entries with the tokenizer, which stays the authority for everything else."""

    def __init__(self, path: str, ranks: str | None = None, limit: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.plain = self._by_ranks(path, ranks) if ranks else None
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def _by_ranks(self, path: str, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        inside = {"".join(letters[b] for b in k): v for k, v in table.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        in_order = all(model["vocab"][a + b] == 256 + i for i, (a, b) in enumerate(merges))
        if inside != {k: v for k, v in model["vocab"].items() if k != SPECIAL} or not in_order:
            raise ValueError("the ranks are not those of the tokenizer")
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _learn(self, table: dict[str, bytes], words: set[str], lead: str) -> None:
        new = words.difference(table)
        plain = {w for w in new if PLAIN.fullmatch(w)} if self.plain else set()
        for w in plain:
            ids = self.plain.encode_ordinary(lead + w)
            table[w] = struct.pack(f"<{len(ids)}I", *ids)
        rest = list(new - plain)
        table.update(zip(rest, self.ids([lead + w for w in rest]), strict=True))

    def words(self, text: str) -> list[str] | None:
        """Words between single spaces, or None for a text that has to be segmented whole."""
        if SPECIAL in text or "  " in text or " \n" in text or "\n " in text or (OTHER_SPACE.search(text) and BESIDE_SPACE.search(text)):
            return None
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.later) > self.limit or len(self.first) > self.limit:
            self.first, self.later = {}, {}
        split = [self.words(t) for t in texts]
        whole = iter(self.ids([t for t, ws in zip(texts, split, strict=True) if ws is None]))
        self._learn(self.first, {ws[0] for ws in split if ws}, "")
        self._learn(self.later, set().union(*(ws[1:] for ws in split if ws)), " ")
        first, later = self.first.__getitem__, self.later.__getitem__
        return [next(whole) if ws is None else first(ws[0]) + b"".join(map(later, ws[1:])) for ws in split]


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: its own where it is printable, else from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    out |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)}
    return [out[b] for b in range(256)]


_TABLES: dict[str, WordTable] = {}


def word_table(tokenizer: str, ranks: str | None) -> WordTable:
    """One table a worker and tokenizer."""
    if tokenizer not in _TABLES:
        _TABLES[tokenizer] = WordTable(tokenizer, ranks)
    return _TABLES[tokenizer]


PIECE_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, capacity: int = CAPACITY) -> list[int]:
    """Starts of the pieces of n ids, and n."""
    head = n % capacity or capacity
    return [0, *range(head, n, capacity), n]


def pieces(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, batch: int = 500
) -> DataFrame:
    """Tokenise and cut: a row a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_table(tokenizer, ranks), np.array([END_ID], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                out = [[] for _ in PIECE_COLUMNS]
                for i, ids in zip(b.column(0).to_pylist(), words.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                    ids += end
                    points = cut_points(len(ids) // 4, capacity)
                    for k, (s, e) in enumerate(zip(points, points[1:], strict=False)):
                        for c, v in zip(out, (i, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, PIECE_TYPES, strict=True)], PIECE_COLUMNS)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, PIECE_SCHEMA)


@dataclass(frozen=True)
class Scheme:
    groups: int = 400
    smallest_large: int = 683  # lengths from here on are large: at most two a sequence
    most_columns: int = 600


def grouped(counts: dict[int, int], groups: int) -> list[tuple[int, int]]:
    """(rounded size, number of items) of groups of about equal cardinality, the largest first. A group may hold part of a length."""
    total, share, out, inside, top = sum(counts.values()), 0, [], 0, None
    share = max(1, -(-total // groups))
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            top = length if inside == 0 else top
            take = min(left, share - inside)
            inside, left = inside + take, left - take
            if inside == share:
                out.append((top, inside))
                inside = 0
    if inside:
        out.append((top, inside))
    merged: dict[int, int] = defaultdict(int)
    for size, n in out:
        merged[size] += n
    return sorted(merged.items(), reverse=True)


def _best_filling(sizes: list[int], prices: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """Most valuable filling of a sequence (knapsack by number of items, all rooms at once), as counts of each size."""
    size = np.array(sizes)
    at = np.arange(capacity + 1)[None, :] - size[:, None]
    worth, choices = np.zeros(capacity + 1), []
    for _ in range(capacity // min(sizes)):
        value = np.where(at >= 0, worth[np.maximum(at, 0)] + prices[:, None], -1)
        best = value.argmax(0)
        top = value[best, np.arange(capacity + 1)]
        better = top > worth + 1e-12
        if not better.any():
            break
        choices.append(np.where(better, best, -1))
        worth = np.where(better, top, worth)
    use, room = [0] * len(sizes), capacity
    for choice in reversed(choices):
        if choice[room] >= 0:
            use[choice[room]] += 1
            room -= sizes[choice[room]]
    return worth[capacity], use


def configurations(demand: list[tuple[int, int]], capacity: int, most_columns: int) -> list[tuple[list[int], int]]:
    """(counts of each size, times) that cover the demand: column generation over fillings, basic solution rounded down, and
    first-fit decreasing for what is left."""
    sizes, need = [s for s, _ in demand], np.array([n for _, n in demand], float)
    m = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(most_columns):
        level = np.linalg.solve(basis, need)
        prices = np.linalg.solve(basis.T, np.ones(m))
        value, use = _best_filling(sizes, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-9:
            break
        direction = np.linalg.solve(basis, np.array(use, float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, np.maximum(level, 0) / direction, np.inf)
        basis[:, int(ratio.argmin())] = use
    level = np.linalg.solve(basis, need)
    plan, left = [], need.astype(np.int64)
    for j in range(m):
        use = np.rint(basis[:, j]).astype(np.int64)
        times = int(np.floor(max(level[j], 0) + 1e-9))
        if times and use.any():
            times = min([times, *(left[use > 0] // use[use > 0])])
            if times > 0:
                plan.append((use.tolist(), int(times)))
                left -= use * times
    while left.any():
        use, room = np.zeros(m, np.int64), capacity
        for i in range(m):
            use[i] = min(left[i], room // sizes[i])
            room -= use[i] * sizes[i]
        times = int(min(left[use > 0] // use[use > 0]))
        plan.append((use.tolist(), times))
        left -= use * times
    return plan


def plan(histogram: dict[int, int], capacity: int = CAPACITY, scheme: Scheme = Scheme()) -> tuple[list[tuple[int, ...]], int]:
    """Runs (length, first rank, last rank + 1, first sequence, offset) and the number of sequences. Rank r of a run goes to sequence
    first + (r - first rank)."""
    counts = {int(k): int(v) for k, v in histogram.items() if v}
    bins: list[tuple[tuple[int, ...], int]] = []  # (lengths in order, number of such sequences)
    if capacity in counts:
        bins.append(((capacity,), counts.pop(capacity)))
    large = {k: v for k, v in counts.items() if k >= scheme.smallest_large}
    small = {k: v for k, v in counts.items() if k < scheme.smallest_large}
    if large:
        demand = grouped(large, scheme.groups)
        supply: list[list[list[int]]] = []  # for each rounded size the actual (length, count), the longest last
        flat = [[k, large[k]] for k in sorted(large, reverse=True)]
        for _, n in demand:
            mine = []
            while n:
                take = min(n, flat[0][1])
                mine.append([flat[0][0], take])
                flat[0][1] -= take
                n -= take
                if not flat[0][1]:
                    flat.pop(0)
            supply.append(mine[::-1])
        for use, times in configurations(demand, capacity, scheme.most_columns):
            places = [i for i, k in enumerate(use) for _ in range(k)]
            while times:
                # as many sequences at a time as take the same actual lengths in all places
                want = {i: use[i] for i in set(places)}
                step = times
                for i, k in want.items():
                    first = supply[i][-1][1]
                    step = min(step, first // k if first >= k else 1)
                lengths = []
                for i in places:
                    lengths.append(supply[i][-1][0])
                    supply[i][-1][1] -= step
                    if not supply[i][-1][1]:
                        supply[i].pop()
                bins.append((tuple(lengths), step))
                times -= step
    room: dict[int, list[list]] = defaultdict(list)  # free tokens -> [[lengths, number], ...]
    for lengths, n in bins:
        room[capacity - sum(lengths)].append([lengths, n])
    for length in sorted(small, reverse=True):
        left = small[length]
        while left:
            free = min((r for r in room if r >= length and room[r]), default=None)
            if free is None:
                each = capacity // length
                n, rest = divmod(left, each)
                for k, times in ((each, n), (rest, 1 if rest else 0)):
                    if times:
                        room[capacity - k * length].append([(length,) * k, times])
                break
            lengths, n = room[free].pop()
            fit = free // length
            if left >= fit * n:
                k, times = fit, n
            elif left >= fit:
                k, times = fit, left // fit
            else:
                k, times = left, 1
            if times < n:
                room[free].append([lengths, n - times])
            room[free - k * length].append([(*lengths, *(length,) * k), times])
            left -= k * times
    runs, used, sequence = [], defaultdict(int), 0
    for free in sorted(room):
        for lengths, n in room[free]:
            offset = 0
            for length in lengths:
                runs.append((length, used[length], used[length] + n, sequence, offset))
                used[length] += n
                offset += length
            sequence += n
    return sorted(runs), sequence


def ranked(rows: DataFrame, key: str, order: list[str], salts: int) -> DataFrame:
    """rows with `rank`, from 0 within equal `key`. A key's rows are counted in `salts` parts, so that no key has to fit one task."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sizes = salted.groupBy(key, "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select(F.col(key).alias("_key"), F.col("_salt").alias("_part"), F.coalesce(before, F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order)) - 1
    joined = salted.withColumn("_inside", inside).join(bases, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_part")))
    return joined.withColumn("rank", F.col("_base") + F.col("_inside")).select(*rows.columns, "rank")


def pack(cut: DataFrame, capacity: int = CAPACITY, scheme: Scheme = Scheme(), rows_a_part: int = 20_000) -> DataFrame:
    """Pieces with sequence_id and offset. The histogram has at most `capacity` rows; it alone comes to the driver."""
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan(histogram, capacity, scheme)
    salts = max(1, -(-max([1, *histogram.values()]) // rows_a_part))
    placed = np.array(runs, np.int64).reshape(-1, 5)
    shared = cut.sparkSession.sparkContext.broadcast((placed, (placed[:, 0] << 44) + placed[:, 1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, starts = shared.value
        for b in batches:
            names = b.schema.names
            length, rank = (b.column(names.index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(starts, (length << 44) + rank, "right") - 1
            new = [pa.array(table_[at, 3] + rank - table_[at, 1]), pa.array(table_[at, 4])]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i, n in enumerate(names) if n != "rank"), *new], [*(n for n in names if n != "rank"), "sequence_id", "offset"])

    order = [c for c in cut.columns if c != "length"]
    return ranked(cut, "length", order, salts).mapInArrow(run, PIECE_SCHEMA + ", sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pack(written(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))))
