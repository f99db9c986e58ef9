"""SentencePiece encoding and decoding by distinct marked words.

Spaces become the marker U+2581 and a marker is put before the text. No piece of the model crosses from a letter to a marker, so a
text falls into marked words (a run of markers and what follows it) that are segmented apart. Each task keeps a bounded table of
distinct words; a word is segmented by the library once and its ids are joined back by position.

Defined results: null is the empty text, which has the end id only. Repeated rows get equal results; nulls in other columns and
extra columns change nothing. A model with a piece that crosses a marker, or one that normalises text, is refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from copresence.llm.common import table

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class WordTable:
    """Distinct marked word (without its first marker) -> its ids as text, of bounded size."""

    def __init__(self, model_file: str, limit: int = 600_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces) or self.model.encode("ﬁ", out_type=str)[-1] != "ﬁ":
            raise ValueError("pieces of this model cross white space, or it normalises text")
        self.text_of = [f" {i}" for i in range(len(pieces))]
        self.lone = self.text_of[self.model.piece_to_id(MARK)]
        self.known: dict[str, str] = {}
        self.odd: dict[str, str] = {}  # words that decode to something else than themselves
        self.limit = limit

    def words(self, text: str) -> list[str]:
        """The marked words of a text, each without its first marker."""
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " ":
            return [w[1:] for w in WORD.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def add(self, words: set[str]) -> None:
        """Segment what is not in the table yet; the library puts the first marker back by itself."""
        if len(self.known) > self.limit:
            self.known.clear()
            self.odd.clear()
        new = [w for w in words if w not in self.known]
        coded = self.model.encode(new, num_threads=1)
        for w, ids, back in zip(new, coded, self.model.decode(coded, num_threads=1), strict=True):
            self.known[w] = "".join([self.text_of[i] for i in ids]) if w else self.lone
            if back != w.replace(MARK, " "):
                self.odd[w] = back

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of ids with the end id, ids joined by spaces, decoded text."""
        split = [self.words(t) for t in texts]
        self.add(set().union(*split))
        get, end = self.known.__getitem__, self.text_of[self.model.eos_id()]
        for words in split:
            ids = ("".join(map(get, words)) + end)[1:]
            back = [self.odd.get(w, w) for w in words] if self.odd else words
            yield ids.count(" ") + 1, ids, " ".join(back).replace(MARK, " ")


_TABLES: dict[str, WordTable] = {}


def word_table(model_file: str) -> WordTable:
    """One table a worker and model."""
    if model_file not in _TABLES:
        _TABLES[model_file] = WordTable(model_file)
    return _TABLES[model_file]


def encode(docs: DataFrame, model_file: str, text: str = "text", batch: int = 500) -> DataFrame:
    """docs with n_tokens, ids (decimal, joined by spaces, the end id last) and decoded, in place of any columns of those names."""
    docs = docs.drop("n_tokens", "ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_table(model_file)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                got = list(words.encode([t or "" for t in b.column(b.schema.names.index(text)).to_pylist()]))
                new = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "n_tokens", "ids", "decoded"])

    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *new]))


def digests(docs: DataFrame, model_file: str, text: str = "text", batch: int = 500) -> DataFrame:
    """The columns of docs but the text, with n_tokens and SHA-256 digests of ids and decoded text: what encode() gives, without
    moving it out of the worker."""
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_table(model_file)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                rows = [
                    (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
                    for n, ids, back in words.encode([t or "" for t in b.column(b.schema.names.index(text)).to_pylist()])
                ]
                kept = [n for n in b.schema.names if n != text]
                new = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(n)) for n in kept), *new], [*kept, "n_tokens", "ids_sha256", "decoded_sha256"])

    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return docs.mapInArrow(run, T.StructType([*(f for f in docs.schema.fields if f.name != text), *new]))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
