"""Language identification with a blended-spectrum string kernel.

k(x, y) is the mean over n = 1, 2, 3 of |G_n(x) ∩ G_n(y)| / sqrt(|G_n(x)| |G_n(y)|), where G_n is the set of character n-grams present in
a text. Letters of any script are symbols of their own, in lower case; all else is one symbol. Landmark texts give a Nyström feature map;
one-versus-rest kernel ridge regression is fitted on those features, and documents are scored with two matrix products a batch.

Defined results: null text, or text without a letter, gives `und` and 0; so does everything where no labelled row exists.
Ties go to the language that sorts first. Text is scored whole, row by row, so repeated rows get equal results. Null labels and
null ids only keep a row out of training; rows equal in id, text and label count once there. Extra columns of any names pass through, but
for those that the results replace. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copresence.llm.common import cut, quoted, table

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
#: Bits of a symbol in the code of an n-gram; an n-gram's code has its order on top.
BITS = 20


@dataclass(frozen=True)
class Fit:
    """Bounds of the labelled sample: rows over all languages (8 a language at least), landmarks among them (2 a language at least) and their
    characters, where a language has texts so short; ridge strength. Every language takes part."""

    sample_rows: int = 3000
    landmark_rows: int = 120
    landmark_chars: int = 20_000
    ridge: float = 1e-2


@dataclass
class Postings:
    """A sparse grams x landmarks matrix by rows."""

    starts: np.ndarray
    landmarks: np.ndarray
    values: np.ndarray
    width: int


#: Values of a dense matrix of landmarks; a larger one is kept as postings, which give the same products.
DENSE = 1 << 24


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray | None = None  # the sorted n-grams of all landmarks
    landmarks: np.ndarray | Postings | None = None  # grams x landmarks, each column scaled by 1 / sqrt(|G_n|)
    weights: np.ndarray | None = None  # landmarks x languages, the last row the intercepts


def symbol_table() -> np.ndarray:
    """Code point -> symbol: 0 for what is no letter, else a number for the letter in lower case (its code point, less what is over 20 bits)."""
    codes = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        if not 0xD800 <= c <= 0xDFFF and chr(c).isalpha():
            low = chr(c).lower()
            codes[c] = (ord(low) if len(low) == 1 else c) & ((1 << BITS) - 1)
    return codes


def grams(text: str, codes: np.ndarray) -> np.ndarray:
    """Sorted codes of the n-grams that are present in a text framed by spaces."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    s = np.zeros(len(points) + 2, np.int64)
    s[1:-1] = codes[points]
    out, code = [], s
    for n in ORDERS:
        if n > 1:
            code = (code[:-1] << BITS) | s[n - 1 :]
        ordered = np.sort(code)
        out.append(ordered[np.append(True, ordered[1:] != ordered[:-1])] | (n << (3 * BITS)))
    return np.concatenate(out)


def scales(present: np.ndarray) -> np.ndarray:
    """For each gram of a text, 1 / sqrt(|G_n|) of its order n, over the number of orders."""
    order = (present >> (3 * BITS)) - 1
    return 1 / np.sqrt(np.bincount(order, minlength=len(ORDERS))[order] * len(ORDERS))


def landmark_matrix(present: list[np.ndarray], dense: int | None = None) -> tuple[np.ndarray, np.ndarray | Postings]:
    """The sorted grams of all landmarks, and grams x landmarks."""
    known = np.unique(np.concatenate(present))
    at = [np.searchsorted(known, p) for p in present]
    if len(known) * len(present) <= (DENSE if dense is None else dense):
        landmarks = np.zeros((len(known), len(present)), np.float32)
        for j, p in enumerate(present):
            landmarks[at[j], j] = scales(p)
        return known, landmarks
    rows, columns = np.concatenate(at), np.repeat(np.arange(len(present), dtype=np.int32), [len(p) for p in present])
    order = np.argsort(rows, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(known)))])
    values = np.concatenate([scales(p) for p in present]).astype(np.float32)
    return known, Postings(starts, columns[order], values[order], len(present))


def kernel(texts: list[str], codes: np.ndarray, landmarks: np.ndarray | Postings, known: np.ndarray) -> np.ndarray:
    """Texts x landmarks. known: the grams of the rows of `landmarks`; others have no part in any product."""
    sparse = isinstance(landmarks, Postings)
    x = np.zeros((len(texts), landmarks.width if sparse else len(landmarks)), np.float32)
    for i, text in enumerate(texts):
        present = grams(text, codes)
        at = np.minimum(np.searchsorted(known, present), len(known) - 1)
        hit = known[at] == present
        if not sparse:
            x[i, at[hit]] = scales(present)[hit]
            continue
        at, weight = at[hit], scales(present)[hit]
        size = landmarks.starts[at + 1] - landmarks.starts[at]
        place = np.arange(size.sum()) + np.repeat(landmarks.starts[at] - (np.cumsum(size) - size), size)
        x[i] = np.bincount(landmarks.landmarks[place], np.repeat(weight, size) * landmarks.values[place], landmarks.width)
    return x if sparse else x @ landmarks


def sampled(docs: DataFrame, settings: Fit) -> tuple[list[str], DataFrame]:
    """Languages, and a sample (lang, text, h) of at most settings.sample_rows rows (8 a language at least) of docs(doc_id, text, lang), about
    equally many of each language; h orders them. Which rows it holds depends on a hash of id and text alone."""
    usable = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.rlike("text", F.lit(r"\p{L}")))
    counted = cut(usable.groupBy("lang").agg(F.count("*").alias("n")))
    languages = sorted(r.lang for r in counted.collect())
    if not languages:
        return [], usable
    share = max(8, settings.sample_rows // len(languages))
    # twice the share is expected to pass; the exact bound is drawn from that
    rates = counted.select(F.col("lang").alias("of"), F.least(F.lit(1.0), F.lit(2.0 * share) / F.col("n")).alias("rate"))
    h = F.xxhash64("doc_id", "text")
    chance = F.pmod(h, F.lit(1 << 30)) / float(1 << 30)
    # a rate a language: as few rows as the model has classes
    passed = usable.select("lang", "text", h.alias("h"), chance.alias("chance")).join(F.broadcast(rates), F.col("lang") == F.col("of")).filter("chance < rate")
    once = passed.groupBy("lang", "h").agg(F.first("text").alias("text"))
    within = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("h"), F.lit(1 << 40)), "h"))
    return languages, once.withColumn("place", within).filter(F.col("place") <= share)


def fit(docs: DataFrame, settings: Fit = Fit()) -> Model:
    """Fit on labelled rows of docs(doc_id, text, lang), on a sample of rows that `settings` bounds."""
    languages, sample = sampled(docs, settings)
    if not languages:
        return Model([])
    sample = cut(sample)
    codes = symbol_table()
    each = max(2, settings.landmark_rows // len(languages))
    short = Window.partitionBy("lang").orderBy(F.greatest(F.char_length("text"), F.lit(settings.landmark_chars)), "place")
    chosen = sample.withColumn("turn", F.row_number().over(short)).filter(F.col("turn") <= each)
    present = [grams(r.text, codes) for r in chosen.select("lang", "turn", "text").orderBy("lang", "turn").toLocalIterator()]
    known, landmarks = landmark_matrix(present)
    shared = docs.sparkSession.sparkContext.broadcast((landmarks, known))

    def kernel_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _symbols()
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                k = kernel(b.column(0).to_pylist(), codes, *shared.value)
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(k.astype(np.float64)), pa.list_(pa.float64()))], ["lang", "k"])

    got = sample.select("text", "lang").mapInArrow(kernel_rows, "lang string, k array<double>").collect()
    k = np.array([r.k for r in got])
    y = np.where(np.array([r.lang for r in got])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    between = _between(present, known, landmarks)
    return Model(languages, known, landmarks, ridge(between, k, y, settings.ridge * len(k) / len(languages)))


def _between(present: list[np.ndarray], known: np.ndarray, landmarks: np.ndarray | Postings) -> np.ndarray:
    """Landmarks x landmarks."""
    if not isinstance(landmarks, Postings):
        return landmarks.astype(np.float64).T @ landmarks
    out = np.zeros((landmarks.width, landmarks.width))
    for i, p in enumerate(present):
        for g, w in zip(np.searchsorted(known, p), scales(p), strict=True):
            run = slice(landmarks.starts[g], landmarks.starts[g + 1])
            out[i, landmarks.landmarks[run]] += w * landmarks.values[run]
    return out


def ridge(between: np.ndarray, k: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Weights of landmarks, and intercepts, of ridge regression on Nyström features. between: kernel of the landmarks; k: of the sample
    with them; y: sample x languages, 1 or -1."""
    value, vector = np.linalg.eigh(between)
    good = value > 1e-8 * value.max()
    whiten = vector[:, good] / np.sqrt(value[good])
    z = np.hstack([k @ whiten, np.ones((len(k), 1))])
    diagonal = penalty * np.eye(z.shape[1])
    diagonal[-1, -1] = 0
    beta = np.linalg.solve(z.T @ z + diagonal, z.T @ y)
    return np.vstack([whiten @ beta[:-1], beta[-1:]])


_SYMBOLS: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """The table of symbols, built once a worker."""
    if not _SYMBOLS:
        _SYMBOLS.append(symbol_table())
    return _SYMBOLS[0]


def predict(docs: DataFrame, model: Model, text: str = "text", label: str = "lang_pred", score: str = "score", batch: int = 64) -> DataFrame:
    """docs with two more columns, in place of any of the same names: the predicted language and a score from 0 to 1."""
    docs = docs.select(*(F.col(quoted(c)) for c in docs.columns if c not in (label, score)))
    if not model.languages:
        return docs.withColumns({label: F.lit(UNDETERMINED), score: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, codes = shared.value, _symbols()
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), batch):
                part = whole.slice(at, batch)
                labels, values = classify(part.column(part.schema.names.index(text)).to_pylist(), model, codes)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(labels, pa.string()), pa.array(values, pa.float64())], [*part.schema.names, label, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(scored, schema)


def classify(texts: list[str | None], model: Model, codes: np.ndarray) -> tuple[list[str], list[float]]:
    labels, values = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    have = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    if have:
        k = kernel([texts[i] for i in have], codes, model.landmarks, model.grams)
        s = k.astype(np.float64) @ model.weights[:-1] + model.weights[-1]
        best = s.argmax(1)
        for i, b, v in zip(have, best, np.clip((s.max(1) + 1) / 2, 0, 1), strict=True):
            labels[i], values[i] = model.languages[b], float(v)
    return labels, values


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
