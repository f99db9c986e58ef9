"""SHA-256 of files that are too large for one task.

A SHA-256 is a chain over the bytes of a file, so its steps follow one another, but no task has to read it all: Spark's text reader splits the file,
each step is a job on the next split alone, and the state of the hash (some bytes) goes from step to step. Lines are taken as raw bytes, between
which the line feeds are put back; the file's size tells whether there was one at its end, and whether the reader left out a byte order mark.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the text reader would unpack.
PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".passthrough")
_MARK = b"\xef\xbb\xbf"
_STEP = "state binary, n_bytes long, n_lines long, at long"


class Sha256:
    """A SHA-256 with a state that can be taken along. hashlib's cannot; that of the OpenSSL which hashlib is linked with is a plain struct of 112 bytes."""

    def __init__(self, state: bytes | None = None):
        import _hashlib

        self._lib = ctypes.CDLL(_hashlib.__file__)
        self._lib.SHA256_Update.argtypes = (ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t)
        self._state = ctypes.create_string_buffer(128)
        if state is None:
            self._lib.SHA256_Init(self._state)
        else:
            self._state.raw = state

    def update(self, data: bytes) -> None:
        self._lib.SHA256_Update(self._state, data, len(data))

    def state(self) -> bytes:
        return self._state.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self._lib.SHA256_Final(out, self._state)
        return out.raw.hex()


def literal(path: str) -> str:
    """A path as a pattern that matches it alone."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def resumable() -> bool:
    """Whether this Python's OpenSSL gives out states that do what hashlib does."""
    try:
        sha = Sha256()
        sha.update(b"a" * 100)
        sha = Sha256(sha.state())
        sha.update(b"b" * 100)
        return sha.hexdigest() == hashlib.sha256(b"a" * 100 + b"b" * 100).hexdigest()
    except (ImportError, OSError, AttributeError):
        return False


def _advance(batches: Iterator[pa.RecordBatch], state: bytes, n_bytes: int, n_lines: int, at: int) -> Iterator[pa.RecordBatch]:
    """The state behind the lines of a split, which has to begin behind `at`."""
    sha = Sha256(state)
    for batch in batches:
        if not batch.num_rows:
            continue
        start = batch.column(1)[0].as_py()
        if start < at or batch.column(1)[-1].as_py() < start:
            raise RuntimeError(f"the split at {start} comes behind that at {at}")
        data = b"\n".join(batch.column(0).to_pylist())
        if n_lines:
            sha.update(b"\n")
            n_bytes += 1
        sha.update(data)
        n_bytes, n_lines, at = n_bytes + len(data), n_lines + batch.num_rows, batch.column(1)[-1].as_py()
    yield pa.RecordBatch.from_pydict({"state": [sha.state()], "n_bytes": [n_bytes], "n_lines": [n_lines], "at": [at]}, pa.schema([("state", pa.binary()), *((n, pa.int64()) for n in ("n_bytes", "n_lines", "at"))]))


def _through(lines: DataFrame, head: bytes) -> tuple[Sha256, int]:
    """The hash behind `head` and all lines, split by split, and the bytes that it has seen."""
    sha = Sha256()
    sha.update(head)
    step, k, n = (sha.state(), len(head), 0, 0), 0, lines.rdd.getNumPartitions()
    while k < n:
        done = lines.mapInArrow(partial(_advance, state=step[0], n_bytes=step[1], n_lines=step[2], at=step[3]), _STEP).rdd
        for r in lines.sparkSession.sparkContext.runJob(done, list, [k]):
            step = (bytes(r.state), r.n_bytes, r.n_lines, r.at)
        k += 1
    return Sha256(step[0]), step[1]


def sha256_by_splits(spark: SparkSession, path: str, size: int) -> str:
    """Hex digits of a file's SHA-256; the largest task reads a split (spark.sql.files.maxPartitionBytes) and the rest of its last line."""
    lines = spark.read.option("lineSep", "\n").text(literal(path)).select(F.col("value").cast("binary"), F.col("_metadata.file_block_start").alias("start"))
    sha, seen = _through(lines, b"")
    if size - seen in (3, 4):
        sha, seen = _through(lines, _MARK)
    if size - seen == 1:
        sha.update(b"\n")
    elif seen != size:
        raise RuntimeError(f"{path} has {size} bytes, of which {seen} were read")
    return sha.hexdigest()
