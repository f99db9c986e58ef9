"""What the training-data operators share: table readers, shared storage, small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regex class of the white space that separates words: space and U+0009 to U+000D.
WORD_BREAK = r"[\x20\x09-\x0D]+"


#: Rows and bytes that go to a Python worker at a time: whole texts are long, and a worker's memory follows the batch.
BATCH_ROWS, BATCH_BYTES = "1000", "16m"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches of Python workers, a setting of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table in a folder that Spark's readers can open. The operators' queries start here, so the batches are bounded here."""
    bounded_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local one serves, but in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder, so that a lost executor costs one stage."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}")
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared folder, read back."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that is not read any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, even where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def quoted(name: str) -> str:
    """A column's name as Spark reads it whole, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def packed_row(docs: DataFrame, *without: str) -> Column:
    """A struct of all columns but some: names inside it meet no others."""
    return F.struct(*(F.col(quoted(c)) for c in docs.columns if c not in without))


def unpacked_row(row: Column, columns: list[str], /, **new: Column) -> list[Column]:
    """The columns of a packed row, in order, with new values for some."""
    return [(new[c] if c in new else row.getField(c)).alias(c) for c in columns]
