"""A training corpus from raw documents: language ID, quality rules, near-dedup, passage dedup, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of docs. Between stages rows are
written as Parquet and read again. SQL cannot express the stages on models, fingerprints and packings, so there is no oracle; the
stages are tested against brute-force versions.

Defined results, for all stages: extra columns of any names pass through every stage but the last, which gives places only; nulls in
them mean nothing. An empty table gives an empty result. Texts of any length are taken whole. What null and empty texts, ties, repeated
rows and null ids do is said at each stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copresence.llm import language_id, near_sets, packing, quality_rules, suffix_dedup
from copresence.llm.common import bounded_batches, discard, packed_row, quoted, shared_dir, table, unpacked_row, written

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; lang becomes the predicted one. Null and empty text, and text without a letter, goes. Rows are
    judged one by one, so repeated rows fare alike; of equal scores the language that sorts first counts. Null ids and null
    languages only keep a row from being learned from."""
    bounded_batches(spark)
    model = language_id.fit(docs.filter(~language_id.held_out()).select("doc_id", "text", "lang"))
    named = language_id.predict(docs.select(packed_row(docs, "text", "lang").alias("row"), "text"), model)
    return named.filter(F.col("lang_pred") != language_id.UNDETERMINED).select(*unpacked_row(F.col("row"), docs.columns, text=F.col("text"), lang=F.col("lang_pred")))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines. Null and empty text fails. Rows are judged one by one, so repeated
    rows fare alike and ids do not matter."""
    bounded_batches(spark)
    judged = quality_rules.judge(docs.select(packed_row(docs, "text", "n_chars").alias("row"), "text")).filter("quality.kept")
    text = F.col("quality")["clean_text"]
    return judged.select(*unpacked_row(F.col("row"), docs.columns, text=text, n_chars=F.char_length(text).cast("long")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each group that 5-word shingles with a Jaccard similarity of 0.8 or more connect. Texts without a word are
    one group. Smaller ids come first, null ids last, equal ids by a hash of the text; of rows equal in id and text one stays."""
    bounded_batches(spark)
    return near_sets.keep_first(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that also start earlier in the corpus; documents that nothing is left of go, null and empty ones too.
    The order is that of near-dedup; of rows equal in id and text one keeps what no earlier row has."""
    bounded_batches(spark)
    cut = suffix_dedup.cut_repeats(docs).filter(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))
    return cut.select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(quoted(c)) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document: null and empty text has the end id only, repeated rows are packed each, and equal lengths
    are placed in an order that means nothing."""
    bounded_batches(spark)
    return packing.pack(written(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", clean_lines),
    ("near_dedup", drop_near_duplicates),
    ("passage_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage has written goes once the next one is written; the last table stays, for the result reads it."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{name}")
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
