"""How the terms of each source differ from those of its language, and sources from each other.

Two sorted scans. Tasks first count terms per (lang, source) and give out partial runs (lang, term, source, first document of the run,
documents, occurrences), so that a frequent term costs a row a task and source. Runs are dealt by (lang, term), sorted by (lang, term, source,
document) and scanned as a stream: where the term changes, document frequencies and counts are complete, and only terms in enough
documents go on. The kept counts are dealt and sorted again, behind a header that has the totals of all sources of the language, and a
second scan gives out, run by run, the excess of each term over its language and, summed by blocks of sources, partial pairs.
All arithmetic is on integers. Memory: one batch, one run and one block of sources.

Defined results: null text, lang and source are read as ''. Every row is a document of its own, so repeated rows and ids count each; ids
only sort the runs, and null ids sort first. A (lang, source) without terms has pairs like any other; without kept terms their value is 0. A
language with one source has no pairs. Ties are broken by item in UTF-8 order. Extra columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copresence.llm.common import table, written

LEAST_DOCUMENTS, MOST_TERMS, PRIOR, SCALE = 30, 50, 5, 1_000_000_000
#: Distinct (lang, source, term) that a task holds before it gives out partial runs.
HELD = 1_000_000
#: Sources that are paired at a time, and values (terms x sources) that a block of terms holds.
SOURCES, CELLS = 256, 1 << 20
#: Bytes of a term as they are, A-Z in lower case, all others as spaces.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PARTIAL = "lang string, term string, source string, document long, documents long, n long"
COUNTS = "lang string, term string, source string, n long"


def _text(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _partial_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, document, text) -> partial runs."""
    groups: dict[tuple[str, str], tuple[Counter, Counter, list]] = {}

    def given_out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (documents, counts, first) in groups.items():
            terms = list(counts)
            k = len(terms)
            columns = [
                pa.array([lang] * k, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([source] * k, pa.string()),
                pa.array(first * k, pa.int64()), pa.array([documents[t] for t in terms], pa.int64()), pa.array([counts[t] for t in terms], pa.int64()),
            ]
            whole = pa.RecordBatch.from_arrays(columns, ["lang", "term", "source", "document", "documents", "n"])
            yield from (whole.slice(at, 50_000) for at in range(0, k, 50_000))
        groups.clear()

    for b in batches:
        texts = b.column(3).cast(pa.binary())
        for lang, source, document, text in zip(_text(b.column(0)), _text(b.column(1)), b.column(2).to_pylist(), texts, strict=True):
            if (lang, source) not in groups:
                groups[lang, source] = Counter(), Counter(), [document]
            documents, counts, first = groups[lang, source]
            terms = (text.as_py() or b"").translate(TERM_BYTES).split()
            counts.update(terms)
            documents.update(set(terms))
            if document is None or first[0] is not None and document < first[0]:
                first[0] = document
        if sum(len(g[1]) for g in groups.values()) > HELD:
            yield from given_out()
    yield from given_out()


def _changes(*columns: pa.ChunkedArray) -> np.ndarray:
    """Where each run of equal values starts."""
    import pyarrow.compute as pc

    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _summed(runs: pa.Table) -> pa.Table:
    """Sorted partial runs of the same (lang, term, source) in one row each."""
    at = _changes(runs["lang"], runs["term"], runs["source"])
    sums = {c: pa.array(np.add.reduceat(runs[c].to_numpy(), at)) for c in ("documents", "n")}
    return pa.table({c: sums.get(c, runs[c].take(pa.array(at))) for c in ("lang", "term", "source", "documents", "n")})


def _scan_terms(least: int):
    """Sorted partial runs -> counts by source of the terms that are in enough documents of the language."""

    def complete(runs: pa.Table) -> pa.Table:
        at = _changes(runs["lang"], runs["term"])
        documents = np.add.reduceat(runs["documents"].to_numpy(), at)
        kept = np.repeat(documents >= least, np.diff(np.append(at, len(runs))))
        return runs.filter(pa.array(kept)).select(["lang", "term", "source", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            now = pa.Table.from_batches([b]).select(["lang", "term", "source", "documents", "n"])
            now = _summed(now if rest is None else pa.concat_tables([rest, now]))
            cut = int(_changes(now["lang"], now["term"])[-1])  # the last term may go on
            if cut:
                yield from complete(now.slice(0, cut)).to_batches()
            rest = now.slice(cut)
        if rest is not None:
            yield from complete(rest).to_batches()

    return run


def kept_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """docs(lang, source, document, text) -> (lang, term, source, n): occurrences of each kept term in the sources that have it."""
    runs = docs.mapInArrow(_partial_runs, PARTIAL).repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    return runs.mapInArrow(_scan_terms(least), COUNTS)


def probabilities(counts: np.ndarray, total: np.ndarray | int, prior: int = PRIOR, scale: int = SCALE) -> np.ndarray:
    """1 + floor(scale * (count + prior) / total), exactly."""
    if counts.size and int(counts.max()) + prior > (2**63 - 1) // scale:
        counts = counts.astype(object)
    return ((counts + prior) * scale // total + 1).astype(np.int64)


class _Language:
    """What the scan of one language's kept terms adds up."""

    def __init__(self, name: str, header: pa.Table):
        self.name = name
        self.sources, totals = header["source"].to_pylist(), np.array(header["total"].to_pylist(), dtype=object)
        self.at = {s: i for i, s in enumerate(self.sources)}
        most = max(totals, default=0)
        self.whole = header["whole"][0].as_py()
        self.totals = totals.astype(np.int64) if most < 2**63 else totals
        self.none = probabilities(np.zeros(len(totals), np.int64), self.totals)
        self.rows: list[np.ndarray] = []

    def add(self, sources: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One term: gives the places of its sources and their excess over the language."""
        at = np.fromiter((self.at[s] for s in sources), np.int64, len(sources))
        p = probabilities(counts, self.totals[at])
        row = self.none.copy()
        row[at] = p
        self.rows.append(row)
        return at, p - probabilities(np.array([int(counts.sum())], dtype=object), self.whole)[0]

    def full(self) -> bool:
        return len(self.rows) * len(self.sources) >= CELLS

    def pairs(self) -> Iterator[pa.RecordBatch]:
        """Sums of abs(p - q) over the terms held, a block of sources by a block of sources."""
        if not self.rows or len(self.sources) < 2:
            self.rows = []
            return
        p, self.rows = np.stack(self.rows, axis=1), []
        for i in range(len(self.sources)):
            for j in range(i + 1, len(self.sources), SOURCES):
                block = np.abs(p[j : j + SOURCES] - p[i]).sum(1)
                k = len(block)
                yield _given(self.name, [self.sources[i]] * k, "pair", self.sources[j : j + k], block)


def _given(lang: str, sources: list[str], part: str, items: list[str], values: np.ndarray) -> pa.RecordBatch:
    k = len(items)
    columns = [pa.array([lang] * k, pa.string()), pa.array(sources, pa.string()), pa.array([part] * k, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "part", "item", "value"])


def _scan_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (deal, lang, term, source, n, total, whole), the header of each language (term '') first -> partial pairs, and terms."""
    language: _Language | None = None
    for group in _whole_terms(batches):
        at = _changes(group["deal"], group["lang"], group["term"])
        ends = np.append(at[1:], len(group))
        names, terms = group["lang"].take(pa.array(at)).to_pylist(), group["term"].take(pa.array(at)).to_pylist()
        sources, counts = group["source"].to_pylist(), group["n"].to_numpy()
        out: list[tuple[str, str, int]] = []
        for name, term, a, b in zip(names, terms, at.tolist(), ends.tolist(), strict=True):
            if term == "":
                if language is not None:
                    yield from _terms_of(language, out)
                    yield from language.pairs()
                language, out = _Language(name, group.slice(a, b - a)), []
                continue
            places, more = language.add(sources[a:b], counts[a:b])
            out += [(language.sources[i], term, v) for i, v in zip(places.tolist(), more.tolist(), strict=True) if v > 0]
            if language.full():
                yield from language.pairs()
        if language is not None:
            yield from _terms_of(language, out)
    if language is not None:
        yield from language.pairs()


def _terms_of(language: _Language, out: list[tuple[str, str, int]]) -> Iterator[pa.RecordBatch]:
    if out:
        yield _given(language.name, [x[0] for x in out], "term", [x[1] for x in out], np.array([x[2] for x in out], np.int64))


def _whole_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in which no run of a term is cut; the last run of a batch waits for the next one."""
    rest: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        now = pa.concat_tables([*rest, pa.Table.from_batches([b])]).combine_chunks()
        cut = int(_changes(now["deal"], now["lang"], now["term"])[-1])
        if cut:
            yield now.slice(0, cut)
        rest = [now.slice(cut)]
    yield from rest


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", document: str = "doc_id", least: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of each language, part `pair` ranks all other sources by the
    distance of their smoothed term distributions, part `term` the most_terms kept terms by their excess over the language."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), F.col(document).cast("long").alias("document"), F.col(text).cast("string").alias("text"))
    groups = read.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    kept = written(kept_counts(read, least))

    # totals: a row a (lang, source); the header of a language goes to each deal of its terms, since the terms are spread
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    by_source = kept.groupBy("lang", "source").agg(exact("n").alias("occurrences"))
    by_term = kept.groupBy("lang", "term").agg(F.lit(1).alias("one"))
    by_lang = by_source.groupBy("lang").agg(exact("occurrences").alias("occurrences")).join(by_term.groupBy("lang").agg(F.count("*").alias("v")), "lang")
    smooth = F.coalesce("v", F.lit(0)) * F.lit(PRIOR)
    sources = groups.join(by_source, ["lang", "source"], "left").join(by_lang.select("lang", "v", F.col("occurrences").alias("all")), "lang", "left")
    whole = lambda c: (F.coalesce(c, F.lit(0).cast("decimal(38,0)")) + smooth).cast("long")
    totals = written(sources.select("lang", "source", whole("occurrences").alias("total"), whole("all").alias("whole"), F.coalesce("v", F.lit(0)).alias("v")))

    deals = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = F.pmod(F.xxhash64("lang", "term"), F.lit(deals)).cast("int")
    counted = kept.select(deal.alias("deal"), "lang", "term", "source", "n", F.lit(None).cast("long").alias("total"), F.lit(None).cast("long").alias("whole"))
    header = totals.filter("v > 0").select(F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), "lang", F.lit("").alias("term"), "source", F.lit(None).cast("long").alias("n"), "total", "whole")
    dealt = counted.unionAll(header).repartition(deals, "deal").sortWithinPartitions("deal", "lang", "term", "source")
    found = dealt.mapInArrow(_scan_sources, "lang string, source string, part string, item string, value long")

    found = written(found)
    halves = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # a language without kept terms has its pairs too: sources of the language meet each other, as in the result
    none = totals.filter("v = 0")
    idle = none.alias("a").join(none.alias("b"), F.expr("a.lang = b.lang AND a.source < b.source")).select("a.lang", "a.source", F.col("b.source").alias("item"), F.lit(0).cast("long").alias("value"))
    halves = halves.unionAll(idle)
    pairs = halves.unionAll(halves.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda rows: rows.withColumn("rank", order)
    return ranked(pairs).unionAll(ranked(found.filter("part = 'term'")).filter(F.col("rank") <= most_terms))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 30
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), vocabulary AS (
  SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)
), shares AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM dense JOIN vocabulary USING (lang)
), whole AS (
  SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM dense GROUP BY lang, term) JOIN vocabulary USING (lang)
), distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
