import random
import re
from collections import defaultdict

import pytest

from copresence.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, value int, rank int, n long, deal int, term string"


def _table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "x") for r in rows], SCHEMA)


def _plain(rows, least, most):
    docs = [("" if lang is None else lang, source or "", ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[A-Za-z\u0080-\U0010ffff]+", text or "")]) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        frequency, count = defaultdict(int), defaultdict(lambda: defaultdict(int))
        for _, source, words in mine:
            for w in set(words):
                frequency[w] += 1
            for w in words:
                count[source][w] += 1
        kept = {w for w, n in frequency.items() if n >= least}
        total = {s: sum(count[s][w] for w in kept) for s in {d[1] for d in mine}}
        share = lambda n, of: 1 + 10**9 * (n + 5) // (of + 5 * len(kept))
        p = {s: {w: share(count[s][w], total[s]) for w in kept} for s in total}
        q = {w: share(sum(count[s][w] for s in total), sum(total.values())) for w in kept}
        for s in total:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in total if o != s]
            terms = [(p[s][w] - q[w], w) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or k <= most:
                        out.add((lang, s, part, item, v, k))
    return out


def _rows(rng):
    words = [f"{a}{b}" for a in ("Ta", "é", "st", "一", "o") for b in ("na", "X", "ñe", "ion")]
    rows = []
    for i in range(300):
        lang, source = rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "é", None, "C"])
        rows.append((i if i % 17 else None, " ".join(rng.choice(words[: 8 + 4 * (i % 4)]) + rng.choice(["", ".", "1", " "]) for _ in range(rng.randint(0, 60))), lang, source))
    rows += [rows[3], rows[3], (400, None, "en", "quiet"), (401, "", "en", "quiet"), (402, "1 2 3", "xx", "alone"), (403, "rare", "xx", "other"), (404, None, "xx", None), (405, "tana " * 20_000, "fr", "a")]
    return rows


@pytest.mark.parametrize("held,cells", [(400_000, 1 << 20), (1, 1)])
def test_matches_brute_force(spark, monkeypatch, held, cells):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "CELLS", cells)
    rows = _rows(random.Random(held))
    got = divergence.audit(_table(spark, rows), least=20, most_terms=5).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == _plain(rows, 20, 5)


def test_blocks_of_sources_and_runs_cut_by_batches(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i, "one two " * (i % 5 + 1) + "three " * (i % 3), "en", f"s{i % 11}") for i in range(200)]
        assert {tuple(r) for r in divergence.audit(_table(spark, rows), least=5).collect()} == _plain(rows, 5, 50)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_probabilities_are_exact_beyond_64_bits():
    import numpy as np

    counts = np.array([0, 7, 10**13], np.int64)
    assert divergence.probabilities(counts, 3 * 10**14 + 1).tolist() == [1 + 10**9 * (c + 5) // (3 * 10**14 + 1) for c in counts.tolist()]


def test_without_kept_terms_and_empty(spark):
    got = {tuple(r) for r in divergence.audit(_table(spark, [(1, "a b", "en", "x"), (2, None, "en", "y"), (3, "c", "de", "x")])).collect()}
    assert got == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}
    assert divergence.audit(_table(spark, [])).collect() == []
