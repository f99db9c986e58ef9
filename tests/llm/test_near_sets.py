"""Near duplicates by similarity of shingle sets, against all pairs."""

import random

import numpy as np

from copresence.llm import near_sets


def _rows():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(6))
    rows = []
    for base in range(12):
        words = [word() for _ in range(248)]
        for copy in range(8):
            edited = list(words)
            for at in rng.sample(range(248), copy):
                edited[at] = word()
            rows.append((base * 100 + copy, " ".join(edited)))
    chain = [word() for _ in range(400)]
    rows += [(5000 + i, " ".join(chain[i * 10 : i * 10 + 200])) for i in range(20)]
    return rows + [(9000, None), (9001, ""), (9002, "One"), (9003, "one"), (9004, "one two"), (9003, "one"), (9005, "a b " * 9000)]


def _plain_roots(rows):
    sets = {}
    for i, t in rows:
        words = (t or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            union = len(sets[a] | sets[b])
            if a < b and (not union or len(sets[a] & sets[b]) / union >= 0.8) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def test_matches_all_pairs(docs_of):
    rows = _rows()
    roots = _plain_roots(rows)
    got = near_sets.near_duplicates(docs_of([*rows, (None, "one"), (None, "nowhere else")])).collect()
    assert len(got) == len(rows) + 2 and len(set(roots.values())) < len(roots) - 60
    assert {(r.doc_id, r.component_id) for r in got} == set(roots.items()) | {(None, 9002), (None, None)}
    assert near_sets.near_duplicates(docs_of([])).collect() == []


def test_keep_first_drops_edited_copies(docs_of):
    rows = _rows()
    docs = docs_of(rows)
    kept = near_sets.keep_first(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(_plain_roots(rows).values())) and kept.columns == docs.columns
    assert near_sets.keep_first(docs_of([])).collect() == []


def test_rows_of_one_id_and_null_ids(docs_of):
    """Rows of one id with different texts are documents of their own; copies go whatever their ids are."""
    rows = [(1, "one two three"), (1, "four five six"), (1, "one two three"), (2, "four five six"), (None, "seven"), (None, "seven"), (None, "eight"), (3, "eight")]
    kept = sorted((r.doc_id or 0, r.text) for r in near_sets.keep_first(docs_of(rows)).collect())
    assert kept == [(0, "seven"), (1, "four five six"), (1, "one two three"), (3, "eight")]


def test_many_texts_of_one_template(spark, docs_of):
    """Texts that share most words with all others meet by their own words, and by those alone."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(7))
    template, rows = [word() for _ in range(150)], []
    for base in range(60):
        own = [word() for _ in range(50)]
        rows.append((base * 10, " ".join(template + own)))
        if base % 3 == 0:
            rows.append((base * 10 + 1, " ".join(template[:130] + own)))
        if base % 4 == 0:
            rows.append((base * 10 + 2, " ".join([word(), *template[2:], *own[:40]])))
    roots = _plain_roots(rows)
    got = near_sets.near_duplicates(docs_of(rows)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == set(roots.items()) and 30 < len(set(roots.values())) <= 60


def test_prefixes_lose_no_pair(spark):
    rng = np.random.default_rng(5)
    families = [rng.choice(200, rng.integers(5, 60), replace=False) for _ in range(25)]
    sets = [np.unique(rng.permutation(families[i % 25])[rng.integers(0, 4) :]).astype(np.uint64) for i in range(250)] + [np.zeros(0, np.uint64)]
    sets += [np.arange(n, dtype=np.uint64) for n in (4, 5, 10, 35, 36)]
    spread = np.unique(rng.integers(0, 1 << 63, 300, np.int64)).astype(np.uint64)
    sets = [np.sort(spread[s.astype(np.int64)]) for s in sets]
    rows = [(i, i % 17, bytearray(s.tobytes())) for i, s in enumerate(sets)]
    got = {(r.a, r.b) for r in near_sets.by_prefix(spark.createDataFrame(rows, "node long, root long, hashes binary"), 0.8).collect()}
    plain = [(a, b, len(np.intersect1d(sets[a], sets[b])) / max(1, len(np.union1d(sets[a], sets[b])))) for a in range(len(sets)) for b in range(a + 1, len(sets)) if a % 17 != b % 17]
    assert {(a, b) for a, b, s in plain if s >= 0.8} <= got and len(got) < len(plain) / 4
    assert sum(s >= 0.8 for *_, s in plain) > 20
    for a, b, _ in plain[:500]:
        differ = np.bitwise_count((near_sets.marks(sets[a]) ^ near_sets.marks(sets[b])).view(np.uint64)).sum()
        assert differ <= len(np.setxor1d(sets[a], sets[b])) and (differ > 0) <= (len(np.setxor1d(sets[a], sets[b])) > 0)


def test_fingerprints_alone_find_lightly_edited_copies(spark, docs_of):
    """The Golay keys meet copies with a word changed in a long text, and equal fingerprints of different sets."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(6))
    rows = []
    for base in range(5):
        words = [word() for _ in range(3000)]
        rows += [(2 * base, " ".join(words)), (2 * base + 1, " ".join(words[:1500] + [word()] + words[1501:]))]
    prints = near_sets._prints(docs_of(rows).select(*near_sets._keyed(docs_of(rows), "doc_id", "text")), 5)
    ids = {r.node: r.did for r in prints.collect()}
    fps = {r.did: r.fp for r in prints.collect()}
    plain = {(a, b) for a in fps for b in fps if a < b and ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 2}
    found = {tuple(sorted((ids[r.a], ids[r.b]))) for r in near_sets.by_fingerprint(prints.select("node", "fp")).collect()}
    assert found == plain and len(plain) >= 3
    same = spark.createDataFrame([(5, 1), (3, 1), (9, 1), (4, 1 << 40)], "node long, fp long")
    assert {(r.a, r.b) for r in near_sets.by_fingerprint(same).collect()} == {(3, 5), (3, 9), (3, 4)}


def test_neighbours_connect_all_runs_of_a_key(spark):
    rows = [(1, i % 3, i) for i in range(20)] + [(2, 0, 7), (2, 0, 30), (3, 0, 99)]
    pairs = {(r.a, r.b) for r in near_sets.neighbours(spark.createDataFrame(rows, "key long, run long, node long")).collect()}
    assert (7, 30) in pairs and not any(99 in p for p in pairs) and len(pairs) == 20
    reached = {0}
    for _ in rows:
        reached |= {v for p in pairs if set(p) & reached for v in p}
    assert reached == {*range(20), 30}


def test_hot_keys_in_runs(docs_of, monkeypatch):
    monkeypatch.setattr(near_sets, "RUN", 2)
    rows = _rows()
    roots = _plain_roots(rows)
    assert {(r.doc_id, r.component_id) for r in near_sets.near_duplicates(docs_of(rows)).collect()} == set(roots.items())


def test_common_token_meets_in_cells(spark, monkeypatch):
    """A token that every text holds, in components of two: each pair that sizes allow meets in one cell, and cells share the rows."""
    monkeypatch.setattr(near_sets, "GRID", 16)
    rng = np.random.default_rng(4)
    sizes = rng.integers(5, 400, 300)
    sizes[:6] = [4, 5, 16, 20, 80, 100]
    cells = -(-len(sizes) // near_sets.GRID)
    rows = [(1, int(n), int(s), cells) for n, s in enumerate(sizes)] + [(2, 1000 + n, int(s), 1) for n, s in enumerate(sizes[:9])]
    one, two = near_sets.in_grid(spark.createDataFrame(rows, "token long, node long, size long, cells long"), 0.8)
    sides = [side.selectExpr(*near_sets.MEETING, f"node AS {n}", f"size AS s{n}") for n, side in (("a", one), ("b", two))]
    met = sides[0].join(sides[1], near_sets.MEETING).collect()
    pairs = {(r.a, r.b) for r in met}
    assert len(pairs) == len(met)
    plain = {(a, b) for t, a, s, _ in rows for u, b, z, _ in rows if t == u and min(s, z) >= 0.8 * max(s, z)}
    assert plain <= pairs and len(pairs) < len(rows) ** 2 / 3
    held = sides[0].groupBy(*near_sets.MEETING).count().agg({"count": "max"}).first()[0]
    assert held <= 4 * near_sets.GRID


def test_shared_rare_token_of_many_components(spark, monkeypatch):
    """Sets that hold one token, half of them near copies of a neighbour: what the join gives does not depend on the grid."""
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(60):
        base = rng.choice(1 << 62, 40, replace=False).astype(np.uint64)
        base[0] = 5
        other = base.copy()
        other[1:3] = rng.choice(1 << 62, 2, replace=False).astype(np.uint64)
        sets += [np.sort(base), np.sort(other)]
    rows = spark.createDataFrame([(i, i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, root long, hashes binary")
    found = []
    for grid in (2048, 8):
        monkeypatch.setattr(near_sets, "GRID", grid)
        found.append({(r.a, r.b) for r in near_sets.by_prefix(rows, 0.8).collect()})
    assert found[0] == found[1] >= {(i, i + 1) for i in range(0, 120, 2)}
