import numpy as np
import pytest
import xxhash

from copresence.llm import golay, simhash
from copresence.llm.components import components


def _plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _plain_roots(prints):
    ids = [i for i in prints if i is not None]
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in ids:
        for y in ids:
            if (prints[x] ^ prints[y]).bit_count() <= 2:
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    return {i: find(i) for i in ids}


def _rows():
    base = " ".join(f"w{i * i % 97}" for i in range(400))
    rows = [(i, base + f" tail{i}") for i in range(40)] + [(100 + i, base.replace("w9 ", f"v{i} ")) for i in range(10)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One"), (204, "one"), (205, "ONE two"), (206, "é É"), (203, "One"), (300, "x y z " * 20_000)]
    return rows


def test_matches_brute_force(docs_of):
    rows = _rows()
    got = simhash.near_duplicates(docs_of([*rows, (None, "one")])).collect()
    prints = {i: _plain_print(t) for i, t in rows}
    roots = _plain_roots(prints)
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.component_id == 203
        else:
            assert (r.fp & (2**64 - 1), r.component_id) == (prints[r.doc_id], roots[r.doc_id])


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 23, 2000)
    for _ in range(60):
        i, j = rng.integers(0, 23, 2)
        a, b = golay.keys(x), golay.keys(x ^ (1 << i) ^ (1 << j))
        assert ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any((1, 2)).all()


@pytest.mark.parametrize("spread", [1, 3])
def test_flips_and_groups_find_the_same_links(spark, spread):
    rng = np.random.default_rng(spread)
    fps = {int(rng.integers(-(2**63), 2**63))}
    for f in list(fps) * 60:
        for _ in range(spread):
            f ^= 1 << int(rng.integers(0, 63))
        fps.add(f)
    df = spark.createDataFrame([(i, f) for i, f in enumerate(sorted(fps))], "first long, fp long")
    roots = lambda links: {r.node: r.root for r in components(links).collect()}
    assert roots(simhash.links(df)) == roots(simhash._flip_links(df))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (1, 0)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {i: 1000 for i in range(1000, 1400)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_rows_without_ids_link_others(docs_of, spark, monkeypatch):
    """1 and 2 are two bits from a row without an id, and four from each other; two rows without ids are a component without a name."""
    a = 0b1011 << 20
    prints = [(1, a ^ 0b11), (None, a), (2, a ^ 0b1100), (5, 1 << 62), (None, ~a & 0x7FFFFFFF00000000), (None, (~a & 0x7FFFFFFF00000000) ^ 1)]
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: spark.createDataFrame(prints, "doc_id long, fp long"))
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs_of([(1, "x")])).collect()), key=lambda r: r[1])
    want = sorted(((i, f, {a: 1, a ^ 0b11: 1, a ^ 0b1100: 1, 1 << 62: 5}.get(f)) for i, f in prints), key=lambda r: r[1])
    assert got == want
