import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from copresence.llm import suffix_dedup as S


def _plain(rows):
    """Removed bytes by set of seen 100-byte strings, in the order of id and text."""
    seen, out = set(), []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, text in order:
        body = (text or "").encode()
        gone = bytearray(len(body))
        for s in range(len(body) - 99):
            if body[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            else:
                seen.add(body[s : s + 100])
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(body), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def _rows(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(40) for _ in range(6)] + [text(16)]
    line = text(14)[:85]
    rows = [(i, text(rng.randint(0, 60)) + rng.choice(passages) + text(rng.randint(0, 30)) + line + text(8)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "x" * 99), (103, "x" * 100), (104, "x" * 5000), (105, "ab" * 3000), (106, rows[3][1]), (107, rows[3][1]), (108, text(3000))]
    rows += [(109, rows[-1][1][:9000] + "!" + rows[-1][1][9000:]), (110, passages[0][:150]), (111, passages[0][1:150] + passages[1][:120])]
    rng.shuffle(rows)
    return rows


def _digests(docs):
    return sorted(tuple(r) for r in S.digests(S.repeated_spans(docs)).collect())


def test_matches_brute_force(docs_of):
    rows = _rows()
    assert _digests(docs_of(rows).repartition(5)) == sorted(_plain(rows))


def test_repeated_ids_and_null_ids(docs_of):
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh") for _ in range(300))
    rows = [(1, passage), (1, passage), (None, passage + "tail"), (2, passage)]
    got = _digests(docs_of([r for r in rows if r[0] is not None]))
    assert sorted(x[2] for x in got) == [0, 300, 300]
    with_null = S.digests(S.repeated_spans(docs_of(rows))).collect()
    assert {r.n_removed for r in with_null if r.doc_id is None} == {300}
    assert _digests(docs_of([])) == []


def test_cut_keeps_columns(docs_of):
    rows = _rows(2)
    docs = docs_of(rows)
    cut = S.cut_repeats(docs)
    assert cut.columns == docs.columns
    left = {r.doc_id: r.text for r in cut.collect()}
    assert left[100] is None and left[101] == "" and left[107] == "" and len(left) == len(rows)


@pytest.mark.parametrize("seed", range(5))
def test_maximal_repeats(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(6)]
    array = S.SuffixArray(strings)
    suffixes = [(strings[array.string[i]][i - array.start[array.string[i]] :], i) for i in range(len(array.data))]
    assert array.order.tolist() == [i for _, i in sorted(suffixes)]
    got = {(array.data[array.order[a] : array.order[a] + n].tobytes(), tuple(sorted(array.order[a : b + 1].tolist()))) for n, a, b in array.maximal_repeats(3)}
    want = set()
    places = {}
    for k, s in enumerate(strings):
        for i in range(len(s)):
            for j in range(i + 3, len(s) + 1):
                places.setdefault(s[i:j], []).append((k, i))
    for s, at in places.items():
        before = {strings[k][i - 1] if i else (k, "start") for k, i in at}
        after = {strings[k][i + len(s)] if i + len(s) < len(strings[k]) else (k, "end") for k, i in at}
        if len(at) > 1 and len(before) > 1 and len(after) > 1:
            want.add((s, tuple(sorted(int(array.start[k]) + i for k, i in at))))
    assert got == want


def _flow(rows, common=np.zeros(0, np.uint64)):
    """The whole flow in this process: removed bytes of each document, and how many of them a suffix array of a chunk or of a slice found."""
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([0] * len(rows)), pa.array([t for _, t in rows])], ["did", "th", "text"])
    parts = pa.Table.from_batches(list(S._parts(common)(iter([batch])))).sort_by([(c, "ascending") for c in S.PART_COLUMNS])
    asks = pa.Table.from_batches(list(S._asked(iter(parts.combine_chunks().to_batches(max_chunksize=50)), most=20))).to_pylist()
    covers = [(r["did"], r["start"], r["span"]) for r in asks if r["kind"] == S.COVER]
    by = {}
    for r in asks:
        if r["kind"] != S.COVER:
            by.setdefault(r["did"], []).append({k: r[k] for k in ("kind", "key", "start", "span", "delta", "of_did", "of_th")})
    fields = [("kind", pa.int8()), ("key", pa.int64()), ("start", pa.int32()), ("span", pa.int32()), ("delta", pa.int32()), ("of_did", pa.int64()), ("of_th", pa.int64())]
    asked = pa.array([by.get(i) for i, _ in rows], pa.list_(pa.struct(fields)))
    joined = pa.RecordBatch.from_arrays([*batch.columns, asked], ["did", "th", "text", "asked"])
    strings = pa.Table.from_batches(list(S._strings(iter([joined])))).sort_by([(c, "ascending") for c in ("key", "did", "th", "start")])
    more = [r for b in S._covered(iter(strings.combine_chunks().to_batches())) for r in b.to_pylist()]
    covers += [(r["did"], r["start"], r["span"]) for r in more]
    out = {}
    for i, t in rows:
        found = S.spans([(s << 32) | n for d, s, n in covers if d == i], len(t.encode()), False)
        out[i] = sum(e - s for s, e in found)
    return out, {r["kind"] for r in asks}


def test_every_way_of_dealing_gives_the_same(monkeypatch):
    rows = [(i, t) for i, t in _rows(3) if t]
    want = {i: removed for i, _, removed, _, _ in _plain(rows)}
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([0] * len(rows)), pa.array([t for _, t in rows])], ["did", "th", "text"])
    keys = np.concatenate([b.column(0).to_numpy() for b in S._parts(np.zeros(0, np.uint64))(iter([batch]))]).view(np.uint64)
    every, number = np.unique(keys, return_counts=True)
    for chunk in (S.CHUNK, 3000, 700):
        for limit in (1, S.PART_LIMIT):
            for size in (200, S.SLICE):
                for common in (every[:0], every[number > 3], every):
                    monkeypatch.setattr(S, "CHUNK", chunk)
                    monkeypatch.setattr(S, "PART_LIMIT", limit)
                    monkeypatch.setattr(S, "SLICE", size)
                    got, kinds = _flow(rows, common)
                    assert got == want, (chunk, limit, size, len(common))
                    if chunk == 700:
                        assert {S.CLAIM, S.SOURCE} <= kinds


def test_hot_anchor_of_many_contexts(docs_of):
    """A line of 90 bytes in very many contexts: no window of 100 bytes repeats but where the contexts are equal too."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    line = " ".join(word() for _ in range(20))[:90]
    rows = [(i, f"{word()} {word()} {word()} {line} {word()} {word()} {rng.choice(['same end of it', word()])}") for i in range(700)]
    assert _digests(docs_of(rows).repartition(4)) == sorted(_plain(rows))


def test_a_shared_hash_removes_nothing(monkeypatch):
    """Keys and hashes that all parts share: the bytes decide."""
    rows = [(i, t) for i, t in _rows(5)[:40] if t]
    whole = S._parts_of

    def blind(*args):
        piece, first, span, key, block = whole(*args)
        return piece, first, span, key * np.uint64(0), block * np.uint64(0)

    monkeypatch.setattr(S, "_parts_of", blind)
    want = {i: removed for i, _, removed, _, _ in _plain(rows)}
    got, _ = _flow(rows)
    assert all(got[i] <= want[i] for i in want)


def test_internal_names_as_extra_columns(spark):
    names = ["row", "body", "did", "th", "at", "first", "again", "of", "of_th", "asked", "covers", "key", "block", "meta", "kind", "start", "span", "delta", "sliced", "n", "_did", "_th", "_covers", "_nth", "_of", "a.b"]
    rows = _rows(6)[:20]
    docs = spark.createDataFrame([(i, t, *range(len(names))) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    for some in (docs, docs.unionAll(docs)):
        cut = S.cut_repeats(some)
        assert cut.columns == docs.columns and cut.count() == some.count()
        assert {tuple(r)[2:] for r in cut.collect()} == {tuple(range(len(names)))}


def test_all_null(docs_of):
    got = S.digests(S.repeated_spans(docs_of([(None, None), (None, None), (1, None)]))).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(0, 0, 0, 0), (0, 0, 0, 0), (1, 0, 0, 0)]
