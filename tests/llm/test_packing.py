import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from copresence.llm import packing as P

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_ids_are_the_tokenizers(ranks):
    plain, words = Tokenizer.from_file(JSON), P.WordTable(JSON, ranks, limit=50)
    rng = random.Random(1)
    texts = ["", "a", " a", "a ", "  a  b ", "a\n b", "\n", "   ", "don't 'S it's", "x<|endoftext|> y", "\x1c a\x85 b", "漢字 é😀", "a　b c"]
    texts += ["".join(rng.choice(" ab\n\té漢😀.'s1 \x85　,-<|ª½") for _ in range(rng.randrange(25))) for _ in range(800)]
    for at in range(0, len(texts), 40):
        part = texts[at : at + 40]
        got = [np.frombuffer(b, "<u4").tolist() for b in words.encode(part)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in part]


def test_wrong_ranks_are_refused():
    with pytest.raises(ValueError, match="ranks"):
        P.WordTable(JSON, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.mark.parametrize("n, points", [(1, [0, 1]), (2048, [0, 2048]), (2049, [0, 1, 2049]), (4096, [0, 2048, 4096]), (5000, [0, 904, 2952, 5000])])
def test_cut_points(n, points):
    assert P.cut_points(n) == points


def _check(runs, sequences, histogram, capacity):
    ranks, fill = {}, {}
    for length, a, b, first, offset in runs:
        ranks.setdefault(length, []).append((a, b))
        for k in range(b - a):
            fill.setdefault(first + k, []).append((offset, length))
    for length, parts in ranks.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == histogram[length] and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
    assert set(ranks) == {k for k, v in histogram.items() if v} and len(fill) == sequences
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_whole_and_tight(seed):
    rng = random.Random(seed)
    lengths = [min(2048, max(1, int(rng.lognormvariate(5 + seed * 0.4, 1)))) for _ in range(3000)]
    histogram = {}
    for x in lengths:
        histogram[x] = histogram.get(x, 0) + 1
    runs, sequences = P.plan(histogram)
    _check(runs, sequences, histogram, 2048)
    # no packing can do with fewer than these
    bound = max(-(-sum(lengths) // 2048), sum(x > 1024 for x in lengths))
    assert sequences <= bound * 1.02 + 1


@pytest.mark.parametrize("histogram", [{}, {1: 1}, {2048: 5}, {1024: 7}, {1025: 7}, {683: 10, 682: 10}, {2047: 3, 1: 5}, {700: 1000}])
def test_small_plans(histogram):
    runs, sequences = P.plan(histogram)
    _check(runs, sequences, histogram, 2048)
    if histogram == {1024: 7}:
        assert sequences == 4
    if histogram == {2047: 3, 1: 5}:
        assert sequences == 4


def test_every_piece_has_its_place(docs_of):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 600)))) for i in range(150)] + [(500, None), (501, ""), (502, "word " * 30_000), (0, "again"), (None, "no id")]
    got = P.pack(P.pieces(docs_of(rows), JSON, RANKS), rows_a_part=10).collect()
    plain = Tokenizer.from_file(JSON)
    want = []
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        points = P.cut_points(len(ids))
        want += [(i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for k, (s, e) in enumerate(zip(points, points[1:], strict=False))]
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got))) == sorted(map(str, want))
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= P.CAPACITY
    assert P.pack(P.pieces(docs_of([]), JSON, RANKS)).collect() == []
