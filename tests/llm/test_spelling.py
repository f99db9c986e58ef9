import random
import re
from collections import Counter
from zlib import crc32

import pytest

from copresence.llm import spelling


def _edit_one(a, b):
    """Whether b is among all words that one edit makes of a, by listing what each position could be."""
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _plain(rows, one_in=199, least_letters=6, least_count=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % one_in == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_count}
    form, out = {}, {}
    for w, n in counts.items():
        near = sorted((-m, x) for x, m in counts.items() if _edit_one(w, x))
        usual = bool(near) and -near[0][0] >= 5 * n
        form[w] = near[0][1] if usual else None
        out[w] = [n, len(near), form[w], -near[0][0] if usual else None]
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w].append(root)
    return out


def _got(found):
    return {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in found.collect()}


def _text(rng, n):
    syllables = ["tion", "ea", "ré", "st", "ñ", "an", "o", "×", "lle"]
    return "".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) + rng.choice([" ", " ", ", ", "œ", "1", "—", "\n"]) for _ in range(n))


@pytest.mark.parametrize("one_in", [199, 3])
def test_matches_brute_force(docs_of, one_in):
    rng = random.Random(one_in)
    rows = [(i, _text(rng, 300)) for i in range(60)] + [(7, "Tionea tionea " * 40), (None, "TIONEA tionean " * 9), (8, None), (9, ""), (10, "…一 1 2"), (11, "stané " * 30_000)]
    want = _plain(rows, one_in)
    found = spelling.variants(spelling.vocabulary(docs_of(rows), one_in=one_in))
    assert _got(found) == want
    assert sum(v[1] > 0 for v in want.values()) > 50 and any(v[2] for v in want.values())


def test_halves_find_every_edit_at_every_place(spark, monkeypatch):
    """All words one edit from a few, of any length, and in shards of few rows."""
    words = {"abcdef", "aaaaaa", "abababab", "abcdefghijk", "éabcdefghijkl"}
    for w in list(words):
        words |= {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "az"} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "bz"}
    words = sorted(w for w in words if len(w) >= 6)
    rows = [(w, 1 + i % 7) for i, w in enumerate(words)]
    found = spelling.near_words(spark.createDataFrame(rows, "word string, n long")).collect()
    want = {(a, b) for a in words for b in words if _edit_one(a, b)}
    assert len(found) == len(want) and {(r.word, r.near) for r in found} == want
    assert all(r.near_n == dict(rows)[r.near] for r in found)


def test_shards_of_any_size_give_the_same_links(monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(6, 8))) for _ in range(400)})
    rows = pa.RecordBatch.from_arrays([pa.array(words), pa.array([1] * len(words), pa.int64())], ["word", "n"])
    dealt = pa.Table.from_batches(spelling._dealt(6)(iter([rows]))).sort_by("deal")
    links = []
    for size in (1, 50, 10**9):
        monkeypatch.setattr(spelling, "SHARD_ROWS", size)
        found = pa.Table.from_batches(spelling._linked(iter(dealt.to_batches(max_chunksize=100))))
        links.append(sorted(zip(found["word"].to_pylist(), found["near"].to_pylist(), strict=True)))
    assert links[0] == links[1] == links[2] == sorted((a, b) for a in words for b in words if _edit_one(a, b))


def test_forms_are_followed_to_the_last(spark):
    names = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb", "bbbbbb"]
    found = spelling.variants(spark.createDataFrame([(w, 5 ** (i + 1)) for i, w in enumerate(names)], "word string, n long"))
    assert {r.root for r in found.collect()} == {"bbbbbb"}
    tied = spark.createDataFrame([("aaaaaa", 5), ("aaaaac", 25), ("aaaaab", 25), ("zzzzzz", 5)], "word string, n long")
    got = _got(spelling.variants(tied))
    assert got["aaaaaa"] == [5, 2, "aaaaab", 25, "aaaaab"] and got["zzzzzz"] == [5, 0, None, None, "zzzzzz"]


def test_empty_tables(docs_of):
    assert spelling.variants(spelling.vocabulary(docs_of([]))).collect() == []
    assert spelling.variants(spelling.vocabulary(docs_of([(1, None), (2, "one two three")]))).collect() == []
