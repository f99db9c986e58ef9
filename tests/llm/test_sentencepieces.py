import hashlib
import random

import public_tokenizers
import sentencepiece

from copresence.llm import sentencepieces as S

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _texts():
    rng = random.Random(1)
    texts = [None, "", " ", "a", " a", "a ", "  a  b ", "a\n b", "\n", "▁x ▁ y", "a\x00b", "</s> <s>x<unk>", "é😀 漢字　x y", "x\ty  \n\n  z", "<0x41> ﬁ ²", "word " * 20_000]
    return texts + ["".join(rng.choice(" ▁ab\n\té漢😀.<0x41>") for _ in range(rng.randrange(30))) for _ in range(600)]


def test_same_as_the_library(docs_of):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = _texts()
    docs = docs_of(list(enumerate(texts)))
    by_id = {r.doc_id: r for r in S.digests(docs, MODEL, batch=50).collect()}
    whole = {r.doc_id: r for r in S.encode(docs, MODEL).collect()}
    for i, t in enumerate(texts):
        ids = [*library.encode(t or ""), library.eos_id()]
        joined, back = " ".join(map(str, ids)), library.decode(ids)
        assert (whole[i].n_tokens, whole[i].ids, whole[i].decoded) == (len(ids), joined, back)
        assert (by_id[i].ids_sha256, by_id[i].decoded_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (joined, back))


def test_small_tables_and_no_rows(docs_of):
    words = S.WordTable(MODEL, limit=3)
    big = S.WordTable(MODEL)
    texts = [t or "" for t in _texts()]
    assert [x for t in texts for x in words.encode([t])] == list(big.encode(texts))
    assert S.digests(docs_of([]), MODEL).collect() == [] and "text" not in S.digests(docs_of([]), MODEL).columns
