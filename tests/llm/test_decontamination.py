import random
import re

import pytest
from pyspark.sql import functions as F

from copresence.llm import decontamination

WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def _words(text):
    return ["".join(c.lower() if c.isascii() else c for c in w) for w in WORD.findall(text or "")]


def _plain(text, items, window=10):
    words, hit, names = _words(text), set(), set()
    for item, body in items:
        own = _words(body)
        n = min(window, len(own))
        for run in {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == run:
                    hit.update(range(i, i + n))
                    if item is not None:
                        names.add(str(item))
    return len(words), hit, sorted(names)


def _items(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, spans string")


def _cases(rng):
    names = ["a", "b", "c", "é", "1"]
    run = lambda n: " ".join(rng.choice(names) for _ in range(n))
    items = [(i, run(rng.choice([1, 2, 3, 5, 9, 10, 11, 14, 30]) if i > 3 else 12)) for i in range(25)]
    items += [(24, "z z z z z z z z z z"), (50, None), (51, ""), (52, " ,. "), (None, "q q q"), (53, "Only\tOnce, é"), (54, items[0][1]), (55, "b " * 40)]
    docs = [(i, run(rng.randint(0, 60)) if i % 3 else f"{run(5)} y {rng.choice(items)[1]} y. {run(4)}") for i in range(200)]
    docs += [(300, None), (301, ""), (302, "--"), (303, "Z-z z z z z z z z z z"), (None, "q Q q w"), (304, "only once É only ONCE é"), (300, "x"), (305, "w " * 50_000 + items[0][1])]
    return docs, items


@pytest.mark.parametrize("window,most_bytes", [(10, 1 << 20), (10, 100), (3, 1 << 20), (1, 200)])
def test_matches_brute_force(spark, docs_of, window, most_bytes):
    docs, items = _cases(random.Random(window))
    if most_bytes == 100:
        docs, items = docs[::4] + docs[200:], items[::3] + items[-8:]
    found = decontamination.matched(docs_of(docs), _items(spark, items), window, most_bytes=most_bytes).select("row.doc_id", "text", "n_words", "spans", "items", decontamination.n_hit().alias("n")).collect()
    assert len(found) == len(docs)
    some = 0
    for r in found:
        n_words, hit, names = _plain(r.text, items, window)
        covered = [k for s in r.spans for k in range(s.start, s.end)]
        assert (r.n_words, sorted(covered), r["items"], r.n) == (n_words, sorted(hit), names, len(hit)), r.text
        some += bool(hit)
    assert 10 < some < len(docs)


def test_long_items_are_cut_without_a_loss(spark, docs_of, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 15)
    rng = random.Random(1)
    text = " ".join(f"w{rng.randint(0, 40)}" for _ in range(300))
    docs = [(i, " ".join(text.split()[i : i + 10 + i % 9])) for i in range(0, 280)]
    found = decontamination.matched(docs_of(docs), _items(spark, [(1, text)]), most_bytes=200).select("n_words", decontamination.n_hit().alias("n"), "items").collect()
    assert all(r.n == r.n_words and r["items"] == ["1"] for r in found) and len(found) == 280


def test_long_matches_are_one_span(spark, docs_of):
    body = " ".join(f"w{i}" for i in range(100))
    (r,) = decontamination.matched(docs_of([(1, f"before {body} after")]), _items(spark, [(1, body)])).select("spans").collect()
    assert [tuple(s) for s in r.spans] == [(1, 101, 100)]


def test_spans_are_removed_and_covered_documents_go(spark, docs_of):
    item = "The answer is, of course: one two three four five six"
    docs = [(1, f"Clean   start. {item.upper()}! And an end that goes on; " + "so more text " * 5), (2, item + " tail"), (3, "nothing here"), (4, None), (5, "")]
    table = docs_of(docs)
    kept = decontamination.decontaminate(table, _items(spark, [(7, item)]))
    assert kept.columns == table.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "Clean   start. ! And an end that goes on; " + "so more text " * 5, 3: "nothing here", 4: None, 5: ""}
    assert kept.select(F.sum("rank"), F.sum("n_tokens")).first() == (4, 24)


def test_empty_tables(spark, docs_of):
    assert decontamination.matched(docs_of([]), _items(spark, [(1, "a")])).collect() == []
    (r,) = decontamination.matched(docs_of([(1, "a b")]), _items(spark, [])).collect()
    assert (r.n_words, r.spans, r["items"]) == (2, [], [])
