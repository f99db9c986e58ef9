"""URL filters, license scans, importance resampling."""

import math
import random
import re
import textwrap
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from copresence.llm import license_scan, resampling, url_filter
from copresence.llm.license_texts import LICENSES

URLS = [
    (1, "https://www.Example.ORG/es/1"), (2, "http://a.example.org/en/12?x#y"), (3, "http://example.org/en/2"), (4, "https://x.com/fr/"), (5, "https://x.com/de/1"),
    (6, "https://xcom/de/1"), (7, None), (8, "no scheme"), (9, "ftp://cheapcasino.net/bonus/1"), (10, "http://garden.net/roses"), (11, "://"), (12, "http://org"),
    (12, "http://org"), (None, "http://user@h.com:80/p?q://r"), (13, "http://é.net/ü#f"), (14, "http://h.net?://x.org/"), (15, "a://b://c/d\ne"), (16, "http://" + "ab" * 5000 + ".net/" + "k" * 50_000),
] + [(100 + i, f"http://{w}.net/{i}") for i, w in enumerate(["casino-games", "cheap-pills", "rose-garden", "green-garden", "cheap-casino"] * 8)]


HTML = [
    "<p>Cheap <b>casino</b> games</p><script>var cheapcasino=1</script>", "<style>.rosegarden{}</style>rose garden, green &amp; red roses <!-- greengarden -->", None, "<a href='/garden'>garden rose</a> pills",
]


def _pages(spark, urls=URLS):
    rows = [(i, u, HTML[k % len(HTML)], 1, 2, "x", "y") for k, (i, u) in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, row int, raw int, page string, t string")


def test_urls(spark, tmp_path):
    _pages(spark).write.parquet(str(tmp_path / "pages.parquet"))
    got = url_filter.op2_url_filter(spark, str(tmp_path)).collect()
    assert len(got) == len(URLS)
    by = {r.page_id: r for r in got}
    for i, url in URLS:
        assert (by[i].host, by[i].path) == url_filter.split_url(url)
    rules = {i: (by[i].rule, by[i].verdict) for i in (1, 2, 3, 4, 5)}
    assert rules == {1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: ("org/", "allow"), 4: ("com/fr/", "allow"), 5: ("com/de/", "block")}
    assert by[6].rule is None and by[12].rule is None
    assert by[9].words == ["cheap", "casino", "bonus"] and by[9].block_score > by[10].block_score and by[10].verdict == "allow"


def test_no_urls_and_clashing_names(spark, tmp_path):
    _pages(spark, []).write.parquet(str(tmp_path / "pages.parquet"))
    assert url_filter.op2_url_filter(spark, str(tmp_path)).collect() == []
    got = url_filter.judge(_pages(spark).withColumns({"verdict": F.lit("old"), "words": F.lit(1)}))
    assert got.columns == ["page_id", "url", "html", "row", "raw", "page", "t", "host", "path", "rule", "words", "block_score", "verdict"]
    assert {(r.row, r.raw, r.page, r.t) for r in got.collect()} == {(1, 2, "x", "y")} and not any(r.verdict == "old" for r in got.collect())


def test_words_of_pages(spark):
    got = spark.createDataFrame([(h,) for h in HTML], "h string").select(url_filter.text_words(F.col("h"))).collect()
    assert [r[0] for r in got] == [["cheap", "casino", "games"], ["rose", "garden", "green", "red", "roses"], [], ["garden", "rose", "pills"]]


def _splits(name):
    return [[name[:i], *rest] for i in range(1, len(name)) for rest in _splits(name[i:])] + [[name]] if name else [[]]


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_against_all_splits(seed):
    """On random names and dictionaries: no split costs less, and letters outside words are joined."""
    rng = random.Random(seed)
    for _ in range(40):
        word = lambda n: "".join(rng.choice("abc") for _ in range(n))
        counts = {word(rng.randint(2, 4)): rng.randint(1, 50) for _ in range(6)}
        total, name = sum(counts.values()), word(rng.randint(1, 9))
        cost = lambda parts: sum(math.log(total / counts[p]) if p in counts else (math.log(total) + 5) * len(p) for p in parts)
        got = url_filter.Segmenter(counts).split(name)
        assert "".join(got) == name and cost(got) == pytest.approx(min(cost(s) for s in _splits(name)))
        assert not any(a not in counts and b not in counts for a, b in zip(got, got[1:], strict=False))
    assert url_filter.Segmenter({}).split("ab") == ["ab"]


def test_segments_and_scores_against_plain_python(spark):
    """All of it again with Counter and log: dictionary, splits, labels, ratios, scores."""
    got = url_filter.judge(_pages(spark)).collect()
    texts = {0: ["cheap", "casino", "games"], 1: ["rose", "garden", "green", "red", "roses"], 2: [], 3: ["garden", "rose", "pills"]}
    counts = Counter({s: url_filter.PRIOR for s in url_filter.SEEDS})
    hosts = [url_filter.split_url(u) for _, u in URLS]
    letters = lambda t: re.findall(r"[^\W\d_]+", t)
    for k, (host, path) in enumerate(hosts):
        hyphened = "/".join(x for x in host.split(".") if "-" in x)
        counts.update(w for w in [*texts[k % 4], *letters(hyphened), *letters(path.lower())] if len(w) > 1)
    segmenter, words = url_filter.Segmenter(counts), []
    for host, path in hosts:
        named = re.sub(r"(:\d+)?$|\.[^.]*(:\d+)?$", "", host, count=1) if ":" not in host else re.sub(r"\.[^.]*(:\d+)?$", "", host)
        words.append([w for t in [*letters(named), *letters(path.lower())] for w in segmenter.split(t)])
    by = {}
    for r in got:
        by.setdefault((r.page_id, r.url), r)
    assert [by[x].words for x in URLS] == words
    block, allow, n = Counter({s: url_filter.PRIOR for s in url_filter.SEEDS}), Counter(), Counter()
    for x, ws in zip(URLS, words, strict=True):
        if by[x].rule:
            (block if by[x].verdict == "block" else allow).update(ws)
            n[by[x].verdict] += 1
    vocabulary = set(url_filter.SEEDS).union(*words)
    total = lambda c: sum(c.values()) + len(vocabulary)
    for x, ws in zip(URLS, words, strict=True):
        ratio = sum(math.log((block[w] + 1) / total(block)) - math.log((allow[w] + 1) / total(allow)) for w in ws)
        assert by[x].block_score == pytest.approx(ratio + math.log((n["block"] + 1) / (n["allow"] + 1)))
        if not by[x].rule:
            assert by[x].verdict == ("block" if by[x].block_score > 0 else "allow")


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="needs the driver's tables")
def test_model_agrees_with_rules_that_it_has_not_seen(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    found = url_filter.held_out_accuracy(pages).first()
    assert found.n > 150 and found.accuracy > 0.85, found
    judged = url_filter.judge(pages).filter("rule IS NULL").collect()
    seeded = [bool(set(r.words) & set(url_filter.SEEDS)) for r in judged]
    assert any(r.verdict == "block" and not s for r, s in zip(judged, seeded, strict=True))


def _wrapped(text, width):
    return "\n".join(textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False))


NOTICES = ("", "Copyright (c) 2020 Jane Doe\n\n", "Copyright 2019-2024 The Authors. All rights reserved.\n", "© 2021 X\n", "Copyright (C) 2001 A\nCopyright (c) 2007, 2008 B, Inc.\n")
TITLED = {"MIT": "The MIT License (MIT)", "BSD-3-Clause": "BSD 3-Clause License", "BSD-2-Clause": "BSD 2-Clause Licence", "ISC": "ISC License", "Zlib": "zlib License", "MIT-0": "MIT No Attribution", "0BSD": "Zero-Clause BSD"}


def test_licenses_however_they_are_written(docs_of):
    """Every license wrapped, titled, noticed, commented and spelled in other ways; and near misses, which are none."""
    rows, want = [], {}
    for name, text in LICENSES.items():
        made = [_wrapped(text, w) for w in range(60, 91, 3)]
        made += [f"{t}\n\n{n}{_wrapped(text, 72)}" for t in ("", TITLED[name]) for n in NOTICES]
        made += [" ".join(f"{TITLED[name]} {n} {text}".split()) for n in NOTICES[1:]]
        made += ["\n".join(f" * {x}" for x in _wrapped(text, 70).split("\n")), text.upper(), text.replace("merchantability", "merchantibility").replace("COPYRIGHT HOLDERS", "copyright  owners").replace(",", " ,")]
        near = [text[:-30], text.replace("without", "with", 1) if "without" in text else text.replace("not", "", 1), f"{text} And one more thing.", f"{text[:50]}x{text[50:]}"]
        for t, license in [(m, name) for m in made] + [(m, None) for m in near]:
            want[len(rows)] = license
            rows.append((len(rows), t))
    got = {r.doc_id: r.license for r in license_scan.scan(docs_of(rows)).collect()}
    assert {i: (want[i], got[i], rows[i][1][:200]) for i in want if want[i] != got[i]} == {}


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="needs the texts of long licenses")
def test_digests_of_long_licenses(docs_of):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows, want = [], {}
    for name, file in files.items():
        text = Path(f"/usr/share/common-licenses/{file}").read_text(encoding="utf-8")
        for made in (text, _wrapped(text, 66), " ".join(text.split()), "\n".join(f"# {x}" for x in text.split("\n"))):
            want[len(rows)] = name
            rows.append((len(rows), made))
    got = {r.doc_id: r.license for r in license_scan.scan(docs_of(rows)).collect()}
    assert got == want


def test_licenses(spark, docs_of, tmp_path):
    mit = LICENSES["MIT"]
    rows = [(1, mit), (2, "MIT License\n" + mit), (3, "Copyright (c) 2020 Someone\n\n" + mit.lower().replace(",", " ;")), (4, mit.replace("Software", "software") + "\n© 2021 X"), (5, None), (6, ""), (7, mit[:-3])]
    rows += [(8, LICENSES["BSD-3-Clause"].replace("COPYRIGHT HOLDERS", "Copyright owners")), (9, "x" * 100_000), (1, mit), (None, LICENSES["ISC"].replace("merchantability", "merchantibility"))]
    got = {r.doc_id: r.license for r in license_scan.scan(docs_of(rows)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT", 4: "MIT", 5: None, 6: None, 7: None, 8: "BSD-3-Clause", 9: None, None: "ISC"}
    docs = docs_of(rows).select("doc_id", "text")
    documents = docs.toArrow()  # noqa: F841
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    ours = sorted(map(str, (tuple(r) for r in license_scan.op5_license_scan(spark, str(tmp_path)).collect())))
    assert ours == sorted(map(str, duckdb.connect().sql(license_scan.ORACLE_SQL).fetchall()))
    assert license_scan.scan(docs_of([])).collect() == []


def test_resampling_prefers_the_target(docs_of):
    good, bad = "calm words about rivers and hills {}", "buy now click here win win {}"
    rows = [(i, (good if i % 2 else bad).format(i)) for i in range(200)] + [(500, None), (501, ""), (None, good), (1, good.format(1)), (502, bad * 3000)]
    target = docs_of([(i, good.format(i)) for i in range(50)])
    got = resampling.resample(docs_of(rows), target, share=0.5).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == math.ceil(0.5 * len(rows))
    kept = {r.doc_id for r in got if r.kept}
    assert len([i for i in kept if i is not None and i < 200 and i % 2]) >= 95
    assert {r.weight for r in got if r.doc_id in (500, 501)} == {0.0}
    assert resampling.resample(docs_of([]), target).collect() == []


def test_weights_follow_their_definition(docs_of):
    docs = docs_of([(1, "a b a"), (2, "c")])
    target = docs_of([(1, "a b")])
    count = lambda texts: sum(np.bincount(resampling.features(t), minlength=resampling.BUCKETS) for t in texts)
    raw, wanted = count(["a b a", "c"]), count(["a b"])
    ratio = np.log((wanted + 1) / (wanted.sum() + resampling.BUCKETS)) - np.log((raw + 1) / (raw.sum() + resampling.BUCKETS))
    got = {r.doc_id: r.weight for r in resampling.weights(docs, target).collect()}
    for i, t in ((1, "a b a"), (2, "c")):
        assert got[i] == pytest.approx(ratio[resampling.features(t)].sum())


@pytest.mark.parametrize("keys", [[1.0] * 40, [float(i % 7) for i in range(40)], [math.exp(i) for i in range(40)], [-0.0, 0.0] * 20])
@pytest.mark.parametrize("share", [0.01, 0.3, 0.999, 1.0])
def test_top_share_is_exact(spark, keys, share):
    df = spark.createDataFrame([(i, 0, k) for i, k in enumerate(keys)], "doc_id long, th long, key double")
    kept = sorted(r.doc_id for r in resampling.keep_top(df, "key", share).collect() if r.kept)
    want = sorted(sorted(range(len(keys)), key=lambda i: (-keys[i], i))[: math.ceil(share * len(keys))])
    assert kept == want


@pytest.mark.parametrize("kind", ["one row", "one id", "null ids", "mixed", "far ids"])
def test_exactly_so_many_rows_are_kept(spark, kind):
    """Repeated rows, ids and keys against a sort."""
    make = {
        "one row": lambda i: (7, 3, 1.0), "one id": lambda i: (7, i * 997 % 41, 1.0), "null ids": lambda i: (None, i % 3, 2.0),
        "mixed": lambda i: (None if i % 3 == 0 else i % 5, i % 2, float(i % 2)), "far ids": lambda i: ((1 << 62) - i if i % 2 else i - (1 << 62), (-1) ** i * (1 << 62), 0.0),
    }[kind]
    rows = [make(i) for i in range(43)]
    df = spark.createDataFrame(rows, "doc_id long, th long, key double").repartition(3)
    order = sorted(rows, key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1]))
    for share in (0.05, 0.3, 0.6):
        got = resampling.keep_top(df, "key", share, most_tied=5).collect()
        assert len(got) == len(rows)
        want = order[: math.ceil(share * len(rows))]
        assert sorted(map(str, ((r.doc_id, r.th, r.key) for r in got if r.kept))) == sorted(map(str, want))


def test_keys_are_weights_with_noise(spark, docs_of):
    """Gumbel keys, by hand; rows of one id and null ids draw noise of their own; the sample has exactly its share of rows."""
    rows = [(i, f"word{i} here") for i in range(30)] + [(None, "a b")] * 20 + [(99, "same text")] * 40
    docs, target = docs_of(rows), docs_of([(1, "word1 here")])
    got = resampling.resample(docs, target, share=0.3, seed=17).collect()
    assert len(got) == 90 and sum(r.kept for r in got) == 27
    low = min(r.key for r in got if r.kept)
    assert all(r.kept == (r.key >= low) for r in got)
    hashes = {r.doc_id: r.h for r in spark.sql("SELECT id AS doc_id, xxhash64(id, 17) AS h FROM range(30)").collect()}
    for r in got:
        if r.doc_id in hashes:
            unit = (hashes[r.doc_id] % (1 << 52) + 0.5) / (1 << 52)
            assert r.key == pytest.approx(r.weight - math.log(-math.log(unit)))
    for i, n in ((None, 20), (99, 40)):
        assert len({r.key for r in got if r.doc_id == i}) == n


def test_sample_is_bounded_and_whole_if_it_fits(spark):
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    assert resampling.bounded_sample(ids, 5000).count() == 5000 and resampling.bounded_sample(ids.limit(0), 10).count() == 0
    assert 350 < resampling.bounded_sample(ids, 500).count() < 650


def test_compounds_are_no_entries():
    counts = {"rose": 900, "garden": 800, "rosegarden": 7, "roses": 100, "den": 50, "gar": 60, "ab": 30, "abab": 3, "ababab": 4}
    kept = url_filter.elementary(counts)
    assert "rosegarden" not in kept and "abab" not in kept and {"rose", "garden", "roses", "den"} <= set(kept)
    assert url_filter.Segmenter(kept, 10_000).split("rosegarden") == ["rose", "garden"]


def test_names_split_by_the_words_of_pages_that_print_them(spark):
    """A site's own name stands in its footer and as a rare word in texts, and still splits; unwanted names are blocked whatever their path."""
    texts = ["the rose and the garden are in the rose garden " * 5, "green garden and red rose of the house " * 5, "a rosegarden is the garden of a rose " * 1]
    rows = [(i, f"http://{n}.example.net/{p}/{i}", f"<p>{texts[i % 3]}</p><footer>&copy; {n}.example.net, www.{n}.example.net</footer>") for i, (n, p) in enumerate((n, p) for n in ("rosegarden", "greenhouse", "casino-win") for p in ("en", "fr", "de", "es") for _ in range(9))]
    rows += [(1000 + i, f"http://{n}.example.{t}/{p}/7", None) for i, (n, t, p) in enumerate((n, t, p) for n in ("rosegarden", "greenhouse") for t in ("org", "com") for p in ("en", "fr", "de", "es") for _ in range(9))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = url_filter.judge(pages, compounds=10, seeded=True).filter("rule IS NULL").collect()
    words = {r.url.split("/")[2].split(".")[0]: r.words[:2] for r in got}
    assert words == {"rosegarden": ["rose", "garden"], "greenhouse": ["green", "house"], "casino-win": ["casino", "win"]}
    assert all(r.verdict == "block" for r in got if "casino" in r.words)
    assert {r.verdict for r in got if "casino" not in r.words and "fr" in r.words} == {"allow"}


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="needs the driver's tables")
def test_segmentation_and_words_decide_on_the_drivers_pages(spark, capsys):
    got = url_filter.op2_url_filter(spark, "/root/testdata/sf0.1").filter("rule IS NULL").collect()
    letters = re.compile(r"[^\W\d_]+")
    whole = lambda r: letters.findall("/".join([r.host.rpartition(".")[0], r.path.lower()]))
    changed = sum(r.words != whole(r) for r in got)
    assert changed > 0.8 * len(got), (changed, len(got))
    verdicts = {}
    for r in got:
        verdicts.setdefault(r.path.split("/")[1], Counter())[r.verdict] += 1
    assert sum(min(v["allow"], v["block"]) for v in verdicts.values()) > 0.05 * len(got), verdicts
    assert all(r.verdict == "block" for r in got if "casino" in r.words)
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    found = url_filter.held_out_accuracy(pages, compounds=url_filter.COMPOUND, seeded=True).first()
    assert found.n > 150 and found.accuracy > 0.79, found  # always `allow` agrees on 0.75
    with capsys.disabled():
        print(f"split: {changed} of {len(got)}; verdicts by the path's first part: {verdicts}")
