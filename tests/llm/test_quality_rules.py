import random

import duckdb
import pytest
from pyspark.sql import functions as F

from copresence.llm import quality_rules

GOOD = "The quick brown fox number {} jumps over the lazy dog while the sun sets behind hills.\n"
_RNG = random.Random(1)
PROSE = "".join(" ".join("".join(_RNG.choice("etaoinsh") for _ in range(_RNG.randint(2, 8))) for _ in range(12)) + ".\n" for _ in range(8))
ROWS = [
    (1, None), (2, ""), (3, "\n\n \t\x0b\x0c\r\n"), (4, PROSE), (5, GOOD.format(1) * 8),
    (6, "Home | About | News | Contact | Help | Shop | Login | Terms | Jobs | Blog | More | Top\n" * 6), (7, "one two three one two three"),
    (8, "a b c a b c a b"), (9, "word"), (9, "word"), (None, "null id text."), (10, PROSE + "Accept cookies to go on.\nX {y}\n"),
    (11, "x*** y&&& z$$$ " * 30), (12, "Wörter für Ärzte ‒ ☃ größer. " * 20), (13, "STOP!! GO!! NOW!! " * 30), (14, "a " * 30_000),
]


def test_matches_sql_on_edge_cases(spark, docs_of, tmp_path):
    docs = docs_of(ROWS)
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    documents = docs.select("doc_id", "text").toArrow()  # noqa: F841
    want = duckdb.connect().sql(quality_rules.ORACLE_SQL)
    got = quality_rules.op1_quality_rules(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_verdicts(docs_of):
    got = {r.doc_id: r.quality for r in quality_rules.judge(docs_of(ROWS)).collect()}
    assert got[4].kept and got[4].lost_chars == 0 and got[4].clean_text == ROWS[3][1]
    assert got[5].base_failed and got[5].n_dup_lines == 7
    assert not got[6].kept and not got[11].kept and not got[13].kept
    assert got[10].kept and got[10].n_lines_removed == 2 and "cookies" not in got[10].clean_text
    assert got[1].base_failed and not got[1].kept and got[1].n_words == 0


@pytest.mark.parametrize("text, words", [("a b c a b c", 6), ("a b c d a b c", 6), ("a a a a", 4), ("a b", 0), ("a b c x y", 0), ("a a a", 0)])
def test_repeated_windows(spark, text, words):
    out = spark.range(1).select(quality_rules.repeated_window_words(F.array(*map(F.lit, text.split()))).alias("n")).first()
    assert out.n == words


def test_empty_table_and_no_python(spark, docs_of):
    judged = quality_rules.judge(docs_of([]))
    assert judged.collect() == []
    plan = judged._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
