"""Every word counts in the URL filter, however many there are."""

from copresence.llm import url_filter


def test_rare_words_count_past_50_000(spark):
    letters = "abcdefghij"
    name = lambda i: "q" + "".join(letters[int(d)] for d in f"{i:05d}")
    rows = [(i, f"http://h.net/{name(i // 2)}") for i in range(104_000)]
    rows += [(200_000, "http://h.net/viagra"), (200_001, "http://h.net/zuzu-zozo"), (200_002, "http://zuzuzozo.net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, html=None).filter("page_id >= 200000").collect()}
    clean = url_filter.judge(pages, html=None).filter("page_id = 0").first()
    assert got[200_002].words == ["zuzu", "zozo"]
    assert got[200_000].words == ["h", "viagra"] and got[200_000].block_score > clean.block_score + 1
