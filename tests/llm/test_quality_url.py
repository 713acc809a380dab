"""Quality rules and URL filters on small fixtures, against plain Python."""

import re

from pyspark.sql import functions as F

from sluicework.llm.quality_rules import RULES, Rule, quality
from sluicework.llm.url_filter import judge_urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


TEXTS = [
    None, "", " \n\t ", "one two three four five", "a b c d e a b c d e", "a a a a a a", "a a a a a",
    "x\u00a0y z\u2003w", "é ü ñ 漢字 # $ |", "same line\nsame line\n\nsame line \n", "a b c d e f " * 3,
    " ".join(f"w{i}" for i in range(3000)) + " w1 w2 w3 w4 w5", "q " * 20000, "\r\nlead\x0btab\x0c",
    "the cat of the house is in the garden and it is by the wall of the town",
]


def test_quality_measures_equal_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "y"), (None, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = quality(docs).collect()
    assert len(got) == len(rows)
    want = sorted((-1 if i is None else i, *brute(t)) for i, t, _ in rows)
    assert sorted((-1 if r[0] is None else r[0], *r[1:7]) for r in got) == want


def test_quality_thresholds_and_empty_table(spark):
    text = "the cat of the house is in the garden and it is by the wall"
    docs = spark.createDataFrame([(1, text), (2, text.replace(" ", " ### "))], "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.kept, r.failed_rules) for r in quality(docs).collect()}
    assert got == {1: (False, True, []), 2: (False, False, ["symbols_per_word"])}
    strict = quality(docs, [Rule("short", "mean_word_length", 30, None)]).collect()
    assert not any(r.kept for r in strict)
    assert quality(docs.where("false"), RULES).count() == 0


URLS = [
    (1, "https://WWW.Example.com/en/a?x=1", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
    (2, "http://m.example.com/en/a", "m.example.com", "/en/a", "example.com/en/", "block"),
    (3, "http://a.com", "a.com", "", None, "allow"),
    (4, "http://a.com/", "a.com", "/", "com/", "allow"),
    (5, "http://x.net/es/1#t", "x.net", "/es/1", "net/es/", "block"),
    (6, "http://x.net/en/1", "x.net", "/en/1", None, "allow"),
    (7, "http://xnet/es/1", "xnet", "/es/1", None, "allow"),
    (8, None, "", "", None, "allow"),
    (9, "no scheme", "", "", None, "allow"),
    (10, "http://bad.org/p/?b=2&utm_source=f&a=1#z", "bad.org", "/p/", None, "block"),
    (11, "http://bad.org/q", "bad.org", "/q", None, "allow"),
    (12, "http://h?x://y/z", "h", "", None, "allow"),
    (12, "http://h?x://y/z", "h", "", None, "allow"),
    (13, "a\n://B.COM/\nx", "b.com", "/\nx", "com/", "allow"),
]


def test_url_rules_list_and_false_positives(spark):
    pages = spark.createDataFrame([(i, u, "z") for i, u, *_ in URLS], "page_id long, url string, host string")
    listed = spark.createDataFrame([("https://bad.org:443/p?a=1&b=2",), (None,), ("x",), ("https://bad.org/p?b=2&a=1",)], "url string")
    for blocks in (1, 32768):  # one block lets nearly all through to the exact join
        got = judge_urls(pages, listed, blocks=blocks).drop("listed").collect()
        assert sorted(map(tuple, got)) == sorted((i, h, p, r, v) for i, _, h, p, r, v in URLS) or \
            sorted(map(str, map(tuple, got))) == sorted(str((i, h, p, r, v)) for i, _, h, p, r, v in URLS)
    many = spark.range(5000).select(F.concat(F.lit("http://l.org/"), "id").alias("url"))
    asked = spark.range(10000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://l.org/"), "id").alias("url"))
    assert judge_urls(asked, many, blocks=4).where("verdict = 'block'").count() == 5000
    assert judge_urls(pages, listed.where("false")).where("listed").count() == 0
    assert judge_urls(pages.where("false"), listed).count() == 0
