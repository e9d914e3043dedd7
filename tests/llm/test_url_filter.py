from urllib.parse import urlsplit

from pyspark.sql import functions as F

from formlens.llm.common import Scratch, table
from formlens.llm.queries import URL_RULES
from formlens.llm.url_filter import FOLDS, judge_urls, url_fold

SF = "/root/testdata/sf0.01"


def rule_of(host, path):
    best = None
    for action, text in URL_RULES:
        at, _, tail = text.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + tail) and (best is None or len(text) > len(best[1])):
            best = (action, text)
    return best


def test_rules_hosts_and_paths(spark):
    rows = {r.page_id: r for r in judge_urls(table(spark, SF, "pages"), URL_RULES, Scratch(spark, "t"), trees=3).collect()}
    for p in table(spark, SF, "pages").select("page_id", "url").collect():
        u, r = urlsplit(p.url), rows[p.page_id]
        assert (r.host, r.path) == (u.netloc.lower(), u.path)
        best = rule_of(r.host, r.path)
        assert r.rule == (best and best[1]) and (best is None or r.verdict == best[0]) and r.verdict in ("allow", "block")


def test_learns_a_lexical_pattern(spark):
    """Labels by rule follow the path's language; unlabelled urls of the same shape get the same verdict."""
    urls = [(i, f"http://a{i}.{'bad' if i % 2 else 'good'}/{'x' * (30 if i % 2 else 3)}/{i}?q={i}") for i in range(300)] + [(1000 + i, f"http://b{i}.other/{'x' * (30 if i % 2 else 3)}/{i}?q={i}") for i in range(100)]
    got = judge_urls(spark.createDataFrame(urls, "page_id long, url string"), [("block", "bad/"), ("allow", "good/")], Scratch(spark, "t"), trees=4).filter("page_id >= 1000")
    right = got.agg(F.avg((F.col("verdict") == F.when(F.col("page_id") % 2 == 1, "block").otherwise("allow")).cast("double"))).first()[0]
    assert right > 0.95


def test_trees_on_rule_labelled_urls_they_have_not_seen(spark):
    """Real urls: the last fold's rule verdicts, which the trees didn't learn from."""
    pages = table(spark, "/root/testdata/sf0.1", "pages").select("page_id", "url")
    got = judge_urls(pages, URL_RULES, Scratch(spark, "t")).join(pages, "page_id").filter(F.col("rule").isNotNull() & (url_fold(F.col("url")) == FOLDS - 1))
    right = got.agg(F.count("*").alias("n"), F.avg(((F.col("p_block") >= 0.5) == (F.col("verdict") == "block")).cast("double")).alias("right"), F.avg((F.col("verdict") == "block").cast("double")).alias("share")).first()
    print(right)
    assert right.n > 100 and right.right > max(right.share, 1 - right.share)


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "no scheme/path", 3), (4, "HTTP://WWW.Example.COM/en/x?q#f", 4), (5, "http://x.net?/es/", 5), (6, "http://x.net/es/" + "a" * 50000, 6), (None, "http://É.net/fr/", 7), (4, "http://com/", 8), (8, "://", 9)]
    got = {str(r.page_id) + str(r.host)[:8]: (r.host, r.path[:4], r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, host int"), URL_RULES, Scratch(spark, "t"), trees=2).collect()}
    assert len(got) == 9 and got["1"][:3] == ("", "", None) and got["3"][:3] == ("", "", None) and got["8"][:3] == ("", "", None)
    assert got["4www.exam"] == ("www.example.com", "/en/", "www.example.com/en/", "allow") and got["4com"] == ("com", "/", "com/", "allow")
    assert got["5x.net"][:3] == ("x.net", "", None) and got["6x.net"] == ("x.net", "/es/", "net/es/", "block") and got["NoneÉ.net"][2:] == ("net/fr/", "block")
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES, Scratch(spark, "t")).collect() == []
