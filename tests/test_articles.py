"""Consolidated articles: year rules, newest rows, and merges that leave other buckets alone."""

import pathlib

from solvara.operators import articles

NAMES = {x: x for x in ("ticker", "title", "time_published", "url")}


def load(spark, rows):
    return articles.aligned(spark.createDataFrame(rows, "ticker string, title string, time_published string, url string"), "s", NAMES, keep_undated=True)


def test_times_and_years(spark):
    rows = [
        (" aa ", " One ", "2005-03-04 10:00:00", "a"), ("AA", "one", "2005-09-01", "b"), ("aa", "ONE", None, "c"), ("aa", "One", "nonsense", "d"),
        ("b", "t", "Fri, 02 Jan 2015 00:00:00 GMT", "e"), ("b", "u", "20160101T000000", "f"), ("b", "v", "2017-01-01T05:00:00Z", "g"), ("b", "w", "2018-01-01 00:00:00 UTC", "h"), ("b", "x", "2019-05-05 garbage", "i"),
        (None, "t", "2005", "j"), ("", "t", "2005-01-01", "k"), ("c", None, "2005-01-01", "l"),
    ]
    got = {(r.ticker, r.title.lower(), r.pub_year): r.url for r in articles.newest(load(spark, rows)).collect()}
    # an unread text sorts after none
    assert got == {("AA", "one", 2005): "b", ("AA", "one", None): "d", ("B", "t", 2015): "e", ("B", "u", 2016): "f", ("B", "v", 2017): "g", ("B", "w", 2018): "h", ("B", "x", 2019): "i"}
    df = spark.createDataFrame(rows, "ticker string, title string, time_published string, url string")
    assert {r.pub_year for r in articles.aligned(df, "s", NAMES, (2016, 2018)).collect()} == {2016, 2017, 2018}
    one = articles.aligned(df, "s", NAMES, (2016, 2016)).first()
    assert one.summary == "u" and one.authors is None and one.source_dataset == "s"


def test_merges_equal_a_rebuild_and_leave_other_buckets(spark, tmp_path):
    path = tmp_path / "articles"
    first = [(f"t{k % 7}", f"title {k}", f"20{10 + k % 9}-01-01", f"u{k}") for k in range(300)]
    second = [("t1", "title 1", "2011-12-31", "newer"), ("t2", "title 2", "2012-01-01", "a"), ("t9", "new", "2020-01-01", "x")] + [("hot", "same", "2020-01-01", "h")] * 500
    assert articles.merge_articles(spark, f"file://{path}", load(spark, []), 16) == 0 and not path.exists()
    articles.merge_articles(spark, f"file://{path}", load(spark, first), 16)
    files = lambda: {p.name for p in pathlib.Path(path).rglob("*.parquet")}
    before = {p.parent.name: {q.name for q in p.parent.glob("*.parquet")} for p in pathlib.Path(path).rglob("*.parquet")}
    touched = articles.merge_articles(spark, f"file://{path}", load(spark, second), 16)
    after = {p.parent.name: {q.name for q in p.parent.glob("*.parquet")} for p in pathlib.Path(path).rglob("*.parquet")}
    assert 0 < touched <= 4 and sum(after[b] != before.get(b) for b in after) == touched
    rebuilt = sorted(map(tuple, articles.newest(load(spark, first + second)).collect()), key=str)
    read = lambda: sorted(map(tuple, spark.read.parquet(f"file://{path}").drop("bucket").collect()), key=str)
    assert read() == rebuilt and len(rebuilt) == 302
    # a load that is merged again changes no row
    articles.merge_articles(spark, f"file://{path}", load(spark, second), 16)
    assert read() == rebuilt and files()


def test_patterns_lose_no_time_and_years_are_read_once(spark):
    from solvara.functions import parse_timestamp

    texts = [
        "02 Jan 2015 00:00:00 GMT", "Fri, 02 Jan 2015 00:00:00 +0100", "02 jan 2015 01:02:03", "02 Jan 2015 01:02:03 ", "02 Jan +12015 01:02:03", "2 Jan 2015 01:02:03", "20160101T000000", "20160101t235959", "+120160101T000000", "20160101T00000",
        "2017-01-01T05:00:00Z", "2017-01-01t05:00:00+01", "2017-01-01T05:00:00", "2018-01-01 00:00:00 UTC", "2018-01-01 00:00:00 Europe/Berlin", "2018-01-01 00:00:00", " 2018-01-01 00:00:00 ", "2018-13-01 00:00:00", "soon", "", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", parse_timestamp("t", list(articles.FORMATS)).cast("string").alias("tried"), parse_timestamp("t", articles.FORMATS).cast("string").alias("fitting")).collect()
    assert [r.tried for r in rows] == [r.fitting for r in rows] and sum(r.tried is not None for r in rows) > 10
    plan = load(spark, [("a", "t", "soon", "u")])._jdf.queryExecution().optimizedPlan().toString()
    # one try for each form and one for the date alone
    assert plan.count("gettimestamp(") == len(articles.FORMATS) + 1
