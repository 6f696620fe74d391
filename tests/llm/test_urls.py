import re

import pytest

from strandsift.llm import urls
from strandsift.llm.queries import URL_RULES, op11_urls


@pytest.fixture(scope="module")
def model(spark):
    return urls.fit(urls.default_table(spark))


def parts(url):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    return (lower(found[1]), found[2]) if found else ("", "")


def rule(host, path):
    fits = []
    for text, says in URL_RULES:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(text), text, says))
    return max(fits)[1:] if fits else (None, None)


def test_whole_table_against_plain_parsing_and_rules(spark, small, model):
    got = op11_urls(spark, small).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        host, path = parts(pages[r.page_id])
        assert (r.host, r.path) == (host, path)
        assert r.rule == rule(host, path)[0]
        assert r.verdict == (rule(host, path)[1] or ("block" if r.score >= 0.5 else "allow"))


def test_margin_is_the_sum_over_hashed_grams(spark, model):
    from pyspark.sql import functions as F

    host, path = "shop.häuser-ab.net", "/en/x"
    df = spark.createDataFrame([(host, path)], "host string, path string")
    found = df.select(urls.grams(F.col("host"), 0, 8192).alias("h"), urls.grams(F.col("path"), 1, 8192).alias("p"), model.margin(F.col("host"), F.col("path")).alias("m")).first()
    for text, part, own in ((host, 0, found.h), (path, 1, found.p)):
        text = f"^{text}$"
        plain = [text[i : i + n] for n in urls.SIZES for i in range(len(text) - n + 1)]
        assert len(own) == len(plain)
        assert all(0 <= f < 8192 for f in own)
        hashed = [spark.range(1).select(F.pmod(F.xxhash64(F.lit(part), *[F.lit(c) for c in g]), F.lit(8192)).cast("int")).first()[0] for g in plain[:5]]
        assert own[:5] == hashed
    want = model.bias + sum(sum(model.weights[f] for f in own) / len(own) ** 0.5 for own in (found.h, found.p))
    assert found.m == pytest.approx(want, abs=1e-9)


def test_names_it_has_not_seen(spark, model):
    """Other names of both kinds than those of the table."""
    bad = ["www.mega-casino-bonus.com/", "sports-betting.example.net/en/2", "m.discount-viagra-pills.org/buy", "free-porn-videos.info/a", "ads.adnetwork.example.com/", "spam-links.net/x"]
    good = ["www.cityschool.org/en/2", "journal-of-history.net/", "blog.wandering.example.com/de/3.html", "weatherstation.info/a", "m.ostrelin.example.net/en/4", "garden-books.com/x"]
    df = spark.createDataFrame([(i, f"https://{u}") for i, u in enumerate(bad + good)], "page_id long, url string")
    said = {r.page_id: r.verdict for r in urls.judge(df, [], model).collect()}
    assert sum(said[i] == "block" for i in range(len(bad))) >= 5
    assert sum(said[i] == "allow" for i in range(len(bad), len(bad) + len(good))) == len(good)


def test_training_fits_its_table_and_needs_both_labels(spark, model):
    from pyspark.sql import functions as F

    table = urls.default_table(spark)
    table = spark.createDataFrame(table.collect(), table.schema)  # a plan over local rows is evaluated while it is planned
    scored = table.select("label", model.margin(urls.host_of(F.col("url")), urls.path_of(F.col("url"))).alias("m"))
    assert scored.select(F.avg(((F.col("m") > 0) == (F.col("label") == 1)).cast("int"))).first()[0] > 0.97
    assert urls.fit(table.where("label = 0")).bias == -1.0
    assert urls.fit(table.where("label = 1")).bias == 1.0
    assert urls.fit(table.limit(0)).bias == -1.0
    odd = table.union(spark.createDataFrame([(None, 1), ("http://a.b/", None), ("http://a.b/", 7)], "url string, label int"))
    again = urls.fit(odd)
    assert again.bias == pytest.approx(model.bias)
    assert again.weights == pytest.approx(model.weights)


def test_a_bounded_sample_teaches(spark):
    table = urls.default_table(spark)
    table = table.union(table).union(table)  # a URL on several rows takes one place
    seen = urls.fit(table, sample_rows=50, rounds=1)
    assert sum(x != 0 for x in seen.weights) < sum(x != 0 for x in urls.fit(table, rounds=1).weights)


def test_odd_rows(spark, model):
    long = "http://a.org/" + "é/" * 20_000
    rows = [(1, None, "x"), (2, "", "x"), (3, "no scheme/at all", "x"), (4, "://HOST.Com/P?q#f", "x"), (4, "://HOST.Com/P?q#f", "x"), (None, "x://y://z/w", "x"), (5, long, "x"), (6, "http://ÄB.COM?x/y", "x"), (7, "http://\n/a\nb#c", "x")]
    df = spark.createDataFrame([(*r, "h", "p", 0.5) for r in rows], "page_id long, url string, verdict string, host string, path string, score double")
    got = urls.judge(df, URL_RULES, model)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    by = {}
    for r in got.collect():
        by.setdefault(r.page_id, []).append(r)
    for i in (1, 2, 3):
        assert tuple(by[i][0])[1:5] == ("", "", None, "allow")
    assert len(by[4]) == 2
    assert tuple(by[4][0])[1:5] == ("host.com", "/P", "com/", "allow")
    assert tuple(by[None][0])[1:3] == ("y:", "//z/w")
    assert by[5][0].path == long[12:]
    assert tuple(by[6][0])[1:4] == ("Äb.com", "", None)
    assert tuple(by[7][0])[1:3] == ("\n", "/a\nb")
    assert urls.judge(df.limit(0), URL_RULES, model).count() == 0


def test_longest_rule_of_host_and_subdomains(spark, model):
    df = spark.createDataFrame([(1, "http://x.example.com/en/1"), (2, "http://www.example.com/en/1"), (3, "http://notexample.com/en/"), (4, "http://net/es/"), (5, "http://a.net/fr"), (6, "http://com")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, URL_RULES, model).collect()}
    assert got[1] == ("example.com/en/", "block")
    assert got[2] == ("www.example.com/en/", "allow")
    assert got[3] == ("com/", "allow")
    assert got[4] == ("net/es/", "block")
    assert got[5][0] is None
    assert got[6][0] is None
