import itertools
import random
import re

from clipmill.llm import queries
from clipmill.llm import url_rules as u


def split(url):
    """Host and path by plain string work."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lower, re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def given(host, path):
    fits = [r for r in u.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


URLS = [
    None, "", "no scheme/en/", "://", "http://", "http://com/", "http://com", "HTTP://WWW.Example.COM/en/x?y#z",
    "https://example.com/en/", "https://a.example.com/en/1", "https://a.www.example.com/en/1", "https://notexample.com/en/",
    "https://example.com/en", "http://x.net/es/1", "http://x.net/fr/", "http://x.net/de/", "http://x.org?q=http://y.net/es/",
    "http://x.org/a://b", "ftp://é.Ünet/es/", "http://x.net#/es/", "http://x.net/es/\nline", "http://com/es/",
]


def test_given_rules_equal_brute_force(spark):
    df = spark.createDataFrame([(i, url, "old") for i, url in enumerate(URLS * 2)], "page_id long, url string, Host string")
    got = u.judge(df, u.mine(df.selectExpr("url", "false block").where("false"))).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path = split(r.url)
        rule = given(host, path)
        assert (r["host"], r.path) == (host, path)
        assert (r.rule, r.verdict) == ((rule.name, rule.action) if rule else (None, "allow"))
    assert u.judge(df.where("false"), u.mine(df.selectExpr("url", "true block"))).count() == 0


def test_mined_rules_equal_brute_force(spark):
    labelled = []
    for i in range(240):
        host = ("good.org", "win-casino.org", "blog.org")[i % 3]
        path = ("news", "play", "win")[i // 3 % 3]
        labelled.append((f"http://{host}/{path}/{i}?a=1", host == "win-casino.org" and path != "news" or i % 40 == 0))
    df = spark.createDataFrame(labelled + [(None, True), ("http://x.org/", None)], "url string, block boolean")
    mining = u.Mining(least=20, confidence=0.8)
    got = {tuple(r.tokens): (r.support, round(r.confidence, 9)) for r in u.mine(df, mining).collect()}
    sets = df.where("block is not null and url is not null").select(u.tokens_of(df.url).alias("t"), "block").collect()
    every = {}
    for r in sets:
        for n in range(1, len(r.t) + 1):
            for tokens in itertools.combinations(r.t, n):
                seen, blocked = every.get(tokens, (0, 0))
                every[tokens] = (seen + 1, blocked + r.block)
    good = {k: (b, b / n) for k, (n, b) in every.items() if b >= mining.least and b / n >= mining.confidence}
    want = {
        k: (b, round(c, 9))
        for k, (b, c) in good.items()
        if not any(set(o) < set(k) and good[o][1] >= c for o in good)
    }
    assert got == want and want
    fresh = ["http://win-casino.org/play/9?a=1", "http://win-casino.org/news/9?a=1", "http://good.org/play/1?a=1", None]
    judged = u.judge(spark.createDataFrame([(x,) for x in fresh], "url string"), u.mine(df, mining)).collect()
    assert {r.url: r.verdict for r in judged} == dict(zip(fresh, ["block", "allow", "allow", "allow"]))


def urls_of(n, seed=1):
    """URLs of many hosts and paths whose kinds do not change with their number."""
    rng = random.Random(seed)
    parts = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    pick = lambda: parts[int(300 * rng.random() ** 2)]
    for i in range(n):
        url = f"http://{pick()}.{pick()}.org/{pick()}/{pick()}/{i}?{pick()}={i}"
        yield url, "/wca/" in url or rng.random() < 0.3


def test_rules_do_not_multiply_with_the_number_of_urls(spark, monkeypatch):
    found = []

    def counted(sets, shapes, confidence, plain=u._confident):
        found.append(sets.count())
        return plain(sets, shapes, confidence)

    monkeypatch.setattr(u, "_confident", counted)
    for n in (1500, 12_000):
        df = spark.createDataFrame(list(urls_of(n)), "url string, block boolean")
        u.mine(df, u.Mining(least=5, share=0.01)).count()
    assert found[1] < 1.2 * found[0]


def test_index_by_shuffle_equals_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(list(urls_of(2000)), "url string, block boolean")
    mining = u.Mining(least=10, confidence=0.5)
    want = sorted(map(repr, u.mine(df, mining).collect()))
    monkeypatch.setattr(u, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, u.mine(df.repartition(5), mining).collect())) == want and want


def test_query_finds_planted_rules(spark, tmp_path):
    """Labels planted by URL: bad documents under one section of one host, through the query itself."""
    pages, labels = [], []
    for i in range(900):
        host, section = ("shop.org", "paper.org", "forum.de")[i % 3], ("news", "offers")[i // 3 % 2]
        bad = (host, section) == ("shop.org", "offers")
        pages.append((i, f"https://{host}/{section}/{i}.html"))
        if i % 5:
            labels.append((i, 0 if bad or i % 90 == 1 else 1))
    pages += [(901, None), (902, "https://shop.org/es/"), (903, "http://shop.org/offers/"), (904, "https://shop.net/es/offers/1")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels + [(None, 0), (5, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: r for r in queries.op9_url_filter(spark, str(tmp_path)).collect()}
    assert len(got) == len(pages)
    for i, url in pages:
        planted = url is not None and "//shop.org/offers/" in url
        assert got[i].verdict == ("block" if planted or i == 904 else "allow")
        assert (got[i].mined is not None) == planted and got[i].rule == ("net/es/" if i == 904 else None)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("http://a.org/x", True)] * 30, "url string, block boolean")
    plan = u.judge(df, u.mine(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
