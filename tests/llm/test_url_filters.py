import re

from pyspark.sql import functions as F

from catalink.llm import queries, url_filters
from tests.conftest import SMALL
from tests.llm.helpers import clashing

URLS = [
    None, "", "no scheme", "http://", "://x/y", "HTTP://WWW.Example.COM/de/1?q=1#f", "http://a.net", "http://a.net/", "http://net/x", "http://internet/x",
    "http://a.example.net/en/1", "http://example.net/en/", "http://example.net/en", "http://example.net/de/2", "http://x.org/fr/", "http://org/fr/9",
    "http://x.org/fr?z", "http://x.com/a://b.net/c", "http://example.com/de/?a=://y", "http://ÄB.net/ü", "https://a.b.c.org/fr/#x?y", "x" * 100_000,
    "http://u@h.net:80/p", "http://a.net?x/", "http://a.net#x/", "http://a.net/\n/x",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules):
    fitting = []
    for rule, verdict in rules:
        own, start = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start):
            fitting.append((-len(rule), rule, verdict))
    return min(fitting)[1:] if fitting else (None, None)


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")


def test_hosts_paths_and_rules(spark):
    got = {r["page_id"]: r for r in url_filters.filter_urls(clashing(pages(spark, URLS + URLS[:9])), queries.URL_RULES).collect()}
    assert len(got) == len(URLS) + 9
    for i, url in enumerate(URLS + URLS[:9]):
        host, path = parts(url)
        rule, verdict = rule_of(host, path, queries.URL_RULES)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), url
        assert got[i]["verdict"] == verdict if rule else got[i]["verdict"] in ("allow", "block")
        assert 0 <= got[i]["score"] <= 1


def test_trees_find_held_out_urls(spark):
    urls = [f"http://site{i % 37}.example.{'com' if i % 3 else 'org'}/{'ad' if i % 2 else 'news'}/{i * 7919 % 100003}{'?id=' + str(i) + '&x=1' if i % 2 else ''}" for i in range(1500)]
    rows = spark.createDataFrame([(u, i % 2 if i % 5 else None, i % 2) for i, u in enumerate(urls)], "url string, label int, truth int")
    from catalink.llm.common import Scratch

    model = url_filters.fit(rows, Scratch(spark))
    scored = url_filters.judge(rows.withColumn("page_id", F.col("truth")), model).collect()
    assert sum((r["score"] >= 0.5) == (r["page_id"] == 1) for r in scored) >= 0.98 * len(scored)
    again = url_filters.judge(rows.withColumn("page_id", F.col("truth")), url_filters.fit(rows, Scratch(spark))).collect()
    assert sorted(r["score"] for r in again) == sorted(r["score"] for r in scored)


def test_labels_of_one_kind_or_none(spark):
    allowed = url_filters.filter_urls(pages(spark, ["http://x.com/", "http://y.com/"]), queries.URL_RULES).collect()
    assert [r["verdict"] for r in allowed] == ["allow", "allow"]
    blocked = url_filters.filter_urls(pages(spark, ["http://x.net/", "http://y.com/"]), queries.URL_RULES)
    assert {r["verdict"] for r in blocked.collect()} == {"block"}
    assert url_filters.filter_urls(pages(spark, []), queries.URL_RULES).count() == 0


def test_lexical_features(spark):
    row = url_filters.lexical(pages(spark, ["https://a.b2.com/x/y1?p=1&q=2#f"]), "url").first()
    assert (row["length"], row["depth"], row["labels"], row["parameters"], row["suffix"]) == (31, 2, 3, 2, "b2.com")
    assert row["digit_ratio"] == 4 / 31 and row["fragment"] == 1 and row["secure"] == 1
    flat = url_filters.lexical(pages(spark, ["aabb"]), "url").first()
    assert flat["entropy"] == 1.0


def test_pages_of_the_small_table(spark):
    got = queries.op10_url_filters(spark, SMALL).collect()
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(got) == len(urls)
    for r in got:
        rule, verdict = rule_of(*parts(urls[r["page_id"]]), queries.URL_RULES)
        assert (r["host"], r["path"]) == parts(urls[r["page_id"]]) and r["rule"] == rule and (rule is None or r["verdict"] == verdict)


def test_no_label_is_a_feature_of_its_own_row(spark):
    # Suffixes of one labelled URL each, labels without any sign in the URL: nothing can be learned from them.
    rows = spark.createDataFrame([(f"http://a{i:05d}.x{i:05d}.com/p", i * 7919 % 2 if i % 3 else (i // 3) % 2) for i in range(2000)], "url string, label int")
    from catalink.llm.common import Scratch

    model = url_filters.fit(rows, Scratch(spark))
    assert model.trees.featureImportances.toArray()[url_filters.FEATURES.index("suffix_blocked")] == 0
