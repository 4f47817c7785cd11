"""Exact dedup, URL rules and shards on small tables against brute force."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from faultline.llm import exact_dedup, sharding, url_rules

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "Very long text. " * 40_000


def rows(spark):
    data = [(1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, "É a"), (5, "é a"), (6, None), (7, ""), (8, LONG), (9, LONG.upper()), (10, LONG + "x"), (11, "a" * 300 + "b"), (12, "a" * 300 + "c"),
            (None, "same text"), (None, "alone"), (13, "twice"), (13, "twice")]
    return spark.createDataFrame([(i, t, "s", 1, "x") for i, t in data], "doc_id bigint, text string, keep_id string, _n int, kept string")


def test_exact_dedup(spark):
    got = {}
    for r in exact_dedup.exact_groups(rows(spark)).collect():
        got.setdefault(r["doc_id"], []).append((r["keep_id"], r["group_size"], r["kept"]))
    groups = defaultdict(list)
    for r in rows(spark).collect():
        groups[(r["text"] or "").translate(FOLD)].append(r["doc_id"])
    want = {}
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want.setdefault(i, []).append((keep, len(ids), i == keep))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    kept = exact_dedup.drop_exact_copies(rows(spark))
    assert kept.columns == rows(spark).columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 3, 4, 5, 7, 9, 10, 11, 12, 13]
    assert exact_dedup.exact_groups(rows(spark).where("false")).collect() == []


def test_exact_dedup_carries_expressions(spark):
    from pyspark.sql import functions as F

    out = exact_dedup.exact_groups(rows(spark), carry=[F.sha2("text", 256).alias("digest")])
    found = {r["doc_id"]: r["digest"] for r in out.collect()}
    assert found[1] == hashlib.sha256(b"Same Text").hexdigest() and found[6] is None


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "a+b.org", ""), ("block", "a+b.org", "/x?"), ("allow", "", "/empty")]
URLS = ["http://Example.COM/en/1", "http://www.example.com/en/2?x=/en/", "https://notexample.com/en/", "http://example.com", "http://example.com?/en/", "http://x.net/es/", "http://net/es/a", "http://x.net/es", None, "", "no scheme",
        "http://a+b.org", "http://aab.org/", "http://sub.a+b.org/x", "ftp://c.com:80/é/en/", "x://a.com#/", "://", ":///empty/1", "http://u.com/a://b.net/es/", "http://\nx.net/es/\nb", "http://x.NET/ES/"]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut].translate(FOLD), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(h + p, v) for v, h, p in RULES if (host == h or h and host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = min(fits, key=lambda x: (-len(x[0]), x)) if fits else (None, "allow")
    return host, path, rule, verdict


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash", "c") for i, u in enumerate(URLS)] + [(None, URLS[0], "a", "b"), (0, URLS[0], "a", "b")], "page_id bigint, url string, host string, token string")
    got = url_rules.judge_urls(pages, url_rules.rules_table(spark, RULES)).collect()
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got), key=str) == sorted(((i, *judge(u)) for i, u in [*enumerate(URLS), (None, URLS[0]), (0, URLS[0])]), key=str)
    assert url_rules.judge_urls(pages.where("false"), url_rules.rules_table(spark, RULES)).collect() == []
    assert {r["verdict"] for r in url_rules.judge_urls(pages, url_rules.rules_table(spark, [])).collect()} == {"allow"}


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([("www.example.com", f"/en/{i}") for i in range(5)] + [("a.net", "/es/1")], "host string, path string")
    index = {r["rule"]: r["token"] for r in url_rules.rule_index(url_rules.rules_table(spark, RULES[:4]), urls).collect()}
    assert index["net/es/"] in ("h:net", "p:es") and index["com/"] == "h:com"


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_shards(spark, shards):
    from pyspark.sql import functions as F

    data = [(i, "word " * (i % 37) + str(i % 90)) for i in range(2000)] + [(5000 + i, "the same text in a third of all rows") for i in range(1000)] + [(None, "null id"), (7, None), (7, ""), (8, "dup"), (8, "dup"), (9, "x" * 3000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in data], "doc_id bigint, text string, shard int, _range int")
    got = sharding.histogram_shards(docs, shards, carry=[F.crc32(F.coalesce("text", F.lit(""))).alias("crc")]).collect()
    assert sorted(((r["doc_id"], r["size"], r["crc"]) for r in got), key=str) == sorted(((i, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t in data), key=str)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) == set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 3001 + 0.01 * sum(sizes.values()) / shards
    assert sharding.histogram_shards(docs.where("false"), shards).collect() == []
