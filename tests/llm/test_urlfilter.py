import random

import numpy as np
import pytest

from pitchlake.llm import urlfilter

URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "https://example.com/en/1", "https://a.b.example.com/en", "https://com/", "x://com",
    "https://example.com?x=://y/en/", "http://shop.net/es/?q", "http://net/fr/#a", "http://xnet/fr/", "http://user@net/fr/", "ftp://Ünet.net/es/\nline", "a://b://c.com/", "http://.com/", "http://a..com/x",
]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    hits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(hits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "x", 5) for i, u in enumerate(urls)], "page_id long, url string, host string, rule int")


@pytest.mark.parametrize("rules", [urlfilter.RULES, (), (("b.com", "/a", "block"), ("com", "/abc", "allow"), ("b.com", "", "allow"))])
def test_against_brute_force(spark, rules):
    rng = random.Random(1)
    urls = URLS + [f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'www.', 'a.', 'A.b.'])}{rng.choice(['com', 'b.com', 'example.com', 'net', 'b.net'])}{rng.choice(['', '/', '/en/', '/EN/', '/es/x', '/abc', '/a?b', '#/en/'])}" for _ in range(200)]
    want = [(i, *brute(u, rules)) for i, u in enumerate(urls)]
    assert sorted(map(tuple, urlfilter.judge(frame(spark, urls), rules).collect())) == want
    if rules:
        table = spark.createDataFrame([(*r, i) for i, r in enumerate(rules)], "host string, path string, verdict string, position int")
        assert sorted(map(tuple, urlfilter.judge_by_join(frame(spark, urls), table).collect())) == want


@pytest.mark.parametrize("shard", [1, 2, 1 << 20])
def test_any_number_of_shards_and_the_join_agree(spark, monkeypatch, shard):
    """Equal rules (the last counts), hosts in any case, and lists on both sides of a shard's size."""
    monkeypatch.setattr(urlfilter, "SHARD_RULES", shard)
    monkeypatch.setattr(urlfilter.build, "__defaults__", (shard,))
    rules = [("a.com", "/", "block"), ("A.com", "/", "allow"), ("b.com", "/x", "allow"), ("B.COM", "/x", "block"), ("É.com", "/", "block"), ("é.com", "/y", "block")]
    urls = ["http://a.com/", "http://x.A.com/q", "http://b.com/xy", "http://b.com/", "http://É.com/", "http://é.com/y", "http://É.com/y", None, "http://" + "a." * 5000 + "com/" + "x" * 50_000]
    last = [("a.com", "/", "allow"), ("b.com", "/x", "block"), ("É.com", "/", "block"), ("é.com", "/y", "block")]
    want = [(i, *brute(u, last)) for i, u in enumerate(urls)]
    assert len(urlfilter.build(rules)) == 1 + -(-4 // shard)
    assert sorted(map(tuple, urlfilter.judge(frame(spark, urls), rules).collect())) == want
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rules)], "host string, path string, verdict string, position int")
    assert sorted(map(tuple, urlfilter.judge_by_join(frame(spark, urls), table).collect())) == want


def test_collisions_are_told_apart_by_the_strings():
    _, blob = urlfilter.build([("a.com", "/", "block"), ("b.com", "/", "allow")])
    shard = urlfilter.Shard(np.frombuffer(blob, np.uint8))
    other = shard.keys[:1].copy()  # a key that isn't stored, with the digest of one that is
    assert shard.find([b"c.com\0/"], other)[0] == -1


def test_empty_table_and_repeated_rows(spark):
    assert urlfilter.judge(frame(spark, [])).collect() == []
    twice = frame(spark, ["http://net/es/", None]).unionByName(frame(spark, ["http://net/es/", None]))
    assert sorted(r.verdict for r in urlfilter.judge(twice).collect()) == ["allow", "allow", "block", "block"]
