"""Endpoints against the standard library's parsers."""

import ipaddress
import random

import pytest
from urllib.parse import unquote, urlsplit

from lodestone.operators import urls

HOSTS = ["localhost", "LOCALHOST.localdomain", "example.com", "127.0.0.1", "127.255.0.9", "0.0.0.0", "0.1.2.3", "10.0.0.1", "100.63.255.255", "100.64.0.0", "100.127.255.255", "100.128.0.0", "169.254.1.1", "172.15.1.1", "172.16.0.1", "172.31.9.9", "172.32.0.1", "192.0.0.8", "192.0.0.9", "192.0.0.10", "192.0.0.11", "192.0.2.1", "192.168.1.1", "198.17.1.1", "198.18.0.1", "198.20.0.1", "198.51.100.7", "203.0.113.9", "224.0.0.1", "239.1.1.1", "240.0.0.1", "255.255.255.255", "8.8.8.8", "01.2.3.4", "1.2.3", "1.2.3.256", "1.2.3.4.5", "[::1]", "[::]", "[::2]", "[fd00::1]", "[FE80::a:b]", "[fec0::1]", "[2001:db8::1]", "[2001:4860:4860::8888]", "[2001:1::1]", "[2001:1::3]", "[2001:20::5]", "[2001:4:112::1]", "[2002:808:808::]", "[3fff::1]", "[64:ff9b:1::1]", "[64:ff9b::1]", "[100::1]", "[::ffff:10.1.2.3]", "[::ffff:8.8.8.8]", "[::ffff:7f00:1]", "[1:2:3:4:5:6:7:8]", "[1:2:3:4:5:6:7]", "[1::2::3]", "[::g]", "[1:2:3:4:5:6:1.2.3.4]", "[]", ""]
URLS = ["http://a/b?x", "http://a/b?", "http://a#", "http://u@a/", "http://u:p@a/", "ftp://a/", "a/b", "", None, "http://a:/x", "http://a:0/", "http://a:65536/", "http://a:65535/", "http://a:x/", "http://a/../b", "http://a/%2e%2e/b", "http://a/b/.", "http://a/..b/c", "http://a/b%5cc", "http://a\\b", "http://a/b c", " http://a/b \n", "HTTPS://A/B", "http://a/%zz/x", "http://a/b+c", "http:///x", "http://[::1/x", "https://a", "http://a/%20x"]


def parse(url):
    raw = (url or "").strip()
    try:
        p = urlsplit(raw)
        port = p.port
    except ValueError:
        return None
    path = unquote(p.path)
    if p.scheme not in ("http", "https") or not p.hostname or p.netloc.endswith(":") or port == 0 or p.username is not None or p.password is not None or "?" in raw or "#" in raw:
        return None
    if any(c.isspace() or ord(c) < 32 or ord(c) == 127 for c in raw) or "\\" in raw + path or any(x in (".", "..") for x in path.split("/")):
        return None
    return p.scheme, p.hostname, port or (443 if p.scheme == "https" else 80), path.rstrip("/")


def kind(url):
    p = parse(url)
    if p is None or p[0] == "https":
        return p and "https"
    if p[1] in urls.LOOPBACK_NAMES:
        return "loopback"
    try:
        a = ipaddress.ip_address(p[1])
    except ValueError:
        return "hostname"
    return "loopback" if a.is_loopback or a.is_unspecified else "public" if a.is_global else "private"


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    some = [f"http://{ipaddress.ip_address(rng.getrandbits(32))}/" for _ in range(300)] + [f"http://[{ipaddress.ip_address(rng.choice([0, 0x20010000 << 96, 0xfc << 120, 0xffff << 32]) | rng.getrandbits(rng.choice([32, 90, 100, 128])))}]/" for _ in range(300)]
    all_ = [*URLS, *(f"http://{h}/v" for h in HOSTS), *(f"https://{h}" for h in HOSTS), *some]
    return spark.createDataFrame(list(enumerate(all_)), "i int, url string")


def test_transport(table):
    for r in urls.transport(table, "url").collect():
        assert r.transport == kind(r.url), r.url


def test_allowed(spark, table):
    prefixes = ["http://A/b/", "https://a", "http://127.0.0.1:80/v", "http://[::1]/", "http://[2001:4860:4860:0::8888]/v", "http://example.com/vv", "ftp://a", "http://a/%2e", "http://a:65535"]
    more = ["http://a/b", "http://a/b/c", "http://a/bc", "http://a:81/b", "https://a/x/y", "https://a:443", "http://127.0.0.1/v/", "http://127.0.0.1/vv", "http://a/b/c", "http://a:65535/q"]
    both = table.unionByName(spark.createDataFrame([(i + 9000, u) for i, u in enumerate(more)], "i int, url string"))
    entries = [p for p in map(parse, prefixes) if p]
    same = lambda h: ipaddress.ip_address(h) if ":" in h else h

    def want(url):
        p = parse(url)
        return p and any((p[0], same(p[1]), p[2]) == (e[0], same(e[1]), e[2]) and (p[3] == e[3] or p[3].startswith(e[3] + "/")) for e in entries)

    got = urls.allowed(both, "url", spark.createDataFrame([(p,) for p in prefixes], "prefix string")).collect()
    assert len(got) == both.count()
    for r in got:
        assert r.allowed == want(r.url), r.url
