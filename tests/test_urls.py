"""URLs against a table of the standard's cases, addresses against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from tallyloom.functions import urls

SERIAL = {
    "http://a/b/./c": "http://a/b/c", "http://a/b/../c": "http://a/c", "http://a/b/..": "http://a/", "http://a/b/.": "http://a/b/", "http://a/../../x": "http://a/x",
    "http://a/%2e%2E/x/%2e": "http://a/x/", "http://a/b//../c": "http://a/b/c", "http://a/b/...": "http://a/b/...", "http://a\\b\\..\\c": "http://a/c",
    "http://a/ x\"<>`{}^|": "http://a/%20x%22%3C%3E%60%7B%7D%5E|", "http://a/%zz%41": "http://a/%zz%41", "http://a/é漢": "http://a/%C3%A9%E6%BC%A2",
    "http://a/?q=é '\"<>`{}": "http://a/?q=%C3%A9%20%27%22%3C%3E`{}", "http://a/#f é'\"<>`{}": "http://a/#f%20%C3%A9'%22%3C%3E%60{}", "http://a/?": "http://a/?", "http://a#": "http://a/#",
    "http://a?x#y?z": "http://a/?x#y?z", "http://u:p@a.example:81": "http://u:p@a.example:81/", "http://u:@a/": "http://u@a/", "http://@a/": "http://a/", "http://:p@a/": "http://:p@a/",
    "http://u:p:q@a/": "http://u:p%3Aq@a/", "http://u@v@a/": "http://u%40v@a/", "http://a:80/": "http://a/", "https://a:443": "https://a/", "http://a:443/": "http://a:443/",
    "http://a:/": "http://a/", "http://a:00081/": "http://a:81/", "http://a:65535/": "http://a:65535/", "http://a:65536/": "", "http://a:8x/": "", "http://a:-1/": "",
    "HTTP://EXAMPLE.Com/A": "http://example.com/A", "http://a/b \n": "http://a/b", "  http://a/b": "", "http://a/b\tc\nd": "http://a/bcd", "http://bücher.example/": "http://xn--bcher-kva.example/",
    "http://BÜCHER.example": "http://xn--bcher-kva.example/", "http://日本語。ｊｐ/": "http://xn--wgv71a119e.jp/", "http://faß.de/": "http://xn--fa-hia.de/", "http://☃.net": "http://xn--n3h.net/",
    "http://%65xample.com/": "http://example.com/", "http://ex%20ample/": "", "http://a b/": "", "http://a^b/": "", "http://a%/": "", "http:///x": "http://x/", "http://": "", "https://?x": "",
    "http://192.168.0.1.": "http://192.168.0.1/", "http://0x7f.1/": "", "http://3232235521/": "http://192.168.0.1/", "http://0300.0250.1/": "http://192.168.0.1/", "http://256/": "http://0.0.1.0/",
    "http://1.2.3.4.5/": "", "http://256.1.1.1/": "", "http://1.2.3.08/": "", "http://0/": "", "http://4294967296/": "", "http://a.0x/": "", "http://1e3/": "http://1e3/", "http://0xffffffff": "http://255.255.255.255/",
    "http://[::1]/": "http://[::1]/", "http://[1:0:0:2::]/": "http://[1:0:0:2::]/", "http://[0:0:0:0:0:0:0:0]": "http://[::]/", "http://[2001:DB8:0:0:1:0:0:1]": "http://[2001:db8::1:0:0:1]/",
    "http://[::ffff:1.2.3.4]/": "http://[::ffff:102:304]/", "http://[1:2:3:4:5:6:7::]/": "http://[1:2:3:4:5:6:7:0]/", "http://[1::2::3]/": "", "http://[1:2:3]/": "", "http://[::12345]/": "", "http://[::g]": "",
    "http://[::1": "", "http://[::1.2.3]/": "", "www.foo-bar.com/x": "https://www.foo-bar.com/x", "localhost:3000": "", "http://127.1/": "", "ftp://a/": "https://ftp//a/", "mailto:a@b": "https://mailto:a@b/", "": "", None: "",
    "http://a/\u0001\u007f": "http://a/%01%7F",
}


def each(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, x string").repartition(4)
    return {values[r.k]: r.v for r in rows.select("k", f(F.col("x")).alias("v")).collect()}


def test_standard_cases(spark):
    found = each(spark, urls.normalize_url, list(SERIAL))
    assert {k: v for k, v in found.items() if v != SERIAL[k]} == {}


def test_normal_urls_stay(spark):
    normal = [v for v in SERIAL.values() if v]
    assert {k: v for k, v in each(spark, urls.normalize_url, normal).items() if k != v} == {}


UNSAFE = """http://127.1/ http://2130706433/ http://0x7f.0.0.1/ http://017700000001/ http://10.0.0.1./ http://[::ffff:127.0.0.1]/ http://[0:0:0:0:0:0:0:1]/ http://100.64.0.1/
http://0/ http://0x0 http://localhost http://LOCALHOST. http://x.localhost http://127.0.0.1.. http://169.254.169.254/latest http://[fe80::1]/ http://[fd00::1] http://[::]/ http://[::7f00:1]/ http://[64:ff9b::10.0.0.1]/
http://[2002:7f00:1::]/ http://[2002:a00:1::1] http://metadata.google.internal/ http://router.local http://127%2e0%2e0%2e1/ http://１２７.０.０.１/ http://127。0。0。1/ http://①②⑦.0.0.1/ http:\\\\127.0.0.1\\ http://u@127.0.0.1/
http://8.8.8.8@127.0.0.1/ http://a@b@10.0.0.1/ http://255.255.255.255/ http://224.0.0.1 http://192.0.2.1/ http://198.18.0.1 http://0300.0250.0.1/ http://1.2.3.4.5/ http://256.1.1.1/ http://[::1%25eth0]/ http://[fe80::1
ftp://example.org/ javascript:alert(1) //example.org/ http:// http:///127.0.0.1/ http://[v1.x]/ http://4294967296/ http://0xffffffffff/ http://12345678901234567890123/ http://[fec0::1]/ http://[ff02::1]/ http://[2001:db8::1]/""".split()
SAFE = """http://example.org/ https://sub.example.co.uk:8443/x?y#z http://8.8.8.8/ http://134744072/ http://0x08080808/ http://010.010.010.010/ http://172.32.0.1/ http://172.15.255.255 http://100.128.0.1 http://11.0.0.1/
http://[2606:4700::1111]/ http://[::ffff:8.8.8.8]/ http://[64:ff9b::8.8.8.8]/ http://bücher.example/ http://localhost.example.org/ http://mylocal/ http://1e100.net/ http://3com.com http://127.0.0.1.example.org/ http://u:p@example.org/""".split()


def test_safety(spark):
    found = each(spark, urls.is_safe, UNSAFE + SAFE + [None, ""])
    assert [u for u in UNSAFE if found[u]] == [] and [u for u in SAFE if not found[u]] == []
    assert found[None] is False and found[""] is False


def test_addresses_equal_the_standard_library(spark):
    rng = random.Random(1)
    four = [rng.getrandbits(32) for _ in range(200)]
    texts = [rng.choice([str(ipaddress.IPv4Address(n)), str(n), hex(n), f"0{n:o}", f"{n >> 24}.0x{n & 0xFFFFFF:x}"]) for n in four]
    read = each(spark, urls.ipv4_number, texts)
    assert [read[t] for t in texts] == four
    six = [ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([2**128 - 1, 0xFFFF << 64, 0xFFFF0000FFFF << 32, 2**48 - 1])) for _ in range(200)]
    shown = [rng.choice([str(a), a.exploded]) for a in six]
    found = each(spark, lambda c: urls.serial_host(F.concat(F.lit("["), c, F.lit("]"))), shown)
    expect = lambda a: str(a) if a.ipv4_mapped is None else None
    assert all(found[s] == f"[{expect(a)}]" for s, a in zip(shown, six) if expect(a))
    inner = each(spark, lambda c: urls.is_inner_ipv4(urls.ipv4_number(c)), texts)
    nets = [ipaddress.ip_network(n) for n in urls.INNER_NETWORKS]
    for n, t in zip(four, texts):
        assert inner[t] == any(ipaddress.IPv4Address(n) in net for net in nets if net.version == 4)
