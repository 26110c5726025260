"""URLs as column expressions: parsing and serialising by the URL standard (http and https), domains, safety."""

from __future__ import annotations

from collections.abc import Callable
from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyloom.functions.text import blank_to_null

#: Hosts that a request may not name.
BLOCKED_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1")
#: Address blocks that are no public hosts (private, loopback, link-local, shared, reserved, multicast).
INNER_NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8",
)
#: Names that lead to the machine itself or to its cloud's metadata.
INNER_NAMES = r"^(?:.*\.)?(?:localhost|local|localdomain|internal|intranet|lan|home|corp|metadata|instance-data)$"
#: ASCII characters that the standard percent-encodes, by part of a URL; others above 0x7E are encoded in all.
ENCODED = {"userinfo": r""" "#<>?^`{}/:;=@\[]|""", "path": r""" "#<>?^`{}""", "query": r""" "#<>'""", "fragment": r""" "<>`"""}
_STANDARD_PORT = {"http": "80", "https": "443"}


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip_scheme(url: Column) -> Column:
    return F.regexp_replace(url, r"^https?://", "")


def percent_encode(value: Column, part: str) -> Column:
    """value with the characters percent-encoded that a part of a URL may not hold; what is encoded stays."""
    some = "".join("\\" + c for c in ENCODED[part]) + r"\x{0}-\x{1F}\x{7F}-\x{10FFFF}"
    pieces = F.regexp_extract_all(value, F.lit(f"([^{some}]+|[{some}]+)"), F.lit(1))
    encoded = lambda p: F.when(p.rlike(f"^[{some}]"), F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))).otherwise(p)
    return F.array_join(F.transform(pieces, encoded), "")


def without_dots(path: Column) -> Column:
    """A path, which starts with a slash, with its . and .. segments resolved, their encoded forms too."""
    dot, dots = r"(?i)^(?:\.|%2e)$", r"(?i)^(?:\.|%2e){2}$"
    segments = F.slice(F.split(path, "/"), 2, 2**30)
    up = lambda kept: F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
    step = lambda kept, s: F.when(s.rlike(dots), up(kept)).when(s.rlike(dot), kept).otherwise(F.concat(kept, F.array(s)))
    kept = F.reduce(segments, F.array().cast("array<string>"), step)
    end = F.when(F.try_element_at(segments, F.lit(-1)).rlike(f"{dot}|{dots}"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, end), "/"))


@F.pandas_udf(StringType())
def _ascii_host(hosts):
    """Hosts outside ASCII in lower-case compatibility form, their labels in Punycode; null for one that has none."""
    import re
    import unicodedata

    import pandas as pd

    def one(host):
        if host is None or host.isascii():
            return host
        plain = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", host).lower())
        plain = re.sub("[\u3002\uff0e\uff61]", ".", plain).replace("\u00ad", "")
        try:
            return ".".join(l if l.isascii() else "xn--" + l.encode("punycode").decode() for l in plain.split("."))
        except UnicodeError:
            return None

    return pd.Series([one(h) for h in hosts], dtype=object)


def ascii_host(host: Column) -> Column:
    """Percent-decoded, in lower case and ASCII. Names outside ASCII take the only Python code here, a batch at a time."""
    return F.lower(_ascii_host(F.coalesce(F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B"))), F.lit("%"))))


def ipv4_number(host: Column) -> Column:
    """The 32-bit number of an IPv4 address of one to four decimal, octal (0) or hexadecimal (0x) parts; null for others."""
    base = F.when
    number = lambda p: (
        base(p.rlike("^0x[0-9a-f]*$"), F.conv(F.concat(F.lit("0"), F.substr(p, F.lit(3))), 16, 10)).when(p.rlike("^0[0-7]*$"), F.conv(p, 8, 10)).when(p.rlike("^[1-9][0-9]*$"), p)
    ).try_cast("long")

    def value(numbers: Column) -> Column:
        n, last = F.size(numbers), F.element_at(numbers, -1)
        rest = F.slice(numbers, 1, F.greatest(n - 1, F.lit(0)))
        room = F.get(F.array(*(F.lit(256**k) for k in (4, 3, 2, 1))), n - 1)
        ok = n.between(1, 4) & F.forall(rest, lambda x: x.isNotNull() & (x <= 255)) & (last < room)
        return F.when(ok, F.reduce(rest, F.lit(0).cast("long"), lambda a, x: a * 256 + x) * room + last)

    return let(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), number), value)


def ends_in_number(host: Column) -> Column:
    return host.rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$")


def ipv6_groups(inner: Column) -> Column:
    """The eight 16-bit numbers of an IPv6 address (in lower case, without brackets); null for others."""
    none = F.array().cast("array<string>")

    def in_groups(text: Column) -> Column:
        """A dotted address at the end becomes two groups."""
        tail = F.regexp_extract(text, r"^[0-9a-f:]*:((?:[0-9]{1,3}\.){3}[0-9]{1,3})$", 1)
        number = let(tail, lambda t: ipv4_number(F.when((t != "") & ~t.rlike(r"(?:^|\.)0[0-9]"), t)))
        words = lambda n: F.concat_ws(":", F.lower(F.hex(F.shiftright(n, 16))), F.lower(F.hex(n.bitwiseAND(F.lit(65535)))))
        return F.when(F.contains(text, F.lit(".")), let(number, lambda n: F.when(n.isNotNull(), F.concat(F.regexp_extract(text, r"^(.*:)[^:]*$", 1), words(n))))).otherwise(text)

    def filled(halves: Column) -> Column:
        groups = lambda k: F.when(F.get(halves, F.lit(k)) == "", none).otherwise(F.split(F.get(halves, F.lit(k)), ":"))
        sides = F.array(groups(0), F.when(F.size(halves) == 2, groups(1)).otherwise(none))
        return let(sides, lambda s: whole(F.get(s, F.lit(0)), F.get(s, F.lit(1)), F.size(halves)))

    def whole(left: Column, right: Column, halves: Column) -> Column:
        missing = 8 - F.size(left) - F.size(right)
        fits = F.when(halves == 1, missing == 0).otherwise((halves == 2) & (missing >= 1))
        return F.when(fits, F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right))

    numbers = lambda g: F.when(F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.transform(g, lambda x: F.conv(x, 16, 10).cast("int")))
    return let(let(F.split(let(inner, in_groups), "::"), filled), numbers)


def _shortest(groups: Column) -> Column:
    """IPv6 groups as text, the longest run of two or more zeros (the first of equal ones) as ::."""

    def shortened(text: Column) -> Column:
        out = F.when(F.lit(False), text)
        for zeros in range(8, 1, -1):
            run = r"(?:^|:)" + ":".join("0" * zeros) + r"(?:$|:)"
            out = out.when(text.rlike(run), F.regexp_replace(text, "^(.*?)" + run, "$1::"))
        return out.otherwise(text)

    return let(F.array_join(F.transform(groups, lambda g: F.lower(F.hex(g))), ":"), shortened)


def _dotted(number: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(number, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)))


def serial_host(host: Column) -> Column:
    """A host as the standard writes it: addresses in their one form, names in ASCII; null for what is no host."""
    bad = r"""[\x{0}-\x{20}"#%/:<>?@\[\\\]^`{|}\x{7F}]"""
    four = lambda h: let(ipv4_number(h), lambda n: F.when(n.isNotNull(), _dotted(n)))
    name = lambda h: F.when((h == "") | h.rlike(bad), None).when(ends_in_number(h), four(h)).otherwise(h)
    six = lambda g: F.when(g.isNotNull(), F.concat(F.lit("["), _shortest(g), F.lit("]")))
    address = lambda h: F.when(F.endswith(h, F.lit("]")), let(ipv6_groups(F.lower(F.substr(h, F.lit(2), F.length(h) - 2))), six))
    # The Python helper takes a column of the row, not a variable of a lambda
    both = F.struct(host.alias("given"), ascii_host(host).alias("ascii"))
    return let(both, lambda b: F.when(F.startswith(b["given"], F.lit("[")), address(b["given"])).otherwise(name(b["ascii"])))


def url_parts(url: Column) -> Column:
    """A struct of an http or https URL's parts as written: scheme, userinfo, host, port, path, query and fragment (with ? and #); null for other texts."""
    clean = F.regexp_replace(F.regexp_replace(url, r"^[\x{0}-\x{20}]+|[\x{0}-\x{20}]+$", ""), r"[\t\n\r]", "")
    clean = F.replace(clean, F.lit("\u0001"), F.lit("%01"))  # the mark below
    pattern = r"(?is)^(https?):[/\\]{2,}(?:([^/\\?#]*)@)?(\[[^\]/\\?#@]*\]|[^/\\?#@:\[]*)(?::([^/\\?#@]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
    cut = F.split(F.regexp_replace(clean, pattern, "$1\u0001$2\u0001$3\u0001$4\u0001$5\u0001$6\u0001$7"), "\u0001")
    names = ("scheme", "userinfo", "host", "port", "path", "query", "fragment")
    part = lambda parts, k: F.get(parts, F.lit(k))
    return let(cut, lambda p: F.when(F.size(p) == 7, F.struct(F.lower(part(p, 0)).alias("scheme"), *(part(p, k).alias(n) for k, n in enumerate(names) if k))))


def normalize_url(url: Column) -> Column:
    """A URL as the standard serialises it, https:// added where it has no scheme; '' for what is none or names a blocked host.

    Done: white space and control characters, backslashes, user and password, names in ASCII (lower-case compatibility
    form and Punycode, without the standard's further checks of labels), IPv4 and IPv6 forms, default ports, dot
    segments, percent-encoding by part.
    """
    full = F.when(url.rlike(r"(?i)^https?://"), url).otherwise(F.concat(F.lit("https://"), url))

    def built(both: Column) -> Column:
        u = both["given"]
        name, rest = F.substring_index(u["userinfo"], ":", 1), F.regexp_extract(u["userinfo"], r"(?s)^[^:]*:(.+)$", 1)
        user = F.concat(percent_encode(name, "userinfo"), F.when(rest != "", F.concat(F.lit(":"), percent_encode(rest, "userinfo"))).otherwise(""))
        user = F.when(user == "", "").otherwise(F.concat(user, F.lit("@")))
        port = F.regexp_replace(u["port"], "^0+(?=.)", "")
        standard = F.when(u["scheme"] == "http", _STANDARD_PORT["http"]).otherwise(_STANDARD_PORT["https"])
        port = F.when((port == "") | (port == standard), "").otherwise(F.concat(F.lit(":"), port))
        ok_port = (u["port"] == "") | (u["port"].rlike("^[0-9]+$") & (F.regexp_replace(u["port"], "^0+(?=.)", "").try_cast("int") <= 65535))
        path = F.replace(F.coalesce(blank_to_null(u["path"]), F.lit("/")), F.lit("\\"), F.lit("/"))
        path = percent_encode(without_dots(path), "path")
        tail = F.concat(*(F.when(u[k] == "", "").otherwise(F.concat(F.lit(mark), percent_encode(F.substr(u[k], F.lit(2)), k))) for k, mark in (("query", "?"), ("fragment", "#"))))
        whole = lambda h: F.when(ok_port & ~h.isin(*BLOCKED_HOSTS), F.concat(u["scheme"], F.lit("://"), user, h, port, path, tail))
        return whole(both["serial"])

    parts = url_parts(full)
    return F.coalesce(let(F.struct(parts.alias("given"), serial_host(parts["host"]).alias("serial")), built), F.lit(""))


def domain_or_slug(url: Column, slug: Column) -> Column:
    """The URL's authority; without a URL a name made of the slug."""
    given = F.regexp_replace(strip_scheme(url), r"(?s)/.*$", "")
    made = F.concat(F.coalesce(blank_to_null(slug), F.lit("company")), F.lit(".example"))
    return F.when(blank_to_null(url).isNotNull(), given).otherwise(made)


def host(url: Column) -> Column:
    """The host of an http or https URL as written, in lower case; '' where there is none."""
    return F.coalesce(F.lower(url_parts(url)["host"]), F.lit(""))


def _networks(version: int) -> Column:
    """First and last address of the inner networks: numbers of 32 bits, or 128 bits as 32 hexadecimal digits."""
    nets = [n for n in map(ip_network, INNER_NETWORKS) if n.version == version]
    show = (lambda a: f"{int(a)}L") if version == 4 else (lambda a: f"'{int(a):032x}'")
    return F.expr("array(" + ", ".join(f"named_struct('low', {show(n.network_address)}, 'high', {show(n.broadcast_address)})" for n in nets) + ")")


def is_inner_ipv4(number: Column) -> Column:
    return F.exists(_networks(4), lambda n: number.between(n["low"], n["high"]))


def is_inner_ipv6(groups: Column) -> Column:
    """Inner itself, or standing for an inner IPv4 address (mapped, translated, 6to4)."""

    def inner(digits: Column) -> Column:
        mapped = F.startswith(digits, F.lit("0" * 20 + "ffff")) | F.startswith(digits, F.lit("0064ff9b" + "0" * 16))
        four = F.when(mapped, F.substr(digits, F.lit(25))).when(F.startswith(digits, F.lit("2002")), F.substr(digits, F.lit(5), F.lit(8)))
        return F.exists(_networks(6), lambda n: digits.between(n["low"], n["high"])) | F.coalesce(let(F.conv(four, 16, 10).cast("long"), is_inner_ipv4), F.lit(False))

    return let(F.array_join(F.transform(groups, lambda g: F.lpad(F.lower(F.hex(g)), 4, "0")), ""), inner)


def is_safe(url: Column) -> Column:
    """http or https with a host as crawlers read it that is a public name or address: no local name, no private, loopback,
    link-local, shared, reserved or metadata address, in whatever form it is written."""
    raw = url_parts(url)["host"]
    four = lambda h: let(ipv4_number(h), lambda n: n.isNotNull() & ~is_inner_ipv4(n))
    six = lambda h: F.endswith(h, F.lit("]")) & let(ipv6_groups(F.lower(F.substr(h, F.lit(2), F.length(h) - 2))), lambda g: g.isNotNull() & ~is_inner_ipv6(g))
    name = lambda h: (h != "") & ~h.rlike("[^0-9a-z._-]") & F.when(ends_in_number(h), four(h)).otherwise(~h.rlike(INNER_NAMES))
    both = F.struct(raw.alias("given"), F.regexp_replace(ascii_host(raw), r"\.+$", "").alias("ascii"))
    return F.coalesce(let(both, lambda b: F.when(F.startswith(b["given"], F.lit("[")), six(b["given"])).otherwise(name(b["ascii"]))), F.lit(False))
