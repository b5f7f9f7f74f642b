"""URLs, content sniffing and robots rules as column expressions."""

from __future__ import annotations

from functools import reduce
from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

ROBOTS_MAX_BYTES = 512 * 1024


def looks_like_html(content_type: Column, body: Column) -> Column:
    """By content type, or by what the body contains (in lower case only)."""
    typed = F.coalesce(content_type.contains("html") | content_type.contains("xhtml"), F.lit(False))
    return typed | F.coalesce(body.contains("<html") | body.contains("<article") | body.contains("<body"), F.lit(False))


def _part(url: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(url, pattern, group)


_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)(?::(\d*))?([^?#]*)"


def domain_key(url: Column) -> Column:
    """scheme://host[:port]: lower case, without user and default port; null for what is no URL."""
    scheme, host, port = F.lower(_part(url, _URL, 1)), F.lower(_part(url, _URL, 2)), _part(url, _URL, 3)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host, F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port))))


def url_path(url: Column) -> Column:
    path = _part(url, _URL, 4)
    return F.when(path == "", F.lit("/")).otherwise(path)


#: Loopback, private and link-local ranges of IPv4, the unspecified and the broadcast address.
PRIVATE = tuple(
    (int(ip_network(n)[0]), int(ip_network(n)[-1]))
    for n in ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "0.0.0.0/32", "255.255.255.255/32")
)


def ipv4(host: Column) -> Column:
    """The address that a numeric host names, as a number: one to four decimal, octal or hexadecimal parts, the last
    of which fills what is left; null for what is no address."""
    parts = F.split(host, r"\.")

    def value(p: Column) -> Column:
        return (
            F.when(p.rlike("^0x[0-9a-f]{0,16}$"), F.conv(F.concat(F.lit("0"), F.substring(p, 3, 16)), 16, 10))
            .when(p.rlike("^0[0-7]{0,20}$"), F.conv(p, 8, 10))
            .when(p.rlike("^[1-9][0-9]{0,17}$"), p)
            .try_cast("long")
        )

    values = F.transform(parts, value)
    rest = F.size(parts) - 1
    head = F.slice(values, F.lit(1), rest)
    fits = (F.size(parts) <= 4) & ~F.exists(values, lambda v: v.isNull()) & F.forall(head, lambda v: v < 256)
    last = F.get(values, rest)
    most = F.pow(F.lit(256.0), F.lit(4) - rest)
    leading = F.aggregate(F.transform(head, lambda v, i: v * F.pow(F.lit(256.0), F.lit(3) - i).cast("long")), F.lit(0).cast("long"), lambda a, v: a + v)
    return F.when(fits & (last >= 0) & (last < most), leading + last)


def url_error(url: Column) -> Column:
    """Why a URL must not be fetched, or null: other schemes, private, loopback and link-local hosts.

    Hosts are taken as a browser takes them: decoded, without a final dot, and numbers in any notation are addresses.
    """
    scheme, raw = F.lower(_part(url, _URL, 1)), _part(url, _URL, 2)
    host = F.regexp_replace(F.lower(F.coalesce(F.try_url_decode(raw), raw)), r"\.$", "")
    numeric = host.rlike(r"(^|\.)(\d+|0x[0-9a-f]*)$")
    address = ipv4(host)
    private = [(address >= F.lit(first)) & (address <= F.lit(last)) for first, last in PRIVATE]
    zeros = F.regexp_replace(host, r"^\[|\]$", "")
    v6 = host.startswith("[") & (zeros.rlike(r"^[0:]*:0*1?$") | zeros.rlike(r"^[0:]*:0*\.0*\.0*\.0*[01]$"))
    name = host.rlike(r"(^|\.)(local|internal)$") & host.contains(".") | (host == "localhost")
    return (
        F.when(url.isNull() | (scheme == ""), F.lit("not a URL"))
        .when(~scheme.isin("http", "https"), F.concat(F.lit("unsupported scheme: "), scheme))
        .when(host == "", F.lit("no host"))
        .when(numeric & address.isNull(), F.concat(F.lit("not an address: "), host))
        .when(numeric & reduce(lambda a, b: a | b, private), F.concat(F.lit("private address: "), host))
        .when(v6, F.concat(F.lit("private address: "), host))
        .when(name, F.concat(F.lit("private domain: "), host))
    )


def robots_rules(body: Column, agent: str, reset_groups: bool = False) -> Column:
    """struct<allow,disallow> that apply to the agent: its own rules if it has any, else those for ``*``.

    Agents named in one group go on into the next, unless ``reset_groups`` starts anew at each first agent line.
    """
    token = agent.split("/")[0].strip().lower()
    empty = F.array().cast("array<string>")
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    pairs = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))
    kinds = ("own_allow", "own_deny", "any_allow", "any_deny")

    def step(a: Column, p: Column) -> Column:
        agent_line = p["k"] == "user-agent"
        start = agent_line & a["ruled"] if reset_groups else F.lit(False)
        own_now = F.lower(p["v"]).isin(token, f"{token}*")
        any_now = p["v"] == "*"
        own = F.when(start, own_now).when(agent_line, a["own"] | own_now).otherwise(a["own"])
        every = F.when(start, any_now).when(agent_line, a["any"] | any_now).otherwise(a["any"])
        rule = p["k"].isin("allow", "disallow")
        put = lambda name, on, key: F.when(a[on] & (p["k"] == key), F.concat(a[name], F.array(p["v"]))).otherwise(a[name]).alias(name)
        return F.struct(own.alias("own"), every.alias("any"), F.when(agent_line, F.lit(False)).otherwise(a["ruled"] | rule).alias("ruled"), put("own_allow", "own", "allow"), put("own_deny", "own", "disallow"), put("any_allow", "any", "allow"), put("any_deny", "any", "disallow"))

    def finish(a: Column) -> Column:
        own = (F.size(a["own_allow"]) > 0) | (F.size(a["own_deny"]) > 0)
        pick = lambda x, y, name: F.when(own, a[x]).otherwise(a[y]).alias(name)
        return F.struct(pick("own_allow", "any_allow", "allow"), pick("own_deny", "any_deny", "disallow"))

    zero = F.struct(F.lit(False).alias("own"), F.lit(False).alias("any"), F.lit(False).alias("ruled"), *[empty.alias(k) for k in kinds])
    return F.aggregate(pairs, zero, step, finish)


def robots_allow(rules: Column, path: Column) -> Column:
    """The longest rule that begins the path wins; allow wins ties; null rules allow."""
    longest = lambda which: F.coalesce(F.array_max(F.transform(F.filter(rules[which], lambda r: (r != "") & path.startswith(r)), lambda r: F.octet_length(r))), F.lit(-1))
    return F.coalesce(longest("allow") >= longest("disallow"), F.lit(True))
