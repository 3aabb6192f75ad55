"""Model endpoints: where a url's bytes go, and whether a prefix allows it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOOPBACK_NAMES = ["localhost", "localhost.localdomain"]
# Special ranges of addresses that are not routed globally, as (first address, prefix length), and the parts of them that are.
V4_LOCAL = [("127.0.0.0", 8), ("0.0.0.0", 32)]
V4_PRIVATE = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4)]
V4_ROUTED = [("192.0.0.9", 32), ("192.0.0.10", 32)]
V6_LOCAL = [("::", 127)]
V6_PRIVATE = [("::", 127), ("64:ff9b:1::", 48), ("100::", 64), ("2001::", 23), ("2001:db8::", 32), ("2002::", 16), ("fc00::", 7), ("fe80::", 10)]
V6_ROUTED = [("2001:1::1", 128), ("2001:1::2", 128), ("2001:3::", 32), ("2001:4:112::", 48), ("2001:20::", 28), ("2001:30::", 28)]
MAPPED = "0" * 20 + "ffff"


def _digits(address: str) -> str:
    """A literal of the tables above as hexadecimal digits."""
    if "." in address:
        return "".join(f"{int(x):02x}" for x in address.split("."))
    head, _, tail = address.partition("::")
    left, right = ([x.zfill(4) for x in part.split(":") if x] for part in (head, tail))
    return "".join([*left, *["0000"] * (8 - len(left) - len(right)), *right])


def within(address: Column, ranges: list[tuple[str, int]]) -> Column:
    """Does an address, as hexadecimal digits, lie in one of the ranges? Digits of one length are ordered as the addresses are."""
    bounds = [(low := _digits(first), f"{int(low, 16) | (1 << 4 * len(low) - size) - 1:0{len(low)}x}") for first, size in ranges]
    return F.exists(F.array(*[F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")) for low, high in bounds]), lambda r: address.between(r["low"], r["high"]))


def v4_digits(host: Column) -> Column:
    """An IPv4 literal as 8 hexadecimal digits, null for anything else; octets have no leading zeros."""
    octet = r"(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
    octets = F.transform(F.split(host, r"\."), lambda x: F.lpad(F.lower(F.hex(x.try_cast("long"))), 2, "0"))
    return F.when(host.rlike(rf"^{octet}(?:\.{octet}){{3}}$"), F.array_join(octets, ""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there: as columns, the optimiser would write it out each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def v6_digits(host: Column) -> Column:
    """An IPv6 literal as 32 hexadecimal digits, null for anything else. Its end may be an IPv4 literal."""
    group = r"[0-9A-Fa-f]{1,4}"

    def groups(part: Column) -> Column:
        return F.transform(F.filter(F.split(part, ":"), lambda g: g != ""), lambda g: F.lpad(F.lower(g), 4, "0"))

    def digits(whole: Column) -> Column:
        full, short = whole.rlike(rf"^{group}(?::{group}){{7}}$"), whole.rlike(rf"^(?:{group}(?::{group})*)?::(?:{group}(?::{group})*)?$")
        sides = F.struct(groups(F.substring_index(whole, "::", 1)).alias("left"), groups(F.when(short, F.substring_index(whole, "::", -1)).otherwise("")).alias("right"), full.alias("full"), short.alias("short"))
        return let(sides, filled)

    def filled(s: Column) -> Column:
        missing = 8 - F.size(s["left"]) - F.size(s["right"])
        return F.when(s["full"] | s["short"] & (missing >= 1), F.array_join(F.concat(s["left"], F.array_repeat(F.lit("0000"), F.greatest(F.lit(0), missing)), s["right"]), ""))

    end = v4_digits(F.regexp_extract(host, r":(\d+\.\d+\.\d+\.\d+)$", 1))
    return let(end, lambda e: let(F.when(e.isNotNull(), F.concat(F.regexp_replace(host, r"\d+\.\d+\.\d+\.\d+$", ""), F.substring(e, 1, 4), F.lit(":"), F.substring(e, 5, 4))).otherwise(host), digits))


def parsed(table: DataFrame, column: str) -> DataFrame:
    """Adds ``parts`` (scheme, host, port, path, address) of unambiguous http and https urls; null for any other.

    Refused: another scheme, no host, a bad port or 0, user information, a query or fragment (even empty), white space or control characters within,
    backslashes and dot segments, plain or percent-coded. Scheme and host are lower-cased, a missing port is the scheme's; the path is
    decoded, without slashes at its end. address: an IP literal's digits.
    """

    def split(raw: Column) -> Column:
        m = lambda g: F.regexp_extract(raw, r"^([A-Za-z]+)://(\[[^\]/]*\]|[^/:\[\]]*)(?::(\d+))?(/.*)?$", g)
        clean = ~raw.rlike(r"[?#@\\\s\x00-\x20\x7f\x1c-\x1f\x85\xa0]")
        return let(F.struct(F.lower(m(1)).alias("scheme"), F.lower(m(2)).alias("site"), m(3).alias("port"), m(4).alias("path"), clean.alias("clean")), decoded)

    def decoded(x: Column) -> Column:
        path = F.coalesce(F.try_url_decode(F.replace(x["path"], F.lit("+"), F.lit("%2B"))), x["path"])
        port = F.when(x["port"] == "", F.when(x["scheme"] == "https", 443).otherwise(80)).otherwise(x["port"].try_cast("int"))
        literal = x["site"].startswith("[")
        host = F.regexp_replace(x["site"], r"^\[|\]$", "")
        known = F.struct(host.alias("host"), F.when(literal, v6_digits(host)).otherwise(v4_digits(host)).alias("address"), path.alias("path"), port.alias("port"), literal.alias("literal"))
        return let(known, lambda y: judged(x, y))

    def judged(x: Column, y: Column) -> Column:
        ok = x["clean"] & x["scheme"].isin("http", "https") & (y["host"] != "") & y["port"].between(1, 65535) & (~y["literal"] | y["address"].isNotNull())
        ok = ok & ~F.contains(y["path"], F.lit("\\")) & ~y["path"].rlike(r"(?:^|/)\.{1,2}(?:/|$)")
        parts = F.struct(x["scheme"].alias("scheme"), y["host"].alias("host"), y["port"].alias("port"), F.regexp_replace(y["path"], "/+$", "").alias("path"), y["address"].alias("address"))
        return F.when(F.coalesce(ok, F.lit(False)), parts)

    return table.withColumn("parts", let(F.regexp_replace(column, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), split))


def transport(table: DataFrame, column: str) -> DataFrame:
    """Adds ``transport``: https; for plain http loopback, private (an address that is not routed globally), public or hostname; null for urls that are refused."""

    def kind(parts: Column) -> Column:
        # an IPv4 address within IPv6 counts as itself
        own = F.when(parts["address"].startswith(MAPPED) & (F.length(parts["address"]) == 32), F.substring(parts["address"], 25, 8)).otherwise(parts["address"])
        return F.when(parts["scheme"] == "https", "https").when(parts["host"].isin(LOOPBACK_NAMES), "loopback").when(parts["address"].isNull(), "hostname").otherwise(let(own, routed))

    def routed(address: Column) -> Column:
        v4 = F.length(address) == 8
        local = F.when(v4, within(address, V4_LOCAL)).otherwise(within(address, V6_LOCAL))
        shut = F.when(v4, within(address, V4_PRIVATE) & ~within(address, V4_ROUTED)).otherwise(within(address, V6_PRIVATE) & ~within(address, V6_ROUTED))
        return F.when(local, "loopback").when(shut, "private").otherwise("public")

    x = parsed(table, column)
    return x.withColumn("transport", let(F.col("parts"), lambda p: F.when(p.isNotNull(), kind(p)))).drop("parts")


def allowed(table: DataFrame, column: str, prefixes: DataFrame) -> DataFrame:
    """Adds ``allowed``: does an entry (prefix) have the url's scheme, host and port, and a path that is the url's or a folder above it? Null for urls that are refused.

    Entries are urls too; one that would be refused allows nothing. Urls meet entries by origin, once for each, so a repeated url costs no more.
    """
    # as written, an address may have several forms: entries and urls are compared by its digits
    def origin(p: str) -> Column:
        return F.struct(F.col(f"{p}.scheme").alias("scheme"), F.coalesce(F.col(f"{p}.address"), F.col(f"{p}.host")).alias("host"), F.col(f"{p}.port").alias("port"))

    entries = parsed(prefixes.select("prefix").distinct(), "prefix").filter("parts is not null").select(origin("parts").alias("origin"), F.col("parts.path").alias("top")).distinct()
    own = parsed(table.select(F.col(column).alias("url_")).distinct(), "url_").filter("parts is not null").select("url_", origin("parts").alias("own"), F.col("parts.path").alias("path"))
    fits = (F.col("path") == F.col("top")) | F.startswith("path", F.concat("top", F.lit("/")))
    told = own.join(entries, (F.col("own") == F.col("origin")) & fits, "left_semi").select("url_", F.lit(True).alias("hit"))
    out = own.select("url_").join(told, "url_", "left").select("url_", F.coalesce("hit", F.lit(False)).alias("allowed"))
    return table.join(out, F.col(column) == F.col("url_"), "left").drop("url_")
