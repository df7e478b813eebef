"""Keys, addresses, timestamps, hexadecimal numbers and contract text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The timestamp formats of saved-query rows, after blanks, " UTC", "T" and "Z" are removed.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss")


def canonical_address(address: Column) -> Column:
    """Trimmed; null if empty or if it holds a colon or white space; lower case only for 0x and 40 hex digits."""
    a = F.trim(address)
    good = (F.length(a) > 0) & ~a.rlike(r"[:\s]")
    return F.when(good, F.when(a.rlike("^0x[0-9a-fA-F]{40}$"), F.lower(a)).otherwise(a))


def asset_uid(chain: Column, address: Column) -> Column:
    """``chain:address`` with the chain in lower case; null if either part is not valid."""
    c = F.lower(F.trim(chain))
    return F.when((F.length(c) > 0) & ~c.rlike(r"[:\s]"), F.concat(c, F.lit(":"), canonical_address(address)))


def parse_uid(uid: Column) -> Column:
    """struct(chain, address), or null unless the uid has exactly two parts that are not empty."""
    p = F.split(uid, ":", -1)
    ok = (F.size(p) == 2) & (F.length(F.get(p, F.lit(0))) > 0) & (F.length(F.get(p, F.lit(1))) > 0)
    return F.when(ok, F.struct(F.get(p, F.lit(0)).alias("chain"), F.get(p, F.lit(1)).alias("address")))


def parse_utc(raw: Column) -> Column:
    """A timestamp in UTC from the known formats or one with an offset; null where none fits."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"(\s*UTC|Z)$", ""), "T", " "))
    tries = [F.try_to_timestamp(clean, F.lit(f)) for f in TIME_FORMATS]
    return F.coalesce(*tries, F.try_to_timestamp(clean, F.lit("yyyy-MM-dd HH:mm:ssXXX")), F.try_to_timestamp(clean, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSSXXX")))


def request_digest(source: Column, dataset: Column, params: Column) -> Column:
    """16 hex digits of SHA-256 over source, dataset and the parameters (a map) in the order of their names."""
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))
    return F.substring(F.sha2(F.concat_ws("|", source, dataset, ordered), 256), 1, 16)


def without_prefix(digits: Column) -> Column:
    """The digits after 0x. Here and below no regular expressions, which take most of the time where logs are decoded."""
    return F.when(digits.startswith("0x"), F.substring(digits, 3, 2**31 - 1)).otherwise(digits)


def hex_to_long(digits: Column) -> Column:
    """A hexadecimal number, with or without 0x; null beyond 15 digits (zeros before it aside) and where it is none."""
    d = without_prefix(digits)
    h = F.ltrim(d, F.lit("0"))
    return F.when((F.length(d) > 0) & (F.length(h) <= 15) & F.unhex(h).isNotNull(), F.conv(F.concat(F.lit("0"), h), 16, 10).cast("long"))


def hex_to_decimal(digits: Column) -> Column:
    """A 256-bit hexadecimal number as decimal(38,0), exact below 10^38; null beyond."""
    h = F.ltrim(F.lower(without_prefix(digits)), F.lit("0"))
    wide = F.lpad(h, 32, "0")
    part = lambda at: F.conv(F.substring(wide, at, 8), 16, 10).cast("decimal(38,0)")
    low = part(25) + part(17) * F.lit(2**32).cast("decimal(20,0)")
    high = part(9) + part(1) * F.lit(2**32).cast("decimal(20,0)")
    # 2^126 < 10^38: beyond that a number is flagged, not computed
    fits = (F.length(h) <= 31) | ((F.length(h) == 32) & (F.substring(wide, 1, 1) < "4"))
    value = F.try_add(F.try_multiply(high.cast("decimal(38,0)"), F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(38,0)"), low.cast("decimal(38,0)"))
    short = F.conv(h, 16, 10).cast("long").cast("decimal(38,0)")
    return F.when(F.length(h) == 0, F.lit(0).cast("decimal(38,0)")).when((F.length(h) <= 15) & F.unhex(h).isNotNull(), short).when(fits, value.cast("decimal(38,0)"))


def negated(amount: Column) -> Column:
    """The amount taken from zero. The minus sign alone rounds a decimal to 34 digits."""
    return F.lit(0) - amount


def topic_address(topic: Column) -> Column:
    """The address in the last 40 digits of a log topic."""
    return F.concat(F.lit("0x"), F.lower(F.right(topic, F.lit(40))))


def contract_text(result: Column, cap: int = 80) -> Column:
    """Text of a contract's answer: a dynamic string (offset, length, bytes) or 32 left-aligned bytes.

    Characters that do not print are dropped, blanks collapsed and trimmed, and long text is cut at ``cap`` and marked.
    """
    h = F.regexp_replace(result, "^0x", "")
    size = F.when(F.length(h) >= 128, hex_to_long(F.substring(h, 114, 15)))
    dynamic = F.substring(h, F.lit(129), F.least(size * 2, F.length(h).cast("long")).cast("int"))
    raw = F.when(F.length(h) == 64, F.regexp_replace(h, "(00)+$", "")).otherwise(dynamic)
    text = F.decode(F.unhex(raw), "UTF-8")
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\p{C}&&[^\s]]", ""), r"\s+", " "))
    return F.when(F.length(clean) > cap, F.concat(F.substring(clean, 1, cap), F.lit("..."))).otherwise(clean)
