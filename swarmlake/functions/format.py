"""Scalar conversions and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EPOCH_OFFSET, U48_MASK


def from_unix(unix: Column) -> Column:
    """Seconds since 2020 in 32 bits; earlier times saturate to 0."""
    return F.greatest(F.lit(0).cast("long"), unix.cast("long") - EPOCH_OFFSET).bitwiseAND(0xFFFFFFFF)


def to_unix(discovered_at: Column) -> Column:
    return discovered_at + EPOCH_OFFSET


def u48(size: Column) -> Column:
    return size.cast("long").bitwiseAND(U48_MASK)


def hex_lower(value: Column) -> Column:
    return F.lower(F.hex(value))


def parse_hash(text: Column) -> Column:
    """The 20 bytes of a hex string in any case, or null."""
    raw = F.try_to_binary(text, F.lit("hex"))
    return F.when(F.octet_length(raw) == 20, raw)


def _tenths(q: Column) -> Column:
    """A whole number of tenths as text with one decimal."""
    return F.concat(F.floor(q / 10).cast("string"), F.lit("."), (q % 10).cast("string"))


def size_binary(n: Column) -> Column:
    """GB and MB of powers of two with one decimal, else whole KB. Ties go to the even tenth, in integers (n is below 2^48)."""
    n = n.cast("long")

    def shown(bits: int, unit: str) -> Column:
        tenths, rest, half = F.shiftright(n * 10, bits), (n * 10).bitwiseAND((1 << bits) - 1), 1 << (bits - 1)
        up = (rest > half) | ((rest == half) & (tenths % 2 == 1))
        return F.concat(_tenths(tenths + up.cast("long")), F.lit(unit))

    return F.when(n >= 1 << 30, shown(30, "GB")).when(n >= 1 << 20, shown(20, "MB")).otherwise(F.concat(F.shiftright(n, 10).cast("string"), F.lit("KB")))


def size_decimal(n: Column) -> Column:
    """Powers of ten with one decimal, as a page shows them: the double n / 10^k is rounded by its exact value, ties up (n is below 2^48).

    Where n lies midway between two tenths, the double is above or below it by less than a digit shows. Times 2^52 it is
    a whole number, and is compared with n in whole numbers.
    """
    n = n.cast("long")
    out = F.concat(n.cast("string"), F.lit("B"))
    wide = lambda c: c.cast("decimal(19,0)")
    for unit, power in (("KB", 3), ("MB", 6), ("GB", 9), ("TB", 12)):
        tenth = 10 ** (power - 1)
        tenths, rest = F.floor(n / tenth).cast("long"), n % tenth
        double = wide((n / F.lit(10.0**power) * F.lit(2.0**52)).cast("long")) * F.lit(10**power).cast("decimal(13,0)")
        at_least = double >= wide(n) * F.lit(1 << 52).cast("decimal(16,0)")
        up = (rest * 2 > tenth) | ((rest * 2 == tenth) & at_least)
        out = F.when(n >= 10**power, F.concat(_tenths(tenths + up.cast("long")), F.lit(unit))).otherwise(out)
    return out


def time_ago(now: Column, then: Column) -> Column:
    d = now - then
    part = lambda div, unit: F.concat(F.floor(d / div).cast("string"), F.lit(unit))
    return F.when(d < 60, part(1, "s ago")).when(d < 3600, part(60, "m ago")).when(d < 86400, part(3600, "h ago")).otherwise(part(86400, "d ago"))


def magnet(infohash_hex: Column, name: Column) -> Column:
    """A magnet link; the name is escaped as JavaScript's encodeURIComponent does."""
    out = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.concat(F.lit("magnet:?xt=urn:btih:"), infohash_hex, F.lit("&dn="), out)


def sampling_interval(value: Column, has_samples: Column) -> Column:
    """Seconds until a node is sampled again."""
    base = F.when(value > 0, value).otherwise(60)
    return F.greatest(F.when(has_samples, F.least(base, F.lit(60))).otherwise(300), F.lit(10))


def sync_state(code: Column) -> Column:
    return F.when(code == 2, "connected").when(code == 3, "disconnected").otherwise("connecting")


def announce_port(implied: Column, port: Column, source_port: Column) -> Column:
    """The port of an announcing peer: its packet's if that is implied or none is given."""
    return F.when(F.coalesce(implied, F.lit(False)), source_port).otherwise(F.coalesce(port, source_port))


def html_escape(text: Column) -> Column:
    """Text as a page shows it."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\u00a0", "&nbsp;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text
