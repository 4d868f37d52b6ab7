"""Addresses and CIDR prefixes as column expressions.

IPv4 addresses are BIGINT, prefixes (length INT, network BIGINT). IPv6 addresses are
two BIGINT halves (hi, lo) in two's complement: 128 bits exceed DECIMAL(38).
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits by family; shortest reported prefix by family; lengths of an address view.
BITS = {"ipv4": 32, "ipv6": 128}
MIN_LENGTH = {"ipv4": 8, "ipv6": 104}
VIEW_LENGTHS = (8, 16, 24)

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


_HALVES = T.StructType([T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType())])


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by.cast("int"))


def is_ipv4(text: Column) -> Column:
    """Four decimal octets, no leading zeros."""
    return F.coalesce(text.rlike(IPV4_PATTERN), F.lit(False))


def parse_ipv4(text: Column) -> Column:
    """The address as BIGINT, null if it is none."""
    part = lambda i: F.split_part(text, F.lit("."), F.lit(i)).cast("long")
    return F.when(is_ipv4(text), part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def format_ipv4(value: Column) -> Column:
    octet = lambda by: (F.shiftright(value, by).bitwiseAND(F.lit(255))).cast("string")
    return F.concat_ws(".", octet(24), octet(16), octet(8), octet(0))


@F.pandas_udf(_HALVES)
def parse_ipv6(text: pd.Series) -> pd.DataFrame:
    """Both halves of an IPv6 address, nulls if it is none. A mapped IPv4 address stays IPv6."""

    def halves(t: str | None) -> tuple[int | None, int | None]:
        try:
            raw = ipaddress.IPv6Address(t).packed if t and "%" not in t else None
        except ValueError:
            raw = None
        return (int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)) if raw else (None, None)

    both = [halves(t) for t in text]
    return pd.DataFrame({name: pd.array([x[k] for x in both], dtype="Int64") for k, name in enumerate(("hi", "lo"))})  # a frame of tuples would round integers beside nulls


@F.pandas_udf(T.StringType())
def _format_ipv6(hi: pd.Series, lo: pd.Series) -> pd.Series:
    return pd.Series([None if h is None or x is None else str(ipaddress.IPv6Address(((int(h) % 2**64) << 64) | (int(x) % 2**64))) for h, x in zip(hi, lo, strict=True)], dtype="object")


def format_ipv6(hi: Column, lo: Column) -> Column:
    """Compressed text of an address's halves; they travel as text, as pandas would round integers beside nulls."""
    return _format_ipv6(hi.cast("string"), lo.cast("string"))


def bit_at(value: Column, index: Column | int, bits: int = 32) -> Column:
    """The bit at index, most significant first."""
    index = F.lit(index) if isinstance(index, int) else index
    return _shift("shiftright", value, F.lit(bits - 1) - index).bitwiseAND(F.lit(1)).cast("int")


def bits_of(value: Column, bits: int = 32) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: bit_at(value, i, bits))


def common_prefix_length(a: Column, b: Column, bits: int = 32) -> Column:
    """Leading bits that two addresses share."""
    differ = a.bitwiseXOR(b)
    return F.when(differ == 0, F.lit(bits)).otherwise(F.lit(bits) - F.length(F.bin(differ))).cast("int")


def mask(value: Column, length: Column | int, bits: int = 32) -> Column:
    """The network of an IPv4 address at a prefix length."""
    length = F.lit(length) if isinstance(length, int) else length
    by = F.lit(bits) - length
    return _shift("shiftleft", _shift("shiftright", value, by), by)


def mask_ipv6(hi: Column, lo: Column, length: Column) -> tuple[Column, Column]:
    """Both halves of an IPv6 network. Shifts by 64 do nothing on the JVM, so the ends are apart."""
    cut = lambda v, by: _shift("shiftleft", _shift("shiftrightunsigned", v, by), by)
    zero = F.lit(0).cast("long")
    high = F.when(length <= 0, zero).when(length >= 64, hi).otherwise(cut(hi, F.lit(64) - F.least(length, F.lit(64))))
    low = F.when(length <= 64, zero).otherwise(cut(lo, F.lit(128) - F.greatest(length, F.lit(65))))
    return high, low


def unsigned_order(half: Column) -> Column:
    """A BIGINT half in a form whose signed order is the unsigned order."""
    return half.bitwiseXOR(F.lit(-(2**63)))


def capacity(length: Column | int, bits: int = 32) -> Column:
    """Addresses under a prefix; BIGINT, so up to 62 free bits."""
    length = F.lit(length) if isinstance(length, int) else length
    return _shift("shiftleft", F.lit(1).cast("long"), F.lit(bits) - length)


def capacity_text(length: Column, bits: int = 32) -> Column:
    """The exact capacity in decimal, as on the wire, for any family."""
    return F.element_at(F.create_map(*[x for k in range(bits + 1) for x in (F.lit(k), F.lit(str(2 ** (bits - k))))]), length.cast("int"))


def hot_ratio(hot_count: Column, length: Column | int, bits: int = 32) -> Column:
    """Exact in DOUBLE for counts below 2**53: the capacity is a power of two."""
    if bits <= 32:
        return hot_count.cast("double") / capacity(length, bits).cast("double")
    return hot_count.cast("double") / F.pow(F.lit(2.0), F.lit(bits) - length)


def format_prefix(network: Column, length: Column) -> Column:
    return F.concat(format_ipv4(network), F.lit("/"), length.cast("string"))


def parse_prefix(text: Column) -> Column:
    """struct(length, network) of a canonical IPv4 prefix; a bare address is its host route; null if host bits are set."""
    length = F.when(text.contains("/"), F.when(F.split_part(text, F.lit("/"), F.lit(2)).rlike("^(?:[0-9]|[12][0-9]|3[0-2])$"), F.split_part(text, F.lit("/"), F.lit(2)).cast("int"))).otherwise(F.lit(32))
    network = parse_ipv4(F.split_part(text, F.lit("/"), F.lit(1)))
    whole = F.size(F.split(text, "/")) <= 2
    return F.when(whole & network.isNotNull() & length.isNotNull() & (mask(network, length) == network), F.struct(length.alias("length"), network.alias("network")))


def contains(network: Column, length: Column, address: Column) -> Column:
    """Containment as a range, which Parquet statistics can use."""
    return address.between(network, network + capacity(length) - 1)


def covers(outer_network: Column, outer_length: Column, inner_network: Column, inner_length: Column) -> Column:
    return (outer_length <= inner_length) & (mask(inner_network, outer_length) == outer_network)


def source_key(text: Column) -> Column:
    """Throttling key of a client: IPv4 as /32, mapped IPv6 as its IPv4 /32, other IPv6 as its /64; null if no address."""
    v6 = parse_ipv6(text)
    mapped = (v6["hi"] == 0) & (_shift("shiftright", v6["lo"], F.lit(32)) == 65535)
    network = F.concat(format_ipv6(v6["hi"], F.lit(0).cast("long")), F.lit("/64"))
    return F.when(is_ipv4(text), F.concat(text, F.lit("/32"))).when(mapped, F.concat(format_ipv4(v6["lo"].bitwiseAND(F.lit(4294967295))), F.lit("/32"))).when(v6["hi"].isNotNull(), network)


def forwarded_client(header: Column, trusted_hops: int) -> Column:
    """The address that the n-th trusted proxy from the right reported; null if the header is too short or it is no IPv4 address."""
    hops = F.transform(F.split(header, ","), lambda h: F.trim(h))
    chosen = F.when(F.size(hops) >= trusted_hops, F.element_at(hops, -trusted_hops))
    return F.when(is_ipv4(chosen), chosen)
