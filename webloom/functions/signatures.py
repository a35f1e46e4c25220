"""64-bit signature Column builders.

Signatures are BIGINT bit patterns (bit 63 = first bit).  The text form used
in tags is ``p:<16 lower-case hex digits>`` behind the ``phash:`` prefix.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG_PREFIX = "phash:"


def sign_bits(values: Column) -> Column:
    """64 values -> BIGINT whose bit i (from the top) is ``value > 0``."""
    return F.aggregate(values, F.lit(0).cast("bigint"),
                       lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")))


def to_hex(sig: Column) -> Column:
    """Unsigned 16-digit lower-case hex of the bit pattern."""
    return F.lpad(F.lower(F.hex(sig)), 16, "0")


def signature_tag(sig: Column) -> Column:
    """G3 text: ``phash:p:<hex>``."""
    return F.concat(F.lit(TAG_PREFIX + "p:"), to_hex(sig))


def from_tags(tags: Column) -> Column:
    """The first ``phash:`` tag, parsed; NULL when absent, malformed or
    of another hash kind (``a:``, ``d:``, ``w:``)."""
    first = F.get(F.filter(tags, lambda t: t.startswith(TAG_PREFIX)), 0)
    body = F.substring(first, len(TAG_PREFIX) + 1, 1 << 30)
    ok = body.rlike("^p:[0-9a-fA-F]{1,16}$")
    return F.when(ok, F.conv(F.substring(body, 3, 16), 16, -10).cast("bigint"))


def add_signature_tag(tags: Column, sig: Column) -> Column:
    """Append ``phash:p:<hex>`` when no ``phash:`` tag is present."""
    has = F.exists(tags, lambda t: t.startswith(TAG_PREFIX))
    return F.when(has | sig.isNull(), tags).otherwise(F.array_append(tags, signature_tag(sig)))


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits."""
    return F.bit_count(a.bitwiseXOR(b))


def band(sig: Column, i: int, bands: int) -> Column:
    """Bits of band ``i`` (0 = most significant) as a non-negative INT."""
    width = 64 // bands
    shift = 64 - width * (i + 1)
    return F.shiftrightunsigned(sig, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
