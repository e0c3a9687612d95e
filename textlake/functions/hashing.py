"""The hash that Spark ML's HashingTF puts terms into buckets with: 32-bit
murmur3 (seed 42) over a term's UTF-8 bytes, from built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlake.functions.text import ColumnOrName, _col, _let

# FIXED VALUES: murmur3's multipliers and the seed HashingTF uses.
C1, C2, SEED = 0xCC9E2D51, 0x1B873593, 42
FINAL1, FINAL2 = 0x85EBCA6B, 0xC2B2AE35
_WORD = 0xFFFFFFFF


def _times(a: Column, c: int) -> Column:
    """a * c modulo 2 ** 32 without leaving 64 bits, a below 2 ** 32."""
    high = (a * F.lit(c >> 16)).bitwiseAND(F.lit(0xFFFF)) * F.lit(1 << 16)
    return (a * F.lit(c & 0xFFFF) + high).bitwiseAND(F.lit(_WORD))


def _rotate(a: Column, n: int) -> Column:
    return F.shiftleft(a, n).bitwiseOR(F.shiftright(a, 32 - n)).bitwiseAND(F.lit(_WORD))


def _little_endian(digits: Column) -> Column:
    """Up to four bytes, given as hex digits, as a number with the first byte lowest."""
    pairs = [F.substr(digits, F.lit(i), F.lit(2)) for i in (7, 5, 3, 1)]
    return F.conv(F.concat(F.lit("0"), *pairs), 16, 10).cast("long")


def murmur3(term: ColumnOrName) -> Column:
    """Unsigned 32-bit murmur3 hash of a string, as a bigint."""
    digits, size = F.hex(_col(term)), F.octet_length(_col(term)).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.floor(size / 4).cast("int")),
                         lambda i: F.struct(i.alias("i"), F.substr(digits, i * 8 + 1, F.lit(8)).alias("d")))

    def scrambled(d: Column) -> Column:
        return _times(_rotate(_times(_little_endian(d), C1), 15), C2)

    def step(h: Column, b: Column) -> Column:
        mixed = lambda k: h.bitwiseXOR(k)
        whole = lambda k: (_rotate(mixed(k), 13) * F.lit(5) + F.lit(0xE6546B64)).bitwiseAND(F.lit(_WORD))
        # the last block is the rest of less than four bytes, maybe none
        return _let(scrambled(b["d"]), lambda k: F.when(F.length(b["d"]) == 8, whole(k)).otherwise(mixed(k)))

    h = F.aggregate(blocks, F.lit(SEED).cast("long"), step).bitwiseXOR(size)
    h = _let(h, lambda x: _times(x.bitwiseXOR(F.shiftright(x, 16)), FINAL1))
    h = _let(h, lambda x: _times(x.bitwiseXOR(F.shiftright(x, 13)), FINAL2))
    return _let(h, lambda x: x.bitwiseXOR(F.shiftright(x, 16)))


def hashing_tf_bucket(term: ColumnOrName, num_features: int | Column) -> Column:
    """HashingTF's bucket of a term; never NULL for a non-NULL term, so a join
    on it needs no test of the hash below the aggregate that feeds it."""
    signed = _let(murmur3(term), lambda h: F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h))
    size = F.lit(num_features) if isinstance(num_features, int) else num_features
    return F.coalesce(F.pmod(signed, size.cast("long")).cast("int"), F.lit(0))
