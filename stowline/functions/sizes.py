"""Byte counts from and to text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

_SIZE = "^\\s*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)\\s+(\\S+)\\s*$"
LARGEST = 1e30  # bytes
_UNITS = ["B", "KB", "MB", "GB", "TB"]
_PREFIXES = ["", "K", "M", "G", "T", "P", "E"]


def _cases(branches: list[tuple[Column, Column]], last: Column) -> Column:
    first, *rest = branches
    chain = reduce(lambda chain, branch: chain.when(*branch), rest, F.when(*first))
    return chain.otherwise(last)


def _bytes(text: Column, base: int) -> Column:
    """The size as a double; null when the text is malformed."""
    factors = F.create_map(*[F.lit(item) for power, name in enumerate(_UNITS) for item in (name, float(base**power))])
    number = F.regexp_extract(text, _SIZE, 1).try_cast("double")
    return number * F.try_element_at(factors, F.upper(F.regexp_extract(text, _SIZE, 2)))


def _whole(size: Column) -> Column:
    """A double cut down to whole bytes as decimal(38,0), every bit of it: limbs of 40 bits are exact in doubles and integers."""
    limb = 2.0**40
    high = F.floor(F.abs(size) / F.lit(limb * limb)).cast("double")
    rest = F.abs(size) - high * F.lit(limb * limb)
    middle = F.floor(rest / F.lit(limb)).cast("double")
    low = F.floor(rest - middle * F.lit(limb)).cast("double")
    wide = lambda part: part.cast("bigint").cast("decimal(38,0)")
    step = F.lit(2**40).cast("decimal(14,0)")
    total = ((wide(high) * step + wide(middle)).cast("decimal(38,0)") * step + wide(low)).cast("decimal(38,0)")
    large = F.when(size < 0, -total).otherwise(total)
    return F.when(F.abs(size) < F.lit(2.0**53), size.cast("bigint").cast("decimal(38,0)")).otherwise(large)


def size_too_large(text: Column, base: int = 1024) -> Column:
    """Whether a well-formed size is beyond what is counted; such a size is null, so totals can tell how many they miss."""
    return F.coalesce(F.abs(_bytes(text, base)) >= F.lit(LARGEST), F.lit(False))


def parse_size(text: Column, base: int = 1024) -> Column:
    """`"1.5 GB"` -> whole bytes as decimal(38,0), cut down; anything malformed is 0, anything too large null.

    Sums of a hundred million largest sizes still fit.
    """
    size = _bytes(text, base)
    return F.when(size.isNull(), F.lit(0).cast("decimal(38,0)")).when(F.abs(size) < F.lit(LARGEST), _whole(size))


def format_binary(size: Column) -> Column:
    """Two decimals in TB, GB, MB or KB (powers of 1024), plain bytes below."""
    branches = [
        (size >= 1024**power, F.format_string(f"%.2f {_UNITS[power]}", size / F.lit(float(1024**power))))
        for power in (4, 3, 2, 1)
    ]
    return _cases(branches, F.concat(size.cast("string"), F.lit(" B")))


def format_si(size: Column, kilo: str = "k") -> Column:
    """One decimal in powers of 1000, plain bytes below 1000; `kilo` is `k` or `K`."""
    prefixes = ["", kilo, *_PREFIXES[2:]]
    branches = [
        (size >= 1000**power, F.format_string(f"%.1f {prefixes[power]}B", size / F.lit(float(1000**power))))
        for power in (6, 5, 4, 3, 2, 1)
    ]
    return _cases(branches, F.concat(size.cast("string"), F.lit(" B")))


def format_cell(size: Column) -> Column:
    """One decimal in powers of 1000 down to bytes; zero is blank."""
    branches = [(size == 0, F.lit(""))] + [
        (size < 1000 ** (power + 1), F.format_string(f"%.1f {_PREFIXES[power]}B", size / F.lit(float(1000**power))))
        for power in range(6)
    ]
    return F.when(size.isNotNull(), _cases(branches, F.format_string("%.1f EB", size / F.lit(float(1000**6)))))
