"""Column expressions (all JVM-side built-ins, no Python UDFs).

Every random choice in the library is a hash order: ``md5(id ':' seed)`` sorts the same
way in Spark and in plain SQL, so sampling and partitioning are reproducible and checkable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BENIGN = "BENIGN"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ----------------------------------------------------------------- hashing / keys
def hash_key(id_col, seed: str | int) -> Column:
    """Hex md5 of ``id:seed``; ordering by it is a seeded shuffle."""
    return F.md5(F.concat(_c(id_col).cast("string"), F.lit(f":{seed}")))


def _leading_bits(md5_hex: Column) -> Column:
    """The first 60 bits of a hex digest as a number."""
    return F.conv(F.substring(md5_hex, 1, 15), 16, 10).cast("bigint")


def unit_of_hex(md5_hex: Column) -> Column:
    """Uniform value in [0, 1) from the first 60 bits of a hex digest."""
    return _leading_bits(md5_hex).cast("double") / F.lit(float(2**60))


def hash_unit(id_col, seed: str | int) -> Column:
    """Uniform value in [0, 1) from the first 60 bits of the md5 key."""
    return unit_of_hex(hash_key(id_col, seed))


def hash_int(key: Column, modulo: Column) -> Column:
    """Non-negative ``int(first 60 bits of md5(key)) mod modulo``."""
    return F.pmod(_leading_bits(F.md5(key)), modulo.cast("bigint"))


# ----------------------------------------------------------------- cleaning
def repair_label(c) -> Column:
    """Runs of non-ASCII characters become '-', then trim (replace first, then trim)."""
    return F.trim(F.regexp_replace(_c(c).cast("string"), r"[^\x00-\x7F]+", "-"))


def to_double(c) -> Column:
    """Text to double; unparsable text becomes NULL (never throws under ANSI)."""
    return F.expr(f"try_cast(`{c}` AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")


def is_finite(c) -> Column:
    x = _c(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def finite_or_null(c) -> Column:
    """Strict clean: NaN and +-inf become NULL."""
    x = _c(c)
    return F.when(is_finite(x), x)


def finite_or_zero(c) -> Column:
    """Lenient clean: NULL, NaN and +-inf become 0."""
    return F.coalesce(finite_or_null(c), F.lit(0.0))


def non_negative(c) -> Column:
    x = _c(c)
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def signed_log1p(c) -> Column:
    x = _c(c)
    return F.signum(x) * F.log1p(F.abs(x))


def clip(c, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), _c(c)))


def is_attack_label(c) -> Column:
    """Binary label from text: anything but BENIGN (case-insensitive) is an attack."""
    return (F.upper(F.trim(_c(c))) != F.lit(BENIGN)).cast("int")


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def percent_label(c) -> Column:
    """``int(round(100*x))%`` with Python's half-even rounding."""
    return F.concat(F.bround(_c(c) * 100, 0).cast("int").cast("string"), F.lit("%"))


def mean_std_text(mean, std, n, digits: int = 4) -> Column:
    """``mean ± std`` when a group has more than one value, else the plain mean.

    Java's formatter rounds half-up on the decimal expansion; numeric mean/std columns
    are the comparison-safe form of the same report.
    """
    fmt = f"%.{digits}f"
    return F.when(_c(n) > 1, F.format_string(f"{fmt} \u00b1 {fmt}", _c(mean), _c(std))).otherwise(
        F.format_string(fmt, _c(mean)))
