"""Number columns: guarded division, truncation, primes, buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


SMALL_PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31)
WITNESSES = (*SMALL_PRIMES, 37)
WIDE = "decimal(38,0)"

# Texts that a cast may take for numbers.  The cast decides; these only keep off
# texts that it would refuse.
WHOLE = r"^[+-]?[0-9]++$"
DECIMAL = (
    r"^[+-]?(([0-9]++[.]?[0-9]*+|[.][0-9]++)([eE][+-]?[0-9]++)?[fFdD]?"
    r"|(?i:nan|inf|infinity|0x[0-9a-fp.+-]++))$"
)
PATTERNS = {
    "tinyint": WHOLE, "smallint": WHOLE, "int": WHOLE, "bigint": WHOLE,
    "float": DECIMAL, "double": DECIMAL,
}


def number_in(text: Column | str, kind: str) -> Column:
    """The number in a trimmed text, null when it is none.

    A failing ``try_cast`` throws and catches inside Spark, which costs far more than a
    cast that succeeds; where many texts are no numbers, looking first is much cheaper.
    """
    t = F.trim(_col(text))
    return F.when(F.rlike(t, F.lit(PATTERNS[kind])), t.try_cast(kind))


def whole_or(text: Column | str, default: int) -> Column:
    """Integer in a text, or the default when it is no integer."""
    return F.coalesce(number_in(text, "int"), F.lit(default))


def integer_average(total: Column | str, count: Column | str) -> Column:
    """Integer division, 0 for a count of 0."""
    # nullif keeps the division off a zero divisor (ANSI mode raises)
    n = F.nullif(_col(count).cast("bigint"), F.lit(0))
    return F.coalesce(F.call_function("div", _col(total).cast("bigint"), n), F.lit(0))


def floor_2(value: Column | str) -> Column:
    """Cut (not round) to two decimals, downwards."""
    return F.floor(_col(value) * 100) / 100.0


def _times(a: Column, b: Column, n: Column) -> Column:
    """a * b modulo n, exact for 64-bit numbers: their product has at most 38 digits."""
    return (a.cast(WIDE) * b.cast(WIDE) % n.cast(WIDE)).cast(WIDE)


def _power(base: Column, exponent: Column, n: Column) -> Column:
    """base ** exponent modulo n, by the exponent's bits from the highest."""

    def step(so_far: Column, bit: Column) -> Column:
        square = _times(so_far, so_far, n)
        is_set = F.call_function("shiftrightunsigned", exponent, bit).bitwiseAND(F.lit(1)) == 1
        return F.when(is_set, _times(square, base, n)).otherwise(square)

    return F.aggregate(F.sequence(F.lit(62), F.lit(0), F.lit(-1)), F.lit(1).cast(WIDE), step)


def is_prime(n: Column | str) -> Column:
    """Whether a number is prime, for all 64-bit numbers; those below 2 are not.

    Most numbers end at a small prime.  The others are tested with the first twelve primes as
    witnesses (Miller and Rabin), which is proof for every number of this size.
    """
    v = _col(n).cast("bigint")
    small = reduce(lambda a, p: a | (v % p == 0), SMALL_PRIMES, F.lit(False))
    below = v - 1
    zeros = F.bit_count(below.bitwiseAND(-below) - 1).cast("int")
    odd = F.call_function("shiftrightunsigned", below, zeros)

    def passes(witness: Column) -> Column:
        ends = F.sequence(F.lit(0), zeros - 1)
        reaches = F.exists(ends, lambda k: _power(witness, F.call_function("shiftleft", odd, k), v) == below)
        return (_power(witness, odd, v) == 1) | reaches

    witnesses = F.array(*[F.lit(p).cast("bigint") for p in WITNESSES])
    return (
        F.when(v < 2, False)
        .when(v.isin(*SMALL_PRIMES), True)
        .when(small, False)
        .when(v < SMALL_PRIMES[-1] ** 2, True)
        .otherwise(F.forall(witnesses, passes))
    )


def hash_bucket(value: Column | str, buckets: int) -> Column:
    """Bucket from the first 8 hex digits of the MD5 of the value's text."""
    digits = F.substring(F.md5(_col(value).cast("string")), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(buckets))

