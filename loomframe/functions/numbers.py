"""Number functions; aggregates over arrays are in `arrays`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomframe.functions.strings import fail_if


def number(v: Column) -> Column:
    """Null is 0."""
    return F.coalesce(v, F.lit(0))


def ceil(v: Column) -> Column:
    return F.ceil(number(v))


def floor(v: Column) -> Column:
    return F.floor(number(v))


def round(v: Column) -> Column:  # noqa: A001
    """Halves away from zero."""
    return F.round(number(v)).cast("long")


def sqrt(v: Column) -> Column:
    return fail_if(v < 0, "sqrt: negative", F.sqrt(v))


def abs(v: Column) -> Column:  # noqa: A001
    return F.abs(v)


def pow(base: Column, exponent: Column) -> Column:  # noqa: A001
    return F.pow(base, exponent)


def int_pow(base: Column, exponent: Column) -> Column:
    """Exact; an error beyond 64 bits."""
    return F.aggregate(F.array_repeat(base.cast("long"), exponent.cast("int")), F.lit(1).cast("long"), lambda x, y: x * y)


def int_pow_of(base: Column, exponent: int) -> Column:
    """The same for an exponent that is known: multiplied out by squaring, so that it stays in generated code."""
    out, power, left = None, base.cast("long"), exponent
    while left:
        if left & 1:
            out = power if out is None else out * power
        left >>= 1
        power = power * power if left else power
    return F.lit(1).cast("long") if out is None else out


def mod(a: Column, b: Column) -> Column:
    """With the dividend's sign; an error for 0."""
    return fail_if(b == 0, "mod: division by zero", a % F.when(b != 0, b))


def divide(a: Column, b: Column) -> Column:
    return fail_if(b == 0, "division by zero", a / F.when(b != 0, b))


def to_radix(n: Column, radix: int) -> Column:
    text = F.conv(F.abs(n).cast("string"), 10, radix)
    return F.when(n < 0, F.concat(F.lit("-"), text)).otherwise(text)


def from_radix(s: Column, radix: int) -> Column:
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:radix]
    size = F.conv(F.regexp_replace(s, "^[-+]", ""), radix, 10).cast("long")
    return fail_if(~s.rlike(f"(?i)^[-+]?[{digits}]+$"), "fromRadix: not a number", F.when(F.startswith(s, F.lit("-")), -size).otherwise(size))


def to_binary(n: Column) -> Column:
    return to_radix(n, 2)


def from_binary(s: Column) -> Column:
    return from_radix(s, 2)


def to_range(a: Column, b: Column) -> Column:
    """Inclusive, downwards where a > b, by steps of 1 from `a`, whole or not."""
    steps = F.sequence(F.lit(0), F.floor(F.abs(b - a)).cast("int"))
    return F.transform(steps, lambda i: F.when(a <= b, a + i).otherwise(a - i))


def range_of(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(fail_if(n < 0, "range: negative", F.array().cast("array<int>")))


def is_integer(v: Column) -> Column:
    return v == F.floor(v)


def is_decimal(v: Column) -> Column:
    """By representation: 3.0 is one."""
    return F.typeof(v).isin("double", "float") | F.startswith(F.typeof(v), F.lit("decimal"))


def is_even(v: Column) -> Column:
    return v % 2 == 0


def is_odd(v: Column) -> Column:
    return v % 2 != 0


def random() -> Column:
    return F.rand()


def random_int(n: int) -> Column:
    return F.floor(F.rand() * n).cast("long")
