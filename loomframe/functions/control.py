"""Defaults, conditions, pattern matching, coercion, type tests, comparison, errors and assertions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomframe.functions.strings import fail_if, to_text, trim

#: Type names by what Spark calls them.
TYPE_NAMES = {"void": "Null", "boolean": "Boolean", "string": "String"}
NUMBERS = ["tinyint", "smallint", "int", "bigint", "float", "double"]


def default(v: Column, d: Column) -> Column:
    return F.coalesce(v, d)


on_null = default


def then(v: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value; null stays null."""
    return F.when(v.isNotNull(), f(v))


def if_else(condition: Column, a: Column, b: Column | None = None) -> Column:
    """A condition that is null is an error; without `b`, null."""
    chosen = F.when(condition, a) if b is None else F.when(condition, a).otherwise(b)
    return fail_if(condition.isNull(), "if: not a Boolean", chosen)


def match_case(v: Column, cases: Sequence[tuple[Callable[[Column], Column], Callable[[Column], Column]]], otherwise: Callable[[Column], Column] | None = None) -> Column:
    """The first case whose test holds; an error if none does and there is no `otherwise`."""
    out = None
    for test, result in cases:
        hit = F.coalesce(test(v), F.lit(False))
        out = F.when(hit, result(v)) if out is None else out.when(hit, result(v))
    last = otherwise(v) if otherwise else F.raise_error(F.lit("match: no case"))
    return last if out is None else out.otherwise(last)


def literal_case(value: object) -> Callable[[Column], Column]:
    return lambda v: v.eqNullSafe(F.lit(value))


def as_number(v: Column) -> Column:
    """Null is 0; text that is no number is an error."""
    return F.coalesce(v.cast("double"), F.lit(0.0))


def as_string(v: Column) -> Column:
    return to_text(v)


def as_boolean(v: Column) -> Column:
    """`true` and `false` only; null is false."""
    text = F.coalesce(v.cast("string"), F.lit("false"))
    return fail_if(~text.isin("true", "false"), "not a Boolean", text == "true")


def as_formatted(v: Column, pattern: str) -> Column:
    return F.date_format(v, pattern)


def as_union(v: Column, *kinds: str) -> Column:
    """Text as the first of the types that takes it, as text again; null where none does."""
    return F.coalesce(*[v.try_cast(k).cast("string") for k in kinds])


def type_of(v: Column) -> Column:
    t = F.typeof(v)
    out = F.when(t.isin(*NUMBERS) | F.startswith(t, F.lit("decimal")), "Number")
    for spark, name in TYPE_NAMES.items():
        out = out.when(t == spark, name)
    return out.when(F.startswith(t, F.lit("array")), "Array").when(F.startswith(t, F.lit("struct")) | F.startswith(t, F.lit("map")), "Object").otherwise("String")


def is_type(v: Column, name: str) -> Column:
    return type_of(v) == name


def equal(a: Column, b: Column) -> Column:
    """Null equals null."""
    return a.eqNullSafe(b)


def equal_coerced(a: Column, b: Column) -> Column:
    """`~=`: numbers and Booleans also by their text."""
    x, y = a.cast("string"), b.cast("string")
    p, q = x.try_cast("double"), y.try_cast("double")
    return F.coalesce(p == q, x.eqNullSafe(y))


def both(a: Column, b: Column) -> Column:
    """`and` of Booleans, never null: null is an error."""
    return fail_if(a.isNull() | (a & b).isNull() & F.coalesce(a, F.lit(False)), "and: not a Boolean", F.when(a, b).otherwise(False))


def either(a: Column, b: Column) -> Column:
    return fail_if(a.isNull() | b.isNull() & ~F.coalesce(a, F.lit(True)), "or: not a Boolean", F.when(a, True).otherwise(b))


def attempt(v: Column) -> Column:
    """`try` over what is null when it fails (the try_ functions): {success, result}."""
    return F.struct(v.isNotNull().alias("success"), v.alias("result"))


def or_else(tried: Column, other: Column) -> Column:
    return F.when(tried["success"], tried["result"]).otherwise(other)


def or_else_try(tried: Column, other: Column) -> Column:
    """The first of two tries that succeeded, as a try: {success, result}."""
    return F.when(tried["success"], tried).otherwise(other)


def fail(message: str = "Error") -> Column:
    return F.raise_error(F.lit(message))


def uuid() -> Column:
    return F.uuid()


Matcher = Callable[[Column], Column]


def must(v: Column, m: Matcher) -> Column:
    return F.coalesce(m(v), F.lit(False))


def assert_that(v: Column, m: Matcher, message: str = "assertion failed") -> Column:
    return fail_if(~must(v, m), message, v)


def each_item(m: Matcher) -> Matcher:
    return lambda v: F.forall(v, lambda x: must(x, m))


def have_item(m: Matcher) -> Matcher:
    return lambda v: F.exists(v, lambda x: must(x, m))


def any_of(*ms: Matcher) -> Matcher:
    def test(v: Column) -> Column:
        out = F.lit(False)
        for m in ms:
            out = out | must(v, m)
        return out

    return test


def not_be(m: Matcher) -> Matcher:
    return lambda v: ~must(v, m)


def be_type(name: str) -> Matcher:
    """beArray, beObject, beString, beNumber, beBoolean, beNull."""
    return (lambda v: v.isNull()) if name == "Null" else (lambda v: v.isNotNull() & is_type(v, name))


be_array, be_object, be_string, be_number, be_boolean, be_null = (be_type(n) for n in ("Array", "Object", "String", "Number", "Boolean", "Null"))


def be_empty(v: Column) -> Column:
    return v == ""


def be_blank(v: Column) -> Column:
    return trim(v) == ""


def equal_to(x: object) -> Matcher:
    return lambda v: v.eqNullSafe(F.lit(x))


def be_greater_than(x: object, inclusive: bool = False) -> Matcher:
    return lambda v: (v >= x) if inclusive else (v > x)


def be_lower_than(x: object, inclusive: bool = False) -> Matcher:
    return lambda v: (v <= x) if inclusive else (v < x)


def be_one_of(*xs: object) -> Matcher:
    return lambda v: v.isin(*xs)


def contain_str(x: str) -> Matcher:
    return lambda v: F.contains(v, F.lit(x))


def contain_val(x: object) -> Matcher:
    return lambda v: F.array_contains(v, x)


def start_with(x: str) -> Matcher:
    return lambda v: F.startswith(v, F.lit(x))


def end_with(x: str) -> Matcher:
    return lambda v: F.endswith(v, F.lit(x))


def have_size(n: int) -> Matcher:
    return lambda v: F.size(v) == n


def have_key(k: str) -> Matcher:
    return lambda v: F.map_contains_key(v, k)


def have_value(x: object) -> Matcher:
    return lambda v: F.array_contains(F.map_values(v), x)


def not_be_null(v: Column) -> Column:
    return v.isNotNull()
