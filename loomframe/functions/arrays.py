"""Functions over array columns. Positions count from 0; lambdas take the element, or the element and its position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomframe.functions.strings import fail_if, let

Lambda = Callable[..., Column]


def clamp(i: int, n: Column) -> Column:
    """A bound, from the end where negative, within 0 .. n."""
    return F.least(F.greatest(F.lit(i) if i >= 0 else n + i, F.lit(0)), n)


def size_of(a: Column) -> Column:
    return F.when(a.isNotNull(), F.size(a))


def is_empty(a: Column) -> Column:
    return a.isNull() | (F.size(a) == 0)


def filter(a: Column, p: Lambda) -> Column:  # noqa: A001
    return F.filter(a, p)


def filter_selector(a: Column, p: Lambda) -> Column:
    """Null where nothing is left."""
    left = F.filter(a, p)
    return F.when(F.size(left) > 0, left)


def map(a: Column, f: Lambda) -> Column:  # noqa: A001
    return F.transform(a, f)


def flat_map(a: Column, f: Lambda) -> Column:
    return F.flatten(F.transform(a, f))


def reduce(a: Column, f: Lambda, start: Column | None = None) -> Column:
    """Left fold of (item, so far); without a start the first element is it, and an empty array gives null."""
    if start is not None:
        return F.aggregate(a, start, lambda acc, x: f(x, acc))
    return F.when(F.size(a) > 0, F.aggregate(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.get(a, F.lit(0)), lambda acc, x: f(x, acc)))


def group_by(a: Column, key: Lambda) -> Column:
    """map<string, array> by the key's text, in order of first appearance."""
    from loomframe.functions.strings import to_text

    def grouped(rows: Column, keys: Column) -> Column:
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(rows, lambda r: r["k"] == k), lambda r: r["x"])))

    rows = F.transform(a, lambda x: F.struct(to_text(key(x)).alias("k"), x.alias("x")))
    return let(rows, lambda rows: let(F.array_distinct(F.transform(rows, lambda r: r["k"])), lambda keys: grouped(rows, keys)))


def order_by(a: Column, key: Lambda, descending: bool = False) -> Column:
    """Stable, by keys of any type that has an order."""
    place = (lambda i: -i) if descending else (lambda i: i)
    rows = F.sort_array(F.transform(a, lambda x, i: F.struct(key(x).alias("k"), place(i).alias("i"), x.alias("x"))), asc=not descending)
    return F.transform(rows, lambda r: r["x"])


def sort(a: Column) -> Column:
    """An error for a null element."""
    return fail_if(F.exists(a, lambda x: x.isNull()), "sort: null element", F.sort_array(a))


def distinct_by(a: Column, key: Lambda) -> Column:
    """The first element of each key, by two sorts."""
    def firsts(rows: Column) -> Column:
        new = F.filter(rows, lambda r, at: (at == 0) | ~r["k"].eqNullSafe(F.get(rows, at - 1)["k"]))
        return F.sort_array(F.transform(new, lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x"))))

    rows = F.sort_array(F.transform(a, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    return F.transform(let(rows, firsts), lambda r: r["x"])


def unique(a: Column) -> Column:
    return F.array_distinct(a)


distinct = unique


def max_by(a: Column, key: Lambda) -> Column:
    """The first element of the greatest key."""
    return F.array_max(F.transform(a, lambda x, i: F.struct(key(x).alias("k"), (-i).alias("i"), x.alias("x"))))["x"]


def min_by(a: Column, key: Lambda) -> Column:
    return F.array_min(F.transform(a, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))["x"]


def first_false(a: Column, p: Lambda) -> Column:
    """Position of the first element that fails, or the size."""
    fails = F.filter(F.transform(a, lambda x, i: F.when(p(x), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_min(fails), F.size(a))


def take_while(a: Column, p: Lambda) -> Column:
    return F.slice(a, F.lit(1), first_false(a, p))


def drop_while(a: Column, p: Lambda) -> Column:
    at = first_false(a, p)
    return F.slice(a, at + 1, F.size(a) - at)


def some(a: Column, p: Lambda) -> Column:
    """False for null."""
    return F.coalesce(F.exists(a, lambda x: F.coalesce(p(x), F.lit(False))), F.lit(False))


def every(a: Column, p: Lambda) -> Column:
    """True for null."""
    return F.coalesce(F.forall(a, lambda x: F.coalesce(p(x), F.lit(False))), F.lit(True))


def take(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(1), F.lit(n if n > 0 else 0))


def drop(a: Column, n: int) -> Column:
    n = n if n > 0 else 0
    return F.slice(a, F.lit(n + 1), F.greatest(F.size(a) - n, F.lit(0)))


def slice(a: Column, start: int, end: int) -> Column:  # noqa: A001
    """[start, end), negative bounds from the end, clamped."""
    s, e = clamp(start, F.size(a)), clamp(end, F.size(a))
    return F.slice(a, s + 1, F.greatest(e - s, F.lit(0)))


def arrays_slice(a: Column, start: int, end: int) -> Column:
    """[start, end); a negative start is 0, a negative end leaves nothing."""
    s, e = F.lit(start if start > 0 else 0), F.least(F.lit(end), F.size(a))
    return F.slice(a, s + 1, F.greatest(e - s, F.lit(0)))


def range_index(a: Column, start: int, end: int) -> Column:
    """start to end inclusive, downwards too; null where a bound is out of range."""
    n = F.size(a)
    s, e = (F.lit(i) if i >= 0 else n + i for i in (start, end))
    ok = (s >= 0) & (e >= 0) & (s < n) & (e < n)
    lo, hi = F.least(s, e), F.greatest(s, e)
    part = F.slice(a, F.when(ok, lo + 1).otherwise(1), F.when(ok, hi - lo + 1).otherwise(0))
    return F.when(ok & (s <= e), part).when(ok, F.reverse(part))


def item(a: Column, i: int) -> Column:
    """a[i]; an error out of range."""
    ok = (clamp(i, F.size(a)) < F.size(a)) if i >= 0 else (F.size(a) + i >= 0)
    return fail_if(~ok, "index out of range", F.get(a, F.lit(i) if i >= 0 else F.size(a) + i))


def safe(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i) if i >= 0 else F.size(a) + i)


def first(a: Column) -> Column:
    """Null for an empty array; an error for null."""
    return fail_if(a.isNull(), "first: null", F.get(a, F.lit(0)))


def last(a: Column) -> Column:
    return fail_if(a.isNull(), "last: null", F.get(a, F.size(a) - 1))


def reverse(a: Column) -> Column:
    return F.reverse(a)


def flatten(a: Column) -> Column:
    """One level; a null element stays one."""
    return F.flatten(F.transform(a, lambda x: F.coalesce(x, F.array(F.lit(None)))))


def prepend(a: Column, v: Column) -> Column:
    return F.array_prepend(a, v)


def append(a: Column, v: Column) -> Column:
    return F.array_append(a, v)


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def remove(a: Column, b: Column) -> Column:
    """Elements of `a` not in `b`; what is kept keeps its repeats."""
    return let(b, lambda b: F.filter(a, lambda x: ~F.exists(b, lambda y: x.eqNullSafe(y))))


def remove_value(a: Column, v: Column) -> Column:
    return F.filter(a, lambda x: ~x.eqNullSafe(v))


def zip(a: Column, b: Column) -> Column:  # noqa: A001
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(x.alias("l"), y.alias("r")))


def unzip(a: Column) -> Column:
    return F.struct(F.transform(a, lambda p: p["l"]).alias("l"), F.transform(a, lambda p: p["r"]).alias("r"))


def contains(a: Column, v: Column) -> Column:
    return F.coalesce(F.exists(a, lambda x: x.eqNullSafe(v)), F.lit(False))


def index_of(a: Column, v: Column) -> Column:
    return F.coalesce(F.array_position(a, v), F.lit(0)) - 1


def last_index_of(a: Column, v: Column) -> Column:
    at = F.array_position(F.reverse(a), v)
    return F.when(at == 0, F.lit(-1)).otherwise(F.size(a) - at)


def find(a: Column, v: Column) -> Column:
    """All positions of a value."""
    return F.filter(F.transform(a, lambda x, i: F.when(x.eqNullSafe(v), i)), lambda i: i.isNotNull())


def index_where(a: Column, p: Lambda) -> Column:
    found = F.filter(F.transform(a, lambda x, i: F.when(p(x), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit(-1))


def first_with(a: Column, p: Lambda) -> Column:
    return F.get(F.filter(a, p), F.lit(0))


def count_by(a: Column, p: Lambda) -> Column:
    return size_of(F.filter(a, p))


def sum_by(a: Column, f: Lambda) -> Column:
    return sum(F.transform(a, f))


def partition(a: Column, p: Lambda) -> Column:
    return F.struct(F.filter(a, p).alias("success"), F.filter(a, lambda x: ~F.coalesce(p(x), F.lit(False))).alias("failure"))


def split_at(a: Column, i: int) -> Column:
    return F.struct(take(a, i).alias("l"), drop(a, i).alias("r"))


def split_where(a: Column, p: Lambda) -> Column:
    at = F.greatest(index_where(a, p), F.lit(0))
    return F.struct(F.slice(a, F.lit(1), at).alias("l"), F.slice(a, at + 1, F.size(a) - at).alias("r"))


def divide_by(a: Column, n: int) -> Column:
    """Chunks of n."""
    step = n if n > 1 else 1
    starts = lambda a: F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return let(a, lambda a: F.transform(starts(a), lambda i: F.slice(a, i, F.lit(step))))


def join_by(a: Column, separator: str) -> Column:
    return F.array_join(a.cast("array<string>"), separator, "null")


def sum(a: Column, kind: str = "double") -> Column:  # noqa: A001
    """0 for an empty array; an error for a null element.

    `kind` is the type to add in: `bigint` and `decimal(p,s)` are exact, and an
    error where the sum does not fit.
    """
    bad = F.exists(a, lambda x: x.isNull())
    return fail_if(bad, "sum: not a number", F.aggregate(F.transform(a, lambda x: x.cast(kind)), F.lit(0).cast(kind), lambda s, x: (s + x).cast(kind)))


def avg(a: Column, kind: str = "double") -> Column:
    """An error for an empty array; exact kinds are divided as decimals."""
    total = sum(a, kind)
    total = total if kind == "double" else total.cast("decimal(38,10)")
    return fail_if(F.size(a) == 0, "avg: empty", total / F.when(F.size(a) > 0, F.size(a)))


def max(a: Column) -> Column:  # noqa: A001
    """Null counts as 0; null for an empty array."""
    return F.array_max(F.transform(a, lambda x: F.coalesce(x, F.lit(0))))


def min(a: Column) -> Column:  # noqa: A001
    return F.array_min(F.transform(a, lambda x: F.coalesce(x, F.lit(0))))
