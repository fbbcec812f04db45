"""Functions over objects: struct columns (fixed keys, in order) and map columns (free keys, in order)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions.strings import fail_if, let


def keys(m: Column) -> Column:
    return F.map_keys(m)


keys_of = names_of = keys


def values(m: Column) -> Column:
    return F.map_values(m)


values_of = values


def size_of(m: Column) -> Column:
    return F.when(m.isNotNull(), F.size(m))


def is_empty(m: Column) -> Column:
    return m.isNull() | (F.size(m) == 0)


def filter_object(m: Column, p: Callable[[Column, Column], Column]) -> Column:
    """Entries whose (value, key) pass."""
    return F.map_filter(m, lambda k, v: p(v, k))


def map_object(m: Column, f: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """A map of the (key, value) that f gives for each (value, key); of equal keys the last value, at the first's place."""
    return array_to_object(F.transform(F.map_entries(m), lambda e: F.struct(*[c.alias(n) for n, c in zip(("key", "value"), f(e["value"], e["key"]), strict=True)])))


def pluck(m: Column, f: Callable[[Column, Column, Column], Column]) -> Column:
    """An array of f(value, key, position)."""
    return F.transform(F.map_entries(m), lambda e, i: f(e["value"], e["key"], i))


def merge(first: Column, *others: Column) -> Column:
    """Later values win, at the key's first place; nulls are skipped. Each map is named twice, however many there are."""
    maps = [first, *others]
    some = first.isNotNull()
    for m in others:
        some = some | m.isNotNull()
    return F.when(some, array_to_object(F.flatten(F.filter(F.array(*[F.map_entries(m) for m in maps]), lambda e: e.isNotNull()))))


update = concat = merge_with = merge


def remove(m: Column, *names: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*names))


def object_to_array(m: Column) -> Column:
    return F.map_entries(m)


entries_of = entry_set = object_to_array


def array_to_object(a: Column) -> Column:
    """A map of {key, value} elements; of equal keys the last value, at the first's place."""

    def last(entries: Column, keys: Column) -> Column:
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))

    return let(a, lambda entries: let(F.array_distinct(F.transform(entries, lambda e: e["key"])), lambda keys: last(entries, keys)))


def has(m: Column, key: str) -> Column:
    """Whether a key is there, a null value included; false for null."""
    return F.coalesce(F.map_contains_key(m, key), F.lit(False))


def required(m: Column, key: str) -> Column:
    return fail_if(~has(m, key), f"missing key {key}", m[key])


def safe(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def multi_value(a: Column, field: str) -> Column:
    """The field of every struct of an array that has it; an empty array for null."""
    return F.coalesce(F.filter(F.transform(a, lambda x: x[field]), lambda x: x.isNotNull()), F.array())


def with_attributes(value: Column, **attributes: Column) -> Column:
    """A scalar under `#text`, with `@` attributes before it."""
    return F.struct(*[c.alias(f"@{n}") for n, c in attributes.items()], value.alias("#text"))


def xsi_type(name: str) -> Column:
    return F.struct(F.lit(name).alias("xsi:type"))


def struct_fields(df: DataFrame, name: str) -> T.StructType:
    kind = df.select(name).schema[0].dataType
    if not isinstance(kind, T.StructType):
        raise TypeError(f"{name} is not an object")
    return kind


def struct_values(df: DataFrame, name: str) -> Column:
    """`o.*`: the values of a struct whose fields have one type."""
    return F.array(*[F.col(name)[f.name] for f in struct_fields(df, name)])


def update_path(value: Column, path: str, f: Callable[[Column], Column]) -> Column:
    """A struct with the field at a dotted path replaced by f of it; other fields stay, in order."""
    head, _, rest = path.partition(".")
    return value.withField(head, update_path(value[head], rest, f) if rest else f(value[head]))


def descend(kind: T.DataType, value: Column, name: str) -> list[Column]:
    """`o..f`: every field `name` below structs and arrays, outer before inner, as array columns."""
    out: list[Column] = []
    if isinstance(kind, T.StructType):
        for f in kind:
            if f.name == name:
                out.append(F.array(value[f.name]))
        for f in kind:
            out += descend(f.dataType, value[f.name], name)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        for f in kind.elementType:
            if f.name == name:
                out.append(value[f.name])
        for f in kind.elementType:
            if isinstance(f.dataType, T.StructType):
                out += descend(T.ArrayType(f.dataType), value[f.name], name)
            elif isinstance(f.dataType, T.ArrayType):
                out += descend(f.dataType, F.flatten(value[f.name]), name)
    return out


def deep(df: DataFrame, column: str, name: str) -> Column:
    """All values of a field at any depth of a column; null where there is none."""
    found = descend(df.schema[column].dataType, F.col(column), name)
    if not found:
        return F.lit(None)
    every = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in (c.cast("array<string>") for c in found)])
    return F.when(F.size(every) > 0, every)


def metadata(df: DataFrame, column: str, what: str) -> Column:
    """`v.^class`, `v.^type`, `v.^size`; null for another name."""
    from loomframe.functions.control import type_of

    if what in ("class", "type"):
        return type_of(F.col(column))
    if what == "size":
        kind = df.schema[column].dataType
        return F.size(column) if isinstance(kind, T.ArrayType | T.MapType) else F.length(F.col(column).cast("string"))
    return F.lit(None).cast("string")
