"""Collection operators over DataFrames: an array of objects is a DataFrame with an order.

`order` names columns whose values order the rows and tell them apart; an
operator that does not depend on the order does not take it. Nothing here
windows over a whole table: positions come from partition counts, and ends of
prefixes from one aggregate.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions.strings import to_text
from loomframe.storage import written

Order = str | Sequence[str]


def names(order: Order) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def filter_rows(df: DataFrame, p: Column, strict: bool = False) -> DataFrame:
    """Rows where p is true; in strict mode a null is an error."""
    return df.filter(F.when(p.isNull(), F.raise_error(F.lit("filter: not a Boolean"))).otherwise(p) if strict else p)


def map_rows(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in columns.items()])


def flat_map_rows(df: DataFrame, array: Column, name: str, *kept: str) -> DataFrame:
    """A row for each element of each row's array; none for an empty or null one."""
    return df.select(*kept, F.explode(array).alias(name))


def with_index(df: DataFrame, order: Order, name: str = "index") -> DataFrame:
    """0-based positions in the order of `order`; rows that tie get adjoining ones.

    Rows are range-partitioned, sorted and written with their (partition, row)
    numbers, so that no retry numbers them anew; only the partitions' counts,
    one row each, are summed up and broadcast. A column of that name is an error;
    others may have any name.
    """
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    keys = [F.col(f"row.`{c}`") for c in names(order)]
    at = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "indexed")
    at = at.withColumn("part", F.shiftright("at", 33))
    counts = at.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    index = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return at.join(F.broadcast(before), "part").select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns], index.alias(name))


def placed(df: DataFrame, order: Order) -> tuple[DataFrame, str]:
    """`df` with positions in a column of a new name."""
    name = f"index_{uuid.uuid4().hex}"
    return with_index(df, order, name), name


def group_rows(df: DataFrame, key: Column, order: Order, *kept: str) -> DataFrame:
    """(key as text, rows in order). For sums and counts of groups use group_aggregate, which keeps no rows."""
    row = F.struct(*names(order), *[c for c in (kept or df.columns) if c not in names(order)])
    return df.groupBy(to_text(key).alias("key")).agg(F.sort_array(F.collect_list(row)).alias("rows"))


def group_aggregate(df: DataFrame, keys: dict[str, Column], **aggregates: Column) -> DataFrame:
    """groupBy followed by sizes, sums and the like of each group, as one partial and one final aggregate."""
    return df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*[c.alias(n) for n, c in aggregates.items()])


#: Folds that are commutative, as aggregates.
FOLDS: dict[str, Callable[[Column], Column]] = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "count": F.count, "min": F.min, "max": F.max, "product": lambda c: F.coalesce(F.product(c), F.lit(1.0)),
    "and": lambda c: F.coalesce(F.bool_and(c), F.lit(True)), "or": lambda c: F.coalesce(F.bool_or(c), F.lit(False)),
}


def fold(df: DataFrame, kind: str, c: Column, name: str = "value") -> DataFrame:
    return df.agg(FOLDS[kind](c).alias(name))


def reduce_rows(df: DataFrame, keys: Sequence[str], order: Order, value: Column, start: Column, step: Callable[[Column, Column], Column], name: str = "value") -> DataFrame:
    """An ordered left fold of each group, for folds that FOLDS does not name; a group's values meet in one row."""
    said = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*names(order), value.alias("_v")))).alias("_rows"))
    return said.select(*keys, F.aggregate("_rows", start, lambda acc, r: step(acc, r["_v"])).alias(name))


def order_rows(df: DataFrame, *keys: Column) -> DataFrame:
    return df.orderBy(*keys)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def distinct_by(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """The first row of each key; null is a key. Rows are reduced before they move."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*names(order))).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in df.columns])


def max_by(df: DataFrame, key: Column, order: Order, by: Sequence[str] = ()) -> DataFrame:
    """The first row of the greatest key, of all rows or of each group; keys are numbers, strings, Booleans or dates."""
    if isinstance(df.select(key).schema[0].dataType, T.NumericType):
        return first_by(df, -key, order, by)
    row, rest = F.struct(*df.columns), [F.col(c).alias(f"by{i}") for i, c in enumerate(by)]
    firsts = df.filter(key.isNotNull()).groupBy(*rest, key.alias("key")).agg(F.min_by(row, F.struct(*names(order))).alias("best"))
    best = firsts.groupBy(*[f"by{i}" for i in range(len(by))]).agg(F.max_by("best", "key").alias("best"))
    return best.filter(F.col("best").isNotNull()).select("best.*")


def min_by(df: DataFrame, key: Column, order: Order, by: Sequence[str] = ()) -> DataFrame:
    return first_by(df, key, order, by)


def first_by(df: DataFrame, key: Column, order: Order, by: Sequence[str]) -> DataFrame:
    row = F.struct(*df.columns)
    best = df.filter(key.isNotNull()).groupBy(*by).agg(F.min_by(row, F.struct(key, *names(order))).alias("_best"))
    return best.filter(F.col("_best").isNotNull()).select("_best.*")


def take_rows(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """The first n by the keys: each task keeps n at most."""
    return df.orderBy(*keys).limit(max(n, 0))


def drop_rows(df: DataFrame, n: int, order: Order) -> DataFrame:
    """All but the first n."""
    return df.orderBy(*names(order)).offset(n) if n > 0 else df


def slice_rows(df: DataFrame, start: int, end: int, order: Order) -> DataFrame:
    at, index = placed(df, order)
    return at.filter((F.col(index) >= start) & (F.col(index) < end)).drop(index)


def reversed_rows(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order])


def first_failing(df: DataFrame, p: Column, order: Order) -> DataFrame:
    fails = ~F.coalesce(p, F.lit(False))
    return df.agg(F.min(F.when(fails, F.struct(*names(order)))).alias("_end"))


def take_while(df: DataFrame, p: Column, order: Order) -> DataFrame:
    """Rows before the first that fails; its place is one row, broadcast."""
    end = F.broadcast(first_failing(df, p, order))
    return df.join(end, F.col("_end").isNull() | (F.struct(*names(order)) < F.col("_end"))).drop("_end")


def drop_while(df: DataFrame, p: Column, order: Order) -> DataFrame:
    end = F.broadcast(first_failing(df, p, order))
    return df.join(end, F.struct(*names(order)) >= F.col("_end")).drop("_end")


def some_rows(df: DataFrame, p: Column) -> DataFrame:
    return fold(df, "or", p)


def every_row(df: DataFrame, p: Column) -> DataFrame:
    return fold(df, "and", F.coalesce(p, F.lit(False)))


def first_with(df: DataFrame, p: Column, *keys: Column) -> DataFrame:
    return df.filter(p).orderBy(*keys).limit(1)


def index_where(df: DataFrame, p: Column, order: Order) -> DataFrame:
    """Position of the first row that passes, or -1: the rows before it are counted, not numbered."""
    hit = F.broadcast(df.agg(F.min(F.when(p, F.struct(*names(order)))).alias("_hit")))
    return df.join(hit).agg(F.max(F.col("_hit").isNotNull()).alias("_any"), F.count_if(F.struct(*names(order)) < F.col("_hit")).alias("_n")).select(F.when(F.col("_any"), F.col("_n")).otherwise(-1).alias("index"))


def count_by(df: DataFrame, p: Column) -> DataFrame:
    return df.agg(F.count_if(p).alias("value"))


def sum_by(df: DataFrame, c: Column) -> DataFrame:
    return fold(df, "sum", c)


def partition_rows(df: DataFrame, p: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the others."""
    ok = F.coalesce(p, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def divide_rows(df: DataFrame, n: int, order: Order, *kept: str) -> DataFrame:
    """(chunk, rows): n rows in order to a chunk."""
    at, index = placed(df, order)
    row = F.struct(F.col(index), *(kept or df.columns))
    return at.groupBy(F.floor(F.col(index) / max(n, 1)).alias("chunk")).agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: F.struct(*[r[c].alias(c) for c in (kept or df.columns)])).alias("rows"))


def split_at(df: DataFrame, n: int, order: Order) -> tuple[DataFrame, DataFrame]:
    at, index = placed(df, order)
    return at.filter(F.col(index) < n).drop(index), at.filter(F.col(index) >= n).drop(index)


def concat_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """`++`: all rows of both; fields that one lacks are null."""
    return a.unionByName(b, allowMissingColumns=True)


def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return concat_rows(a, b).distinct()


def same(a: DataFrame, b: DataFrame, on: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in on:
        out = out & a[c].eqNullSafe(b[c])
    return out


def remove_rows(a: DataFrame, b: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """`--`: rows of a without an equal in b; repeats stay, null equals null."""
    return a.join(b, same(a, b, on or a.columns), "left_anti")


def common_rows(a: DataFrame, b: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    return a.join(b, same(a, b, on or a.columns), "left_semi")


def zip_rows(a: DataFrame, b: DataFrame, order_a: Order, order_b: Order) -> DataFrame:
    """(index, l, r) of the rows at equal positions, as many as the shorter has."""
    x, i = placed(a, order_a)
    y, j = placed(b, order_b)
    return x.select(F.col(i).alias("index"), F.struct(*a.columns).alias("l")).join(y.select(F.col(j).alias("index"), F.struct(*b.columns).alias("r")), "index")


def packed(df: DataFrame, side: str, key: Callable[[DataFrame], Column]) -> DataFrame:
    return df.select(F.struct(*df.columns).alias(side), key(df).alias(f"_{side}"))


def join_rows(a: DataFrame, b: DataFrame, left_key: Callable[[DataFrame], Column], right_key: Callable[[DataFrame], Column], how: str = "inner") -> DataFrame:
    """{l, r} of rows with equal keys, null equal to null; `left` and `full` keep rows without a partner.

    The join is by equality, so Spark shuffles or broadcasts by the sides' sizes and splits hot keys.
    """
    return packed(a, "l", left_key).join(packed(b, "r", right_key), F.col("_l").eqNullSafe(F.col("_r")), how).select("l", "r")


def semi_rows(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
    return a.join(b, on, "left_semi")


def anti_rows(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
    return a.join(b, on, "left_anti")


#: Rows of the smaller side that a range join packs in one array.
CHUNK = 256


def range_join(a: DataFrame, b: DataFrame, point: Column, low: Column, high: Column, width: float) -> DataFrame:
    """Rows of a and b where low <= point < high, over buckets of `width`: an equality join, not all pairs.

    Pairs can be far more than rows, so the join meets not b's rows but arrays of
    at most CHUNK of them, sorted by `low` within a bucket, and skips those that
    lie apart from the point. Rows of a are dealt out evenly first: how a's files
    are split says nothing of the pairs. Columns may have any names.
    """
    tag = uuid.uuid4().hex
    bucket, at, start, end, row, chunk, rows, first, last = (f"{n}_{tag}" for n in ("bucket", "at", "start", "end", "row", "chunk", "rows", "first", "last"))
    x = a.select("*", point.alias(at)).withColumn(bucket, F.floor(F.col(at) / width)).repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    y = b.select("*", low.alias(start), high.alias(end))
    y = y.select(F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias(bucket), start, end, F.struct("*").alias(row))
    # Only equal rows tie, so a retry numbers the others as before.
    y = y.sort(bucket, start, end, F.xxhash64(F.to_json(row))).withColumn(chunk, F.floor(F.monotonically_increasing_id() / CHUNK))
    y = y.groupBy(bucket, chunk).agg(F.min(start).alias(first), F.max(end).alias(last), F.collect_list(row).alias(rows))
    met = x.join(y, bucket).filter((F.col(at) >= F.col(first)) & (F.col(at) < F.col(last))).drop(bucket, chunk, first, last)
    return met.select("*", F.inline(rows)).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop(at, rows, start, end)
