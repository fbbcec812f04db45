"""Edge cases of scalar, array and object functions."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomframe.functions import arrays as A
from loomframe.functions import control as C
from loomframe.functions import dates as D
from loomframe.functions import numbers as N
from loomframe.functions import objects as O
from loomframe.functions import strings as S
from loomframe.functions import urls as U

def null():
    return F.lit(None).cast("string")


def L(*xs, kind="int"):
    return F.array(*[F.lit(x) for x in xs]).cast(f"array<{kind}>")


CASES = [
    (lambda: S.trim(F.lit("  a b \n")), "a b"), (lambda: S.length(null()), 0), (lambda: S.length(F.lit("日本")), 2), (lambda: S.split(F.lit("a.b..c."), "."), ["a", "b", "", "c", ""]), (lambda: S.split(F.lit("añ"), ""), ["a", "ñ"]),
    (lambda: S.substring(F.lit("héllo"), 1, 3), "él"), (lambda: S.char_code_at(F.lit("€"), 0), 8364), (lambda: S.from_char_code(F.lit(128512)), "😀"), (lambda: S.last_index_of(F.lit("abcabc"), "bc"), 4), (lambda: S.last_index_of(F.lit("abc"), "x"), -1),
    (lambda: S.left_pad(F.lit("abcdef"), 3, "x"), "abcdef"), (lambda: S.starts_with(null(), "a"), False), (lambda: S.find(F.lit("aaaa"), "aa"), [0, 1, 2]), (lambda: S.find_regex(F.lit("concat cat"), r"\bcat")["start"][0], 7),
    (lambda: S.match(F.lit("ab12"), r"([a-z]+)(\d+)"), ["ab12", "ab", "12"]), (lambda: S.match(F.lit("xab12!"), r"([a-z]+)(\d+)"), []), (lambda: S.scan(F.lit("a1b2"), r"([a-z])(\d)"), [["a1", "a", "1"], ["b2", "b", "2"]]),
    (lambda: S.is_blank(F.lit(" \t")), True), (lambda: S.to_text(F.lit(3.0)), "3"), (lambda: S.to_text(null()), "null"), (lambda: S.join(F.array(F.lit("a"), null()), "-"), "a-null"), (lambda: S.capitalize(F.lit("customerFirst  name")), "Customer First Name"), (lambda: S.dasherize(F.lit("parseHTMLDoc")), "parse-html-doc"), (lambda: S.underscore(F.lit("aB2C")), "a_b2c"), (lambda: S.singularize(F.lit("glass")), "glass"), (lambda: S.singularize(F.lit("wives")), "wife"),
    (lambda: N.to_radix(F.lit(-255), 16), "-FF"), (lambda: N.from_radix(F.lit("-ff"), 16), -255), (lambda: N.round(F.lit(-2.5)), -3), (lambda: N.mod(F.lit(-7), F.lit(3)), -1), (lambda: N.range_of(F.lit(0)), []), (lambda: N.to_range(F.lit(3), F.lit(1)), [3, 2, 1]), (lambda: N.ceil(F.lit(None).cast("double")), 0),
    (lambda: D.date(F.lit(2023), F.lit(2), F.lit(30)), "2023-03-02"), (lambda: D.at_beginning_of_week(F.lit("2024-02-29T10:11:12-03:00")), "2024-02-25T00:00:00-03:00"), (lambda: D.days_between(F.lit("2024-03-01T12:00:00Z"), F.lit("2024-02-28T00:00:00Z")), 3), (lambda: D.day_of_week(F.lit("2024-03-03T00:00:00Z")), 7), (lambda: D.is_leap_year(F.lit(1900)), False),
    (lambda: U.parse_uri(F.lit("https://u:p@h.com:81/a/b?x=1&x=2&y=%20#f"))["query"]["x"], ["1", "2"]), (lambda: U.parse_uri(F.lit("https://u:p@h.com:81/a/b?x=1#f"))["password"], "p"), (lambda: U.parse_uri(F.lit("mailto:a"))["port"], None), (lambda: U.parse_uri(F.lit("/a%20b"))["scheme"], ""), (lambda: U.parse_uri(F.lit("/a%20b"))["path"], "/a b"), (lambda: U.compose(U.parse_uri(F.lit("https://u:p@h.com:81/a?x=1#f"))), "https://u:p@h.com:81/a?x=1#f"),
    (lambda: U.encode_uri(F.lit("a b/é?x=1")), "a%20b/%C3%A9?x=1"), (lambda: U.encode_uri_component(F.lit("a b/é&")), "a%20b%2F%C3%A9&"), (lambda: U.decode_uri(F.lit("a+b%20c")), "a+b c"),
    (lambda: A.slice(L(1, 2, 3, 4), -3, -1), [2, 3]), (lambda: A.slice(L(1, 2), 5, 9), []), (lambda: A.range_index(L(1, 2, 3, 4), 1, 2), [2, 3]), (lambda: A.range_index(L(1, 2, 3, 4), -1, 1), [4, 3, 2]), (lambda: A.range_index(L(1, 2), 0, 5), None),
    (lambda: A.reduce(L(1, 2, 3), lambda x, acc: x - acc), 2), (lambda: A.reduce(L(), lambda x, acc: x + acc), None), (lambda: A.some(F.lit(None).cast("array<int>"), lambda x: x > 0), False), (lambda: A.every(L(), lambda x: x > 0), True), (lambda: A.every(F.lit(None).cast("array<int>"), lambda x: x > 0), True),
    (lambda: A.filter_selector(L(1), lambda x: x > 5), None), (lambda: A.flatten(F.array(L(1, 2), F.lit(None).cast("array<int>"), L(3))), [1, 2, None, 3]), (lambda: A.remove(L(1, 2, 2, 3, None), L(2, None)), [1, 3]), (lambda: A.zip(L(1, 2, 3), L(4)).getField("r"), [4]), (lambda: A.last_index_of(L(1, 2, 1), F.lit(1)), 2),
    (lambda: A.find(L(1, 2, 1), F.lit(1)), [0, 2]), (lambda: A.index_where(L(1, 5), lambda x: x > 9), -1), (lambda: A.take(L(1, 2), -1), []), (lambda: A.drop(L(1, 2), 5), []), (lambda: A.drop_while(L(1, 5, 1), lambda x: x < 3), [5, 1]), (lambda: A.take_while(L(1, 5, 1), lambda x: x < 3), [1]), (lambda: A.divide_by(L(1, 2, 3), 2), [[1, 2], [3]]), (lambda: A.divide_by(L(), 2), []),
    (lambda: A.max_by(L(3, 1, 3), lambda x: x % 2), 3), (lambda: A.min_by(L(), lambda x: x), None), (lambda: A.order_by(L(1, 2, 3), lambda x: x % 2, descending=True), [1, 3, 2]), (lambda: A.distinct_by(L(1, 3, 2, 4), lambda x: x % 2), [1, 2]), (lambda: A.sum(L()), 0.0), (lambda: A.max(L(None, -5)), 0), (lambda: A.max(L()), None), (lambda: A.item(L(1, 2), -1), 2), (lambda: A.safe(L(1), 7), None),
    (lambda: A.group_by(L(1, 2, 3), lambda x: x % 2), {"1": [1, 3], "0": [2]}), (lambda: A.unzip(A.zip(L(1, 2), L(3, 4)))["r"], [3, 4]), (lambda: A.split_where(L(1, 5, 6), lambda x: x > 4)["r"], [5, 6]), (lambda: A.split_at(L(1, 2, 3), 1)["l"], [1]), (lambda: A.partition(L(1, None, 3), lambda x: x > 2)["failure"], [1, None]),
    (lambda: O.keys(O.merge(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("c"), F.lit(3), F.lit("a"), F.lit(9)))), ["a", "b", "c"]), (lambda: O.merge(F.create_map(F.lit("a"), F.lit(1)), F.lit(None).cast("map<string,int>")), {"a": 1}), (lambda: O.map_object(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), lambda v, k: (F.lit("x"), v)), {"x": 2}),
    (lambda: O.has(F.create_map(F.lit("a"), null()), "a"), True), (lambda: O.has(F.lit(None).cast("map<string,int>"), "a"), False), (lambda: O.safe(F.create_map(F.lit("a"), F.lit(1)), "z"), None), (lambda: O.filter_object(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), lambda v, k: v > 1), {"b": 2}),
    (lambda: C.as_boolean(F.lit("true")), True), (lambda: C.as_number(null()), 0.0), (lambda: C.equal_coerced(F.lit(1), F.lit("1.0")), True), (lambda: C.equal_coerced(F.lit("a"), null()), False), (lambda: C.type_of(L(1)), "Array"), (lambda: C.type_of(F.struct(F.lit(1))), "Object"), (lambda: C.type_of(F.lit(None)), "Null"), (lambda: C.both(F.lit(False), F.lit(None).cast("boolean")), False), (lambda: C.either(F.lit(True), F.lit(None).cast("boolean")), True),
    (lambda: C.as_union(F.lit("x1"), "bigint", "string"), "x1"), (lambda: C.must(F.lit(" "), C.be_blank), True), (lambda: C.must(null(), C.be_null), True), (lambda: C.must(F.lit("a"), C.any_of(C.be_type("Number"), C.equal_to("a"))), True), (lambda: C.or_else(C.attempt(F.lit("x").try_cast("int")), F.lit(7)), 7),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(spark, i):
    make, want = CASES[i]
    assert spark.range(1).select(make().alias("x")).first().x == want


ERRORS = [
    lambda: S.substring(F.lit("abc"), 1, 9), lambda: S.char_at(F.lit("abc"), 3), lambda: S.repeat(F.lit("a"), -1), lambda: N.sqrt(F.lit(-1.0)), lambda: N.mod(F.lit(1), F.lit(0)), lambda: N.from_radix(F.lit("zz"), 16), lambda: N.int_pow(F.lit(10), F.lit(30)), lambda: A.avg(L()), lambda: A.sum(L(1, None)),
    lambda: A.item(L(1), 5), lambda: O.required(F.create_map(F.lit("a"), F.lit(1)), "b"), lambda: C.as_boolean(F.lit("yes")), lambda: C.if_else(F.lit(None).cast("boolean"), F.lit(1)), lambda: C.match_case(F.lit(1), [(C.literal_case(2), lambda v: v)]), lambda: C.assert_that(F.lit(1), C.be_greater_than(5)), lambda: C.fail("x"), lambda: C.both(F.lit(True), F.lit(None).cast("boolean")),
]


@pytest.mark.parametrize("i", range(len(ERRORS)))
def test_error(spark, i):
    with pytest.raises((PySparkException, Py4JJavaError)):
        spark.range(1).select(ERRORS[i]().cast("string").alias("x")).collect()


def test_unknown_algorithm():
    with pytest.raises(ValueError):
        S.hashed(F.lit("a"), "crc")


def test_deep_update_metadata(spark):
    d = spark.createDataFrame([((1, [("a", [(7,), (8,)])]),)], "o struct<x:int, rows:array<struct<n:string, sub:array<struct<x:int>>>>>")
    assert d.select(O.deep(d, "o", "x").alias("v")).first().v == ["1", "7", "8"]
    assert d.select(O.deep(d, "o", "zz").alias("v")).first().v is None
    assert d.select(O.metadata(d, "o", "class").alias("v")).first().v == "Object"


def test_runtime(spark, monkeypatch):
    from loomframe.functions import runtime

    monkeypatch.setenv("LOOM_X", "1")
    row = spark.range(1).select(runtime.env_var("LOOM_X").alias("a"), runtime.env_vars("LOOM_X", "LOOM_NOT_SET")["LOOM_X"].alias("b"), runtime.compatibility_flag("strictTypeChecking").alias("c"), runtime.compatibility_flag("x").alias("d")).first()
    assert tuple(row) == ("1", "1", False, None)
    df, seen = runtime.logged(spark.range(5), n=F.count("*"))
    df.collect()
    assert seen.get == {"n": 5}


def test_maps_compute_their_inputs_once(spark):
    """A key made anew wherever it is named finds its value only if it is made once."""
    made = F.create_map(F.uuid(), F.lit(1), F.uuid(), F.lit(2))
    d = spark.range(3).select(O.values(O.merge(made, F.create_map(F.lit("k"), F.lit(3)), F.lit(None).cast("map<string,int>"))).alias("m"), O.values(O.array_to_object(O.object_to_array(made))).alias("o"), O.values(O.map_object(made, lambda v, k: (k, v + 1))).alias("p"))
    assert [tuple(r) for r in d.collect()] == [([1, 2, 3], [1, 2], [2, 3])] * 3
    none = F.lit(None).cast("map<string,int>")
    assert spark.range(1).select(O.merge(none, none), O.array_to_object(O.object_to_array(none)), O.merge(none, F.create_map(F.lit("k"), F.lit(None).cast("int")))).first()[:] == (None, None, {"k": None})


def test_arrays_compute_their_inputs_once(spark):
    """Equal elements made anew wherever the array is named are only equal if it is made once."""
    made = lambda: F.array_repeat(F.uuid(), 4)
    d = spark.range(3).select(
        F.size(A.distinct_by(made(), lambda x: x)).alias("distinct"), F.size(F.array_distinct(F.flatten(A.divide_by(made(), 1)))).alias("chunks"),
        F.transform(F.map_values(A.group_by(made(), lambda x: x)), lambda v: F.size(v)).alias("groups"),
    )
    assert [tuple(r) for r in d.collect()] == [(1, 1, [4])] * 3


def test_orders_with_nulls(spark):
    a = L(3, None, 1, None, 3, kind="int")
    row = spark.range(1).select(
        A.order_by(a, lambda x: x).alias("up"), A.order_by(a, lambda x: x, descending=True).alias("down"), A.order_by(L(4, 1, 2, 3), lambda x: x % 2, descending=True).alias("ties"),
        A.distinct_by(a, lambda x: x).alias("first"), A.distinct_by(L(5, 2, 7, 4, 9), lambda x: x % 2).alias("parity"), A.distinct_by(L(), lambda x: x).alias("empty"), A.distinct_by(F.lit(None).cast("array<int>"), lambda x: x).alias("null"),
        A.remove(a, L(None, 1)).alias("removed"), A.group_by(a, lambda x: x).alias("groups"), A.divide_by(L(1, 2, 3), 2).alias("chunks"),
    ).first()
    assert row.asDict() == {
        "up": [None, None, 1, 3, 3], "down": [3, 3, 1, None, None], "ties": [1, 3, 4, 2], "first": [3, None, 1], "parity": [5, 2], "empty": [], "null": None,
        "removed": [3, 3], "groups": {"3": [3, 3], "null": [None, None], "1": [1]}, "chunks": [[1, 2], [3]],
    }
