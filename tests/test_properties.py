"""Algebraic identities over generated arrays and texts, many examples in one job."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomframe.functions import arrays as A
from loomframe.functions import strings as S
from loomframe.functions import urls as U
from loomframe.sources import documents as DOC

FEW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
ROWS = st.lists(st.lists(st.integers(-9, 9), max_size=12), min_size=30, max_size=60)
TEXTS = st.lists(st.text(max_size=20).filter(lambda t: "\x00" not in t), min_size=30, max_size=60)


@FEW
@given(ROWS)
def test_array_identities(spark, rows):
    d = spark.createDataFrame([(r,) for r in rows], "a array<int>")
    a = F.col("a")
    laws = {
        "reverse": A.reverse(A.reverse(a)) == a, "take_drop": A.concat(A.take(a, 3), A.drop(a, 3)) == a, "distinct": A.unique(A.unique(a)) == A.unique(a), "sort": A.sort(A.reverse(a)) == A.sort(a), "prefix": A.concat(A.take_while(a, lambda x: x > 0), A.drop_while(a, lambda x: x > 0)) == a,
        "chunks": A.flat_map(A.divide_by(a, 4), lambda c: c) == a, "partition": F.size(A.partition(a, lambda x: x > 0)["success"]) + F.size(A.partition(a, lambda x: x > 0)["failure"]) == F.size(a), "sum": A.sum(a) == A.reduce(a, lambda x, acc: acc + x, F.lit(0.0)),
        "zip": F.size(A.zip(a, A.drop(a, 1))) == F.greatest(F.size(a) - 1, F.lit(0)), "split": A.concat(A.split_at(a, 2)["l"], A.split_at(a, 2)["r"]) == a, "slice": A.slice(a, 0, 100) == a,
    }
    row = d.agg(*[F.bool_and(law).alias(n) for n, law in laws.items()]).first().asDict()
    assert all(row.values()), row
    got = [r.x for r in d.select(A.order_by(a, lambda x: x % 3).alias("x")).collect()]
    assert got == [sorted(r, key=lambda x: x % 3 if x >= 0 else -(-x % 3)) for r in rows]


@FEW
@given(TEXTS)
def test_text_round_trips(spark, texts):
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    laws = {"base64": S.from_base64(S.to_base64(t)) == t, "hex": S.from_hex(S.to_hex(t)) == t, "uri": U.decode_uri_component(U.encode_uri_component(t)) == t, "split": F.array_join(S.split(t, "a"), "a") == t, "chars": F.array_join(S.split(t, ""), "") == t, "trim": S.trim(S.trim(t)) == S.trim(t)}
    row = d.agg(*[F.bool_and(law).alias(n) for n, law in laws.items()]).first().asDict()
    assert all(row.values()), row


@FEW
@given(st.dictionaries(st.text(st.characters(categories=["L", "N"]), min_size=1, max_size=6), st.one_of(st.integers(-1000, 1000), st.text(st.characters(categories=["L", "N", "P"]), max_size=8), st.booleans(), st.none()), max_size=5))
def test_yaml_round_trip(value):
    assert json.loads(DOC.yaml_json(DOC.yaml_text(json.dumps(value)))) == value
