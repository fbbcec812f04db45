"""Row operators, files and streams."""

import json
from email.headerregistry import HeaderRegistry
from email.policy import HTTP

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomframe.operators import rows as R
from loomframe.sources import documents as DOC
from loomframe.sources import files as FI
from loomframe.streaming import windows


def nums(spark, xs):
    return spark.createDataFrame(list(enumerate(xs)), "pos long, v int")


def test_strict_filter_and_prefixes(spark):
    d = nums(spark, [1, 2, None, 4])
    with pytest.raises((PySparkException, Py4JJavaError)):
        R.filter_rows(d, F.col("v") > 1, strict=True).collect()
    assert [r.v for r in R.take_while(d, F.col("v") < 4, "pos").orderBy("pos").collect()] == [1, 2]
    assert [r.v for r in R.drop_while(d, F.col("v") < 4, "pos").orderBy("pos").collect()] == [None, 4]
    assert R.drop_while(d, F.lit(True), "pos").count() == 0 and R.take_while(d, F.lit(True), "pos").count() == 4
    assert R.index_where(d, F.col("v") == 9, "pos").first()[0] == -1 and R.index_where(d, F.col("v") == 4, "pos").first()[0] == 3


def test_index_on_many_rows_and_ties(spark):
    d = spark.range(5000).select((F.col("id") % 7).alias("k"), (4999 - F.col("id")).alias("v"), F.lit("x").alias("extra"))
    got = sorted((r["index"], r.k, r.v) for r in R.with_index(d, ["k", "v"]).collect())
    assert [g[0] for g in got] == list(range(5000)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    ties = R.with_index(d.select("k"), "k").collect()
    assert sorted(r["index"] for r in ties) == list(range(5000))
    assert R.with_index(d.limit(0), "k").count() == 0


def test_keys_with_nulls(spark):
    d = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, "null")], "pos long, k string")
    assert sorted((r.pos, r.k) for r in R.distinct_by(d, ["k"], "pos").collect()) == [(1, None), (3, "a"), (5, "null")]
    grouped = {r.key: len(r.rows) for r in R.group_rows(d, F.col("k"), "pos").collect()}
    assert grouped == {"null": 3, "a": 2}
    joined = R.join_rows(d, d.limit(1), lambda x: x["k"], lambda x: x["k"], "left").collect()
    assert len(joined) == 5 and sum(r.r is not None for r in joined) == 2
    assert sorted(r.pos for r in R.remove_rows(d, d.filter("pos = 1"), ["k"]).collect()) == [3, 4, 5]
    assert R.max_by(d.limit(0), F.col("pos"), "pos").count() == 0


def test_range_join_packs_and_deals_out(spark, tmp_path):
    """Odd values, a bucket of more rows than an array holds, columns of any names, and one partition of points."""
    odd = [None, float("nan"), 0.0, -0.0, 24.999, 25.0, -1.0, 50.0]
    points = [*enumerate(odd + [i * 0.7 for i in range(300)])]
    spark.createDataFrame(points, "id long, `_bucket` double").coalesce(1).write.parquet(str(tmp_path / "a"))
    ranges = [(k, lo, hi, {"k": k}) for k, (lo, hi) in enumerate([(0.0, 25.0), (None, 1.0), (1.0, None), (30.0, 10.0), (5.0, 5.0), (-10.0, 130.0), (24.999, 25.0)] + [(30.0, 31.0)] * 700 + [(31.0 + i / 900, 33.0) for i in range(600)])]
    ranges += ranges[-5:]
    spark.createDataFrame(ranges, "`k.y` long, low double, high double, m map<string,long>").write.parquet(str(tmp_path / "b"))
    a, b = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b"))
    got = R.range_join(a, b, a["_bucket"], b["low"], b["high"], 25.0)
    assert got.columns == ["id", "_bucket", "k.y", "low", "high", "m"]
    seen = got.collect()
    want = [(i, k) for i, p in points for k, lo, hi, _ in ranges if None not in (p, lo, hi) and lo <= p < hi]
    assert sorted((r["id"], r["k.y"]) for r in seen) == sorted(want) and all(r["m"] == {"k": r["k.y"]} for r in seen)
    spark.range(50000).coalesce(1).write.parquet(str(tmp_path / "c"))
    c = spark.read.parquet(str(tmp_path / "c"))
    assert R.range_join(c, b, c["id"], b["low"], b["high"], 25.0).select(F.spark_partition_id()).distinct().count() > 1
    assert R.range_join(a, b.limit(0), a["_bucket"], b["low"], b["high"], 25.0).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,age\nAlice,30\nBob,007\n")
    assert [tuple(r) for r in FI.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("Alice", "30"), ("Bob", "007")]
    (tmp_path / "b.csv").write_text("name,age\nAlice,30,1\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        FI.read_csv(spark, str(tmp_path / "b.csv")).collect()
    (tmp_path / "c.csv").write_text("name,\nAlice,30\n")
    with pytest.raises(ValueError):
        FI.read_csv(spark, str(tmp_path / "c.csv"))
    (tmp_path / "a.json").write_text('[{"v": 9007199254740993}, {"v": null}]')
    assert [r.v for r in FI.read_json(spark, str(tmp_path / "a.json")).collect()] == [9007199254740993, None]
    (tmp_path / "bad.ndjson").write_text('{"v": 1}\n{"v": \n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        FI.read_ndjson(spark, str(tmp_path / "bad.ndjson"), "v long").collect()
    (tmp_path / "a.xml").write_text('<r><u id="07"><n>A</n></u><u id="8"><n>B</n></u></r>')
    assert [(r["@id"], r.n) for r in FI.read_xml(spark, str(tmp_path / "a.xml"), "u").collect()] == [("07", "A"), ("8", "B")]
    (tmp_path / "a.txt").write_text("x\ny")
    assert FI.read_text(spark, str(tmp_path / "a.txt")).first().value == "x\ny" and bytes(FI.read_binary(spark, str(tmp_path / "a.txt")).first().content) == b"x\ny"
    d = spark.createDataFrame([("a", [1, 2], None)], "s string, a array<int>, n int")
    FI.write_csv(d, str(tmp_path / "out.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out.csv")).first().a == "[1,2]"
    assert FI.json_rows(d).first().value == '{"s":"a","a":[1,2],"n":null}'
    FI.write_ndjson(d, str(tmp_path / "out.ndjson"))
    assert FI.read_ndjson(spark, str(tmp_path / "out.ndjson")).first().a == [1, 2]
    FI.write_xml(d.select("s"), str(tmp_path / "out.xml"), "r", "x")
    assert FI.read_xml(spark, str(tmp_path / "out.xml"), "x").first().s == "a"
    (tmp_path / "f.txt").write_text("0007Bob ")
    fields = [{"name": "id", "length": 4, "type": "int", "align": "right", "pad": "0"}, {"name": "n", "length": 4}]
    assert tuple(FI.read_flat_file(spark, str(tmp_path / "f.txt"), fields).first()) == (7.0, "Bob")


def test_document_formats(spark):
    assert json.loads(DOC.yaml_json("a: &x {b: 1}\nc: {<<: *x, d: [1, two]}")) == {"a": {"b": 1}, "c": {"b": 1, "d": [1, "two"]}}
    with pytest.raises(ValueError):
        DOC.yaml_json("a: 1\na: 2")
    assert DOC.properties("a=1\n!c\n b : x\\\n  y\nc\\=d = \\u0041\\t\n\n#e=1\nf") == {"a": "1", "b": "xy", "c=d": "A\t", "f": ""}
    rows = [{"n": "x<&>", "v": 1.5, "b": True, "z": None}, {"n": None, "v": 2, "b": False, "z": "q"}]
    assert DOC.xlsx(DOC.xlsx_bytes({"B": [], "A": rows})) == {"A": [{"n": "x<&>", "v": 1.5, "b": True, "z": None}, {"n": None, "v": 2.0, "b": False, "z": "q"}], "B": []}
    fields = [{"number": i + 1, "name": k, "type": k} for i, k in enumerate(sorted(DOC.VARINTS - {"bool", "enum"}) + sorted(DOC.FIXED))]
    value = {f["name"]: (-3 if f["type"][0] == "s" or f["type"].startswith("int") else 3) for f in fields}
    assert DOC.proto_decode(DOC.proto_encode(value, fields), fields) == value
    with pytest.raises(ValueError):
        DOC.proto_decode(DOC.proto_encode({"a": 1}, [{"number": 9, "name": "a", "type": "int32"}]), fields[:1], strict=True)
    d = spark.createDataFrame([(1, None), (2, "a: 1")], "id int, y string")
    assert [r.json for r in DOC.read_yaml(d, "y").orderBy("id").collect()] == [None, '{"a": 1}']
    with pytest.raises((PySparkException, Py4JJavaError)):
        spark.range(1).select(FI.envelope_column(F.lit('{"@class":"java.lang.Long","value":"a"}'), "string")).collect()


def test_multipart_headers(monkeypatch):
    """Plain headers do without the email package's grammar; every header reads as by it."""
    form = lambda *parts: "".join(f"--b\r\n{h}\r\n\r\n{c}\r\n" for h, c in parts) + "--b--\r\n"
    plain = form(('Content-Disposition: form-data; name="a"', "1"), ('content-disposition: form-data; name="f"; filename="a b.txt"\r\nContent-Type: text/csv; name="x"\r\nContent-Transfer-Encoding: base64', "w6k="))
    heads = ['form-data; name="é"', 'form-data; name="a  b"', 'form-data; name=""', 'form-data;name=a', "form-data; name=a (c)", 'form-data; name="a\\"b"', "form-data; filename*=utf-8''%C3%A9", 'form-data; name="=?utf-8?q?=C3=A9?="', 'form-data;\r\n name="a"', 'form-data; name="a"; name="b"', "form-data/x"]
    odd = [form((f"Content-Disposition: {h}\r\nContent-Type: {k}", "x")) for h in heads for k in ("text", "text/plain; name=n", "multipart/mixed")]
    with monkeypatch.context() as m:
        m.setattr(DOC, "FORM", HTTP)
        want = [DOC.multipart(d) for d in odd]
    assert [DOC.multipart(d) for d in odd] == want
    monkeypatch.setattr(HeaderRegistry, "__call__", lambda self, name, value: pytest.fail(f"parsed {name}"))
    assert DOC.multipart(plain) == [{"name": "a", "filename": None, "contentType": None, "content": "1"}, {"name": "f", "filename": "a b.txt", "contentType": "text/csv", "content": "é"}]


def test_stream_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{path}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    live = windows.stream(spark, str(tmp_path / "in"), events.schema)
    assert live.isStreaming
    picked = windows.lazy_filter(windows.lazy_map(live, ts=F.col("ts"), kind=F.col("event_type"), value=F.col("value")), F.col("value") > 0)
    windows.run_once(windows.tumbling(picked, "ts", "1 hour", ["kind"], delay="365 days", n=F.count("*")), str(tmp_path / "out"), str(tmp_path / "ck"), "append")
    windows.run_once(picked, str(tmp_path / "out2"), str(tmp_path / "ck2"))
    assert spark.read.parquet(str(tmp_path / "out2")).count() == events.filter("value > 0").count()
    batch = windows.tumbling(events, "ts", "1 hour", ["event_type"], slide="30 minutes", n=F.count("*"))
    assert batch.agg(F.sum("n")).first()[0] == 2 * events.count()
