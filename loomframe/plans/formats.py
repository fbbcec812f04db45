"""Codecs over columns: text in, typed values out, and back."""

from __future__ import annotations


from pyspark.sql import functions as F

from loomframe.plans.registry import plan
from loomframe.sources import documents as DOC
from loomframe.sources import files as FI
from loomframe.storage import new_path


@plan("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"event_id\":' || event_id || ',\"k\":' || json_extract_string(props, '$.k') || '}' AS value FROM events")
def json_read_write(t):
    d = t("events").select("event_id", FI.json_column(F.col("props"), "k bigint")["k"].alias("k"))
    return d.select("event_id", "k", F.to_json(F.struct("event_id", "k")).alias("value"))


@plan("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def csv_read_write(t):
    line = F.to_csv(F.struct("s_suppkey", "s_name", "s_nationkey"))
    return t("supplier").select(FI.csv_column(line, "s_suppkey bigint, s_name string, s_nationkey int").alias("r")).select("r.*")


@plan("SELECT c_custkey, c_name AS name, c_mktsegment AS seg FROM customer")
def xml_read_write(t):
    text = F.concat(F.lit('<c id="'), F.col("c_custkey").cast("string"), F.lit('"><name>'), "c_name", F.lit("</name><seg>"), "c_mktsegment", F.lit("</seg></c>"))
    x = FI.xml_column(text, "`@id` string, name string, seg string")
    return t("customer").select(x["@id"].cast("bigint").alias("c_custkey"), x["name"].alias("name"), x["seg"].alias("seg"))


@plan("SELECT n_nationkey, n_name AS name, n_regionkey || '|' || n_nationkey AS tags FROM nation")
def form_read_write(t):
    m = F.create_map(F.lit("name"), F.array(F.col("n_name")), F.lit("tags"), F.array(F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")))
    back = FI.form_column(FI.form_text(m))
    return t("nation").select("n_nationkey", back["name"][0].alias("name"), F.array_join(back["tags"], "|").alias("tags"))


FIELDS = [{"name": "id", "length": 8, "type": "int", "align": "right", "pad": "0"}, {"name": "name", "length": 34}, {"name": "rich", "length": 5, "type": "boolean"}]


@plan("SELECT c_custkey::DOUBLE AS id, 'é' || c_name || 'ü' AS name, c_acctbal > 5000 AS rich, lpad(CAST(c_custkey AS VARCHAR), 8, '0') || rpad('é' || c_name || 'ü', 32, ' ') || rpad(CAST(c_acctbal > 5000 AS VARCHAR), 5, ' ') AS line FROM customer")
def flat_file_read_write(t):
    rows = t("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("é"), "c_name", F.lit("ü")).alias("name"), (F.col("c_acctbal") > 5000).alias("rich"))
    return FI.flat_lines(rows, FIELDS).select(FI.flat_fields(F.col("value"), FIELDS).alias("r"), F.col("value").alias("line")).select("r.*", "line")


@plan("SELECT n_nationkey, 'java.lang.String' AS class, n_name AS value FROM nation")
def envelope_read_write(t):
    e = FI.envelope_column(FI.envelope_text("java.lang.String", F.col("n_name")), "string")
    return t("nation").select("n_nationkey", e["class"].alias("class"), e["value"].alias("value"))


@plan("SELECT n_nationkey, n_name AS name, n_regionkey AS region FROM nation")
def yaml_read_write(t):
    d = DOC.write_yaml(t("nation").withColumn("j", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))), "j")
    return DOC.read_yaml(d, "yaml").select("n_nationkey", F.from_json("json", "name string, region int").alias("r")).select("n_nationkey", "r.*")


@plan("SELECT n_nationkey, n_name AS name, n_name || ' of x' AS more FROM nation")
def properties_read(t):
    text = F.concat(F.lit("# made\nname = "), "n_name", F.lit("\n! other\nmore:"), "n_name", F.lit(" \\\n   of x\n"))
    d = DOC.read_properties(t("nation").withColumn("p", text), "p")
    return d.select("n_nationkey", F.col("properties")["name"].alias("name"), F.col("properties")["more"].alias("more"))


@plan("SELECT s_suppkey, 'name|file' AS names, s_name || '|' || s_nationkey AS contents, 'a.txt' AS filename FROM supplier")
def multipart_read_write(t):
    part = lambda n, f, c: F.struct(F.lit(n).alias("name"), F.lit(f).cast("string").alias("filename"), F.lit("text/plain" if f else None).cast("string").alias("contentType"), c.alias("content"))
    text = DOC.multipart_text(F.array(part("name", None, F.col("s_name")), part("file", "a.txt", F.col("s_nationkey").cast("string"))))
    d = DOC.read_multipart(t("supplier").withColumn("m", text), "m")
    return d.select("s_suppkey", F.array_join("parts.name", "|").alias("names"), F.array_join("parts.content", "|").alias("contents"), F.get("parts.filename", F.lit(1)).alias("filename"))


@plan("SELECT r_regionkey, r_name AS name, r_regionkey + 0.5 AS half, r_regionkey % 2 = 0 AS even FROM region")
def xlsx_read_write(t):
    row = F.struct(F.col("r_name").alias("name"), (F.col("r_regionkey") + F.lit(0.5).cast("double")).alias("half"), (F.col("r_regionkey") % 2 == 0).alias("even"))
    d = DOC.write_xlsx(t("region").withColumn("j", F.to_json(F.struct(F.array(row).alias("Sheet")))), "j")
    got = DOC.read_xlsx(d, "content").select("r_regionkey", F.from_json("json", "Sheet array<struct<name:string,half:double,even:boolean>>")["Sheet"][0].alias("s"))
    return got.select("r_regionkey", "s.*")


MESSAGE = [
    {"number": 1, "name": "id", "type": "int64"}, {"number": 2, "name": "name", "type": "string"}, {"number": 3, "name": "delta", "type": "sint32", "repeated": True}, {"number": 4, "name": "price", "type": "double"},
    {"number": 5, "name": "inner", "type": "message", "schema": [{"number": 1, "name": "ok", "type": "bool"}]}, {"number": 6, "name": "tags", "type": "map", "schema": [{"number": 1, "name": "key", "type": "string"}, {"number": 2, "name": "value", "type": "string"}]},
]


@plan("SELECT p_partkey AS id, p_name AS name, (-p_size) || ',' || p_size AS delta, p_retailprice AS price, p_size > 10 AS ok, p_brand AS brand FROM part")
def protobuf_read_write(t):
    value = F.struct(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array(-F.col("p_size"), F.col("p_size")).alias("delta"), F.col("p_retailprice").alias("price"),
        F.struct((F.col("p_size") > 10).alias("ok")).alias("inner"), F.create_map(F.lit("brand"), F.col("p_brand")).alias("tags"),
    )
    d = DOC.read_protobuf(DOC.write_protobuf(t("part").select(F.to_json(value).alias("j")), "j", MESSAGE), "content", MESSAGE)
    r = F.from_json("json", "id bigint, name string, delta array<int>, price double, inner struct<ok:boolean>, tags map<string,string>").alias("r")
    return d.select(r).select("r.id", "r.name", F.array_join(F.col("r.delta").cast("array<string>"), ",").alias("delta"), "r.price", F.col("r.inner.ok").alias("ok"), F.col("r.tags")["brand"].alias("brand"))




def folder(df, what):
    return new_path(df.sparkSession, what)


@plan("SELECT event_id, nullif(user_id, 5) AS user_id, event_type, props FROM events")
def ndjson_files(t):
    d = t("events").select("event_id", F.nullif("user_id", F.lit(5)).alias("user_id"), "event_type", "props")
    path = folder(d, "ndjson")
    FI.write_ndjson(d, path)
    return FI.read_ndjson(d.sparkSession, path, d.schema)


@plan("SELECT n_nationkey, n_name FROM nation")
def json_files(t):
    """A document with a list of objects, over many lines."""
    d = t("nation").select("n_nationkey", "n_name")
    path = folder(d, "json")
    rows = FI.json_rows(d).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("value"), ",\n"), F.lit("\n]")).alias("value"))
    FI.write_text(rows, "value", path)
    return FI.read_json(d.sparkSession, path, d.schema)


@plan("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', \"x\"' AS c_name, c_mktsegment FROM customer")
def csv_files(t):
    d = t("customer").select("c_custkey", F.concat("c_name", F.lit(', "x"')).alias("c_name"), "c_mktsegment")
    path = folder(d, "csv")
    FI.write_csv(d, path)
    return FI.read_csv(d.sparkSession, path)


@plan("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name || ' <&>' AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
def xml_files(t):
    d = t("supplier").select(F.col("s_suppkey").alias("@id"), F.concat("s_name", F.lit(" <&>")).alias("name"), F.col("s_nationkey").alias("nation"))
    path = folder(d, "xml")
    FI.write_xml(d, path, "suppliers", "supplier")
    return FI.read_xml(d.sparkSession, path, "supplier").select(F.col("@id").alias("id"), "name", "nation")


@plan("SELECT p_name || '|é' AS line, count(*) AS n FROM part GROUP BY 1")
def text_files(t):
    d = t("part").select(F.concat("p_name", F.lit("|é")).alias("line"))
    path = folder(d, "text")
    FI.write_text(d, "line", path)
    lines = FI.read_text(d.sparkSession, path).select(F.explode(F.split("value", "\n")).alias("line")).filter("line <> ''")
    return lines.groupBy("line").agg(F.count("*").alias("n"))


@plan("SELECT CAST(sum(octet_length(encode(p_name)) + 1) AS BIGINT) AS bytes, count(*) AS lines FROM part")
def binary_files(t):
    d = t("part").select("p_name")
    path = folder(d, "binary")
    FI.write_text(d, "p_name", path)
    data = FI.read_binary(d.sparkSession, f"{path}/part-*")
    ends = F.size(F.split(F.decode("content", "UTF-8"), "\n")) - 1
    return data.agg(F.sum(F.octet_length("content")).cast("long").alias("bytes"), F.sum(ends).cast("long").alias("lines"))


@plan("SELECT c_custkey::DOUBLE AS id, 'é' || c_name || 'ü' AS name, c_acctbal > 5000 AS rich FROM customer")
def flat_files(t):
    rows = t("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("é"), "c_name", F.lit("ü")).alias("name"), (F.col("c_acctbal") > 5000).alias("rich"))
    path = folder(rows, "flat")
    FI.write_text(FI.flat_lines(rows, FIELDS), "value", path)
    return FI.read_flat_file(rows.sparkSession, path, FIELDS)


@plan("SELECT * FROM orders")
def parquet_files(t):
    d = t("orders")
    path = folder(d, "parquet")
    d.write.parquet(path)
    return FI.read_parquet(d.sparkSession, path)
