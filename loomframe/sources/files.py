"""Formats that Spark reads and writes itself, and the column forms of the same (text in, text out)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions.strings import fail_if


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One document a file; a list of objects gives a row for each."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def json_rows(df: DataFrame, keep_nulls: bool = True) -> DataFrame:
    """(value): each row as compact JSON in the columns' order."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": str(not keep_nulls).lower()}).alias("value"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A header, all strings; ragged rows and blank names are errors. A row of too few fields is one where a schema is given."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)
    if any(not c.strip() or re.fullmatch(r"_c\d+", c) for c in df.columns):
        raise ValueError("csv: blank header name")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """Nested values as JSON text, null as empty."""
    nested = {f.name for f in df.schema if isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType)}
    df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns]).write.option("header", True).csv(path)


def read_xml(spark: SparkSession, path: str, row: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A row for each `row` element; attributes `@a`, text `#text`, all strings."""
    reader = spark.read.option("rowTag", row).option("attributePrefix", "@").option("valueTag", "#text").option("inferSchema", False).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).xml(path)


def write_xml(df: DataFrame, path: str, root: str, row: str) -> None:
    df.write.option("rootTag", root).option("rowTag", row).option("attributePrefix", "@").option("valueTag", "#text").xml(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(value): whole files. Script sources are read so too."""
    return spark.read.text(path, wholetext=True)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.text(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): files as they are; containers that are passed through undecoded (Avro, and others without a schema) are read so."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def json_column(s: Column, schema: str) -> Column:
    """Text as JSON; broken text is an error."""
    return F.from_json(s, schema, {"mode": "FAILFAST"})


def csv_column(s: Column, schema: str) -> Column:
    return F.from_csv(s, F.lit(schema), {"mode": "FAILFAST"})


def xml_column(s: Column, schema: str) -> Column:
    return F.from_xml(s, schema, {"attributePrefix": "@", "valueTag": "#text", "mode": "FAILFAST"})


def form_column(s: Column) -> Column:
    """URL-encoded form text as map<string, array<string>>, repeats gathered, names sorted."""
    from loomframe.functions.urls import query_parameters

    plus = F.replace(s, F.lit("+"), F.lit("%20"))
    return F.when(s.isNotNull(), query_parameters(plus))


def form_text(m: Column) -> Column:
    """The inverse."""
    pairs = F.flatten(F.transform(F.map_entries(m), lambda e: F.transform(e["value"], lambda v: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(v)))))
    return F.array_join(pairs, "&")


#: Words that a fixed-width Boolean takes as true.
TRUE_WORDS = ["true", "1", "y", "yes"]


def flat_fields(line: Column, fields: Sequence[Mapping]) -> Column:
    """A struct of a fixed-width line. Fields: name, length in bytes of UTF-8, and type (string, int, number, boolean), align, pad, trim."""
    total, at, out = sum(f["length"] for f in fields), 1, []
    data = F.encode(line, "UTF-8")
    for f in fields:
        raw, pad = F.decode(F.substring(data, at, f["length"]), "UTF-8"), re.escape(f.get("pad", " "))
        at += f["length"]
        if f.get("trim", True):
            raw = F.regexp_replace(raw, f"^({pad})+" if f.get("align") == "right" else f"({pad})+$", "")
        kind = f.get("type", "string")
        if kind in ("int", "number"):
            raw = F.when(F.trim(raw) == "", F.lit(0.0)).otherwise(F.trim(raw).cast("double"))
        elif kind == "boolean":
            raw = F.lower(F.trim(raw)).isin(*TRUE_WORDS)
        out.append(raw.alias(f["name"]))
    return fail_if(F.octet_length(line) != total, "flat file: wrong record length", F.struct(*out))


def read_flat_file(spark: SparkSession, path: str, fields: Sequence[Mapping]) -> DataFrame:
    return spark.read.text(path).select(flat_fields(F.col("value"), fields).alias("r")).select("r.*")


def flat_lines(df: DataFrame, fields: Sequence[Mapping]) -> DataFrame:
    """(value): lines padded to bytes, by a pad of one byte; a value that is too long is an error."""
    cells = []
    for f in fields:
        text = F.coalesce(F.regexp_replace(F.col(f["name"]).cast("string"), r"\.0$", "") if f.get("type") in ("int", "number") else F.col(f["name"]).cast("string"), F.lit(""))
        fill = F.repeat(F.lit(f.get("pad", " ")), F.lit(f["length"]) - F.octet_length(text))
        padded = F.concat(fill, text) if f.get("align") == "right" else F.concat(text, fill)
        cells.append(fail_if(F.octet_length(text) > f["length"], f"flat file: {f['name']} is too long", padded))
    return df.select(F.concat(*cells).alias("value"))


#: Object classes by the kind of value that they wrap.
CLASSES = {"string": ["java.lang.String"], "long": ["java.lang.Integer", "java.lang.Long", "java.lang.Short"], "double": ["java.lang.Double", "java.lang.Float"], "boolean": ["java.lang.Boolean"]}


def envelope_column(s: Column, schema: str) -> Column:
    """A `{"@class", "value"}` JSON envelope as struct(class, value); a class that contradicts the value's type is an error."""
    got = F.from_json(s, f"`@class` string, value {schema}", {"mode": "FAILFAST"})
    known = [c for kinds in CLASSES.values() for c in kinds]
    fits = CLASSES.get(schema.lower().replace("bigint", "long"), [])
    wrong = got["@class"].isin(*known) & ~got["@class"].isin(*fits) if fits else got["@class"].isin(*known)
    return fail_if(F.coalesce(wrong, F.lit(True)), "envelope: class and value differ", F.struct(got["@class"].alias("class"), got["value"].alias("value")))


def envelope_text(cls: str, value: Column) -> Column:
    return F.to_json(F.struct(F.lit(cls).alias("@class"), value.alias("value")))
