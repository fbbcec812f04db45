"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parts of a URI, and the characters that each encoding keeps.
URI = r"^(?:([^:/?#]+):)?(?://(?:([^@/?#]*)@)?([^:/?#]*)(?::(\d+))?)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
KEPT_IN_URI = r"[A-Za-z0-9\-_.~!*'();:@&=+$,/?#\[\]]"
KEPT_IN_COMPONENT = r"[A-Za-z0-9\-_.~$&+:=@]"


def part(s: Column, i: int) -> Column:
    return F.nullif(F.regexp_extract(s, URI, i), F.lit(""))


def encoded(s: Column, kept: str) -> Column:
    percent = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    chars = F.filter(F.split(s, "", -1), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: F.when(c.rlike(kept), c).otherwise(percent(c))), "")


def encode_uri(s: Column) -> Column:
    return encoded(s, KEPT_IN_URI)


def encode_uri_component(s: Column) -> Column:
    return encoded(s, KEPT_IN_COMPONENT)


def decode_uri(s: Column) -> Column:
    """`+` stays."""
    return F.url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


decode_uri_component = decode_uri


def query_parameters(query: Column) -> Column:
    """map<string, array<string>>, names sorted."""
    pairs = F.transform(F.filter(F.split(F.coalesce(query, F.lit("")), "&", -1), lambda p: p != ""), lambda p: F.struct(F.url_decode(F.substring_index(p, "=", 1)).alias("k"), F.url_decode(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit(""))).alias("v")))
    names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["k"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"])))


def parse_uri(s: Column) -> Column:
    """Scheme, host, path and fragment are empty where missing; user, password and port are null."""
    user = part(s, 2)
    return F.when(s.isNotNull(), F.struct(
        F.regexp_extract(s, URI, 1).alias("scheme"), F.regexp_extract(s, URI, 3).alias("host"), decode_uri(F.regexp_extract(s, URI, 5)).alias("path"), decode_uri(F.regexp_extract(s, URI, 7)).alias("fragment"), query_parameters(part(s, 6)).alias("query"),
        F.substring_index(user, ":", 1).alias("user"), F.when(F.contains(user, F.lit(":")), F.regexp_replace(user, "^[^:]*:", "")).alias("password"), part(s, 4).cast("int").alias("port"),
    ))


def compose(p: Column) -> Column:
    """The inverse of parse_uri; query keys are sorted."""
    keys = F.array_sort(F.map_keys(p["query"]))
    form = lambda x: F.url_encode(x)
    query = F.array_join(F.flatten(F.transform(keys, lambda k: F.transform(p["query"][k], lambda v: F.concat(form(k), F.lit("="), form(v))))), "&")
    login = F.when(p["user"].isNotNull(), F.concat(p["user"], F.coalesce(F.concat(F.lit(":"), p["password"]), F.lit("")), F.lit("@"))).otherwise("")
    return F.concat(
        F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit("://"))).otherwise(""), login, F.coalesce(p["host"], F.lit("")), F.coalesce(F.concat(F.lit(":"), p["port"].cast("string")), F.lit("")),
        F.coalesce(p["path"], F.lit("")), F.when(F.length(query) > 0, F.concat(F.lit("?"), query)).otherwise(""), F.when(p["fragment"] != "", F.concat(F.lit("#"), p["fragment"])).otherwise(""),
    )
