"""URL filters: host-suffix and path-prefix expressions, joined on short hashes.

Each URL becomes the few (host suffix, path prefix) expressions that some rule
could have: as many host labels and path characters as the rules use. Each
different host and path is expanded once, without the rows' other columns. The
expressions meet the rules in an equi-join on the first characters of their
SHA-256; the full digest then confirms, and the longest confirmed rule decides.
Only DataFrame functions run.

Defined results: a null URL, or one without `://`, has an empty host and path
and no rule; repeated rows are judged one by one; an empty table gives an empty
result; other columns are kept, whatever their names, unless they clash with an
output column, which then wins. Rules of equal length: the longer host, then
`block`, wins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) tuples as a literal relation, whose size Spark knows."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def split_url(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, URL, 1), UPPER, LOWER), F.regexp_extract(text, URL, 2)


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", short: int = 8) -> DataFrame:
    """`pages` with host, path, rule and verdict. `short`: hex digits of the joined hash prefix.

    The rules' own label counts and path lengths are read first (a few integers).
    Spark broadcasts the rules where their size is under its threshold and
    shuffles both sides on the hash prefix otherwise.
    """
    shape = rules.select(F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("chars")).distinct().collect()
    labels, chars = sorted({r.labels for r in shape}), sorted({r.chars for r in shape})
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.struct(*own).alias("row"), host.alias("host"), path.alias("path"))
    if not shape:
        return rows.select("row.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hosts = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in labels]))
    starts = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in chars]
    paths = F.array_distinct(F.filter(F.array(*starts), lambda p: p.isNotNull()))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    tried = rows.select("host", "path").distinct().select("host", "path", F.explode(pairs).alias("e")).withColumn("full", digest(F.col("e.h"), F.col("e.p")))
    keyed = rules.withColumn("rule_full", digest(F.col("rule_host"), F.col("rule_path")))
    short_of = lambda full: F.substring(full, 1, short)
    met = tried.join(keyed, short_of("full") == short_of("rule_full")).filter(F.col("full") == F.col("rule_full"))
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("chars"),
        F.length("rule_host").alias("host_chars"),
        (F.col("verdict") == "block").alias("blocks"),
        F.concat("rule_host", "rule_path").alias("rule"),
        "verdict",
    )
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best"))
    told = rows.join(best, ["host", "path"], "left")
    return told.select("row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
