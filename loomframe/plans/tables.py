"""Collection operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.operators import rows as R
from loomframe.plans.registry import plan


def cents(c):
    return F.round(c * 100).cast("long")


LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@plan("SELECT l_returnflag AS flag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def flagship_filter_group(t):
    kept = R.filter_rows(t("lineitem"), F.col("l_discount") > 0.05)
    return R.group_aggregate(kept, {"flag": F.col("l_returnflag")}, n=F.count("*"), qty=F.sum("l_quantity").cast("long"))


@plan("""SELECT l_returnflag, l_linestatus, count(*) AS count_order, CAST(sum(l_quantity) AS BIGINT) AS sum_qty,
sum(CAST(round(l_extendedprice * 100) AS BIGINT)) ::BIGINT AS sum_base_cents, sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT))::BIGINT AS sum_disc_cents,
round(avg(l_discount), 6) AS avg_disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(t):
    kept = R.filter_rows(t("lineitem"), F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return R.group_aggregate(
        kept, {"l_returnflag": F.col("l_returnflag"), "l_linestatus": F.col("l_linestatus")}, count_order=F.count("*"), sum_qty=F.sum("l_quantity").cast("long"),
        sum_base_cents=F.sum(cents(F.col("l_extendedprice"))), sum_disc_cents=F.sum(cents(F.col("l_extendedprice") * (1 - F.col("l_discount")))), avg_disc=F.round(F.avg("l_discount"), 6),
    )


@plan("SELECT o_orderkey AS id, upper(o_orderstatus) AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS price_cents FROM orders")
def map_project(t):
    return R.map_rows(t("orders"), id=F.col("o_orderkey"), status=F.upper("o_orderstatus"), price_cents=cents(F.col("o_totalprice")))


@plan("SELECT o_orderkey, o_custkey FROM orders WHERE (o_totalprice > 100000 AND o_orderstatus = 'O') OR NOT o_orderpriority LIKE '1%'")
def filter_and_or_not(t):
    p = ((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "O")) | ~F.col("o_orderpriority").startswith("1")
    return R.filter_rows(t("orders"), p, strict=True).select("o_orderkey", "o_custkey")


@plan("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM orders")
def map_with_index(t):
    return R.with_index(t("orders").select("o_orderkey"), "o_orderkey")


@plan("SELECT doc_id, word FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> ''")
def flat_map_words(t):
    return R.flat_map_rows(t("documents"), F.split("text", " ", -1), "word", "doc_id").filter("word <> ''")


@plan("SELECT CAST(o_custkey AS VARCHAR) AS key, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def group_by_rows(t):
    grouped = R.group_rows(t("orders"), F.col("o_custkey"), "o_orderkey", "o_orderkey")
    return grouped.select("key", F.size("rows").cast("long").alias("n"), F.array_join(F.transform("rows", lambda r: r["o_orderkey"].cast("string")), ",").alias("orders"))


@plan("SELECT event_type, user_id % 10 AS bucket, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1, 2")
def group_by_many_keys(t):
    return R.group_aggregate(t("events"), {"event_type": F.col("event_type"), "bucket": F.col("user_id") % 10}, n=F.count("*"), first_id=F.min("event_id"), last_id=F.max("event_id"))


@plan("SELECT CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem")
def reduce_sum(t):
    return R.fold(t("lineitem"), "sum", F.col("l_quantity"), "total").select(F.col("total").cast("long").alias("total"))


@plan("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def reduce_in_order(t):
    step = lambda acc, v: F.when(acc == "", v).otherwise(F.concat(acc, F.lit(">"), v))
    return R.reduce_rows(t("conversations"), ["conv_id"], "turn", F.col("role"), F.lit(""), step, "roles")


@plan("SELECT count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high, bool_and(l_quantity > 0) AS all_positive, bool_or(l_discount > 0.09) AS some_large FROM lineitem")
def reduce_folds(t):
    d = t("lineitem")
    kinds = {"n": ("count", F.lit(1)), "low": ("min", F.col("l_extendedprice")), "high": ("max", F.col("l_extendedprice")), "all_positive": ("and", F.col("l_quantity") > 0), "some_large": ("or", F.col("l_discount") > 0.09)}
    return d.agg(*[R.FOLDS[k](c).alias(n) for n, (k, c) in kinds.items()])


@plan("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def distinct_by_first(t):
    return R.distinct_by(t("orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@plan("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct_rows(t):
    return R.distinct_rows(t("customer").select("c_mktsegment", "c_nationkey"))


@plan("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def max_by_row(t):
    return R.max_by(t("orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice"), "o_orderkey")


@plan("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) = 1")
def min_by_group(t):
    return R.min_by(t("part").select("p_brand", "p_partkey", "p_retailprice"), F.col("p_retailprice"), "p_partkey", ["p_brand"])


@plan("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def order_by_take(t):
    return R.take_rows(t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), 100, F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"))


@plan("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def order_by_descending(t):
    return R.order_rows(t("supplier").select("s_suppkey", "s_acctbal"), F.desc("s_acctbal"), F.col("s_suppkey"))


@plan("SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100")
def drop_rows(t):
    return R.drop_rows(t("customer").select("c_custkey"), 100, "c_custkey")


@plan("SELECT event_id, ts FROM events ORDER BY event_id LIMIT 200 OFFSET 50")
def slice_rows(t):
    return R.slice_rows(t("events").select("event_id", "ts"), 50, 250, "event_id")


@plan("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM orders WHERE o_totalprice > 400000)")
def take_while_rows(t):
    return R.take_while(t("orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice") <= 400000, "o_orderkey")


@plan("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= (SELECT min(o_orderkey) FROM orders WHERE o_totalprice > 300000)")
def drop_while_rows(t):
    return R.drop_while(t("orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice") <= 300000, "o_orderkey")


@plan("SELECT bool_or(l_tax > 0.07) AS some, bool_and(l_tax >= 0) AS every FROM lineitem")
def some_every(t):
    d = t("lineitem")
    return R.some_rows(d, F.col("l_tax") > 0.07).select(F.col("value").alias("some")).join(R.every_row(d, F.col("l_tax") >= 0).select(F.col("value").alias("every")))


@plan("SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 ORDER BY o_orderkey LIMIT 1")
def first_with(t):
    return R.first_with(t("orders"), F.col("o_totalprice") > 300000, F.col("o_orderkey")).select("o_orderkey")


@plan("SELECT count(*) AS index FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM orders WHERE o_totalprice > 300000)")
def index_where(t):
    return R.index_where(t("orders"), F.col("o_totalprice") > 300000, "o_orderkey")


@plan("SELECT (SELECT count(*) FROM events WHERE event_type = 'click') AS clicks, (SELECT CAST(sum(l_linenumber) AS BIGINT) FROM lineitem) AS lines")
def count_by_sum_by(t):
    clicks = R.count_by(t("events"), F.col("event_type") == "click").select(F.col("value").alias("clicks"))
    return clicks.join(R.sum_by(t("lineitem"), F.col("l_linenumber")).select(F.col("value").alias("lines")))


@plan("SELECT s_suppkey, s_acctbal >= 0 AS success FROM supplier")
def partition_rows(t):
    ok, other = R.partition_rows(t("supplier"), F.col("s_acctbal") >= 0)
    return ok.select("s_suppkey", F.lit(True).alias("success")).union(other.select("s_suppkey", F.lit(False).alias("success")))


@plan("SELECT (row_number() OVER (ORDER BY c_custkey) - 1) // 7 AS chunk, c_custkey FROM customer")
def divide_by_chunks(t):
    chunks = R.divide_rows(t("customer").select("c_custkey"), 7, "c_custkey")
    return chunks.select("chunk", F.inline("rows"))


@plan("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) <= 30 AS is_left FROM part")
def split_at_rows(t):
    left, right = R.split_at(t("part").select("p_partkey"), 30, "p_partkey")
    return left.withColumn("is_left", F.lit(True)).union(right.withColumn("is_left", F.lit(False)))


@plan("SELECT s_name AS name, s_nationkey AS nation FROM supplier UNION ALL SELECT c_name, c_nationkey FROM customer")
def concat_rows(t):
    return R.concat_rows(R.map_rows(t("supplier"), name=F.col("s_name"), nation=F.col("s_nationkey")), R.map_rows(t("customer"), name=F.col("c_name"), nation=F.col("c_nationkey")))


@plan("SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer")
def union_distinct(t):
    return R.union_rows(R.map_rows(t("supplier"), nation=F.col("s_nationkey")), R.map_rows(t("customer"), nation=F.col("c_nationkey")))


@plan("SELECT c_nationkey AS nation FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")
def remove_rows(t):
    return R.remove_rows(R.map_rows(t("customer"), nation=F.col("c_nationkey")), R.map_rows(t("supplier").filter("s_acctbal > 0"), nation=F.col("s_nationkey")))


@plan("SELECT c_custkey, c_nationkey AS nation FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def common_rows(t):
    return R.common_rows(R.map_rows(t("customer"), c_custkey=F.col("c_custkey"), nation=F.col("c_nationkey")), R.map_rows(t("supplier").filter("s_acctbal < 0"), nation=F.col("s_nationkey")), ["nation"])


@plan("WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier), b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey DESC) AS i FROM customer) SELECT i - 1 AS index, s_suppkey, c_custkey FROM a JOIN b USING (i)")
def zip_rows(t):
    back = t("customer").select((-F.col("c_custkey")).alias("minus"), "c_custkey")
    return R.zip_rows(t("supplier").select("s_suppkey"), back, "s_suppkey", "minus").select("index", "l.s_suppkey", "r.c_custkey")


@plan("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t):
    return R.join_rows(t("orders"), t("customer"), lambda d: d["o_custkey"], lambda d: d["c_custkey"]).select("l.o_orderkey", "r.c_name", "r.c_mktsegment")


@plan("SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left(t):
    return R.join_rows(t("documents").select("doc_id"), t("labels"), lambda d: d["doc_id"], lambda d: d["doc_id"], "left").select("l.doc_id", "r.quality", "r.toxic")


@plan("SELECT s_suppkey, n_name FROM (SELECT *, s_nationkey + 9 AS k FROM supplier) FULL JOIN nation ON k = n_nationkey")
def join_outer(t):
    return R.join_rows(t("supplier"), t("nation"), lambda d: d["s_nationkey"] + 9, lambda d: d["n_nationkey"], "full").select("l.s_suppkey", "r.n_name")


@plan("SELECT a.s_suppkey AS a, b.c_custkey AS b FROM (SELECT *, nullif(s_suppkey, 3) AS k FROM supplier) a JOIN (SELECT *, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS k FROM customer) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_keys(t):
    """One null on the left meets a fifth of the right, which is one hot key."""
    left, right = lambda d: F.nullif(d["s_suppkey"], F.lit(3)), lambda d: F.when(d["c_custkey"] % 5 != 0, d["c_custkey"])
    return R.join_rows(t("supplier"), t("customer"), left, right).select(F.col("l.s_suppkey").alias("a"), F.col("r.c_custkey").alias("b"))


@plan("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def filter_some_semi(t):
    rich = t("orders").filter("o_totalprice > 200000")
    return R.semi_rows(t("customer"), rich, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@plan("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def filter_none_anti(t):
    return R.anti_rows(t("customer"), t("orders"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@plan("SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON o_totalprice / 100 >= s_acctbal AND o_totalprice / 100 < s_acctbal + 25")
def theta_range_join(t):
    return R.range_join(t("orders").select("o_orderkey", "o_totalprice"), t("supplier").select("s_suppkey", "s_acctbal"), F.col("o_totalprice") / 100, F.col("s_acctbal"), F.col("s_acctbal") + 25, 25.0).select("o_orderkey", "s_suppkey")


@plan("SELECT r_name, n_name FROM region, nation")
def cross_flat_map(t):
    return t("region").crossJoin(t("nation")).select("r_name", "n_name")


@plan("""SELECT n_name, count(*) AS orders, sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT))::BIGINT AS revenue_cents
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def local_supplier_volume(t):
    d = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    d = d.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return R.group_aggregate(d, {"n_name": F.col("n_name")}, orders=F.count("*"), revenue_cents=F.sum(cents(F.col("l_extendedprice") * (1 - F.col("l_discount")))))


@plan("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(t):
    from loomframe.streaming import windows

    return windows.tumbling(t("events"), "ts", "1 hour", ["event_type"], n=F.count("*")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@plan("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS window_start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(t):
    from loomframe.streaming import windows

    return windows.sessions(t("events"), "ts", "30 minutes", ["user_id"], n=F.count("*")).select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@plan("SELECT c_mktsegment, c_custkey, c_name FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name DESC, c_custkey) = 1")
def max_by_text(t):
    return R.max_by(t("customer").select("c_mktsegment", "c_custkey", "c_name"), F.col("c_name"), "c_custkey", ["c_mktsegment"])


@plan("SELECT o_custkey, o_orderkey, o_totalprice > 200000 AS big FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice > 200000 DESC, o_orderkey) = 1")
def max_by_boolean(t):
    d = t("orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") > 200000).alias("big"))
    return R.max_by(d, F.col("big"), "o_orderkey", ["o_custkey"])


@plan("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place, ts AS _at, user_id AS _part FROM events")
def map_with_index_of_any_names(t):
    d = t("events").select("event_id", F.col("ts").alias("_at"), F.col("user_id").alias("_part"))
    return R.with_index(d, "event_id", "place")


@plan("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC")
def reverse_rows(t):
    return R.reversed_rows(t("customer").select("c_custkey", "c_name"), "c_custkey")
