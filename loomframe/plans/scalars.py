"""Scalar, array, object, date and URL functions over the test tables. Results are scalars, so that both engines print them alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import arrays as A
from loomframe.functions import control as C
from loomframe.functions import dates as D
from loomframe.functions import numbers as N
from loomframe.functions import objects as O
from loomframe.functions import strings as S
from loomframe.functions import runtime as X
from loomframe.functions import urls as U
from loomframe.plans.registry import plan


def text(a, mark=","):
    return F.array_join(a.cast("array<string>"), mark)


@plan("SELECT c_custkey, upper(c_name) AS up, lower(c_name) AS low, trim('  ' || c_name || ' ') AS trimmed, length(c_name) AS n, repeat(c_mktsegment, 2) AS twice, reverse(c_name) AS back FROM customer")
def strings_case(t):
    c = F.col("c_name")
    return t("customer").select("c_custkey", S.upper(c).alias("up"), S.lower(c).alias("low"), S.trim(F.concat(F.lit(" \t "), c, F.lit("\n"))).alias("trimmed"), S.length(c).alias("n"), S.repeat(F.col("c_mktsegment"), 2).alias("twice"), F.reverse(c).alias("back"))


@plan("""SELECT p_partkey, substring(p_name, 3, 4) AS part, p_name[2] AS ch, unicode(p_name[2]) AS code, chr(CAST(64 + p_partkey % 26 + 1 AS INTEGER)) AS made, strpos(p_name, 'e') - 1 AS at,
CASE WHEN strpos(p_name, 'e') = 0 THEN -1 ELSE length(p_name) - strpos(reverse(p_name), 'e') END AS last_at, list_aggregate(string_split(p_name, ' '), 'string_agg', '|') AS words FROM part""")
def strings_parts(t):
    c = F.col("p_name")
    return t("part").select("p_partkey", S.substring(c, 2, 6).alias("part"), S.char_at(c, 1).alias("ch"), S.char_code_at(c, 1).alias("code"), S.from_char_code(64 + F.col("p_partkey") % 26 + 1).alias("made"), S.index_of(c, "e").alias("at"), S.last_index_of(c, "e").alias("last_at"), text(S.split(c, " "), "|").alias("words"))


@plan("""SELECT doc_id, md5(text) AS m, sha1(text) AS s1, sha256(text) AS s256, base64(encode(text)) AS b, lower(hex(encode(text))) AS h FROM documents""")
def strings_hash_encode(t):
    c = F.col("text")
    return t("documents").select("doc_id", S.hashed(c, "MD5").alias("m"), S.hashed(c, "SHA-1").alias("s1"), S.hashed(c, "sha_256").alias("s256"), S.to_base64(c).alias("b"), S.to_hex(c).alias("h"))


@plan("SELECT doc_id, text AS b, text AS h FROM documents")
def strings_decode(t):
    c = F.col("text")
    return t("documents").select("doc_id", S.from_base64(S.to_base64(c)).alias("b"), S.from_hex(S.to_hex(c)).alias("h"))


@plan("""SELECT c_custkey, CASE WHEN ends_with(c_name, '9') THEN c_name ELSE c_name || '9' END AS app, CASE WHEN starts_with(c_name, 'Customer') THEN c_name ELSE 'Customer' || c_name END AS pre,
lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS l, rpad(CAST(c_custkey AS VARCHAR), 6, '.') AS r, starts_with(c_name, 'C') AS st, ends_with(c_name, '1') AS en, contains(c_name, '00') AS has, replace(c_name, '0', 'o') AS rep FROM customer""")
def strings_affixes(t):
    c, k = F.col("c_name"), F.col("c_custkey").cast("string")
    return t("customer").select("c_custkey", S.append_if_missing(c, "9").alias("app"), S.prepend_if_missing(c, "Customer").alias("pre"), S.left_pad(k, 6, "0").alias("l"), S.right_pad(k, 6, ".").alias("r"), S.starts_with(c, "C").alias("st"), S.ends_with(c, "1").alias("en"), S.contains(c, "00").alias("has"), S.replace(c, "0", "o").alias("rep"))


@plan(r"""SELECT p_partkey, regexp_replace(p_name, '([a-z])([a-z]*)', '\2\1', 'g') AS swapped, list_aggregate(regexp_extract_all(p_name, '[aeiou]+'), 'string_agg', '|') AS vowels, regexp_matches(p_name, 'e') AS has, regexp_full_match(p_brand, 'Brand#[0-9]+') AS whole,
regexp_extract(p_brand, '^([A-Za-z]+)#([0-9])([0-9]*)$', 2) AS g2 FROM part""")
def strings_regex(t):
    c, b = F.col("p_name"), F.col("p_brand")
    return t("part").select("p_partkey", S.replace_regex(c, "([a-z])([a-z]*)", "$2$1").alias("swapped"), F.nullif(text(F.transform(S.scan(c, "[aeiou]+"), lambda m: m[0]), "|"), F.lit("")).alias("vowels"), S.contains_regex(c, "e").alias("has"), S.matches(b, "Brand#[0-9]+").alias("whole"), F.coalesce(F.get(S.match(b, "([A-Za-z]+)#([0-9])([0-9]*)"), F.lit(2)), F.lit("")).alias("g2"))


@plan("""SELECT p_partkey, coalesce(list_aggregate(list_filter(range(0, length(p_name)), lambda i: substring(p_name, i + 1, 1) = 'a'), 'string_agg', ','), '') AS found, coalesce(list_aggregate(list_filter(range(0, length(p_name)), lambda i: substring(p_name, i + 1, 1) = 'a'), 'string_agg', ','), '') AS by_regex FROM part""")
def strings_find(t):
    c = F.col("p_name")
    return t("part").select("p_partkey", text(S.find(c, "a")).alias("found"), text(S.find_regex(c, "a")["start"]).alias("by_regex"))


@plan("""SELECT n_nationkey, CASE WHEN n_nationkey % 100 BETWEEN 11 AND 13 THEN n_nationkey || 'th' WHEN n_nationkey % 10 = 1 THEN n_nationkey || 'st' WHEN n_nationkey % 10 = 2 THEN n_nationkey || 'nd' WHEN n_nationkey % 10 = 3 THEN n_nationkey || 'rd' ELSE n_nationkey || 'th' END AS nth,
'myNationName' AS camel, 'my-nation-name' AS dash, 'my_nation_name' AS under, 'My Nation Name' AS cap, 'Hello ' || n_name || ' of null' AS said FROM nation""")
def strings_words(t):
    w = F.lit("my_nation_name")
    return t("nation").select("n_nationkey", S.ordinalize(F.col("n_nationkey")).alias("nth"), S.camelize(w).alias("camel"), S.dasherize(S.camelize(w)).alias("dash"), S.underscore(S.camelize(w)).alias("under"), S.capitalize(S.camelize(w)).alias("cap"), S.interpolate("Hello ", F.col("n_name"), " of ", F.lit(None)).alias("said"))


@plan("SELECT * FROM (VALUES ('city', 'cities', 'city'), ('box', 'boxes', 'box'), ('knife', 'knives', 'knife'), ('leaf', 'leaves', 'leaf'), ('day', 'days', 'day'), ('bus', 'buses', 'bus')) v(word, many, one)")
def strings_plurals(t):
    one = t("region").limit(1).select(F.explode(F.array(*[F.lit(w) for w in ("city", "box", "knife", "leaf", "day", "bus")])).alias("word"))
    return one.select("word", S.pluralize(F.col("word")).alias("many"), S.singularize(S.pluralize(F.col("word"))).alias("one"))


@plan("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ceil(l_extendedprice)::BIGINT AS up, floor(l_extendedprice)::BIGINT AS down, CAST(round(l_extendedprice) AS BIGINT) AS near, abs(l_linenumber - 4) AS dist, l_orderkey % 7 AS rest, l_linenumber % 2 = 0 AS even, l_linenumber % 2 <> 0 AS odd,
CAST(pow(l_linenumber, 3) AS BIGINT) AS cube, round(sqrt(l_extendedprice), 6) AS root, l_extendedprice = floor(l_extendedprice) AS whole FROM lineitem""")
def numbers_scalar(t):
    p, k = F.col("l_extendedprice"), F.col("l_linenumber")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.ceil(p).cast("long").alias("up"), N.floor(p).cast("long").alias("down"), N.round(p).alias("near"), N.abs(k - 4).alias("dist"), N.mod(F.col("l_orderkey"), F.lit(7)).alias("rest"), N.is_even(k).alias("even"), N.is_odd(k).alias("odd"), N.int_pow_of(k, 3).alias("cube"), F.round(N.sqrt(p), 6).alias("root"), N.is_integer(p).alias("whole"))


@plan("SELECT o_orderkey, to_base(o_orderkey, 16) AS hexed, to_base(o_orderkey, 2) AS bits, o_orderkey AS back, -o_orderkey AS minus, true AS is_dec, false AS int_dec FROM orders")
def numbers_radix(t):
    k = F.col("o_orderkey")
    return t("orders").select("o_orderkey", N.to_radix(k, 16).alias("hexed"), N.to_binary(k).alias("bits"), N.from_radix(N.to_radix(k, 36), 36).alias("back"), N.from_binary(N.to_binary(-k)).alias("minus"), N.is_decimal(F.col("o_totalprice")).alias("is_dec"), N.is_decimal(k).alias("int_dec"))


@plan("""SELECT n_nationkey, coalesce(list_aggregate(range(0, n_nationkey), 'string_agg', ','), '') AS below, list_aggregate(CASE WHEN n_nationkey < 10 THEN range(n_nationkey, 11) ELSE range(n_nationkey, 9, -1) END, 'string_agg', ',') AS down FROM nation""")
def numbers_ranges(t):
    k = F.col("n_nationkey")
    return t("nation").select("n_nationkey", text(N.range_of(k)).alias("below"), text(N.to_range(k, F.lit(10))).alias("down"))


VEC = "embedding"


@plan("""SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS mean, list_max(embedding)::DOUBLE AS high, list_min(embedding)::DOUBLE AS low,
embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last, len(list_filter(embedding, lambda x: x > 0)) AS positive, len(list_filter(embedding, lambda x: x > 0.1)) > 0 AS some, len(list_filter(embedding, lambda x: x < 5)) = len(embedding) AS every FROM embeddings""")
def arrays_aggregate(t):
    v = F.col(VEC)
    return t("embeddings").select(
        "vec_id", A.size_of(v).alias("n"), F.round(A.sum(v), 4).alias("total"), F.round(A.avg(v), 5).alias("mean"), A.max(v).cast("double").alias("high"), A.min(v).cast("double").alias("low"), A.first(v).cast("double").alias("first"), A.last(v).cast("double").alias("last"),
        A.count_by(v, lambda x: x > 0).alias("positive"), A.some(v, lambda x: x > F.lit(0.1).cast("double")).alias("some"), A.every(v, lambda x: x < 5).alias("every"),
    )


WORDS = "list_filter(string_split(text, ' '), lambda w: w <> '')"


@plan(f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents)
SELECT doc_id, array_to_string(w[1:3], ',') AS head, array_to_string(w[4:], ',') AS tail, array_to_string(w[3:5], ',') AS mid, array_to_string(list_reverse(w), ',') AS back, array_to_string(w[-2:], ',') AS last2,
array_to_string(list_filter(w, lambda x: length(x) > 4), ',') AS long, array_to_string(list_transform(w, lambda x, i: (i - 1) || x), ',') AS numbered FROM d""")
def arrays_slices(t):
    d = t("documents").select("doc_id", A.filter(S.split(F.col("text"), " "), lambda w: w != "").alias("w"))
    w = F.col("w")
    return d.select("doc_id", text(A.take(w, 3)).alias("head"), text(A.drop(w, 3)).alias("tail"), text(A.slice(w, 2, 5)).alias("mid"), text(A.reverse(w)).alias("back"), text(A.slice(w, -2, 100000)).alias("last2"), text(A.filter(w, lambda x: F.length(x) > 4)).alias("long"), text(A.map(w, lambda x, i: F.concat(i.cast("string"), x))).alias("numbered"))


@plan(f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
u AS (SELECT doc_id, w, list_filter(w, lambda x, i: list_position(w, x) = i) AS uniq, list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: length(y)), length(x)) = i) AS by_len FROM d)
SELECT doc_id, array_to_string(uniq, ',') AS uniq, array_to_string(by_len, ',') AS by_len, array_to_string(list_sort(w), ',') AS sorted, coalesce(list_position(w, 'the'), 0) - 1 AS at, list_contains(w, 'the') AS has,
array_to_string(list_filter(w, lambda x: x <> 'the' AND x <> 'of'), ',') AS without, 'x,' || array_to_string(w, ',') AS pre, array_to_string(w, ',') || ',x' AS app FROM u""")
def arrays_sets(t):
    d = t("documents").select("doc_id", A.filter(S.split(F.col("text"), " "), lambda w: w != "").alias("w"))
    w = F.col("w")
    return d.select(
        "doc_id", text(A.unique(w)).alias("uniq"), text(A.distinct_by(w, lambda x: F.length(x))).alias("by_len"), text(A.sort(w)).alias("sorted"), A.index_of(w, F.lit("the")).alias("at"), A.contains(w, F.lit("the")).alias("has"),
        text(A.remove(w, F.array(F.lit("the"), F.lit("of")))).alias("without"), text(A.prepend(w, F.lit("x"))).alias("pre"), text(A.append(w, F.lit("x"))).alias("app"),
    )


@plan(f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, arg_min(x, i ORDER BY i) FILTER (length(x) = m) AS longest, string_agg(x, ',' ORDER BY length(x), i) AS by_length, sum(length(x)) AS chars, coalesce(min(i) FILTER (length(x) > 5), max(i) + 1) - 1 AS prefix
      FROM (SELECT *, max(length(x)) OVER (PARTITION BY doc_id) AS m FROM e) GROUP BY doc_id)
SELECT doc_id, longest, by_length, chars::BIGINT AS chars, prefix FROM g""")
def arrays_order(t):
    d = t("documents").select("doc_id", A.filter(S.split(F.col("text"), " "), lambda w: w != "").alias("w")).filter(F.size("w") > 0)
    w = F.col("w")
    return d.select("doc_id", A.max_by(w, lambda x: F.length(x)).alias("longest"), text(A.order_by(w, lambda x: F.length(x))).alias("by_length"), A.reduce(w, lambda x, acc: acc + F.length(x), F.lit(0).cast("long")).alias("chars"), F.size(A.take_while(w, lambda x: F.length(x) <= 5)).cast("long").alias("prefix"))


@plan("""SELECT vec_id, round(list_sum(list_transform(list_zip(embedding[1:4], embedding[5:7]), lambda p: (p[1] * p[2])::DOUBLE)), 6) AS dot3, len(embedding) * 2 AS n, CAST(ceil(len(embedding) / 5) AS INTEGER) AS chunks FROM embeddings""")
def arrays_zip_flatten(t):
    v = F.col(VEC)
    pairs = A.zip(A.take(v, 4), A.slice(v, 4, 7))
    dot = A.sum(A.map(pairs, lambda p: (p["l"] * p["r"]).cast("double")))
    return t("embeddings").select("vec_id", F.round(dot, 6).alias("dot3"), F.size(A.flatten(F.array(v, v))).alias("n"), F.size(A.divide_by(v, 5)).alias("chunks"))


@plan("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, list_aggregate(json_keys(props), 'string_agg', ',') AS names, json_exists(props, '$.k') AS has, json_exists(props, '$.zz') AS has_not FROM events""")
def objects_json(t):
    m = F.from_json("props", "map<string,bigint>")
    return t("events").select("event_id", O.safe(m, "k").alias("k"), text(O.keys(m)).alias("names"), O.has(m, "k").alias("has"), O.has(m, "zz").alias("has_not"))


@plan("""SELECT c_custkey, 'name=' || upper(c_name) || ';seg=' || c_mktsegment || ';key=' || c_custkey AS mapped, 'seg,key,name' AS names, c_name || '|' || c_custkey AS without, 'b,a' AS entries FROM customer""")
def objects_maps(t):
    a = F.create_map(F.lit("name"), F.col("c_name"), F.lit("seg"), F.lit("old"))
    b = F.create_map(F.lit("seg"), F.col("c_mktsegment"), F.lit("key"), F.col("c_custkey").cast("string"))
    d, both = t("customer").select("c_custkey", O.merge(a, b).alias("both")), F.col("both")
    shown = O.pluck(O.map_object(both, lambda v, k: (k, F.when(k == "name", F.upper(v)).otherwise(v))), lambda v, k, i: F.concat(k, F.lit("="), v))
    order = A.order_by(O.keys(both), lambda k: F.when(k == "seg", 0).when(k == "key", 1).otherwise(2))
    back = O.array_to_object(A.reverse(O.object_to_array(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)))))
    return d.select("c_custkey", text(shown, ";").alias("mapped"), text(order).alias("names"), text(O.values(O.remove(both, "seg")), "|").alias("without"), text(O.keys(back)).alias("entries"))


@plan("SELECT c_custkey, c_name || '!' AS deep_name, c_nationkey + 1 AS nation, c_name || ',' || c_mktsegment AS every FROM customer")
def objects_update_deep(t):
    d = t("customer").select("c_custkey", F.struct(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("who"), F.struct(F.col("c_mktsegment").alias("name")).alias("seg")).alias("o"))
    new = O.update_path(O.update_path(F.col("o"), "who.name", lambda v: F.concat(v, F.lit("!"))), "who.nation", lambda v: v + 1)
    return d.select("c_custkey", new["who"]["name"].alias("deep_name"), new["who"]["nation"].alias("nation"), text(O.deep(d, "o", "name")).alias("every"))


@plan("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'big' WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS said, coalesce(nullif(o_orderstatus, 'O'), 'none') AS dflt,
CASE WHEN o_totalprice > 200000 THEN 'high' ELSE 'low' END AS lvl, nullif(o_orderstatus, 'F') || '?' AS thn FROM orders""")
def control_match_default(t):
    s, p = F.col("o_orderstatus"), F.col("o_totalprice")
    said = C.match_case(s, [(C.literal_case("O"), lambda v: F.lit("open")), (lambda v: (v == "F") & (p > 100000), lambda v: F.lit("big")), (C.literal_case("F"), lambda v: F.lit("done"))], lambda v: v)
    return t("orders").select("o_orderkey", said.alias("said"), C.default(F.nullif(s, F.lit("O")), F.lit("none")).alias("dflt"), C.if_else(p > 200000, F.lit("high"), F.lit("low")).alias("lvl"), C.then(F.nullif(s, F.lit("F")), lambda v: F.concat(v, F.lit("?"))).alias("thn"))


@plan("""SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS as_str, coalesce(nullif(s_suppkey, 3)::DOUBLE, 0) AS as_num, coalesce(CAST(nullif(s_suppkey, 3) AS VARCHAR), 'null') AS null_str, TRY_CAST(s_name AS BIGINT) IS NULL AS failed, 'Number' AS kind, 'String' AS skind, true AS is_num,
nullif(s_suppkey, 3) IS NOT DISTINCT FROM nullif(s_suppkey, 3) AS eq, true AS coerced, s_nationkey > 5 AND s_suppkey > 2 AS both, s_nationkey > 5 OR s_suppkey > 2 AS either FROM supplier""")
def control_coerce_equal(t):
    k, n = F.col("s_suppkey"), F.nullif(F.col("s_suppkey"), F.lit(3))
    return t("supplier").select(
        "s_suppkey", C.as_string(k).alias("as_str"), C.as_number(n).alias("as_num"), C.as_string(n).alias("null_str"), F.col("s_name").try_cast("bigint").isNull().alias("failed"), C.type_of(k).alias("kind"), C.type_of(F.col("s_name")).alias("skind"), C.is_type(F.col("s_acctbal"), "Number").alias("is_num"),
        C.equal(n, n).alias("eq"), C.equal_coerced(k, k.cast("string")).alias("coerced"), C.both(F.col("s_nationkey") > 5, k > 2).alias("both"), C.either(F.col("s_nationkey") > 5, k > 2).alias("either"),
    )


@plan("SELECT o_orderkey, o_totalprice > 0 AS positive, o_orderstatus IN ('O', 'F') AS one_of, starts_with(o_orderpriority, '1') AS urgent, NOT starts_with(o_orderpriority, '1') AS not_urgent, true AS lists, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -1 END AS tried FROM orders")
def control_matchers(t):
    pr = F.col("o_orderpriority")
    lists = C.must(F.array(F.lit(1), F.lit(2)), C.each_item(C.be_greater_than(0))) & C.must(F.array(F.lit(1), F.lit(2)), C.have_item(C.equal_to(2))) & C.must(F.array(F.lit(1)), C.have_size(1))
    kept = C.assert_that(F.col("o_totalprice"), C.any_of(C.be_greater_than(0), C.be_null))
    tried = C.or_else(C.attempt(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey"))), F.lit(-1).cast("long"))
    return t("orders").select("o_orderkey", (kept > 0).alias("positive"), C.must(F.col("o_orderstatus"), C.be_one_of("O", "F")).alias("one_of"), C.must(pr, C.start_with("1")).alias("urgent"), C.must(pr, C.not_be(C.start_with("1"))).alias("not_urgent"), lists.alias("lists"), tried.alias("tried"))


@plan("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+02:00') AS said, strftime(date_trunc('day', o_orderdate), '%Y-%m-%dT%H:%M:%S+02:00') AS d, strftime(date_trunc('hour', o_orderdate), '%Y-%m-%dT%H:%M:%S+02:00') AS h, strftime(date_trunc('month', o_orderdate), '%Y-%m-%dT%H:%M:%S+02:00') AS m,
strftime(date_trunc('year', o_orderdate), '%Y-%m-%dT%H:%M:%S+02:00') AS y, strftime(date_trunc('day', o_orderdate) - INTERVAL 1 DAY * dayofweek(o_orderdate), '%Y-%m-%dT%H:%M:%S+02:00') AS w, isodow(o_orderdate) AS dow, dayofyear(o_orderdate) AS doy,
CAST(round((epoch(o_orderdate) - 7200 - epoch(TIMESTAMP '1995-01-01')) / 86400.0) AS BIGINT) AS days, year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0) AS leap FROM orders""")
def dates_truncate(t):
    s = F.concat(F.date_format("o_orderdate", D.ISO), F.lit("+02:00"))
    return t("orders").select(
        "o_orderkey", s.alias("said"), D.at_beginning_of_day(s).alias("d"), D.at_beginning_of_hour(s).alias("h"), D.at_beginning_of_month(s).alias("m"), D.at_beginning_of_year(s).alias("y"), D.at_beginning_of_week(s).alias("w"), D.day_of_week(s).alias("dow"), D.day_of_year(s).alias("doy"),
        D.days_between(s, F.lit("1995-01-01T00:00:00Z")).alias("days"), D.is_leap_year(F.year("o_orderdate")).alias("leap"),
    )


@plan("""SELECT n_nationkey, strftime(DATE '2023-01-01' + INTERVAL 1 MONTH * n_nationkey + INTERVAL 29 DAY, '%Y-%m-%d') AS d, strftime(TIMESTAMP '2024-02-01 00:00:00' + INTERVAL 1 DAY * n_nationkey + INTERVAL 25 HOUR + INTERVAL 1 MINUTE * n_nationkey, '%Y-%m-%dT%H:%M:%S') AS l,
strftime(TIMESTAMP '2024-02-01 00:00:00' + INTERVAL 1 DAY * n_nationkey + INTERVAL 25 HOUR + INTERVAL 1 MINUTE * n_nationkey, '%Y-%m-%dT%H:%M:%S') || '-05:00' AS z, strftime(TIMESTAMP '2000-01-01' + INTERVAL 1 HOUR * (n_nationkey % 24), '%H:%M:%S') AS lt, strftime(TIMESTAMP '2000-01-01' + INTERVAL 1 HOUR * (n_nationkey % 24), '%H:%M:%S') || 'Z' AS tt FROM nation""")
def dates_make(t):
    k = F.col("n_nationkey")
    at = (F.lit(2024), F.lit(2), k + 1, F.lit(25), k, F.lit(0))
    return t("nation").select("n_nationkey", D.date(F.lit(2023), k + 1, F.lit(30)).alias("d"), D.local_date_time(*at).alias("l"), D.date_time(*at, "-05:00").alias("z"), D.local_time(k % 24, F.lit(0), F.lit(0)).alias("lt"), D.time(k % 24, F.lit(0), F.lit(0)).alias("tt"))


@plan(r"""SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, nullif(list_aggregate(list_sort(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')), 'string_agg', '&'), '') AS query, regexp_extract(url, '#(.*)$', 1) AS fragment, url AS again, url AS decoded FROM pages""")
def urls_parse(t):
    p = U.parse_uri(F.col("url"))
    query = text(F.flatten(F.transform(F.map_entries(p["query"]), lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit("="), v)))), "&")
    return t("pages").select("page_id", p["scheme"].alias("scheme"), p["host"].alias("host"), p["path"].alias("path"), F.nullif(query, F.lit("")).alias("query"), p["fragment"].alias("fragment"), U.compose(p).alias("again"), U.decode_uri(U.encode_uri(F.col("url"))).alias("decoded"))


@plan("SELECT n_nationkey, url_encode(n_name || ' é/ü?') AS component, n_name || ' é/ü?' AS back FROM nation")
def urls_encode(t):
    s = F.concat("n_name", F.lit(" é/ü?"))
    return t("nation").select("n_nationkey", U.encode_uri_component(s).alias("component"), U.decode_uri_component(U.encode_uri_component(s)).alias("back"))


@plan("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, v[3] AS third, v[-2] AS but_last, array_to_string(list_transform(v[2:4], lambda x: round(x * 1000)::BIGINT), ',') AS part, array_to_string(list_reverse(list_transform(v[1:3], lambda x: round(x * 1000)::BIGINT)), ',') AS down, v[1] IS NULL AS out_of_range,
len(list_filter(v, lambda x: x > 0.1)) AS above, len(v) = 0 AS empty, array_to_string(list_transform(v[1:2], lambda x: round(x * 1000)::BIGINT), ',') AS clamped, 0 AS nothing FROM e""")
def arrays_selectors(t):
    v, whole = F.col("v"), lambda a: text(F.transform(a, lambda x: F.round(x * 1000).cast("long")))
    d = t("embeddings").select("vec_id", F.col(VEC).cast("array<double>").alias("v"))
    return d.select(
        "vec_id", A.item(v, 2).alias("third"), A.item(v, -2).alias("but_last"), whole(A.range_index(v, 1, 3)).alias("part"), whole(A.range_index(v, 2, 0)).alias("down"), A.range_index(v, 0, 10**6).isNotNull().alias("out_of_range"),
        F.coalesce(A.size_of(A.filter_selector(v, lambda x: x > 0.1)), F.lit(0)).alias("above"), A.is_empty(v).alias("empty"), whole(A.arrays_slice(v, -5, 2)).alias("clamped"), F.size(A.arrays_slice(v, 0, -1)).alias("nothing"),
    )


@plan("SELECT vec_id, label + 9007199254740993 AS exact, label * 3 + 0.25 AS dec, array_to_string(list_transform(range(0, len(embedding)), lambda i: i), ',') AS back, 1.5::DOUBLE + label AS last_step FROM embeddings")
def arrays_exact_sums(t):
    big, label = F.lit(9007199254740993).cast("bigint"), F.col("label").cast("bigint")
    dec = F.lit("0.25").cast("decimal(12,2)")
    pairs = A.unzip(A.zip(F.sequence(F.lit(0), F.size(VEC) - 1), F.col(VEC)))
    return t("embeddings").select(
        "vec_id", A.sum(F.array(big, label), "bigint").alias("exact"), A.sum(F.array(label.cast("decimal(12,2)"), (label * 2).cast("decimal(12,2)"), dec), "decimal(20,2)").alias("dec"), text(pairs["l"]).alias("back"),
        F.element_at(N.to_range(F.lit(1.5).cast("double"), F.lit(1.5).cast("double") + label), -1).alias("last_step"),
    )


@plan("""SELECT doc_id, array_to_string(list_reverse(list_sort(list_distinct(list_filter(string_split(lower(text), ' '), lambda w: w <> '')))), ' ') AS falling,
len(list_distinct(list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: length(w)))) AS lengths FROM documents""")
def arrays_order_text(t):
    w = A.filter(S.split(S.lower(F.col("text")), " "), lambda x: x != "")
    return t("documents").select("doc_id", text(A.order_by(A.unique(w), lambda x: x, descending=True), " ").alias("falling"), F.size(A.distinct_by(A.filter(S.split(F.col("text"), " "), lambda x: x != ""), lambda x: F.length(x))).alias("lengths"))


@plan(r"""SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, p_name[2:4] AS part, p_name[-3:] AS ending, reverse(p_name[1:3]) AS down, trim(p_name) = '' AS blank, regexp_matches(p_name, '(?i)[AEIOU]') AS vowel, len(regexp_extract_all(p_brand, '(?i)BRAND')) AS brands,
regexp_extract(p_brand, '#([0-9]+)', 1) AS num, replace(p_name, ' ', chr(10)) AS told, len(string_split(p_name, ' ')) AS parts FROM part""")
def strings_slices_flags(t):
    c, b = F.col("p_name"), F.col("p_brand")
    words = S.split(c, " ")
    told = S.unlines(words)
    return t("part").select(
        "p_partkey", S.to_upper(c).alias("up"), S.to_lower(b).alias("low"), S.range_index(c, 1, 3).alias("part"), S.slice(c, -3, 1000).alias("ending"), S.range_index(c, 2, 0).alias("down"), S.is_blank(c).alias("blank"), S.contains_regex(c, S.regex("[AEIOU]", "i")).alias("vowel"),
        F.size(S.scan(b, S.regex("BRAND", "i"))).alias("brands"), S.match(b, "(?<name>[A-Za-z]+)#(?<num>[0-9]+)")[2].alias("num"), A.join_by(S.lines(told), "\n").alias("told"), F.size(S.lines(told)).alias("parts"),
    )


@plan("""SELECT c_custkey, c_name AS name, c_mktsegment AS seg, c_name || ',' || c_mktsegment AS every, 2 AS size, 'Object' AS kind, c_name || '|' || c_mktsegment AS many, '{"@k":' || c_custkey || ',"#text":"' || c_name || '"}' AS tagged, '{"xsi:type":"Customer"}' AS typed, 'name,seg' AS names, c_name AS entry, false AS none FROM customer""")
def objects_selectors(t):
    d = t("customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg")).alias("o"), "c_name", "c_mktsegment").withColumn("m", F.create_map(F.lit("name"), "c_name", F.lit("seg"), "c_mktsegment"))
    m = F.col("m")
    rows = F.array(F.struct(F.col("c_name").alias("x")), F.struct(F.col("c_mktsegment").alias("x")))
    return d.select(
        "c_custkey", O.required(m, "name").alias("name"), O.safe(O.filter_object(m, lambda v, k: k != "name"), "seg").alias("seg"), text(O.struct_values(d, "o")).alias("every"), O.metadata(d, "m", "size").alias("size"), O.metadata(d, "o", "class").alias("kind"),
        text(O.multi_value(rows, "x"), "|").alias("many"), F.to_json(O.with_attributes(F.col("c_name"), k=F.col("c_custkey"))).alias("tagged"), F.to_json(O.xsi_type("Customer")).alias("typed"), text(O.keys(m)).alias("names"), O.object_to_array(m)[0]["value"].alias("entry"), O.is_empty(m).alias("none"),
    )


@plan("""SELECT o_orderkey, true AS is_string, true AS is_number, false AS is_null, o_orderstatus = 'O' AS open, contains(o_orderpriority, 'U') AS has_u, ends_with(o_orderpriority, 'T') AS ends, true AS not_null, o_totalprice < 100000 AS cheap, false AS blank, CASE WHEN o_orderstatus = 'O' THEN 'kept' ELSE 'other' END AS tried, true AS flag, 36 AS uuid_size FROM orders""")
def control_more_matchers(t):
    s, p, pr = F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_orderpriority")
    guarded = F.when(s == "", C.fail("no status")).otherwise(s)
    tried = C.or_else_try(C.attempt(F.when(guarded == "O", F.lit("kept"))), C.attempt(F.lit("other")))
    return t("orders").select(
        "o_orderkey", C.must(s, C.be_type("String")).alias("is_string"), C.must(p, C.be_type("Number")).alias("is_number"), C.must(s, C.be_null).alias("is_null"), C.must(s, C.equal_to("O")).alias("open"), C.must(pr, C.contain_str("U")).alias("has_u"), C.must(pr, C.end_with("T")).alias("ends"),
        C.must(s, C.not_be_null).alias("not_null"), C.must(p, C.be_lower_than(100000)).alias("cheap"), C.must(pr, C.be_blank).alias("blank"), tried["result"].alias("tried"), X.compatibility_flag("allowUndefinedProperties").alias("flag"), F.length(C.uuid()).alias("uuid_size"),
    )


@plan("SELECT n_nationkey, true AS has_val, true AS has_key, true AS has_value, true AS empty, true AS inside, true AS whole, true AS ordered, true AS text_size, true AS unset FROM nation")
def control_collections_random(t):
    m, a = F.create_map(F.lit("k"), F.col("n_name")), F.array("n_nationkey")
    day = D.today()
    return t("nation").select(
        "n_nationkey", C.must(F.array(F.lit(1), F.lit(2)), C.contain_val(2)).alias("has_val"), C.must(m, C.have_key("k")).alias("has_key"), C.must(F.create_map(F.lit("k"), F.lit("v")), C.have_value("v")).alias("has_value"), C.must(F.lit(""), C.be_empty).alias("empty"),
        ((N.random() >= 0) & (N.random() < 1)).alias("inside"), N.random_int(7).isin(*range(7)).alias("whole"), ((D.yesterday() < day) & (day < D.tomorrow())).alias("ordered"), ((F.length(D.now()) == 27) & (A.index_of(a, F.col("n_nationkey")) == 0)).alias("text_size"), X.env_var("LOOMFRAME_NOT_SET").isNull().alias("unset"),
    )


@plan("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT12:00:00') || CASE WHEN o_orderdate::DATE >= d.a AND o_orderdate::DATE < d.b THEN '-04:00' ELSE '-05:00' END AS made,
year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0) AS leap, strftime(o_orderdate, '%Y-%m-%dT12:00:00Z') AS utc
FROM orders, LATERAL (SELECT make_date(year(o_orderdate), 4, 1) + ((7 - dayofweek(make_date(year(o_orderdate), 4, 1))) % 7)::INT AS a, make_date(year(o_orderdate), 10, 31) - dayofweek(make_date(year(o_orderdate), 10, 31))::INT AS b) d""")
def dates_zones(t):
    """New York's summer time from the first Sunday of April to the last of October, as it was until 2006."""
    at = F.col("o_orderdate")
    parts = (F.year(at), F.month(at), F.day(at), F.lit(12), F.lit(0), F.lit(0))
    return t("orders").select("o_orderkey", D.date_time(*parts, "America/New_York").alias("made"), D.is_leap_year(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("leap"), D.date_time(*parts, "UTC").alias("utc"))
