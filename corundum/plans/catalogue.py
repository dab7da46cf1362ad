"""A query for every operator of the engine, with the SQL that DuckDB answers alike.

Sums of prices are taken over decimals, which are exact in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..functions import extras, secure
from ..functions import json as js
from ..operators import indexes
from ..operators import relational as rel
from ..session import Engine, Pool
from ..sources import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEY = bytes(range(32))


def query(oracle: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query through the engine's SQL; most texts serve DuckDB as they are."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine.open_memory(spark)
        for t in sorted({w for w in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels") if w in text}):
            engine.attach(t, table(spark, sf_dir, t))
        return engine.sql(text)

    run.__name__ = name
    query(oracle or text)(run)


def money(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


# ---------------------------------------------------------------- scan, projection, predicates
@query("SELECT * FROM region")
def scan_all(spark, d):
    return table(spark, d, "region")


@query("SELECT o_orderkey, o_totalprice AS price FROM orders")
def project_cols(spark, d):
    return rel.project(table(spark, d, "orders"), "o_orderkey", price="o_totalprice")


@query("SELECT DISTINCT c_mktsegment FROM customer")
def select_distinct(spark, d):
    return table(spark, d, "customer").select("c_mktsegment").distinct()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(spark, d):
    return rel.where(table(spark, d, "orders"), F.col("o_orderstatus") == "F").select("o_orderkey")


@query("SELECT n_name FROM nation WHERE n_regionkey <> 1")
def filter_ne(spark, d):
    return rel.where(table(spark, d, "nation"), F.col("n_regionkey") != 1).select("n_name")


def _sizes(name: str, op: str) -> None:
    def run(spark, d):
        return rel.where(table(spark, d, "part"), f"p_size {op} 10").select("p_partkey")

    run.__name__ = f"filter_{name}"
    query(f"SELECT p_partkey FROM part WHERE p_size {op} 10")(run)


for _name, _op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _sizes(_name, _op)


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget'")
def filter_like(spark, d):
    return rel.where(table(spark, d, "part"), F.col("p_name").like("%widget")).select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_in(spark, d):
    return rel.where(table(spark, d, "orders"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'O') AND o_totalprice > 200000")
def filter_bool(spark, d):
    o = table(spark, d, "orders")
    return rel.where(o, (F.col("o_orderstatus") == "F") | (F.col("o_orderstatus") == "O"), F.col("o_totalprice") > 200000).select("o_orderkey")


sql("filter_not", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice BETWEEN 100000 AND 200000)")
sql("filter_null_3vl", "SELECT event_id FROM (SELECT event_id, nullif(event_type, 'error') k FROM events) WHERE k <> 'click'")
sql("filter_is_null", "SELECT event_id FROM (SELECT event_id, nullif(event_type, 'error') k FROM events) WHERE k IS NULL")
sql("filter_not_distinct", "SELECT event_id FROM (SELECT event_id, nullif(event_type, 'error') k FROM events) WHERE k IS NOT DISTINCT FROM NULL")


# ---------------------------------------------------------------- order and limit
@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def order_limit(spark, d):
    return rel.order(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ("o_totalprice", "desc"), "o_orderkey", limit=20)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
def limit_offset(spark, d):
    return rel.order(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", limit=10, offset=5)


sql("offset_only", "SELECT n_name FROM nation ORDER BY n_name OFFSET 20")


# ---------------------------------------------------------------- joins
@query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def join_inner(spark, d):
    return rel.equi_join(table(spark, d, "orders"), table(spark, d, "customer"), {"o_custkey": "c_custkey"}).select("o_orderkey", "c_name")


_RICH = "(SELECT * FROM orders WHERE o_totalprice > 450000)"


@query(f"SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN {_RICH} o ON c.c_custkey = o.o_custkey")
def join_left(spark, d):
    rich = table(spark, d, "orders").filter("o_totalprice > 450000")
    return rel.equi_join(table(spark, d, "customer"), rich, {"c_custkey": "o_custkey"}, "left").select("c_custkey", "o_orderkey")


@query(f"SELECT c.c_custkey, o.o_orderkey FROM {_RICH} o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey")
def join_right(spark, d):
    rich = table(spark, d, "orders").filter("o_totalprice > 450000")
    return rel.equi_join(rich, table(spark, d, "customer"), {"o_custkey": "c_custkey"}, "right").select("c_custkey", "o_orderkey")


@query(
    "SELECT s.s_suppkey, n.n_nationkey FROM (SELECT * FROM supplier WHERE s_nationkey < 15) s "
    "FULL OUTER JOIN (SELECT * FROM nation WHERE n_nationkey >= 5) n ON s.s_nationkey = n.n_nationkey"
)
def join_full(spark, d):
    s, n = table(spark, d, "supplier").filter("s_nationkey < 15"), table(spark, d, "nation").filter("n_nationkey >= 5")
    return rel.equi_join(s, n, {"s_nationkey": "n_nationkey"}, "full").select("s_suppkey", "n_nationkey")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left_docs(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select(F.col("doc_id").alias("of"), "quality")
    return rel.equi_join(docs, labels, {"doc_id": "of"}, "left").select("doc_id", "quality")


@query(f"SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM {_RICH} o WHERE o.o_custkey = c.c_custkey)")
def join_semi(spark, d):
    return rel.equi_join(table(spark, d, "customer"), table(spark, d, "orders").filter("o_totalprice > 450000"), {"c_custkey": "o_custkey"}, "left_semi").select("c_custkey")


@query(f"SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM {_RICH} o WHERE o.o_custkey = c.c_custkey)")
def join_anti(spark, d):
    return rel.equi_join(table(spark, d, "customer"), table(spark, d, "orders").filter("o_totalprice > 450000"), {"c_custkey": "o_custkey"}, "left_anti").select("c_custkey")


@query("SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey")
def join_theta(spark, d):
    a, b = table(spark, d, "nation"), table(spark, d, "region")
    return rel.project(rel.theta_join(a, b, a.n_regionkey < b.r_regionkey), x="n_nationkey", y="r_regionkey")


@query("SELECT a.s_suppkey AS x, b.r_regionkey AS y FROM supplier a FULL OUTER JOIN region b ON a.s_suppkey < b.r_regionkey")
def join_theta_full(spark, d):
    a, b = table(spark, d, "supplier"), table(spark, d, "region")
    return rel.project(rel.theta_join(a, b, a.s_suppkey < b.r_regionkey, "full"), x="s_suppkey", y="r_regionkey")


@query("SELECT a.c_custkey, b.s_suppkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) k FROM customer) a JOIN (SELECT s_suppkey, nullif(s_nationkey, 5) k FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_safe(spark, d):
    a = table(spark, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("a"))
    b = table(spark, d, "supplier").select("s_suppkey", F.nullif("s_nationkey", F.lit(5)).alias("b"))
    return rel.block_join(a, b, {"a": "b"}, null_safe=True).select("c_custkey", "s_suppkey")


sql("join_cross", "SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region")
sql("join_using", "SELECT doc_id, toxic FROM documents JOIN labels USING (doc_id)")
sql("join_natural", "SELECT doc_id, lang, quality FROM documents NATURAL JOIN labels")
sql("qualified_columns", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")


@query("SELECT e.event_id, w.low FROM events e JOIN (SELECT 0 AS low, 1000000000000 AS high UNION ALL SELECT 7, 7 UNION ALL SELECT 30, 45 UNION ALL SELECT NULL, 9) w ON e.user_id BETWEEN w.low AND w.high")
def join_range_wide(spark, d):
    ranges = spark.createDataFrame([(0, 10**12), (7, 7), (30, 45), (None, 9)], "low bigint, high bigint")
    return rel.range_join(table(spark, d, "events"), ranges, "user_id", "low", "high", 10).select("event_id", F.col("low").cast("int").alias("low"))


_CLICKS = "SELECT nullif(user_id, 3) AS u, CASE WHEN event_id % 7 <> 0 THEN ts END AS t, event_id FROM events WHERE event_type = "


@query(f"SELECT e.event_id, (SELECT max_by(c.event_id, (c.t, c.event_id)) FROM ({_CLICKS}'click') c WHERE c.u = e.u AND c.t <= e.t) AS last_click FROM ({_CLICKS}'purchase') e")
def join_as_of_nulls(spark, d):
    """Null keys and null times on both sides, dealt into many ranges."""
    e = table(spark, d, "events")
    side = lambda kind: e.filter(F.col("event_type") == kind).select(F.nullif("user_id", F.lit(3)).alias("u"), F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("t"), "event_id")
    clicks = side("click").groupBy("u", "t").agg(F.max("event_id").alias("event_id"))
    return rel.as_of_join(side("purchase"), clicks, "u", "t", ["event_id"], rows_per_task=500).select("event_id", F.col("right_event_id").alias("last_click"))


@query(
    "SELECT r.r_name, count(*) AS n, CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM region r "
    "JOIN nation n ON r.r_regionkey = n.n_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey "
    "JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY r.r_name"
)
def join_multi(spark, d):
    r, n, c, o = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    # orders are summed by customer first: the join carries a row a customer
    by_customer = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    joined = by_customer.join(c, by_customer.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy("r_name").agg(F.sum(by_customer["n"]).alias("n"), F.sum("v").cast("double").alias("v"))


@query("SELECT e.event_id, o.label FROM events e JOIN (SELECT 0 AS low, 25 AS high, 'small' AS label UNION ALL SELECT 20, 60, 'middle' UNION ALL SELECT 55, 1000, 'large') o ON e.user_id BETWEEN o.low AND o.high")
def join_range(spark, d):
    ranges = spark.createDataFrame([(0, 25, "small"), (20, 60, "middle"), (55, 1000, "large")], "low bigint, high bigint, label string")
    return rel.range_join(table(spark, d, "events"), ranges, "user_id", "low", "high", 50).select("event_id", "label")


@query(
    "SELECT e.event_id, (SELECT max_by(c.event_id, (c.ts, c.event_id)) FROM events c WHERE c.event_type = 'click' AND c.user_id = e.user_id AND c.ts <= e.ts) AS last_click "
    "FROM events e WHERE e.event_type = 'purchase'"
)
def join_as_of(spark, d):
    e = table(spark, d, "events")
    clicks = e.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    buys = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return rel.as_of_join(buys, clicks, "user_id", "ts", ["event_id"]).select("event_id", F.col("right_event_id").alias("last_click"))


# ---------------------------------------------------------------- aggregates
@query(
    "SELECT count(*) AS c, count(c_custkey) AS cc, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS s, "
    "CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(c_acctbal) AS a, min(c_name) AS mn, max(c_name) AS mx FROM customer"
)
def agg_global(spark, d):
    c = table(spark, d, "customer")
    return c.agg(F.count(F.lit(1)).alias("c"), F.count("c_custkey").alias("cc"), money("c_acctbal").alias("s"), (money("c_acctbal") / F.count("c_acctbal")).alias("a"), F.min("c_name").alias("mn"), F.max("c_name").alias("mx"))


@query("SELECT count(*) AS a, count(k) AS b, min(k) AS mn FROM (SELECT nullif(event_type, 'error') k FROM events)")
def agg_count_nulls(spark, d):
    e = table(spark, d, "events").select(F.nullif("event_type", F.lit("error")).alias("k"))
    return rel.aggregate(e, a=("count", None), b=("count", "k"), mn=("min", "k"))


@query("SELECT CAST(sum(c_nationkey) AS BIGINT) AS s FROM customer")
def agg_int_sum(spark, d):
    return rel.aggregate(table(spark, d, "customer"), s=("sum", "c_nationkey"))


@query("SELECT event_type, count(DISTINCT user_id) AS u FROM events GROUP BY event_type")
def agg_distinct(spark, d):
    return rel.aggregate(table(spark, d, "events"), ["event_type"], u=("count_distinct", "user_id"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS c, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_multi(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("c"), money("l_quantity").alias("q"))


@query("SELECT k, count(*) AS n FROM (SELECT nullif(event_type, 'error') k FROM events) GROUP BY k")
def group_null(spark, d):
    return rel.aggregate(table(spark, d, "events").select(F.nullif("event_type", F.lit("error")).alias("k")), ["k"], n=("count", None))


@query("SELECT o_custkey, count(*) AS c FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having(spark, d):
    return rel.aggregate(table(spark, d, "orders"), ["o_custkey"], having="c > 12", c=("count", None))


sql("group_only", "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority")
sql("audit_summary", "SELECT event_type, count(*) n, min(ts) a, max(ts) b, count(DISTINCT user_id) u FROM events GROUP BY event_type HAVING count(*) > 0 ORDER BY n DESC")


sql(
    "group_rollup",
    "SELECT l_returnflag, l_linestatus, count(*) n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
)
sql("group_cube", "SELECT o_orderstatus, o_orderpriority, count(*) n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("group_sets", "SELECT c_mktsegment, c_nationkey, count(*) n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
sql("agg_filter", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') c, count(DISTINCT event_type) FILTER (WHERE value > 10) k FROM events GROUP BY user_id")


# ---------------------------------------------------------------- set operations, CTEs, views, windows
sql("set_union", "SELECT n_regionkey k FROM nation UNION SELECT r_regionkey FROM region")
sql("set_intersect", "SELECT c_nationkey k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
sql("set_except", "SELECT n_nationkey k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 8")
sql("set_union_all", "SELECT n_regionkey k FROM nation UNION ALL SELECT r_regionkey FROM region")
sql("set_intersect_all", "SELECT c_nationkey k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
sql("set_except_all", "SELECT c_nationkey k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
sql("cte", "WITH d AS (SELECT CAST(CAST(o_orderdate AS DATE) AS STRING) d, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) v FROM orders GROUP BY 1) SELECT d, v FROM d WHERE v > 500000")
sql("scalar_subquery", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
sql("window_rank", "SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) r FROM customer", "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS INTEGER) r FROM customer")
sql("date_filter", "SELECT count(*) n FROM orders WHERE o_orderdate > timestamp_ntz'1997-01-01'", "SELECT count(*) n FROM orders WHERE o_orderdate > timestamp '1997-01-01'")


# ---------------------------------------------------------------- JSON
@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", js.extract(F.col("props"), "$.k").alias("k"))


@query("SELECT event_id, coalesce(json_valid(props), false) AS ok FROM events")
def json_valid(spark, d):
    return table(spark, d, "events").select("event_id", js.valid(F.col("props")).alias("ok"))


@query(
    "SELECT event_id, CASE json_type(props, '$.k') WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'text' "
    "WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'real' END AS t FROM events"
)
def json_type(spark, d):
    return table(spark, d, "events").select("event_id", js.type_of(F.col("props"), "$.k").alias("t"))


@query("SELECT event_id, CAST(to_json(list_sort(json_keys(props))) AS VARCHAR) AS k FROM events")
def json_keys(spark, d):
    return table(spark, d, "events").select("event_id", js.object_keys(F.col("props")).alias("k"))


@query("SELECT event_id, CAST(json_array_length('[' || props || ',2,3]') AS BIGINT) AS n FROM events")
def json_array_length(spark, d):
    return table(spark, d, "events").select("event_id", js.array_length(F.concat(F.lit("["), "props", F.lit(",2,3]"))).alias("n"))


@query("SELECT event_id FROM events WHERE contains(CAST(json_extract(props, '$.k') AS VARCHAR), '87')")
def json_contains(spark, d):
    return table(spark, d, "events").filter(js.contains(F.col("props"), "87")).select("event_id")


@query("SELECT event_id, CAST(json_object('k', json_extract(props, '$.k'), 'seen', 1) AS VARCHAR) AS j FROM events")
def json_set(spark, d):
    return table(spark, d, "events").select("event_id", js.set_value(F.col("props"), "$.seen", F.lit("1")).alias("j"))


@query("SELECT event_id, '{\"k\":[1.50,' || event_id || '],\"a\":{\"b\":12345678901234567890.123}}' AS j, '{\"k\":[true,' || event_id || ',9]}' AS i, '[1]' AS x FROM events")
def json_set_paths(spark, d):
    """A path that does not fit leaves the text as it is; digits stay."""
    whole = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    n = F.col("event_id").cast("string")
    text = whole('{"k":[1.50,', n, '],"a":{"b":1}}')
    j = js.set_values(text, ("$.k.x", F.lit("7")), ("$.a.b", F.lit("12345678901234567890.123")))
    i = js.set_values(whole('{"k":[1,', n, "]}"), ("$.k[0]", F.lit("true")), ("$.k[2]", F.lit("9")), ("$.k[7]", F.lit("1")))
    return table(spark, d, "events").select("event_id", j.alias("j"), i.alias("i"), js.set_value(F.lit("[1]"), "$.x", F.lit("2")).alias("x"))


@query("SELECT event_id, CAST(json(props) AS VARCHAR) AS j FROM events")
def json_roundtrip(spark, d):
    return table(spark, d, "events").select("event_id", js.stringify(js.parse(F.col("props"))).alias("j"))


# ---------------------------------------------------------------- index lookups
@query("SELECT event_id FROM events WHERE user_id = 13 AND event_type = 'click'")
def index_point(spark, d):
    return indexes.prefix(table(spark, d, "events"), ["user_id", "event_type"], [13, "click"]).select("event_id")


@query("SELECT event_id FROM events WHERE user_id BETWEEN 5 AND 12")
def index_range(spark, d):
    return indexes.between(table(spark, d, "events"), ["user_id"], 5, 12).select("event_id")


@query("SELECT event_id FROM events WHERE (user_id > 5 OR user_id = 5 AND event_type >= 'error') AND (user_id < 12 OR user_id = 12 AND event_type <= 'login')")
def index_range_multi(spark, d):
    return indexes.between(table(spark, d, "events"), ["user_id", "event_type"], (5, "error"), (12, "login")).select("event_id")


@query("SELECT event_id FROM events WHERE user_id = 13")
def index_prefix(spark, d):
    return indexes.prefix(table(spark, d, "events"), ["user_id", "event_type"], [13]).select("event_id")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type HAVING count(*) > 1")
def unique_violation(spark, d):
    return indexes.violations(table(spark, d, "events"), ["user_id", "event_type"])


def _indexed(spark, d, kind: str = "") -> Engine:
    engine = Engine.open_memory(spark)
    engine.sql("CREATE TABLE e (event_id INTEGER PRIMARY KEY, user_id INTEGER, event_type TEXT)")
    engine.insert("e", table(spark, d, "events").select("event_id", "user_id", "event_type"))
    engine.sql(f"CREATE {kind} INDEX by_user ON e (user_id, event_type)")
    return engine


@query("SELECT event_id FROM events WHERE user_id = 13 AND event_type = 'click'")
def index_lookup(spark, d):
    """Through an ordered index: files that cannot hold the key are not read."""
    return _indexed(spark, d).lookup("by_user", 13, "click").select("event_id")


@query("SELECT event_id FROM events WHERE user_id = 13 AND event_type = 'click'")
def index_lookup_hash(spark, d):
    return _indexed(spark, d, "HASH").lookup("by_user", 13, "click").select("event_id")


@query("SELECT event_id FROM events WHERE (user_id > 5 OR user_id = 5 AND event_type >= 'error') AND (user_id < 12 OR user_id = 12 AND event_type <= 'login')")
def index_lookup_range(spark, d):
    return _indexed(spark, d).range("by_user", (5, "error"), (12, "login")).select("event_id")


@query("SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error')")
def index_lookup_batch(spark, d):
    """All keys of another table at once."""
    keys = table(spark, d, "events").filter("event_type = 'error'").select("user_id")
    return _indexed(spark, d).lookup_many("by_user", keys).select("event_id")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(1 AS BIGINT) AS indexes, CAST(1 AS BIGINT) AS tables FROM events")
def storage_stats(spark, d):
    s = _indexed(spark, d).stats()
    return spark.createDataFrame([(s.rows, s.indexes, s.tables)], "n bigint, indexes bigint, tables bigint")


# ---------------------------------------------------------------- DDL, DML, transactions, prepared statements
def _orders(spark, d) -> Engine:
    engine = Engine.open_memory(spark)
    engine.attach("orders_in", table(spark, d, "orders"))
    engine.sql("CREATE TABLE o (o_orderkey INTEGER PRIMARY KEY, st TEXT NOT NULL, price REAL)")
    engine.sql("INSERT INTO o SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders_in")
    return engine


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS st FROM orders")
def dml_update(spark, d):
    engine = _orders(spark, d)
    engine.sql("UPDATE o SET st = 'X' WHERE st = 'F'")
    return engine.sql("SELECT o_orderkey, st FROM o")


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(o_orderstatus = 'F', false)")
def dml_delete(spark, d):
    engine = _orders(spark, d)
    engine.sql("DELETE FROM o WHERE st = 'F'")
    return engine.sql("SELECT o_orderkey FROM o")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NEW' UNION ALL SELECT 100, NULL")
def dml_insert(spark, d):
    engine = Engine.open_memory(spark)
    engine.sql("CREATE TABLE r (r_regionkey INT PRIMARY KEY, r_name TEXT)")
    engine.insert("r", table(spark, d, "region").select("r_regionkey", "r_name"))
    engine.sql("INSERT INTO r (r_name, r_regionkey) VALUES ('NEW', 99)")
    engine.sql("INSERT INTO r (r_regionkey) VALUES (100)")
    return engine.sql("SELECT CAST(r_regionkey AS INT) r_regionkey, r_name FROM r")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 1")
def transaction_rollback(spark, d):
    engine = Engine.open_memory(spark)
    engine.sql("CREATE TABLE n (n_nationkey INT, n_name TEXT, n_regionkey INT)")
    engine.insert("n", table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    with engine.transaction():
        engine.sql("DELETE FROM n WHERE n_regionkey = 1")
    engine.begin()
    engine.sql("DELETE FROM n")
    engine.rollback()
    return engine.sql("SELECT CAST(n_nationkey AS INT) n_nationkey, n_name FROM n")


def _nations(spark, d) -> Engine:
    engine = Engine.open_memory(spark)
    engine.sql("CREATE TABLE n (n_nationkey INT PRIMARY KEY, n_name TEXT, n_regionkey INT)")
    engine.sql("CREATE TABLE r (r_regionkey INT PRIMARY KEY, r_name TEXT)")
    engine.insert("n", table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    engine.insert("r", table(spark, d, "region").select("r_regionkey", "r_name"))
    return engine


_N = "SELECT CAST(n_nationkey AS INT) n_nationkey, n_name FROM n"


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
def dml_subquery(spark, d):
    """Subqueries in changes see the tables as they are, not as an earlier query saw them."""
    engine = _nations(spark, d)
    engine.sql("SELECT * FROM r WHERE r_regionkey < 0").count()
    engine.sql("UPDATE r SET r_name = lower(r_name) WHERE r_name NOT LIKE 'A%'")
    engine.sql("DELETE FROM n WHERE n_regionkey IN (SELECT r_regionkey FROM r WHERE r_name LIKE 'A%')")
    return engine.sql(_N)


@query("SELECT n_nationkey, n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey AND r_regionkey > 2)")
def dml_delete_exists(spark, d):
    engine = _nations(spark, d)
    engine.sql("DELETE FROM N WHERE EXISTS (SELECT 1 FROM r WHERE r.r_regionkey = n.n_regionkey AND r.r_regionkey > 2)")
    return engine.sql(_N)


@query("SELECT n_nationkey, CASE WHEN n_regionkey = (SELECT max(r_regionkey) FROM region) THEN 'last' ELSE n_name END AS n_name FROM nation")
def dml_update_subquery(spark, d):
    engine = _nations(spark, d)
    engine.sql("UPDATE n SET n_name = 'last' WHERE n_regionkey = (SELECT max(r_regionkey) FROM r)")
    return engine.sql(_N)


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 3 GROUP BY r_name")
def views(spark, d):
    engine = _nations(spark, d)
    engine.sql("CREATE VIEW named AS SELECT n.n_nationkey, r.r_name FROM n JOIN r ON n.n_regionkey = r.r_regionkey")
    engine.sql("CREATE VIEW counted AS SELECT r_name, count(*) n FROM named GROUP BY r_name")
    engine.sql("DELETE FROM n WHERE n_nationkey = 3")
    return engine.sql("SELECT * FROM counted")


@query("SELECT n_nationkey, n_regionkey AS region, CASE WHEN n_nationkey = 3 THEN 9 ELSE 7 END AS rank FROM nation UNION ALL SELECT 99, 1, 7")
def alter_columns(spark, d):
    engine = _nations(spark, d)
    engine.sql("ALTER TABLE n ADD COLUMN rank INT NOT NULL DEFAULT 7")
    engine.sql("ALTER TABLE n RENAME COLUMN n_regionkey TO region")
    engine.sql("ALTER TABLE n DROP COLUMN n_name")
    engine.sql("UPDATE n SET rank = 9 WHERE n_nationkey = 3 AND rank = 7")
    engine.sql("INSERT INTO n (n_nationkey, region) VALUES (99, 1)")
    return engine.sql("SELECT CAST(n_nationkey AS INT) n_nationkey, CAST(region AS INT) region, CAST(rank AS INT) rank FROM n")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def backup_restore(spark, d):
    engine = _nations(spark, d)
    engine.sql("CREATE VIEW first AS SELECT n_nationkey, n_name FROM n WHERE n_regionkey = 1")
    copy = Engine.open_memory(spark)
    engine.backup(copy.path)
    engine.sql("DELETE FROM n")
    return Engine.open(copy.path, spark).sql("SELECT CAST(n_nationkey AS INT) n_nationkey, n_name FROM first")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 5")
def vacuum_safe(spark, d):
    """Another engine's commit survives a vacuum, and so does what a transaction rolls back to."""
    engine = _nations(spark, d)
    other = Engine.open(engine.path, spark)
    other.sql("DELETE FROM n WHERE n_nationkey < 5")
    engine.vacuum(0)
    engine.begin()
    engine.sql("DELETE FROM n")
    try:
        engine.vacuum(0)
    except RuntimeError:
        engine.rollback()
    return engine.sql(_N)


@query("SELECT n_nationkey, n_name FROM nation")
def compaction(spark, d):
    engine = Engine.open_memory(spark)
    engine.sql("CREATE TABLE n (n_nationkey INT, n_name TEXT, PRIMARY KEY (n_nationkey, n_name), CHECK (n_nationkey >= 0))")
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    for part in ("n_nationkey < 9", "n_nationkey BETWEEN 9 AND 20", "n_nationkey > 20"):
        engine.insert("n", nations.filter(part))
    engine.compact("n")
    return engine.sql(_N)


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 5 THEN 0 ELSE (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) END AS n FROM region")
def foreign_keys(spark, d):
    """Children of no parent and parents of children are refused."""
    from ..tables import ConstraintViolation

    engine = Engine.open_memory(spark)
    engine.sql("CREATE TABLE r (r_regionkey INT PRIMARY KEY, r_name TEXT)")
    engine.sql("CREATE TABLE n (n_nationkey INT PRIMARY KEY, n_regionkey INT, FOREIGN KEY (n_regionkey) REFERENCES r (r_regionkey))")
    engine.insert("r", table(spark, d, "region").select("r_regionkey", "r_name"))
    engine.insert("n", table(spark, d, "nation").select("n_nationkey", "n_regionkey"))
    for bad in ("INSERT INTO n VALUES (100, 77)", "DELETE FROM r WHERE r_regionkey = 1", "UPDATE n SET n_regionkey = -1"):
        try:
            engine.sql(bad)
        except ConstraintViolation:
            continue
        raise AssertionError(bad)
    return engine.sql("SELECT CAST(r_regionkey AS INT) r_regionkey, count(n_nationkey) n FROM r LEFT JOIN n ON n_regionkey = r_regionkey GROUP BY r_regionkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 50, 'NEW'")
def pool_batch(spark, d):
    """Statements of a batch are one transaction; one that fails leaves nothing."""
    engine = _nations(spark, d)
    pool = Pool(engine.path, 2, spark)
    pool.batch([("DELETE FROM n WHERE n_regionkey = ?", [2]), ("INSERT INTO n VALUES (?, ?, ?)", [50, "NEW", 1])]).result()
    failed = pool.batch([("DELETE FROM n", []), ("INSERT INTO n VALUES (1, 'x', 1), (1, 'y', 1)", [])]).exception()
    assert failed is not None
    pool.close()
    return Engine.open(engine.path, spark).sql(_N)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 250000")
def prepared_statement(spark, d):
    engine = Engine.open_memory(spark)
    engine.attach("orders", table(spark, d, "orders"))
    return engine.prepare("SELECT o_orderkey FROM orders WHERE o_orderstatus = ? AND o_totalprice > ?").bind(0, "O").bind(1, 250000).execute()


# ---------------------------------------------------------------- digests and encryption
@query("SELECT c_custkey, sha256(c_name) AS h FROM customer")
def hash_sha256(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("h"))


@query()
def hash_sha3(spark, d):
    return table(spark, d, "customer").select("c_custkey", secure.sha3_256(F.col("c_name")).alias("h"), secure.blake2b(F.col("c_name")).alias("b"))


@query("SELECT event_id, sha256(props) AS h, coalesce(lag(sha256(props)) OVER (ORDER BY event_id), repeat('0', 64)) AS p FROM events")
def audit_chain(spark, d):
    return secure.chain(table(spark, d, "events").select("event_id", "props"), "props", "event_id").select("event_id", F.col("data_hash").alias("h"), F.col("prev_hash").alias("p"))


@query("SELECT event_id FROM events WHERE event_id IN (7, 100, 101)")
def audit_forged(spark, d):
    """Data altered under its old digest, and data altered together with digest and the link of the next entry."""
    sealed = secure.chain(table(spark, d, "events").select("event_id", "props"), "props", "event_id", key=KEY)
    new = F.when(F.col("event_id").isin(7, 100), "forged").otherwise(F.col("props"))
    forged = sealed.withColumn("props", new).withColumn("data_hash", F.when(F.col("event_id") == 100, F.sha2("props", 256)).otherwise(F.col("data_hash")))
    forged = forged.withColumn("prev_hash", F.when(F.col("event_id") == 101, F.sha2(F.lit("forged"), 256)).otherwise(F.col("prev_hash")))
    return secure.broken(forged, "event_id", "props", KEY)


@query("SELECT event_id FROM events WHERE event_id = 101")
def audit_verify(spark, d):
    log = secure.chain(table(spark, d, "events").select("event_id", "props"), "props", "event_id")
    return secure.broken(log.withColumn("data_hash", F.when(F.col("event_id") == 100, "altered").otherwise(F.col("data_hash"))), "event_id")


@query(
    "SELECT 'sha3' AS what, '3a985da74fe225b2045c172d6bd390bd855f086e3e9d525b46bfe24511431532' AS h UNION ALL "
    "SELECT 'blake2b', 'bddd813c634239723171ef3fee98579b94964e3bb1cb3e427262c8c068d52319' UNION ALL "
    "SELECT 'pbkdf2', '120fb6cffcf8b32c43e7225256c4f837a86548c92ccc35480805987cb70be17b' UNION ALL "
    "SELECT 'hkdf', '8da4e775a563c18f715f802a063c5a31b8a11f5c5ee1879ec3454e5f3c738d2d' UNION ALL "
    "SELECT 'hmac', 'f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8' UNION ALL SELECT 'password', 'true'"
)
def key_vectors(spark, d):
    """Published test vectors of the digests and key derivations."""
    abc, salt = spark.range(1), b"salt"
    digests = abc.select(F.explode(F.array(F.struct(F.lit("sha3").alias("what"), secure.sha3_256(F.lit("abc")).alias("h")), F.struct(F.lit("blake2b").alias("what"), secure.blake2b(F.lit("abc")).alias("h")), F.struct(F.lit("hmac").alias("what"), secure.hmac_sha256(b"key", F.lit("The quick brown fox jumps over the lazy dog")).alias("h")))).alias("v")).select("v.*")
    keys = [("pbkdf2", secure.derive_key("password", salt, 1).hex()), ("hkdf", secure.hkdf(bytes([11] * 22), "", 32).hex()), ("password", str(secure.verify_password("p", salt, secure.hash_password("p", salt)) and not secure.verify_password("q", salt, secure.hash_password("p", salt))).lower())]
    return digests.union(spark.createDataFrame(keys, "what string, h string"))


@query("SELECT c_custkey, c_name FROM customer")
def encrypt_roundtrip(spark, d):
    return table(spark, d, "customer").select("c_custkey", secure.decrypt(secure.encrypt(F.col("c_name"), KEY), KEY).alias("c_name"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def encrypted_table(spark, d):
    engine = Engine.open_memory(spark, key=KEY)
    engine.sql("CREATE TABLE c (c_custkey INTEGER PRIMARY KEY, c_name TEXT ENCRYPTED, c_acctbal REAL ENCRYPTED)")
    engine.insert("c", table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"))
    return engine.sql("SELECT * FROM c")


# ---------------------------------------------------------------- extras and streams
@query("SELECT CAST(time_bucket(INTERVAL 5 minutes, ts) AS TIMESTAMP) AS b, count(*) AS c FROM events GROUP BY 1")
def time_bucket(spark, d):
    e = table(spark, d, "events").groupBy(extras.time_bucket("5 minutes", F.col("ts")).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    return e.select(F.col("b").cast("timestamp_ntz").alias("b"), "c")


@query("SELECT CAST(time_bucket(INTERVAL 5 minutes, t) AS TIMESTAMP) AS b, count(*) AS c FROM (SELECT CASE WHEN event_id % 7 <> 0 THEN ts END AS t FROM events) GROUP BY 1")
def time_bucket_nulls(spark, d):
    t = F.when(F.col("event_id") % 7 != 0, F.col("ts"))
    e = table(spark, d, "events").groupBy(extras.time_bucket("5 minutes", t).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    return e.select(F.col("b").cast("timestamp_ntz").alias("b"), "c")


@query("SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS d FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def vector_dot(spark, d):
    e = table(spark, d, "embeddings")
    one = e.filter("vec_id = 0").limit(1).select("embedding").first()  # the vector asked about
    if one is None:
        return e.select("vec_id", F.lit(None).cast("double").alias("d")).limit(0)
    asked = F.array(*[F.lit(float(x)) for x in one[0]])
    return e.select("vec_id", F.round(extras.dot(F.col("embedding"), asked), 9).alias("d"))


@query("SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'the') AND list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'with')")
def fulltext_match(spark, d):
    return table(spark, d, "documents").filter(extras.match(F.col("text"), "the with")).select("doc_id")


_TERMS = "SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))) AS term FROM documents"


@query(_TERMS)
def fulltext_index(spark, d):
    return extras.inverted_index(table(spark, d, "documents"), "doc_id", "text")


@query(f"SELECT doc_id FROM ({_TERMS}) WHERE term IN ('the', 'with') GROUP BY doc_id HAVING count(*) = 2")
def fulltext_search(spark, d):
    """Through the inverted index, kept as a table that is ordered by term."""
    engine = Engine.open_memory(spark)
    engine.sql("CREATE TABLE postings (term TEXT, doc_id INTEGER)")
    engine.sql("CREATE INDEX by_term ON postings (term)")
    engine.insert("postings", extras.inverted_index(table(spark, d, "documents"), "doc_id", "text"))
    return extras.search(engine.table("postings"), "doc_id", "the with")


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS c FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def vector_cosine(spark, d):
    e = table(spark, d, "embeddings")
    one = e.filter("vec_id = 0").limit(1).select(F.col("embedding").alias("asked"))  # a row: the join is a broadcast of it
    return e.join(F.broadcast(one)).select("vec_id", F.round(extras.cosine(F.col("embedding"), F.col("asked")), 9).alias("c"))


@query(
    "SELECT s_suppkey, round(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(s_nationkey * 2.0) - radians(10.0)) / 2), 2) + "
    "cos(radians(10.0)) * cos(radians(s_nationkey * 2.0)) * pow(sin(radians(s_suppkey % 90 - 20.0) / 2), 2)))), 3) AS km FROM supplier"
)
def spatial_distance(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", F.round(extras.haversine_km(F.lit(10.0), F.lit(20.0), F.col("s_nationkey") * 2.0, F.col("s_suppkey") % 90 + F.lit(0.0)), 3).alias("km"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, d):
    """The stream's query over the whole table as a batch; the tests run it as a stream."""
    out = streaming.windowed(table(spark, d, "events"), "1 hour", ["event_type"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(
    "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1800500 milliseconds THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o) "
    "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1800500 milliseconds AS session_end, count(*) AS n FROM g GROUP BY user_id, s"
)
def stream_sessions(spark, d):
    out = streaming.sessions(table(spark, d, "events"), "1800500 milliseconds", ["user_id"])
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("SELECT event_id, event_type FROM events")
def stream_into_table(spark, d):
    """A stream of files that runs to its end: each event once, in a table of an engine."""
    engine = Engine.open_memory(spark)
    engine.sql("CREATE TABLE e (event_id INTEGER, event_type TEXT)")
    events = table(spark, d, "events").select("event_id", "event_type", "ts")
    folder = f"{engine.path}/stream"
    events.union(events.limit(50)).repartition(3).write.parquet(f"{folder}/in")
    stream = streaming.once(streaming.source(spark, f"{folder}/in", events.schema, 1), "event_id", late="100000 days").select("event_id", "event_type")
    streaming.into_table(stream, engine, "e", f"{folder}/checkpoint").awaitTermination()
    return engine.sql("SELECT event_id, event_type FROM e")
