"""Random predicates and joins over tables full of nulls, against DuckDB."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corundum import Engine

ROWS = [(k, v, s) for k in (None, 0, 1, 2) for v in (None, -1.5, 0.0, 2.0) for s in (None, "", "a", "b%")]

atoms = st.one_of(
    st.builds("k {} {}".format, st.sampled_from(["=", "<>", "<", "<=", ">", ">="]), st.sampled_from(["0", "1", "NULL", "v"])),
    st.builds("s {} {}".format, st.sampled_from(["=", "<>", "<", ">=", "LIKE", "NOT LIKE"]), st.sampled_from(["''", "'a'", "'b%'", "'%'", "NULL"])),
    st.builds("{} IS {}NULL".format, st.sampled_from("kvs"), st.sampled_from(["", "NOT "])),
    st.builds("k {}IN ({})".format, st.sampled_from(["", "NOT "]), st.sampled_from(["0", "1, 2", "0, NULL"])),
    st.builds("v {}BETWEEN {} AND {}".format, st.sampled_from(["", "NOT "]), st.sampled_from(["-2", "0"]), st.sampled_from(["0", "2", "NULL"])),
    st.builds("k IS {}DISTINCT FROM v".format, st.sampled_from(["", "NOT "])),
)
predicates = st.recursive(atoms, lambda p: st.one_of(st.builds("({} AND {})".format, p, p), st.builds("({} OR {})".format, p, p), st.builds("NOT ({})".format, p)), max_leaves=5)


@pytest.fixture(scope="module")
def both(spark):
    engine, con = Engine.open_memory(spark), duckdb.connect()
    for t in ("a", "b"):
        engine.sql(f"CREATE TABLE {t} (k INTEGER, v REAL, s TEXT)")
        engine.insert(t, spark.createDataFrame(ROWS[:: 1 if t == "a" else 3], "k bigint, v double, s string").coalesce(1))
        con.sql(f"CREATE TABLE {t} (k BIGINT, v DOUBLE, s VARCHAR)")
        con.executemany(f"INSERT INTO {t} VALUES (?, ?, ?)", ROWS[:: 1 if t == "a" else 3])
    return engine, con


def same(both, sql):
    engine, con = both
    assert sorted((tuple(r) for r in engine.sql(sql).collect()), key=repr) == sorted(con.sql(sql).fetchall(), key=repr)


@settings(max_examples=25, deadline=None)
@given(predicates)
def test_where(both, p):
    same(both, f"SELECT k, v, s FROM a WHERE {p}")


@settings(max_examples=15, deadline=None)
@given(st.sampled_from(["JOIN", "LEFT JOIN", "RIGHT JOIN", "FULL JOIN"]), st.sampled_from(["a.k = b.k", "a.k IS NOT DISTINCT FROM b.k", "a.k = b.k AND a.s = b.s", "a.k = b.k AND a.v < b.v"]), predicates)
def test_join(both, how, on, p):
    same(both, f"SELECT x.k, count(*) n, count(w) m, min(t) lo FROM (SELECT a.k, b.v w, b.s t FROM (SELECT * FROM a WHERE {p}) a {how} b ON {on}) x GROUP BY x.k")
