"""Dialect, tables, transactions, prepared statements, indexes, encryption, pools and the shell."""

import io
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corundum import Conflict, ConstraintViolation, Engine, dialect, types
from corundum.cli import Shell
from corundum.session import Pool
from corundum.tables import NoSuchTable
from pyspark.sql import types as T


@pytest.fixture
def engine(spark):
    e = Engine.open_memory(spark)
    e.sql("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT NOT NULL, email TEXT UNIQUE, score REAL)")
    e.sql("INSERT INTO users VALUES (1, 'Alice', 'a@x', 1.5), (2, 'Bob', NULL, -2.25), (3, 'Cy', NULL, NULL)")
    return e


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_create_and_types(engine):
    assert engine.schema("users") == T.StructType(
        [T.StructField("id", T.LongType(), False, {"pk": True}), T.StructField("name", T.StringType(), False), T.StructField("email", T.StringType(), True, {"unique": True}), T.StructField("score", T.DoubleType())]
    )
    with pytest.raises(ValueError):
        engine.sql("CREATE TABLE users (id INTEGER)")
    engine.sql("CREATE TABLE IF NOT EXISTS users (id INTEGER)")
    with pytest.raises(types.UnknownType):
        engine.sql("CREATE TABLE t (a POINT)")
    with pytest.raises(dialect.SqlError):
        engine.sql("CREATE TABLE t (a INTEGER, A TEXT)")
    engine.sql("DROP TABLE users")
    assert engine.tables() == []
    engine.sql("DROP TABLE IF EXISTS users")
    with pytest.raises(NoSuchTable):
        engine.sql("DROP TABLE users")


def test_insert(engine):
    assert engine.sql("INSERT INTO users (name, id) VALUES ('Di', 4), ('Ed', ?)", [5]).affected_rows == 2
    assert values(engine.sql("SELECT id, name, email FROM users WHERE id > 3")) == [(4, "Di", None), (5, "Ed", None)]
    assert engine.sql("INSERT INTO users (id, name) SELECT id + 10, upper(name) FROM users").affected_rows == 5
    for bad, error in (
        ("INSERT INTO users VALUES (1, 'x', NULL, 0)", ConstraintViolation),
        ("INSERT INTO users VALUES (7, 'x', 'a@x', 0)", ConstraintViolation),
        ("INSERT INTO users VALUES (7, NULL, NULL, 0)", ConstraintViolation),
        ("INSERT INTO users VALUES (8, 'x', NULL, 0), (8, 'y', NULL, 0)", ConstraintViolation),
        ("INSERT INTO users VALUES (8, 'x')", ValueError),
        ("INSERT INTO users (id, nope) VALUES (8, 1)", ValueError),
        ("INSERT INTO nobody VALUES (1)", NoSuchTable),
        ("INSERT INTO users VALUES (9, 'z', NULL, 0) more nonsense", Exception),
    ):
        with pytest.raises(error):
            engine.sql(bad)
    assert engine.sql("SELECT count(*) FROM users").first()[0] == 10
    assert engine.stats().rows == 10


def test_update_delete(engine):
    assert engine.sql("UPDATE users SET score = score * 2 + ?, name = concat(name, '!') WHERE score > ? OR id = 3", [1, 0]).affected_rows == 2
    assert values(engine.sql("SELECT id, name, score FROM users")) == [(1, "Alice!", 4.0), (2, "Bob", -2.25), (3, "Cy!", None)]
    assert engine.sql("UPDATE users SET score = 0 WHERE id = 99").affected_rows == 0
    with pytest.raises(ConstraintViolation):
        engine.sql("UPDATE users SET id = 1 WHERE id = 2")
    with pytest.raises(ConstraintViolation):
        engine.sql("UPDATE users SET name = NULL")
    with pytest.raises(ValueError):
        engine.sql("UPDATE users SET nope = 1")
    assert engine.sql("DELETE FROM users WHERE score < 0").affected_rows == 1
    assert engine.sql("DELETE FROM users WHERE score <> 0").affected_rows == 1  # a null score does not match
    assert engine.sql("DELETE FROM users").affected_rows == 1
    assert engine.sql("SELECT * FROM users").count() == 0


def test_only_touched_files_are_rewritten(engine):
    engine.sql("INSERT INTO users (id, name) VALUES (10, 'x')")
    before = set(engine.store.state("users").files)
    engine.sql("UPDATE users SET name = 'y' WHERE id = 10")
    after = set(engine.store.state("users").files)
    assert len(before & after) == len(before) - 1
    assert engine.vacuum() == 0 and engine.vacuum(0) > 0  # a day is kept by default
    assert engine.sql("SELECT count(*) FROM users").first()[0] == 4


def test_transactions(engine):
    with pytest.raises(ZeroDivisionError), engine.transaction():
        engine.sql("DELETE FROM users")
        engine.sql("CREATE TABLE other (a INTEGER)")
        assert engine.sql("SELECT * FROM users").count() == 0
        1 / 0  # noqa: B018
    assert engine.tables() == ["users"] and engine.sql("SELECT * FROM users").count() == 3
    engine.sql("BEGIN TRANSACTION")
    engine.sql("DELETE FROM users WHERE id = 1")
    engine.sql("COMMIT")
    assert engine.sql("SELECT * FROM users").count() == 2
    with pytest.raises(RuntimeError):
        engine.sql("ROLLBACK")


def test_conflict_and_reopen(engine, spark):
    other = Engine.open(engine.path, spark)
    assert values(other.sql("SELECT id FROM users")) == [(1,), (2,), (3,)]
    engine.begin()
    engine.sql("DELETE FROM users WHERE id = 1")
    other.sql("DELETE FROM users WHERE id = 2")
    with pytest.raises(Conflict):
        engine.commit()
    assert values(engine.sql("SELECT id FROM users")) == [(1,), (3,)]
    assert engine.info().is_memory and not other.info().is_memory


def test_prepared(engine):
    p = engine.prepare("SELECT name FROM users WHERE id = ? AND name LIKE ?")
    assert p.count == 2
    assert values(p.bind(0, 1).bind(1, "A%").execute()) == [("Alice",)]
    assert values(p.execute(2, "B%")) == [("Bob",)]
    p.reset()
    assert p.values == [None, None] and values(p.execute()) == []
    with pytest.raises(IndexError):
        p.bind(2, 1)
    with pytest.raises(ValueError):
        p.execute(1)
    assert engine.prepare("INSERT INTO users (id, name, score) VALUES (?, ?, ?)").execute(9, "It's; -- ?", 0.1).affected_rows == 1
    assert engine.prepare("UPDATE users SET name = ? WHERE name = ?").execute("q'\\n", "It's; -- ?").affected_rows == 1
    assert engine.sql("SELECT name FROM users WHERE id = 9").first()[0] == "q'\\n"


def test_literals(engine):
    from datetime import date, datetime
    from decimal import Decimal

    given = [None, True, -5, 2**40, 0.1, Decimal("1.50"), datetime(2024, 1, 2, 3, 4, 5), date(2024, 1, 2), b"\x00'", "é'\\\n\"?:p1"]
    got = engine.sql("SELECT " + ", ".join("?" * len(given)), given).first()
    assert [bytes(v) if isinstance(v, bytearray) else v for v in got] == given
    assert engine.sql("SELECT id FROM users ORDER BY id LIMIT ? OFFSET ?", [1, 1]).first().id == 2


def test_defaults_and_blobs(engine):
    engine.sql("CREATE TABLE d (a INTEGER, b TEXT DEFAULT 'none', c BLOB, e DECIMAL(10, 2))")
    engine.sql("INSERT INTO d (a, c, e) VALUES (9223372036854775807, X'00ff', 1.25)")
    r = engine.sql("SELECT * FROM d").first()
    assert (r.a, r.b, bytes(r.c), str(r.e)) == (2**63 - 1, "none", b"\x00\xff", "1.25")


def test_close(spark):
    import os

    e = Engine.open_memory(spark)
    e.sql("CREATE TABLE t (a INTEGER)")
    e.begin()
    folder = e.path.removeprefix("file:")
    assert os.path.exists(folder)
    e.close()
    assert not os.path.exists(folder)


def test_views(engine, spark):
    engine.sql("CREATE VIEW named AS SELECT id, upper(name) AS big FROM users WHERE id < 3")
    engine.sql("CREATE VIEW one AS SELECT big FROM named WHERE id = 1")
    assert values(engine.sql("SELECT * FROM one")) == [("ALICE",)]
    assert values(Engine.open(engine.path, spark).sql("SELECT big FROM named")) == [("ALICE",), ("BOB",)]
    engine.sql("UPDATE users SET name = 'al' WHERE id = 1")
    assert values(engine.sql("SELECT * FROM one")) == [("AL",)]
    for bad in ("CREATE VIEW one AS SELECT 1", "CREATE VIEW users AS SELECT 1", "CREATE VIEW x AS SELECT nope FROM users"):
        with pytest.raises(Exception):  # noqa: B017
            engine.sql(bad)
    engine.sql("CREATE OR REPLACE VIEW one AS SELECT 2 AS two")
    engine.sql("DROP VIEW named")
    assert values(engine.sql("SELECT * FROM one")) == [(2,)]


def test_alter(engine, spark):
    engine.sql("ALTER TABLE users ADD COLUMN age INTEGER")
    engine.sql("UPDATE users SET age = 30 WHERE id = 1")
    engine.sql("ALTER TABLE users RENAME COLUMN age TO years")
    assert values(engine.sql("SELECT id, years FROM users")) == [(1, 30), (2, None), (3, None)]
    engine.sql("ALTER TABLE users DROP COLUMN years")
    engine.sql("ALTER TABLE users ADD years REAL")
    assert values(engine.sql("SELECT years FROM users")) == [(None,)] * 3
    engine.sql("INSERT INTO users (id, name, years) VALUES (4, 'Di', 1.5)")
    engine.sql("ALTER TABLE users RENAME TO people")
    assert values(Engine.open(engine.path, spark).sql("SELECT years FROM people WHERE id > 2")) == [(1.5,), (None,)]
    engine.sql("CREATE INDEX by_name ON people (name)")
    for bad in ("ALTER TABLE people ADD name TEXT", "ALTER TABLE people ADD x TEXT NOT NULL", "ALTER TABLE people DROP name", "ALTER TABLE people RENAME id TO email", "ALTER TABLE people DROP nope", "ALTER TABLE people CHANGE id x"):
        with pytest.raises(ValueError):
            engine.sql(bad)


def test_check(engine):
    engine.sql("CREATE TABLE c (a INTEGER CHECK (a > 0 AND a < 10) DEFAULT 5, b TEXT)")
    engine.sql("INSERT INTO c (a, b) VALUES (1, 'x'), (NULL, 'y')")
    engine.sql("INSERT INTO c (b) VALUES ('z')")
    with pytest.raises(ConstraintViolation):
        engine.sql("INSERT INTO c VALUES (10, 'x')")
    with pytest.raises(ConstraintViolation):
        engine.sql("UPDATE c SET a = a - 5 WHERE b = 'x'")
    assert values(engine.sql("SELECT a FROM c")) == [(1,), (5,), (None,)]


def test_indexes(engine):
    engine.sql("CREATE INDEX by_name ON users (name, id)")
    engine.sql("CREATE UNIQUE INDEX by_score ON users (score)")
    engine.sql("INSERT INTO users (id, name, score) VALUES (4, 'Bob', 9)")
    assert values(engine.lookup("by_name", "Bob").select("id")) == [(2,), (4,)]
    assert values(engine.lookup("by_name", "Bob", 4).select("id")) == [(4,)]
    assert values(engine.range("by_name", ("Alice", 2), ("Bob", 2)).select("id")) == [(2,)]
    assert values(engine.range("by_score", None, 1.5).select("id")) == [(1,), (2,)]
    with pytest.raises(ConstraintViolation):
        engine.sql("INSERT INTO users (id, name, score) VALUES (5, 'x', 9)")
    with pytest.raises(ConstraintViolation):
        engine.sql("CREATE UNIQUE INDEX again ON users (name)")
    assert engine.stats().indexes == 2
    engine.sql("DROP INDEX by_score")
    with pytest.raises(KeyError):
        engine.lookup("by_score", 1)


def test_encrypted_columns(spark):
    key = bytes(32)
    e = Engine.open_memory(spark, key=key)
    e.sql("CREATE TABLE s (id INTEGER, secret TEXT ENCRYPTED, n REAL ENCRYPTED)")
    e.sql("INSERT INTO s VALUES (1, 'hush', 2.5), (2, NULL, NULL)")
    e.sql("UPDATE s SET secret = concat(secret, '!') WHERE n > 2")
    assert values(e.sql("SELECT * FROM s")) == [(1, "hush!", 2.5), (2, None, None)]
    assert b"hush" not in bytes(e.store.raw("s").filter("id = 1").first().secret)
    wrong = Engine.open(e.path, spark, key=bytes([1] * 32))
    assert values(wrong.sql("SELECT secret FROM s")) == [(None,), (None,)]
    with pytest.raises(ValueError):
        Engine.open(e.path, spark).sql("INSERT INTO s VALUES (3, 'x', 1)")


def test_backup(engine, spark, tmp_path):
    engine.sql("CREATE INDEX by_name ON users (name)")
    engine.backup(str(tmp_path / "copy"))
    engine.sql("DELETE FROM users")
    copy = Engine.open(str(tmp_path / "copy"), spark)
    assert copy.sql("SELECT * FROM users").count() == 3 and copy.stats().indexes == 1


def test_queries_over_tables_and_frames(engine, spark):
    engine.attach("extra", spark.createDataFrame([(1, "x"), (1, "y")], "id bigint, tag string"))
    q = "SELECT u.name, count(e.tag) n FROM users u LEFT JOIN extra e ON u.id = e.id GROUP BY u.name HAVING count(*) > 0 ORDER BY n DESC, name LIMIT 2"
    assert [tuple(r) for r in engine.sql(q).collect()] == [("Alice", 2), ("Bob", 0)]
    assert [r.id for r in engine.stream("SELECT id FROM users WHERE id < :most ORDER BY id", {"most": 3})] == [1, 2]
    for bad in ("SELECT nope FROM users", "SELECT * FROM users WHERE id =", "SELECT * FROM users extra words", "nonsense", "SELECT 1; SELECT 2", "DELETE FROM users WHERE id = 1 garbage ("):
        with pytest.raises(Exception):  # noqa: B017
            engine.sql(bad)
    assert engine.sql("select * from users -- all\nwhere id <> 2;").count() == 2


def test_subqueries_in_changes(engine, spark):
    engine.attach("extra", spark.createDataFrame([(1,), (7,)], "id bigint"))
    assert engine.sql("DELETE FROM users WHERE id IN (SELECT id FROM extra)").affected_rows == 1
    assert engine.sql("UPDATE users SET score = 7 WHERE EXISTS (SELECT 1 FROM extra e WHERE e.id = users.id + 5)").affected_rows == 1
    assert values(engine.sql("SELECT id FROM users WHERE score = 7")) == [(2,)]
    assert values(engine.sql("SELECT id FROM Users")) == [(2,), (3,)]


def test_pool(engine, spark):
    pool = Pool(engine.path, 2, spark)
    a, b = pool.acquire(), pool.try_acquire()
    assert pool.try_acquire() is None and pool.stats() == {"size": 2, "free": 0, "used": 2}
    timer = threading.Timer(0.2, pool.release, [a])
    timer.start()
    assert pool.acquire(5) is a
    pool.release(a), pool.release(b)
    jobs = [pool.submit("SELECT name FROM users WHERE id = ?", [i]) for i in (1, 2, 3)]
    assert [j.result()[0].name for j in jobs] == ["Alice", "Bob", "Cy"]
    assert pool.batch([("DELETE FROM users WHERE id = ?", [1]), ("UPDATE users SET score = 0", [])]).result().affected_rows == 3
    with pytest.raises(ConstraintViolation):
        pool.batch([("DELETE FROM users WHERE id = 2", []), ("UPDATE users SET name = NULL", [])]).result()
    assert pool.submit("SELECT count(*) n FROM users").result()[0].n == 2
    pool.close()


def test_shell(engine):
    out = io.StringIO()
    shell = Shell(engine, out)
    for line in (".help", ".tables", ".schema users", ".stats", "SELECT id, score FROM users ORDER BY id", ".prepare SELECT name FROM users WHERE id = ?", ".bind 0 2", ".execute", "DELETE FROM users WHERE id = 3", ".nope", "", ".close", "SELECT 1"):
        assert shell.run(line)
    assert not shell.run(".quit")
    text = out.getvalue()
    for part in ("users", "1\t1.50", "3\tNULL", "1 parameters", "Bob", "1 rows", "unknown command .nope", "no database is open"):
        assert part in text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["a", "`b c`", "1", "2.5", "?", "(", ")", ",", "=", "<>", "AND", "'it''s ?'", '"x?"', "-- ?\n", "/* ? */", "||"]))))
def test_parameters_are_found_outside_strings_and_comments(parts):
    sql = " ".join(parts)
    text, n = dialect.parameters(sql)
    assert n == parts.count("?")
    assert dialect.fill(text, {f"p{i}": "?" for i in range(n)}) == sql


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_parses_or_raises(text):
    try:
        dialect.parse(text)
    except (dialect.SqlError, types.UnknownType):
        pass


# ---------------------------------------------------------------- nothing that is committed goes
def test_vacuum_keeps_what_others_use(engine, spark):
    other = Engine.open(engine.path, spark)
    other.sql("DELETE FROM users WHERE id = 1")
    assert engine.vacuum() == 0  # a day of versions stays
    assert engine.vacuum(0) > 0  # the last version is the other's
    assert values(Engine.open(engine.path, spark).sql("SELECT id FROM users")) == values(engine.sql("SELECT id FROM users")) == [(2,), (3,)]
    engine.begin()
    engine.sql("DELETE FROM users")
    with pytest.raises(RuntimeError):
        engine.vacuum(0)
    engine.rollback()
    assert values(engine.sql("SELECT id FROM users")) == [(2,), (3,)]


def test_one_of_many_writers_wins(engine):
    files, won = engine.store.files, []
    start = threading.Barrier(8)

    def run(i):
        start.wait()
        if files.create("catalog/race.txt", f"{i}"):
            won.append(i)

    for _ in range(20):
        won.clear()
        files.delete("catalog/race.txt")
        threads = [threading.Thread(target=run, args=(i,)) for i in range(8)]
        [t.start() for t in threads], [t.join() for t in threads]
        assert len(won) == 1 and files.read("catalog/race.txt") == str(won[0])
    assert not [n for n in files.names("catalog") if n.endswith(".tmp")]


def test_changes_see_tables_as_they_are(engine):
    engine.sql("CREATE TABLE b (id INTEGER)")
    engine.sql("INSERT INTO b VALUES (1)")
    assert engine.sql("SELECT * FROM b").count() == 1
    engine.sql("INSERT INTO b VALUES (3), (NULL)")
    assert engine.sql("DELETE FROM users WHERE id NOT IN (SELECT id FROM b)").affected_rows == 0  # unknown is not true
    assert engine.sql("UPDATE users SET score = (SELECT max(id) FROM b) WHERE id IN (SELECT id FROM b)").affected_rows == 2
    assert engine.sql("DELETE FROM Users WHERE id IN (SELECT id FROM B)").affected_rows == 2
    assert values(engine.sql("SELECT id, score FROM users")) == [(2, -2.25)]


def test_names_are_alike_whatever_their_case(engine):
    engine.sql("INSERT INTO USERS (ID, Name) VALUES (9, 'x')")
    assert engine.tables() == ["users"] and engine.sql("SELECT * FROM Users").count() == 4
    for bad in ("CREATE TABLE Users (a INTEGER)", "CREATE VIEW USERS AS SELECT 1"):
        with pytest.raises(ValueError):
            engine.sql(bad)
    engine.sql("CREATE INDEX By_Name ON Users (NAME)")
    assert engine.lookup("by_name", "x").count() == 1
    engine.sql("DROP TABLE uSERS")
    assert engine.tables() == []


def test_defaults_of_new_columns(spark):
    e = Engine.open_memory(spark, key=bytes(32))
    e.sql("CREATE TABLE t (a INTEGER)")
    e.sql("INSERT INTO t VALUES (1), (2)")
    e.sql("ALTER TABLE t ADD COLUMN b INTEGER NOT NULL DEFAULT 7")
    e.sql("ALTER TABLE t ADD c TEXT DEFAULT 'x'")
    with pytest.raises(ValueError):
        e.sql("ALTER TABLE t ADD d TEXT ENCRYPTED DEFAULT 'x'")
    e.sql("INSERT INTO t VALUES (3, 8, NULL)")
    e.sql("INSERT INTO t (a) VALUES (4)")
    assert values(e.sql("SELECT * FROM t")) == [(1, 7, "x"), (2, 7, "x"), (3, 8, None), (4, 7, "x")]
    assert values(e.sql("SELECT a FROM t WHERE b = 7")) == [(1,), (2,), (4,)]
    e.sql("UPDATE t SET b = 1 WHERE a = 1")
    assert values(Engine.open(e.path, spark, key=bytes(32)).sql("SELECT a, b, c FROM t")) == [(1, 1, "x"), (2, 7, "x"), (3, 8, None), (4, 7, "x")]
    with pytest.raises(ConstraintViolation):
        e.sql("ALTER TABLE t ADD d INTEGER DEFAULT 1 CHECK (d > 1)")
    assert e.sql("SELECT * FROM t").columns == ["a", "b", "c"]


def test_table_constraints(engine):
    engine.sql("CREATE TABLE p (a INTEGER, b TEXT, c INTEGER, CONSTRAINT k PRIMARY KEY (a, b), UNIQUE (c), CHECK (a < c))")
    engine.sql("CREATE TABLE f (x INTEGER, y TEXT, FOREIGN KEY (x, y) REFERENCES p (a, b))")
    engine.sql("INSERT INTO p VALUES (1, 'x', 2), (1, 'y', 3)")
    engine.sql("INSERT INTO f VALUES (1, 'x'), (NULL, 'q'), (1, NULL)")
    for bad in ("INSERT INTO p VALUES (1, 'x', 9)", "INSERT INTO p VALUES (2, 'x', 3)", "INSERT INTO p VALUES (5, 'x', 4)", "INSERT INTO p VALUES (5, NULL, 14)", "INSERT INTO f VALUES (1, 'z')", "DELETE FROM p WHERE b = 'x'", "UPDATE p SET b = 'w'", "DELETE FROM p", "DROP TABLE p", "UPDATE f SET y = 'z' WHERE y = 'x'"):
        with pytest.raises(ConstraintViolation):
            engine.sql(bad)
    assert engine.sql("DELETE FROM p WHERE b = 'y'").affected_rows == 1
    for bad in ("CREATE TABLE g (a INTEGER, FOREIGN KEY (a) REFERENCES p (a))", "CREATE TABLE g (a INTEGER, PRIMARY KEY (b))", "CREATE TABLE g (a INTEGER PRIMARY KEY, b INTEGER, PRIMARY KEY (b))"):
        with pytest.raises(ValueError):
            engine.sql(bad)


def test_lookups_read_only_files_that_can_hold_the_key(engine, spark):
    engine.sql("CREATE TABLE t (a INTEGER, b TEXT)")
    for low in (0, 100, 200):
        engine.insert("t", spark.range(low, low + 100).selectExpr("id", "concat('b', id % 10)").coalesce(1))
    engine.sql("CREATE INDEX by_a ON t (a)")
    engine.compact("t", 60)
    files = engine.store.state("t").files
    assert len(files) == 5
    assert len(engine.store.candidates("t", {"a": (7, 7)})) == 1 < len(engine.store.candidates("t", {"a": (50, 130)})) < 5
    assert values(engine.lookup("by_a", 7)) == [(7, "b7")] and engine.lookup("by_a", 1000).count() == 0 and engine.lookup("by_a", None).count() == 0
    assert engine.range("by_a", 95, 104).count() == 10
    assert values(engine.lookup_many("by_a", spark.createDataFrame([(5,), (299,), (5,), (None,), (999,)], "a bigint"))) == [(299, "b9"), (5, "b5")]
    assert engine.lookup_many("by_a", spark.createDataFrame([], "a bigint")).count() == 0
    engine.sql("CREATE HASH INDEX by_b ON t (b)")
    assert engine.lookup("by_b", "b3").count() == 30 and engine.store.state("t").rows == 300


def test_backup_holds_views_and_constraints(engine, spark, tmp_path):
    engine.sql("CREATE VIEW v AS SELECT id FROM users WHERE id > 1")
    engine.backup(str(tmp_path / "b"))
    copy = Engine.open(str(tmp_path / "b"), spark)
    assert values(copy.sql("SELECT * FROM v")) == [(2,), (3,)]
    with pytest.raises(ConstraintViolation):
        copy.sql("INSERT INTO users VALUES (1, 'x', NULL, 0)")
    with pytest.raises(ValueError):
        engine.backup(str(tmp_path / "b"))


def test_passwords(spark, tmp_path):
    e = Engine.open_encrypted(str(tmp_path / "e"), "open sesame", spark)
    e.sql("CREATE TABLE t (a TEXT ENCRYPTED)")
    e.sql("INSERT INTO t VALUES ('secret')")
    assert values(Engine.open_encrypted(str(tmp_path / "e"), "open sesame", spark).sql("SELECT a FROM t")) == [("secret",)]
    with pytest.raises(PermissionError):
        Engine.open_encrypted(str(tmp_path / "e"), "wrong", spark)
    assert values(Engine.open(str(tmp_path / "e"), spark).sql("SELECT cast(a AS string) LIKE '%secret%' FROM t")) == [(False,)]


def test_a_repeated_batch_is_in_once(engine, spark):
    engine.sql("CREATE TABLE s (a INTEGER)")
    batch = spark.createDataFrame([(1,), (2,)], "a bigint")
    assert engine.insert("s", batch, batch=("q", 0)).affected_rows == 2
    assert engine.insert("s", batch, batch=("q", 0)).affected_rows == 0
    assert Engine.open(engine.path, spark).insert("s", batch, batch=("q", 0)).affected_rows == 0
    assert engine.insert("s", batch, batch=("q", 1)).affected_rows == 2 and engine.sql("SELECT * FROM s").count() == 4
