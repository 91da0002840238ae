"""Mutable tables: DML, constraints, views, triggers, prepared statements, transactions."""

import pytest

from stratalog.engine.errors import ConflictError, EngineError
from stratalog.engine.session import Session, outside, split_top


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/db"


@pytest.fixture
def db(spark, root):
    s = Session(spark, root)
    s.sql("CREATE TABLE t (key TEXT PRIMARY KEY, value TEXT)")
    s.sql("INSERT INTO t VALUES ('k1', 'v1'), ('k2', 'v2')")
    return s


def rows(db, sql="SELECT * FROM t ORDER BY key"):
    return [tuple(r) for r in db.sql(sql).collect()]


def test_parts_of_statements():
    assert split_top("a = f(b, c), d = 'x, y'") == ["a = f(b, c)", "d = 'x, y'"]
    assert outside("a = 'x WHERE y' WHERE b = 1", "WHERE") == ("a = 'x WHERE y'", "b = 1")
    assert outside("a = (SELECT 1 WHERE true)", "WHERE")[1] is None


def test_insert_modes(db):
    db.sql("INSERT INTO t VALUES ('k1', 'new')")
    assert rows(db) == [("k1", "new"), ("k2", "v2")]
    db.sql("INSERT OR IGNORE INTO t VALUES ('k1', 'no'), ('k3', 'first'), ('k3', 'second')")
    assert rows(db) == [("k1", "new"), ("k2", "v2"), ("k3", "first")]
    for mode in ("ABORT", "FAIL"):
        with pytest.raises(EngineError, match="UNIQUE"):
            db.sql(f"INSERT OR {mode} INTO t VALUES ('k4', 'x'), ('k1', 'y')")
    db.sql("INSERT OR REPLACE INTO t (value, key) VALUES ('a', 'k2'), ('b', 'k2')")
    assert rows(db) == [("k1", "new"), ("k2", "b"), ("k3", "first")]
    with pytest.raises(EngineError, match="values for"):
        db.sql("INSERT INTO t VALUES ('k9')")


def test_insert_select_update_delete(db):
    db.sql("CREATE TABLE s (key TEXT PRIMARY KEY, value TEXT)")
    db.sql("INSERT INTO s SELECT concat(key, '!'), value FROM t WHERE key = 'k1'")
    assert rows(db, "SELECT * FROM s") == [("k1!", "v1")]
    db.sql("UPDATE t SET value = concat(value, '+') WHERE key IN (SELECT key FROM t WHERE value = 'v2')")
    assert rows(db) == [("k1", "v1"), ("k2", "v2+")]
    db.sql("UPDATE t SET key = concat(key, 'x') WHERE key = 'k1'")
    assert rows(db) == [("k1x", "v1"), ("k2", "v2+")]
    db.sql("UPDATE s SET value = (SELECT max(value) FROM t)")
    assert rows(db, "SELECT value FROM s") == [("v2+",)]
    db.sql("DELETE FROM t WHERE value LIKE 'v2%' AND EXISTS (SELECT 1 FROM s WHERE s.value = t.value)")
    assert rows(db) == [("k1x", "v1")]
    db.sql("DELETE FROM t")
    assert rows(db) == []


def test_update_sees_earlier_assignments(db):
    db.sql("CREATE TABLE n (k INTEGER PRIMARY KEY, a INTEGER, b INTEGER)")
    db.sql("INSERT INTO n VALUES (1, 1, 10)")
    db.sql("UPDATE n SET a = a + 1, b = a * 5")
    assert rows(db, "SELECT * FROM n") == [(1, 2, 10)]


def test_constraints_and_defaults(db):
    db.sql("CREATE TABLE c (key TEXT PRIMARY KEY, x INTEGER NOT NULL CHECK (x > 0), y TEXT DEFAULT 'd')")
    db.sql("INSERT INTO c (key, x) VALUES ('k', 1)")
    for bad in ("('l', 0)", "('l', NULL)", "(NULL, 1)"):
        with pytest.raises(EngineError, match="constraint failed"):
            db.sql(f"INSERT INTO c (key, x) VALUES {bad}")
    with pytest.raises(EngineError, match="CHECK"):
        db.sql("UPDATE c SET x = -1")
    assert rows(db, "SELECT * FROM c") == [("k", 1, "d")]
    assert rows(db, "PRAGMA table_info(c)")[1] == (1, "x", "bigint", 1, None, 0)


def test_tables_without_key(db):
    db.sql("CREATE TABLE u (x)")
    db.sql("INSERT INTO u VALUES (NULL), (1), (1)")
    assert rows(db, "SELECT COUNT(*), COUNT(x) FROM u") == [(3, 2)]
    db.sql("DELETE FROM u WHERE x = '1'")
    assert rows(db, "SELECT * FROM u") == [(None,)]


def test_views_triggers_prepared(db):
    db.sql("CREATE VIEW v AS SELECT value FROM t WHERE key = 'k1'")
    db.sql("CREATE TABLE log (n INTEGER PRIMARY KEY, what TEXT)")
    db.sql("CREATE TRIGGER g AFTER UPDATE ON t BEGIN INSERT INTO log SELECT COUNT(*) + 1, 'seen' FROM log; END")
    db.sql("PREPARE p AS UPDATE t SET value = 'z' WHERE key = 'k1'")
    db.sql("EXECUTE p")
    db.sql("EXECUTE p")
    assert rows(db, "SELECT * FROM v") == [("z",)]
    assert rows(db, "SELECT * FROM log ORDER BY n") == [(1, "seen"), (2, "seen")]
    db.sql("PREPARE q AS SELECT value FROM t WHERE key = ?")
    assert rows(db, "EXECUTE q('k2')") == [("v2",)]
    db.sql("DROP TRIGGER g")
    db.sql("DROP VIEW v")
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        db.sql("SELECT * FROM v")
    with pytest.raises(EngineError, match="no such table"):
        db.sql("DELETE FROM missing")


def test_transactions(spark, root, db):
    other = Session(spark, root)
    db.sql("BEGIN")
    db.sql("INSERT INTO t VALUES ('k3', 'mine')")
    db.sql("SAVEPOINT s")
    db.sql("DELETE FROM t")
    assert rows(db) == []
    db.sql("ROLLBACK TO s")
    assert len(rows(db)) == 3
    assert len(rows(other)) == 2
    other.sql("UPDATE t SET value = 'theirs' WHERE key = 'k2'")
    assert ("k2", "v2") in rows(db)
    db.sql("COMMIT")
    assert rows(other) == [("k1", "v1"), ("k2", "theirs"), ("k3", "mine")]
    db.sql("BEGIN")
    db.sql("DELETE FROM t")
    db.sql("ROLLBACK")
    assert len(rows(db)) == 3


def test_conflicts(spark, root, db):
    other = Session(spark, root)
    db.sql("BEGIN")
    db.sql("UPDATE t SET value = 'a' WHERE key = 'k1'")
    other.sql("INSERT INTO t VALUES ('k1', 'b')")
    with pytest.raises(ConflictError):
        db.sql("COMMIT")
    assert rows(db) == [("k1", "b"), ("k2", "v2")]


def test_reads_at_commits(db):
    at = db.store.state().number
    db.sql("DELETE FROM t WHERE key = 'k1'")
    assert [r.key for r in db.query("SELECT key FROM t ORDER BY key", at=at).collect()] == ["k1", "k2"]
    assert db.query("SELECT key FROM t", at=at - 1).collect() == []
    assert rows(db) == [("k2", "v2")]


def test_failed_statement_in_transaction_keeps_the_rest(db):
    db.sql("BEGIN")
    db.sql("INSERT INTO t VALUES ('k3', 'x')")
    with pytest.raises(EngineError):
        db.sql("INSERT INTO t VALUES (NULL, 'x')")
    db.sql("COMMIT")
    assert [r[0] for r in rows(db)] == ["k1", "k2", "k3"]
