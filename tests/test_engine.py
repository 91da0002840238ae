"""Sessions beyond plain changes: validation, dialect, indexes, compaction, key-value access, databases; op-log, chains, command line."""

import json
import time

import pytest
from pyspark.sql import functions as F

from stratalog import cli
from stratalog.engine import dialect
from stratalog.engine.database import ERROR, FEATURE_NOT_SUPPORTED, OK, Database
from stratalog.engine.errors import ConflictError, ContractViolation, EngineError, NotFoundError, NotSupportedError
from stratalog.engine.keyvalue import KeyValue
from stratalog.engine.session import Session
from stratalog.operators import audit, chainfile, oplog, report
from stratalog.streaming import changes


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/db"


def rows(db, sql):
    return sorted(tuple(r) for r in db.sql(sql).collect())


def test_dialect():
    assert dialect.names("SELECT a FROM `t x` WHERE b = 'word' -- c\n") == {"SELECT", "a", "FROM", "t x", "WHERE", "b"}
    assert dialect.rewritten("SELECT 'x NOT NULL' WHERE a NOT NULL AND b IS NOT NULL", ()) == "SELECT 'x NOT NULL' WHERE a IS NOT NULL AND b IS NOT NULL"
    for bad in ("SELECT COUNT(DISTINCT *) FROM t", "SELECT GROUP_CONCAT(DISTINCT x, ';') FROM t"):
        with pytest.raises(EngineError):
            dialect.rewritten(bad, ())
    deep = "SELECT 1 WHERE 1 IN (SELECT 1 WHERE 1 IN (SELECT 1 WHERE 1 IN (SELECT 1)))"
    assert dialect.depth_of(deep) == 3
    with pytest.raises(EngineError, match="depth"):
        dialect.rewritten(deep, (), 2)


def test_expressions(spark, root):
    db = Session(spark, root)
    db.sql("CREATE TABLE t (k INTEGER PRIMARY KEY, x TEXT)")
    db.sql("INSERT INTO t VALUES (1, '12abc'), (2, NULL), (3, ' y '), (4, '7.5')")
    assert rows(db, "SELECT k, CAST(x AS INTEGER) FROM t WHERE x NOT NULL") == [(1, 12), (3, 0), (4, 7)]
    assert rows(db, "SELECT CAST(CAST(2.9 AS REAL) AS INTEGER), 1 / 0") == [(2, None)]
    assert rows(db, "SELECT k FROM t WHERE x NOT IN ()") == [(1,), (2,), (3,), (4,)] and rows(db, "SELECT k FROM t WHERE x IN ()") == []
    assert rows(db, "SELECT TRIM(x), TYPEOF(x), SUBSTR(x, 0, 2), SUBSTR(x, 9) FROM t WHERE k = 3") == [("y", "text", " y", None)]
    assert rows(db, "SELECT TOTAL(k), GROUP_CONCAT(DISTINCT x), IIF(COUNT(*) > 1, 'IN ()', '') FROM t") == [(10.0, " y ,12abc,7.5", "IN ()")]
    for bad in ("SHOW TABLES", "SET spark.x = 1", "GRANT ALL ON t TO u", "ALTER TABLE t DROP COLUMN x"):
        with pytest.raises(NotSupportedError):
            db.sql(bad)
    with pytest.raises(EngineError):
        db.sql("FROBNICATE t")
    with pytest.raises(ContractViolation):
        db.sql("/* @max_pages=3 */ SELECT k FROM t")
    assert len(rows(db, "/* @max_pages=4 */ SELECT k FROM t")) == 4
    assert all(r.detail.startswith("QUERY PLAN") for r in db.sql("EXPLAIN QUERY PLAN SELECT * FROM t").collect())


def test_changes(spark, root):
    db = Session(spark, root)
    db.sql("CREATE TABLE c (k INTEGER PRIMARY KEY, x INTEGER CHECK (x > 0))")
    db.sql("INSERT INTO c VALUES (1, 1), (2, 2)")
    with pytest.raises(EngineError, match="CHECK"):  # unknown fails
        db.sql("INSERT INTO c VALUES (3, NULL)")
    with pytest.raises(EngineError, match="UNIQUE"):
        db.sql("UPDATE c SET k = 2 WHERE k = 1")
    db.sql("UPDATE c SET k = k + 1")
    db.sql("ALTER TABLE c ADD COLUMN note TEXT DEFAULT 'old'")
    db.sql("INSERT INTO c (k, x, note) VALUES (9, 9, 'new'), (8, 8, NULL)")
    db.sql("CREATE UNIQUE INDEX by_x ON c (x)")
    at, want = db.latest_commit(), [(2, 1, "old"), (3, 2, "old"), (8, 8, None), (9, 9, "new")]
    assert rows(db, "SELECT * FROM c") == want
    db.sql("DELETE FROM c WHERE k = 8")
    db.sql("REINDEX by_x")
    assert len(db.store.state().parts[db._table("c")["id"]]) == 1
    assert rows(db, "SELECT * FROM c") == [want[0], want[1], want[3]]
    assert sorted(tuple(r) for r in db.query("SELECT * FROM c", at=at).collect()) == want
    assert db.store.vacuum(seconds=0) > 3 and len(rows(db, "SELECT * FROM c")) == 3
    with pytest.raises(EngineError, match="no such index"):
        db.sql("REINDEX missing")
    db.sql("CREATE TEMP VIEW v AS SELECT k FROM c")
    with pytest.raises(EngineError, match="cannot modify view"):
        db.sql("DELETE FROM v")
    assert "v" not in Session(spark, root)._state().catalog
    db.sql("DROP TABLE c")
    assert db._state().catalog == {}


def test_state_files(spark, root, monkeypatch):
    from stratalog.engine import store

    monkeypatch.setattr(store, "EVERY", 3)
    db = Session(spark, root)
    db.sql("CREATE TABLE t (k INTEGER PRIMARY KEY)")
    for i in range(4):
        db.sql(f"INSERT INTO t VALUES ({i})")
    assert db.store._list("_states") == [f"{3:020d}.json"]
    other = Session(spark, root)
    assert rows(other, "SELECT k FROM t") == [(0,), (1,), (2,), (3,)]
    assert other.store.state(2).number == 2 and not other.store.publish(5, {}, [])
    # a writer that stopped halfway leaves nothing that counts
    assert all(not n.endswith(".json") or n[:1] != "." for n in other.store._list("_commits"))


def test_serializable(spark, root):
    a, b = (Session(spark, root, isolation="serializable") for _ in range(2))
    a.sql("CREATE TABLE t (k INTEGER PRIMARY KEY, v INTEGER)")
    a.sql("INSERT INTO t VALUES (1, 1), (2, 2)")
    a.sql("BEGIN")
    a.sql("SELECT v FROM t WHERE v < 10").collect()
    b.sql("BEGIN")
    b.sql("INSERT INTO t VALUES (3, 3)")
    with pytest.raises(ConflictError, match="phantom"):
        b.sql("COMMIT")
    b.sql("INSERT INTO t VALUES (4, 40)")  # outside what was scanned
    b.sql("UPDATE t SET v = 5 WHERE k = 2")  # changes what was read
    a.sql("INSERT INTO t VALUES (9, 90)")
    with pytest.raises(ConflictError, match="read"):
        a.sql("COMMIT")
    b.sql("INSERT INTO t VALUES (3, 3)")  # nothing is held any more
    assert rows(b, "SELECT * FROM t") == [(1, 1), (2, 5), (3, 3), (4, 40)]


def test_group_tier(spark, root):
    db, other = Session(spark, root, group=3), Session(spark, root)
    db.sql("CREATE TABLE t (k INTEGER PRIMARY KEY)")
    db.sql("INSERT INTO t VALUES (1)")
    assert rows(db, "SELECT k FROM t") == [(1,)] and other.latest_commit() == 0
    db.sql("INSERT INTO t VALUES (2)")
    assert other.latest_commit() == 1
    db.sql("INSERT INTO t VALUES (3)")
    assert len(rows(other, "SELECT k FROM t")) == 2
    assert db.group_commit() == 2 and len(rows(other, "SELECT k FROM t")) == 3


def test_keys_and_values(spark, root):
    kv = KeyValue(Session(spark, root))
    kv.put_all([("a", "1"), ("b", "2"), ("b", "it's \\ 3")])
    at, now = kv.session.latest_commit(), time.time()
    kv.put("a", "9")
    kv.delete("b")
    assert kv.get("a") == "9" and kv.get("b", at=at) == "it's \\ 3" and kv.get("a", ts=now) == "1"
    assert [tuple(r) for r in kv.scan("a", "z").collect()] == [("a", "9")]
    assert [(r.value, r.deleted) for r in kv.versions("a").collect()] == [("9", False), ("1", False)]
    assert kv.prepare("a", "b", at) is False and kv.prepare("a", "b", at + 2)
    with pytest.raises(NotFoundError):
        kv.get("b")
    with pytest.raises(EngineError, match="no commit"):
        kv.get("a", ts=0.0)
    with pytest.raises(EngineError):
        kv.scan("b", "a")


def test_database(spark, root):
    monitor = report.Monitor()
    db = Database.open(spark, root, monitor=monitor)
    assert db.execute("CREATE TABLE t (k INTEGER PRIMARY KEY)").status == OK and db.execute("INSERT INTO t VALUES (1)").status == OK
    assert db.execute("SELECT k FROM t").rows == [(1,)]
    assert db.execute("SHOW TABLES").status == FEATURE_NOT_SUPPORTED
    monitor.see(report.Report(missing=3, verdict="FAIL:missing"))
    assert db.execute("INSERT INTO t VALUES (2)").status == ERROR and "circuit" in db.last_error
    status = dict(db.execute("PRAGMA rar_status").rows)
    assert len(status) == 11 and status["allows_write"] == "0" and status["last_chain_reason"] == "missing"
    monitor.see(report.Report(verdict="PASS"))
    assert db.execute("INSERT INTO t VALUES (2)").status == OK
    assert Database.open(spark, root, "ro").execute("DELETE FROM t").status == ERROR
    with pytest.raises(EngineError):
        Database.open(spark, root + "-missing", "rw")
    db.close()
    assert db.execute("SELECT 1").status == ERROR and db.execute(f"OPEN '{root}'").status == OK


def test_oplog_and_reports(spark, root):
    log = oplog.OpLog(spark, root)
    assert log.read().count() == 0
    columns = "op string, key string, value string, lsn long, durable boolean, tier string, ts_unix long"
    log.append(spark.createDataFrame([("put", "1:a", "x", 1, True, "sync", 0), ("put", "1:b", "y", 2, False, "group", 0), ("put", "2:c", "z", 3, False, "group", 0)], columns))
    log.append(spark.createDataFrame([("delete", "2:c", None, 4, False, "group", 0), ("put", "7:d", "w", 5, True, "sync", 0)], columns))
    expected, touched = oplog.expectations(log.read())
    assert {(r.key, r.durable) for r in expected.collect()} == {("1:a", True), ("1:b", False), ("7:d", True)} and touched.count() == 4
    known = oplog.known_tables(expected, spark.createDataFrame([(1,), (2,)], "id int"))
    live = spark.createDataFrame([("1:a", "x"), ("1:e", "?")], "key string, value string")
    found = report.build(known, live)
    assert (found.missing, found.unexpected, found.pending, found.verdict) == (0, 1, 1, "FAIL:unexpected")
    log.mark_durable(4)
    found = report.build(oplog.known_tables(oplog.expectations(log.read())[0], spark.createDataFrame([(1,)], "id int")), live, most_missing=1)
    assert (found.missing, found.pending, found.verdict) == (1, 0, "FAIL:unexpected")
    allowed = spark.createDataFrame([("open", "sync")], "state string, tier string")
    assert report.tier_violations(spark.createDataFrame([("open", "sync", 1), ("open", "group", 2)], "state string, tier string, n int"), allowed).collect()[0].n == 2


def test_chains(spark, tmp_path, capsys):
    chain, anchors, key = str(tmp_path / "c.jsonl"), str(tmp_path / "a.jsonl"), str(tmp_path / "key")
    (tmp_path / "key").write_bytes(b"secret")
    for i in range(11):
        chainfile.append(chain, json.dumps({"n": i}))
    assert chainfile.errors(chain) == [] and audit.chain_errors(chainfile.table(spark, chain)).count() == 0
    assert chainfile.anchored(chain, anchors) == "no anchor"
    chainfile.publish(chain, anchors, b"secret")
    assert chainfile.anchored(chain, anchors, b"secret") == "ok" and chainfile.anchored(chain, anchors, b"other") == "signature differs"
    assert cli.main(["chain-verify", chain, "--anchors", anchors, "--key", key]) == 0
    capsys.readouterr()
    assert cli.main(["chain-proof", chain, "10"]) == 0
    said = json.loads(capsys.readouterr().out)
    proof = spark.createDataFrame([(said["leaf"], said["proof"], said["root"]), (said["leaf"], said["proof"], "0" * 64)], "h string, p array<string>, r string")
    assert [r.ok for r in proof.select(audit.verify_proof(F.col("h"), F.col("p"), F.col("r")).alias("ok")).collect()] == [True, False]
    lines = (tmp_path / "c.jsonl").read_text().splitlines()
    (tmp_path / "c.jsonl").write_text("\n".join([*lines[:10], lines[10].replace('\\"n\\": 10', '\\"n\\": 99')]) + "\n")
    assert chainfile.errors(chain) == ["body hash differs at 11"]
    assert [(r.sequence, r.error) for r in audit.chain_errors(chainfile.table(spark, chain)).collect()] == [(11, "body hash differs")]
    assert cli.main(["chain-verify", chain]) == 1
    assert chainfile.rotate(chain, 12) is None and chainfile.rotate(chain, 11) and chainfile.append(chain, "{}") == 1
    assert chainfile.anchored(chain, anchors) == "the chain is shorter than its anchor"


def test_chain_worker():
    monitor, kept = report.Monitor(), []
    worker = report.ChainWorker(lambda body: kept.append(body) or len(kept), monitor, most=2)
    assert [worker.offer(str(i)) for i in range(3)] == [True, True, False] and monitor.rar_chain_drop_total == 1
    worker.start()
    worker.stop()
    assert kept == ["0", "1"] and monitor.last_chain_sequence == 2 and not monitor.worker_running


def test_signed_reports(tmp_path, capsys):
    (tmp_path / "r.json").write_text(report.Report(pending=1, verdict="WARN:pending").body())
    (tmp_path / "key").write_bytes(b"k")
    assert cli.main(["verify", str(tmp_path / "r.json")]) == 0
    capsys.readouterr()
    assert cli.main(["sign", str(tmp_path / "r.json"), "--key", str(tmp_path / "key")]) == 0
    signature = capsys.readouterr().out.strip()
    assert cli.main(["verify-sig", str(tmp_path / "r.json"), signature, "--key", str(tmp_path / "key")]) == 0
    assert cli.main(["verify-sig", str(tmp_path / "r.json"), "0" * 64, "--key", str(tmp_path / "key")]) == 1


def test_streamed_changes(spark, root, tmp_path):
    db = Session(spark, root)
    db.sql("CREATE TABLE t (key TEXT PRIMARY KEY, value TEXT)")
    source, schema = str(tmp_path / "in"), "key string, value string, lsn long, deleted boolean"
    put = lambda *entries: spark.createDataFrame(entries, schema).coalesce(1).write.mode("append").json(source)
    run = lambda: changes.follow(spark.readStream.schema(schema).json(source), db, "t", str(tmp_path / "check")).awaitTermination()
    put(("a", "1", 1, False), ("b", "2", 2, False), ("a", "3", 3, False))
    run()
    assert rows(db, "SELECT * FROM t") == [("a", "3"), ("b", "2")]
    put(("b", None, 4, True), ("c", "5", 5, False))
    run()
    run()
    assert rows(db, "SELECT * FROM t") == [("a", "3"), ("c", "5")]
    again = spark.createDataFrame([("z", "9", 9, False)], schema)
    assert not changes.apply_batch(db, "t", again, 1) and changes.apply_batch(db, "t", again, 7) and len(rows(db, "SELECT * FROM t")) == 3
