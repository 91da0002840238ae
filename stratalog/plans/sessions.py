"""Queries that run statements in a session over the given tables and return what they leave, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..engine.keyvalue import KeyValue
from ..engine.session import Session
from ..sources.tables import scratch

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("nation", "customer", "supplier", "orders", "events")


def opened(spark: SparkSession, folder: str, root: str | None = None, **options) -> Session:
    """A session on a new database, that can read the tables of a folder."""
    s = Session(spark, root or scratch(spark, "session"), **options)
    for name in TABLES:
        s.attach(name, f"{folder}/{name}.parquet")
    return s


def _run(*statements: str) -> Query:
    """The result of the last statement after all others."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        s = opened(spark, folder)
        for text in statements[:-1]:
            s.sql(text)
        return s.sql(statements[-1])

    return run


def check_violations(spark: SparkSession, folder: str) -> DataFrame:
    s = opened(spark, folder)
    s.sql("CREATE TABLE c (c_custkey INTEGER PRIMARY KEY, c_acctbal REAL CHECK (c_acctbal > 0))")
    return s.violations("c", s.sql("SELECT c_custkey, c_acctbal FROM customer")).select("c_custkey")


def occ_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Users that a transaction writes after the first half of the events, and another one meanwhile from the second."""
    s = opened(spark, folder)
    s.sql("CREATE TABLE t (user_id INTEGER PRIMARY KEY, head INTEGER)")
    half = "SELECT user_id, max(event_id) FROM events WHERE 2 * event_id {} (SELECT count(*) FROM events) GROUP BY user_id"
    s.sql(f"INSERT INTO t {half.format('<')}")
    writer = opened(spark, folder, s.store.root)
    writer.sql("BEGIN")
    writer.sql("UPDATE t SET head = head + 1")
    s.sql(f"INSERT INTO t {half.format('>=')}")
    return writer.conflicts("t")


def phantom_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Customers that a transaction inserts into what another open one has scanned."""
    s = opened(spark, folder, isolation="serializable")
    s.sql("CREATE TABLE c (c_custkey INTEGER PRIMARY KEY, c_acctbal REAL)")
    s.sql("INSERT INTO c SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
    s.sql("BEGIN")
    s.sql("SELECT c_custkey FROM c WHERE c_acctbal > 0")
    writer = opened(spark, folder, s.store.root)
    writer.sql("BEGIN")
    writer.sql("INSERT OR IGNORE INTO c SELECT c_custkey, c_acctbal FROM customer")
    return writer.phantoms("c")


def flashback(spark: SparkSession, folder: str) -> DataFrame:
    """Values of all users after the commit of the first half of the events, when the second half is there too."""
    s = opened(spark, folder)
    kv = KeyValue(s)
    half = "INSERT INTO kv SELECT CAST(user_id AS TEXT), CAST(max(event_id) AS TEXT) FROM events WHERE 2 * event_id {} (SELECT count(*) FROM events) GROUP BY user_id"
    s.sql(half.format("<"))
    at = s.latest_commit()
    s.sql(half.format(">="))
    s.compact("kv")
    return kv.scan("0", "z", at=at)


KEPT = "CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT)"
CUSTOMERS = "CREATE TABLE c (c_custkey INTEGER PRIMARY KEY, c_name TEXT, c_acctbal REAL, c_mktsegment TEXT)"
FILLED = "INSERT INTO c SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"

QUERIES: dict[str, tuple[Query, str]] = {
    "upsert_result": (
        _run(KEPT, "INSERT INTO t SELECT c_custkey, 'old' FROM customer", "INSERT OR REPLACE INTO t SELECT DISTINCT o_custkey, 'zz-new' FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT k FROM t)", "SELECT k, v FROM t"),
        "SELECT k, max(v) AS v FROM (SELECT c_custkey AS k, CASE WHEN o.o_custkey IS NULL THEN 'old' ELSE 'zz-new' END AS v FROM {customer} LEFT JOIN (SELECT DISTINCT o_custkey FROM {orders} WHERE o_orderstatus = 'P') o ON c_custkey = o.o_custkey) t GROUP BY k",
    ),
    "or_ignore_result": (
        _run(KEPT, "INSERT INTO t SELECT c_custkey, 'kept' FROM customer", "INSERT OR IGNORE INTO t SELECT o_custkey + 100, 'added' FROM orders", "SELECT k, v FROM t"),
        "SELECT c_custkey AS k, 'kept' AS v FROM {customer} UNION ALL SELECT k, 'added' FROM (SELECT DISTINCT o_custkey + 100 AS k FROM {orders}) n WHERE k NOT IN (SELECT c_custkey FROM {customer})",
    ),
    "update_result": (
        _run(CUSTOMERS, FILLED, "UPDATE c SET c_acctbal = c_acctbal + 1 WHERE c_mktsegment = 'BUILDING'", "SELECT c_custkey, c_acctbal FROM c"),
        "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM {customer}",
    ),
    "delete_result": (_run(CUSTOMERS, FILLED, "DELETE FROM c WHERE c_acctbal < 0", "SELECT c_custkey FROM c"), "SELECT c_custkey FROM {customer} WHERE NOT (c_acctbal < 0)"),
    "insert_select_result": (
        _run(CUSTOMERS, FILLED, "INSERT INTO c (c_custkey, c_name) SELECT s_suppkey + 1000000, s_name FROM supplier WHERE s_acctbal > 0", "SELECT c_custkey, c_name FROM c"),
        "SELECT c_custkey, c_name FROM {customer} UNION ALL SELECT s_suppkey + 1000000, s_name FROM {supplier} WHERE s_acctbal > 0",
    ),
    "alter_compact_result": (
        _run(CUSTOMERS, FILLED, "ALTER TABLE c ADD COLUMN vip TEXT DEFAULT 'no'", "CREATE INDEX seg ON c (c_mktsegment)", "UPDATE c SET vip = 'yes' WHERE c_acctbal > 9000", "REINDEX seg", "SELECT c_custkey, vip FROM c"),
        "SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 'yes' ELSE 'no' END AS vip FROM {customer}",
    ),
    "trigger_result": (
        _run(KEPT, "CREATE TABLE n (k INTEGER PRIMARY KEY, v INTEGER)", "CREATE TRIGGER g AFTER INSERT ON t BEGIN INSERT INTO n SELECT k, length(v) FROM t; END", "INSERT INTO t SELECT n_nationkey, n_name FROM nation", "SELECT k, v FROM n"),
        "SELECT CAST(n_nationkey AS BIGINT) AS k, length(n_name) AS v FROM {nation}",
    ),
    "rollback_result": (
        _run(CUSTOMERS, FILLED, "BEGIN", "DELETE FROM c WHERE c_acctbal < 0", "SAVEPOINT s", "DELETE FROM c", "ROLLBACK TO s", "COMMIT", "SELECT c_custkey FROM c"),
        "SELECT c_custkey FROM {customer} WHERE NOT (c_acctbal < 0)",
    ),
    "check_violations": (check_violations, "SELECT c_custkey FROM {customer} WHERE (c_acctbal > 0) IS NOT TRUE"),
    "occ_conflicts": (occ_conflicts, "SELECT user_id FROM {events} WHERE 2 * event_id < (SELECT count(*) FROM {events}) INTERSECT SELECT user_id FROM {events} WHERE 2 * event_id >= (SELECT count(*) FROM {events})"),
    "phantom_conflicts": (phantom_conflicts, "SELECT c_custkey FROM {customer} WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P')"),
    "kv_flashback": (flashback, "SELECT CAST(user_id AS VARCHAR) AS key, CAST(max(event_id) AS VARCHAR) AS value FROM {events} WHERE 2 * event_id < (SELECT count(*) FROM {events}) GROUP BY user_id"),
    "empty_in": (_run("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN ()"), "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_orderkey IN (SELECT o_orderkey FROM {orders} WHERE false)"),
    "in_table": (_run("CREATE TEMP VIEW busy AS SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'", "SELECT c_custkey FROM customer WHERE c_custkey IN busy AND c_name NOT NULL"), "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P') AND c_name IS NOT NULL"),
    "session_aggregates": (
        _run("SELECT n_regionkey, TOTAL(n_nationkey) AS t, GROUP_CONCAT(n_name, '/') AS names, GROUP_CONCAT(DISTINCT substr(n_name, 1, 1)) AS firsts FROM nation GROUP BY n_regionkey"),
        "SELECT n_regionkey, CAST(sum(n_nationkey) AS DOUBLE) AS t, string_agg(n_name, '/' ORDER BY n_name) AS names, string_agg(DISTINCT substr(n_name, 1, 1), ',' ORDER BY substr(n_name, 1, 1)) AS firsts FROM {nation} GROUP BY n_regionkey",
    ),
    "session_scalars": (
        _run("SELECT o_orderkey, IIF(o_totalprice > 100000, 'big', 'small') AS size, TYPEOF(CAST(o_orderkey AS TEXT)) AS kind, CAST(o_orderpriority AS INTEGER) AS p, QUOTE(o_orderstatus) AS q, o_custkey / 0 AS z FROM orders WHERE o_orderpriority GLOB '[123]-*'"),
        "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size, 'integer' AS kind, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS p, concat('''', o_orderstatus, '''') AS q, CAST(NULL AS DOUBLE) AS z FROM {orders} WHERE substr(o_orderpriority, 1, 2) IN ('1-', '2-', '3-')",
    ),
}
