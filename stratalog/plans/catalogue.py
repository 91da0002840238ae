"""All registered queries of the engine, each with the same query as SQL for DuckDB.

Most are SQL as it stands, with ``{name}`` for tables; where the two dialects differ, the second text is given.
The versioned and audit queries go through the operators of this package.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compat
from ..operators import audit, changelog, oplog, report
from ..sources.tables import scratch, sql, table
from . import sessions

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = """SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, CAST(round(sum(l_extendedprice*(1-l_discount)),2) AS DOUBLE) AS rev
FROM {customer} JOIN {orders} ON c_custkey=o_custkey JOIN {lineitem} ON l_orderkey=o_orderkey
WHERE o_orderstatus <> 'P' GROUP BY c_mktsegment HAVING count(*) > 100 ORDER BY rev DESC LIMIT 5"""

ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders}"
CUST = "SELECT c_custkey, c_name FROM {customer}"

#: name -> SQL, or (Spark SQL, DuckDB SQL)
SQL: dict[str, str | tuple[str, str]] = {
    "flagship": FLAGSHIP,
    # scan and filter
    "scan_project": "SELECT n_nationkey, n_name AS name, n_regionkey + 1 AS r1 FROM {nation}",
    "filter_eq": f"{ORDERS} WHERE o_orderstatus = 'F'",
    "filter_range": f"{ORDERS} WHERE o_totalprice > 100000 AND o_totalprice <= 200000",
    "filter_between": f"{ORDERS} WHERE o_orderkey BETWEEN 100 AND 900",
    "between_reversed": f"{ORDERS} WHERE o_orderkey BETWEEN 900 AND 100",
    "filter_in": f"{ORDERS} WHERE o_orderstatus IN ('F','P')",
    "filter_not_in": f"{ORDERS} WHERE o_orderstatus NOT IN ('F','P')",
    "in_with_null": f"{ORDERS} WHERE nullif(o_orderstatus,'P') IN ('F', NULL)",
    "not_in_with_null": f"{ORDERS} WHERE o_orderstatus NOT IN ('F', NULL)",
    "like_prefix": "SELECT p_partkey, p_type FROM {part} WHERE p_type LIKE 'S%'",
    "like_underscore": "SELECT p_partkey, p_brand FROM {part} WHERE p_brand LIKE 'Brand#_3'",
    "like_escape": "SELECT p_partkey, p_brand FROM {part} WHERE p_brand LIKE '%!_%' ESCAPE '!' OR p_brand LIKE 'Brand#1%'",
    "is_null": f"{ORDERS} WHERE nullif(o_orderstatus,'P') IS NULL",
    "is_not_null": f"{ORDERS} WHERE nullif(o_orderstatus,'P') IS NOT NULL",
    "kleene_or": f"{ORDERS} WHERE nullif(o_orderstatus,'P') = 'F' OR o_totalprice > 150000",
    "kleene_and": f"{ORDERS} WHERE NOT (nullif(o_orderstatus,'P') = 'F' AND o_totalprice > 150000)",
    "not_paren": f"{ORDERS} WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 50000)",
    "ne": f"{ORDERS} WHERE o_orderstatus <> 'O' AND o_custkey != 7",
    # expressions
    "arith": "SELECT l_orderkey, l_linenumber, l_extendedprice*(1-l_discount)*(1+l_tax) - 1 AS x FROM {lineitem}",
    "div_zero_null": ("SELECT l_orderkey, l_linenumber, round(try_divide(l_extendedprice, l_linenumber - 1), 6) AS x FROM {lineitem}", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_linenumber - 1, 0), 6) AS x FROM {lineitem}"),
    "cast_text": "SELECT o_orderkey, CAST(o_custkey AS VARCHAR(20)) AS t FROM {orders}",
    "coalesce_chain": "SELECT o_orderkey, coalesce(nullif(o_orderstatus,'P'), nullif(o_orderpriority,'1-URGENT'), 'none') AS x FROM {orders}",
    "nullif_ifnull_iif": ("SELECT o_orderkey, ifnull(nullif(o_orderstatus,'P'),'?') AS a, if(o_totalprice > 100000,'big','small') AS b FROM {orders}", "SELECT o_orderkey, ifnull(nullif(o_orderstatus,'P'),'?') AS a, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS b FROM {orders}"),
    "length_substr": "SELECT c_custkey, CAST(length(c_name) AS BIGINT) AS n, substr(c_name, 3, 5) AS s FROM {customer}",
    "octet_length": ("SELECT doc_id, CAST(octet_length(text) AS BIGINT) AS n FROM {documents}", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM {documents}"),
    "upper_lower": "SELECT c_custkey, upper(c_mktsegment) AS u, lower(c_name) AS l FROM {customer}",
    "hex_quote": "SELECT n_nationkey, hex(n_name) AS h, concat('''', n_name, '''') AS q FROM {nation}",
    "abs": "SELECT c_custkey, abs(c_acctbal) AS a, abs(c_custkey - 70) AS b FROM {customer}",
    "least_greatest": "SELECT l_orderkey, l_linenumber, least(l_quantity, 20.0D) AS a, greatest(l_quantity, 20.0D) AS b FROM {lineitem}",
    "select_no_from": "SELECT 1 + 2 AS a, 'x' AS b",
    # joins
    "join_inner": "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey",
    "join_left": "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN (SELECT * FROM {orders} WHERE o_totalprice > 300000) o ON c_custkey = o_custkey",
    "join_right": "SELECT c_custkey, o_orderkey FROM (SELECT * FROM {orders} WHERE o_totalprice > 300000) o RIGHT JOIN {customer} ON c_custkey = o_custkey",
    "join_full": "SELECT a.n_name AS l, b.n_name AS r FROM (SELECT * FROM {nation} WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT * FROM {nation} WHERE n_nationkey > 8) b ON a.n_nationkey = b.n_nationkey",
    "join_cross": "SELECT n_name, r_name FROM {nation} CROSS JOIN {region}",
    "join_three": "SELECT r_name, n_name, c_custkey FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE c_acctbal > 5000",
    "semi_in": f"{CUST} WHERE c_custkey IN (SELECT o_custkey FROM {{orders}} WHERE o_totalprice > 250000)",
    "semi_exists_corr": f"{CUST} c WHERE EXISTS (SELECT 1 FROM {{orders}} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)",
    "anti_not_exists": f"{CUST} c WHERE NOT EXISTS (SELECT 1 FROM {{orders}} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "anti_not_in": f"{CUST} WHERE c_custkey NOT IN (SELECT o_custkey FROM {{orders}} WHERE o_orderstatus = 'P')",
    "anti_not_in_null": f"{CUST} WHERE c_custkey NOT IN (SELECT nullif(o_custkey, (SELECT min(o_custkey) FROM {{orders}})) FROM {{orders}} WHERE o_orderkey >= 0)",
    "exists_or": f"{CUST} c WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM {{orders}} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "exists_nested": f"{CUST} c WHERE EXISTS (SELECT 1 FROM {{orders}} o WHERE o.o_custkey = c.c_custkey AND EXISTS (SELECT 1 FROM {{lineitem}} l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49))",
    "scalar_subquery": "SELECT n_name, (SELECT count(*) FROM {customer} WHERE c_nationkey = n_nationkey) AS n FROM {nation}",
    # aggregates
    "count_star": "SELECT count(*) AS n FROM {lineitem}",
    "count_col_null": "SELECT count(nullif(o_orderstatus,'P')) AS n FROM {orders}",
    "count_distinct": "SELECT count(DISTINCT o_custkey) AS n FROM {orders}",
    "sum": "SELECT round(sum(l_quantity),2) AS s, CAST(sum(l_linenumber) AS BIGINT) AS t FROM {lineitem}",
    "sum_distinct": "SELECT CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM {lineitem}",
    "total_empty": "SELECT coalesce(sum(l_quantity), 0.0D) AS t FROM {lineitem} WHERE l_orderkey < 0",
    "avg": "SELECT l_returnflag, round(avg(l_discount), 6) AS a FROM {lineitem} GROUP BY l_returnflag",
    "avg_distinct": "SELECT round(avg(DISTINCT l_quantity), 6) AS a FROM {lineitem}",
    "min_max": "SELECT min(o_totalprice) AS a, max(o_totalprice) AS b, min(o_orderpriority) AS c, max(o_orderpriority) AS d FROM {orders}",
    "group_concat": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey"),
    "group_concat_distinct": ("SELECT o_custkey, listagg(DISTINCT o_orderstatus, ',') WITHIN GROUP (ORDER BY o_orderstatus) AS st FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS st FROM {orders} GROUP BY o_custkey"),
    "group_by_multi": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity),2) AS q FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
    "having_alias": "SELECT o_custkey, count(*) AS cnt FROM {orders} GROUP BY o_custkey HAVING cnt > 12",
    "having_expr": "SELECT o_custkey, round(sum(o_totalprice),2) AS s FROM {orders} GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 100000",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}",
    # windows
    "row_number_part": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}",
    "row_number_all": "SELECT n_nationkey, row_number() OVER (ORDER BY n_name) AS rn FROM {nation}",
    "rank_desc": "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC) AS rk FROM {orders}",
    "dense_rank": "SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk FROM {orders}",
    "window_sum": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS s FROM {orders}",
    # order, set operations, common table expressions
    "order_limit": f"{ORDERS} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "order_offset": f"{ORDERS} ORDER BY o_orderkey LIMIT 20 OFFSET 30",
    "order_desc": "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal DESC, c_custkey",
    "union": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}",
    "intersect": "SELECT c_custkey AS k FROM {customer} INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P'",
    "except": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P'",
    "cte_chain": "WITH a AS (SELECT * FROM {orders} WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey, count(*) AS n FROM a GROUP BY o_custkey) SELECT b.o_custkey, n FROM b WHERE n > 5",
    "cte_recursive": ("WITH RECURSIVE t(n) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT n + 1 FROM t WHERE n < 32) SELECT n FROM t", "WITH RECURSIVE t(n) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT n + 1 FROM t WHERE n < 32) SELECT n FROM t"),
    "view_filter": "WITH v AS (SELECT c_custkey, c_name FROM {customer} WHERE c_mktsegment = 'BUILDING') SELECT c_name FROM v WHERE c_custkey < 500",
}

#: The events as a change log.
LOG = "SELECT user_id, value, event_id + 1 AS lsn, ts, event_type = 'error' AS deleted, event_id % 7 AS txn_id, event_type <> 'view' AS durable, event_type, event_id FROM {events}"
LAST = "SELECT user_id, value, lsn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC) AS rn FROM ({log}) l WHERE {where}) t WHERE rn = 1 AND NOT deleted"


def log(spark: SparkSession, folder: str) -> DataFrame:
    return sql(spark, folder, LOG)


def _cols(df: DataFrame) -> DataFrame:
    return df.select("user_id", "value", "lsn")


def _leaves(events: DataFrame) -> DataFrame:
    return events.select(F.floor(F.col("event_id") / 8).cast("bigint").alias("batch"), (F.col("event_id") % 8).alias("place"), F.sha2("props", 256).alias("h"))


def _roots(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return audit.merkle_roots(_leaves(events))


def _inclusion(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the proofs of all leaves of a batch lead to its root."""
    proven = audit.inclusion(_leaves(table(spark, folder, "events")), _roots(spark, folder))
    return proven.groupBy("batch").agg(F.min("ok").alias("ok")).select((F.col("batch") * 8).alias("first"), "ok")


def _checkpoints(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.floor(F.col("event_id") / 100).alias("id")).agg(F.max("ts").alias("cts"), F.max("lsn").alias("data_lsn"))


def _contract(spark: SparkSession, folder: str) -> DataFrame:
    """What the first half of the log promised, against what the whole log holds."""
    entries = log(spark, folder)
    key = F.col("user_id").cast("string").alias("key")
    promised = changelog.as_of_lsn(entries, ["user_id"], 5000).select(key, audit.digest(F.col("lsn")).alias("value_sha256"), "durable")
    return audit.contract(promised, changelog.latest(entries, ["user_id"]).select(key, F.col("lsn").cast("string").alias("value")))


def _chain(spark: SparkSession, folder: str, tamper: bool) -> DataFrame:
    rows = table(spark, folder, "events").select((F.col("event_id") + 1).alias("sequence"), F.col("props").alias("body"))
    chain = audit.chained(rows)
    if tamper:
        chain = chain.withColumn("body", F.when(F.col("sequence") % 97 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return chain


def _tampered(spark: SparkSession, folder: str) -> DataFrame:
    """Batches whose leaves, some of them altered, no longer lead to the root that was kept."""
    leaves = _leaves(table(spark, folder, "events"))
    altered = leaves.withColumn("h", F.when((F.col("batch") * 8 + F.col("place")) % 97 == 0, F.sha2(F.col("h"), 256)).otherwise(F.col("h")))
    proven = audit.inclusion(altered, audit.merkle_roots(leaves))
    return proven.groupBy("batch").agg(F.max("ok").alias("some"), F.min("ok").alias("every"))


def _expected(spark: SparkSession, folder: str) -> DataFrame:
    """What an operation log of the events promises, with everything in the first half durable."""
    ops = oplog.OpLog(spark, scratch(spark, "oplog"))
    entries = log(spark, folder)
    op = F.when(F.col("deleted"), "delete").otherwise("put").alias("op")
    key = F.concat_ws(":", F.col("user_id") % 10, "user_id").alias("key")
    ops.append(entries.select(op, key, F.col("lsn").cast("string").alias("value"), "lsn", "durable", F.lit("group").alias("tier"), F.lit(0).alias("ts_unix")))
    ops.mark_durable(entries.agg(F.max("lsn")).first()[0] // 2)
    expected, _ = oplog.expectations(ops.read())
    return oplog.known_tables(expected, table(spark, folder, "region").select(F.col("r_regionkey").alias("id")))


COMPAT: dict[str, tuple[Query, str]] = {
    "glob_set": (
        lambda s, d: table(s, d, "nation").where(compat.glob(F.col("n_name"), "[ABCDEFGHIJKLMN]*")).select("n_nationkey", "n_name"),
        "SELECT n_nationkey, n_name FROM {nation} WHERE n_name GLOB '[ABCDEFGHIJKLMN]*'",
    ),
    "cast_int_prefix": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", compat.cast_int_prefix(F.col("o_orderpriority")).alias("i")),
        "SELECT o_orderkey, coalesce(try_cast(regexp_extract(o_orderpriority, '^\\s*([+-]?[0-9]+)', 1) AS BIGINT), 0) AS i FROM {orders}",
    ),
    "cast_real": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", compat.cast_real_prefix(F.concat(F.col("o_orderkey").cast("string"), F.lit(".5x"))).alias("r")),
        "SELECT o_orderkey, o_orderkey + 0.5::DOUBLE AS r FROM {orders}",
    ),
    "typeof_compat": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", compat.sqlite_typeof(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.col("o_orderkey").cast("string"), F.lit(".25"))).otherwise(F.nullif(F.col("o_orderstatus"), F.lit("P")))).alias("t")),
        "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'integer' WHEN o_orderkey % 3 = 1 THEN 'real' WHEN o_orderstatus = 'P' THEN 'null' ELSE 'text' END AS t FROM {orders}",
    ),
    "trim_ws": (
        lambda s, d: table(s, d, "nation").select("n_nationkey", compat.trim_ws(F.concat(F.lit(" \t"), "n_name", F.lit("\n "))).alias("t")),
        "SELECT n_nationkey, n_name AS t FROM {nation}",
    ),
    "substr_compat": (
        lambda s, d: table(s, d, "nation").select("n_nationkey", compat.substr_compat(F.col("n_name"), -2, 3).alias("a"), compat.substr_compat(F.col("n_name"), 7).alias("b")),
        "SELECT n_nationkey, substr(n_name, 1, 3) AS a, CASE WHEN length(n_name) >= 7 THEN substr(n_name, 7) END AS b FROM {nation}",
    ),
    "mixed_compare": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", compat.sqlite_cmp(F.col("o_orderkey").cast("string"), "<", F.lit("1000.5")).alias("less")),
        "SELECT o_orderkey, o_orderkey < 1000.5 AS less FROM {orders}",
    ),
    "sum_of_text": (
        lambda s, d: table(s, d, "orders").groupBy("o_orderstatus").agg(compat.sqlite_sum(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise(F.lit("abc"))).alias("s")),
        "SELECT o_orderstatus, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE 0 END) AS DOUBLE) AS s FROM {orders} GROUP BY o_orderstatus",
    ),
    "latest_per_key": (lambda s, d: _cols(changelog.latest(log(s, d), ["user_id"])), LAST.replace("{where}", "true")),
    "asof_lsn": (lambda s, d: _cols(changelog.as_of_lsn(log(s, d), ["user_id"], 400)), LAST.replace("{where}", "lsn <= 400")),
    "asof_ts_checkpoint": (
        lambda s, d: _cols(changelog.as_of_ts(e := log(s, d), ["user_id"], _checkpoints(e), F.timestamp_ntz_literal("2024-01-15 00:00:00") if hasattr(F, "timestamp_ntz_literal") else F.expr("timestamp'2024-01-15 00:00:00'"))),
        LAST.replace("{where}", "lsn <= (SELECT max(dl) FROM (SELECT max(ts) AS cts, max(event_id) + 1 AS dl FROM {events} GROUP BY event_id // 100) c WHERE cts <= TIMESTAMP '2024-01-15 00:00:00')"),
    ),
    "version_chain": (lambda s, d: changelog.version_chain(log(s, d), ["user_id"]).select("user_id", "lsn", "prev_lsn"), "SELECT user_id, lsn, lag(lsn) OVER (PARTITION BY user_id ORDER BY lsn) AS prev_lsn FROM ({log}) l"),
    "version_floor": (lambda s, d: changelog.version_floor(log(s, d), ["user_id"], 250), 'SELECT user_id, max(lsn) FILTER (WHERE lsn <= 250) AS "floor", max(lsn) AS head FROM ({log}) l GROUP BY user_id'),
    "key_range_scan": (
        lambda s, d: changelog.key_range(log(s, d).withColumn("key", F.col("user_id").cast("string")), "key", "1", "5").select("key", "value", "lsn"),
        "SELECT CAST(user_id AS VARCHAR) AS key, value, lsn FROM (" + LAST.replace("{where}", "true") + ") q WHERE CAST(user_id AS VARCHAR) BETWEEN '1' AND '5'",
    ),
    "tombstones": (
        lambda s, d: changelog.newest(log(s, d), ["user_id"]).where("deleted").select("user_id", "lsn"),
        "SELECT user_id, lsn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC) AS rn FROM ({log}) l) t WHERE rn = 1 AND deleted",
    ),
    "committed_only": (
        lambda s, d: _cols(changelog.latest(changelog.committed(e := log(s, d), e.select("txn_id").distinct().where("txn_id <> 3")), ["user_id"])),
        LAST.replace("{where}", "txn_id <> 3"),
    ),
    "shard_counts": (
        lambda s, d: table(s, d, "orders").groupBy(changelog.shard(F.col("o_orderkey").cast("string"), 16).alias("shard")).agg(F.count(F.lit(1)).alias("n")),
        "SELECT list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1,length(k)+1), lambda i: ord(k[i])::BIGINT)), lambda h,x: (xor(h,x) * 16777619) & 4294967295) % 16 AS shard, count(*) AS n FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM {orders}) o GROUP BY 1",
    ),
    "group_commit_watermark": (lambda s, d: log(s, d).groupBy("txn_id").agg(F.max(F.when(F.col("durable"), F.col("lsn"))).alias("watermark")), "SELECT txn_id, max(lsn) FILTER (WHERE durable) AS watermark FROM ({log}) l GROUP BY txn_id"),
    "compaction": (
        lambda s, d: changelog.compacted(log(s, d), ["user_id"], 600).select("user_id", "lsn"),
        "SELECT user_id, lsn FROM ({log}) l WHERE lsn > 600 UNION ALL SELECT user_id, lsn FROM (" + LAST.replace("{where}", "lsn <= 600") + ") f",
    ),
    "sha256_digest": (lambda s, d: table(s, d, "events").select("event_id", audit.digest(F.col("props")).alias("h")), "SELECT event_id, sha256(props) AS h FROM {events}"),
    "chain_links": (
        lambda s, d: _chain(s, d, False).select("sequence", "hash", "prev_hash"),
        "SELECT event_id + 1 AS sequence, sha256(props) AS hash, lag(sha256(props)) OVER (ORDER BY event_id) AS prev_hash FROM {events}",
    ),
    "chain_tamper": (lambda s, d: audit.chain_errors(_chain(s, d, True)), "SELECT event_id + 1 AS sequence, 'body hash differs' AS error FROM {events} WHERE (event_id + 1) % 97 = 0"),
    "merkle_batch_root": (_roots, ""),
    "merkle_inclusion": (
        _inclusion,
        'SELECT event_id AS "first", true AS ok FROM {events} WHERE event_id % 8 = 0',
    ),
    "merkle_tampered": (_tampered, "SELECT event_id // 8 AS batch, count(*) FILTER (WHERE event_id % 97 = 0) = 0 AS some, count(*) FILTER (WHERE event_id % 97 = 0) = 0 AS every FROM {events} GROUP BY 1"),
    "oplog_expectations": (
        _expected,
        "SELECT CAST(user_id % 10 AS VARCHAR) || ':' || CAST(user_id AS VARCHAR) AS key, sha256(CAST(lsn AS VARCHAR)) AS value_sha256, durable OR lsn <= (SELECT max(event_id + 1) // 2 FROM {events}) AS durable FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC) AS rn FROM ({log}) l) t WHERE rn = 1 AND NOT deleted AND user_id % 10 IN (SELECT r_regionkey FROM {region})",
    ),
    "physical_attestation": (
        lambda s, d: report.physical(log(s, d).withColumn("key", F.col("user_id")), F.col("user_id") % 4).drop("digest"),
        "SELECT user_id % 4 AS shard, count(*) AS entries, count(DISTINCT user_id) AS keys, max(lsn) AS max_lsn, max(lsn) FILTER (WHERE durable) AS data_lsn, count(*) FILTER (WHERE NOT durable) AS tail, true AS ordered FROM ({log}) l GROUP BY 1",
    ),
    "statistics": (
        lambda s, d: report.statistics(report.physical(log(s, d).withColumn("key", F.col("user_id")), F.col("user_id") % 4)),
        "SELECT CAST(count(*) AS BIGINT) AS entries, CAST(count(DISTINCT user_id) AS BIGINT) AS keys, max(lsn) AS max_lsn, max(lsn) FILTER (WHERE durable) AS data_lsn, count(*) FILTER (WHERE NOT durable) AS tail FROM ({log}) l",
    ),
    "asof_token": (
        lambda s, d: _cols(changelog.as_of_token(log(s, d).withColumn("shard", F.col("user_id") % 4), ["user_id"], table(s, d, "events").groupBy((F.col("user_id") % 4).alias("shard")).agg((F.max("event_id") / 2).cast("long").alias("lsn_at")))),
        "SELECT user_id, value, lsn FROM (SELECT l.*, row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC) AS rn FROM ({log}) l JOIN (SELECT user_id % 4 AS shard, max(event_id) // 2 AS lsn_at FROM {events} GROUP BY 1) k ON l.user_id % 4 = k.shard WHERE lsn <= lsn_at) t WHERE rn = 1 AND NOT deleted",
    ),
    "contract_verdicts": (
        _contract,
        "WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC) AS rn FROM ({log}) l WHERE lsn <= 5000), e AS (SELECT * FROM p WHERE rn = 1 AND NOT deleted), q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC) AS rn FROM ({log}) l), n AS (SELECT * FROM q WHERE rn = 1 AND NOT deleted) SELECT * FROM (SELECT CAST(coalesce(e.user_id, n.user_id) AS VARCHAR) AS key, CASE WHEN e.user_id IS NULL THEN 'unexpected' WHEN NOT e.durable THEN 'pending_uncommitted' WHEN n.lsn IS NULL OR n.lsn <> e.lsn THEN 'missing' END AS verdict FROM e FULL OUTER JOIN n ON e.user_id = n.user_id) v WHERE verdict IS NOT NULL",
    ),
    "phantom_conflicts_all": (
        lambda s, d: changelog.phantoms(
            table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("lo"), (F.col("o_custkey") + 3).alias("hi")),
            table(s, d, "customer").select(F.col("c_custkey").alias("k")).join(table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), "k", "left_anti"),
        ),
        "WITH ticket AS (SELECT o_orderkey AS id, unnest(range(o_custkey, o_custkey + 4)) AS k FROM {orders}), fresh AS (SELECT c_custkey AS k FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P')) SELECT id, ticket.k AS k FROM ticket JOIN fresh ON ticket.k = fresh.k",
    ),
    "policy_verdict": (
        lambda s, d: table(s, d, "events").select("event_id", audit.policy(*[(F.col("event_id") % n == 0).cast("int") for n in (11, 7, 5)], F.col("event_id") % 4, F.lit(2), (F.col("event_id") % 3 == 0).cast("int"), (F.col("event_id") % 2 == 0).cast("int")).alias("verdict")),
        "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'FAIL:unexpected_path' WHEN event_id % 7 = 0 THEN 'FAIL:tier' WHEN event_id % 5 = 0 THEN 'FAIL:decompress' WHEN event_id % 4 > 2 THEN 'FAIL:missing' WHEN event_id % 3 = 0 THEN 'FAIL:unexpected' WHEN event_id % 2 = 0 THEN 'WARN:pending' ELSE 'PASS' END AS verdict FROM {events}",
    ),
    "tier_violations": (
        lambda s, d: (e := log(s, d)).join(s.createDataFrame([("click", True), ("view", False), ("purchase", True)], "event_type string, durable boolean"), ["event_type", "durable"], "left_anti").select("event_id", "event_type"),
        "SELECT event_id, event_type FROM {events} WHERE NOT (event_type IN ('click','view','purchase'))",
    ),
    "physical_stats": (
        lambda s, d: log(s, d).groupBy((F.col("user_id") % 4).alias("shard")).agg(F.count(F.lit(1)).alias("entries"), F.max("lsn").alias("max_lsn"), F.count(F.when(~F.col("durable"), 1)).alias("tail"), F.count_distinct("user_id").alias("keys")),
        "SELECT user_id % 4 AS shard, count(*) AS entries, max(lsn) AS max_lsn, count(*) FILTER (WHERE NOT durable) AS tail, count(DISTINCT user_id) AS keys FROM ({log}) l GROUP BY 1",
    ),
}


def _merkle_oracle() -> str:
    up = "SELECT a.b, a.p // 2 AS p, sha256(concat('carl:node:', a.x, coalesce(z.x, a.x))) AS x FROM {t} a LEFT JOIN {t} z ON a.b = z.b AND z.p = a.p + 1 WHERE a.p % 2 = 0"
    parts = ["l0 AS (SELECT event_id // 8 AS b, event_id % 8 AS p, sha256(concat('carl:leaf:', sha256(props))) AS x FROM {events})"]
    parts += [f"l{i + 1} AS ({up.replace('{t}', f'l{i}')})" for i in range(3)]
    return f"WITH {', '.join(parts)} SELECT b AS batch, x AS root FROM l3"


def queries() -> dict[str, Query]:
    plain = {n: (lambda s, d, t=t if isinstance(t, str) else t[0]: sql(s, d, t)) for n, t in SQL.items()}
    return plain | {n: f for n, (f, _) in (COMPAT | sessions.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    texts = {n: t if isinstance(t, str) else t[1] for n, t in SQL.items()} | {n: t for n, (_, t) in (COMPAT | sessions.QUERIES).items()} | {"merkle_batch_root": _merkle_oracle()}
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", t.replace("{log}", LOG)).replace("0.0D", "0.0::DOUBLE").replace("20.0D", "20.0::DOUBLE")
    return {n: plain(t) for n, t in texts.items()}
