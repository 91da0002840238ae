"""A stream of changes (key columns, other columns, lsn, deleted) applied to a table of a session.

Each micro-batch is one transaction: the newest change of each key, and the batch's number in a table of its own.  A batch
that is given again after a failure finds its number there and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from stratalog.engine.session import Session
from stratalog.operators import changelog

APPLIED = "applied_batches"


def apply_batch(session: Session, table: str, changes: DataFrame, number: int) -> bool:
    """Apply one batch; False if it had been applied already."""
    session.sql(f"CREATE TABLE IF NOT EXISTS {APPLIED} (name TEXT PRIMARY KEY, batch INTEGER)")
    before = session.sql(f"SELECT batch FROM {APPLIED} WHERE name = '{table}'").collect()  # a row at most
    if before and before[0].batch >= number:
        return False
    keys = session._table(table)["key"]
    newest = changelog.newest(changes, keys)
    session.sql("BEGIN")
    try:
        session.insert(table, newest.where("not deleted").drop("lsn", "deleted"))
        session.remove(table, newest.where("deleted").select(*keys))
        session.sql(f"INSERT INTO {APPLIED} VALUES ('{table}', {number})")
        session.sql("COMMIT")
    except Exception:
        if session.txn:
            session.sql("ROLLBACK")
        raise
    return True


def follow(changes: DataFrame, session: Session, table: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Start applying a streaming table of changes; ``trigger`` as for ``writeStream``, all that is there by default."""
    each = lambda batch, number: apply_batch(session, table, batch, number) and None
    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
