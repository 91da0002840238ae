"""Keys and values on a table of a session: put, delete, get, range scans, and reads at a commit or a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.engine.errors import EngineError, NotFoundError
from stratalog.engine.session import Session


class KeyValue:
    """A table (key TEXT PRIMARY KEY, value TEXT) of a session; it is created where it isn't there yet."""

    def __init__(self, session: Session, table: str = "kv"):
        self.session, self.table = session, table
        session.sql(f"CREATE TABLE IF NOT EXISTS {table} (key TEXT PRIMARY KEY, value TEXT)")

    def put(self, key: str, value: str | None) -> None:
        self.put_all([(key, value)])

    def put_all(self, pairs: list[tuple[str, str | None]]) -> None:
        """One change for many keys; of equal ones the last wins."""
        if not all(k for k, _ in pairs):
            raise EngineError("a key can't be empty")
        self.session.insert(self.table, self.session.spark.createDataFrame(pairs, "key string, value string"), ordered=True)

    def delete(self, key: str) -> None:
        self.session.sql(f"DELETE FROM {self.table} WHERE key = {self._text(key)}")

    def get(self, key: str, at: int | None = None, ts: float | None = None) -> str | None:
        """The value of a key, now, after commit ``at`` or at a time."""
        found = self._read(f"SELECT value FROM {self.table} WHERE key = {self._text(key)}", at, ts).collect()
        if not found:
            raise NotFoundError(key)
        return found[0].value

    def scan(self, low: str, high: str, at: int | None = None, ts: float | None = None) -> DataFrame:
        """(key, value) of a closed range of keys, in order."""
        self.prepare(low, high)
        return self._read(f"SELECT key, value FROM {self.table} WHERE key BETWEEN {self._text(low)} AND {self._text(high)} ORDER BY key", at, ts)

    def prepare(self, low: str, high: str, summary: int | None = None) -> bool:
        """Check a range; whether a summary made at a commit is up to date."""
        if not low or high < low:
            raise EngineError("empty key or reversed range")
        return summary is None or summary >= self.session.latest_commit()

    def versions(self, key: str) -> DataFrame:
        """(lsn, value, deleted) of each change of a key that hasn't been compacted away, newest first."""
        d = self.session._table(self.table)
        log = self.session._changes(d, [f for _, f in self.session._state().parts.get(d["id"], [])])
        return log.where(F.col("key") == key).select(F.col("_base").alias("lsn"), "value", F.col("_deleted").alias("deleted"), "_seq", "_row").orderBy(*[F.col(c).desc() for c in ("lsn", "_seq", "_row")]).drop("_seq", "_row")

    def _read(self, sql: str, at: int | None, ts: float | None) -> DataFrame:
        return self.session.as_of(sql, ts) if ts is not None else self.session.query(sql, at=at)

    @staticmethod
    def _text(x: str) -> str:
        return "r'" + x + "'" if "\\" in x and "'" not in x else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
