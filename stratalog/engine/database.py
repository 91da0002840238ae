"""A database as a program without exceptions sees it: open, execute, status codes, the last error, close."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from stratalog.engine.errors import EngineError, NotSupportedError
from stratalog.engine.session import Session
from stratalog.operators.report import Monitor

OK, ERROR, FEATURE_NOT_SUPPORTED = 0, 1, 2
MODES = ("rw", "ro", "create")


@dataclass
class Result:
    status: int = OK
    columns: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)


class Database:
    """``mode``: ``ro`` refuses changes, ``rw`` wants the database to be there, ``create`` makes it; ``limit`` bounds fetched rows."""

    def __init__(self, spark: SparkSession, monitor: Monitor | None = None, limit: int = 10_000):
        self.spark, self.monitor, self.limit = spark, monitor or Monitor(), limit
        self.session: Session | None = None
        self.last_error = ""

    @classmethod
    def open(cls, spark: SparkSession, path: str, mode: str = "create", monitor: Monitor | None = None, **options: Any) -> Database:
        db = cls(spark, monitor)
        if mode not in MODES:
            raise EngineError(f"no such mode: {mode}")
        session = Session(spark, path, guard=lambda: mode != "ro" and db.monitor.allows_write, **options)
        if mode != "create" and session.latest_commit() == 0:
            raise EngineError(f"no database at {path}")
        db.session = session
        return db

    def execute(self, text: str) -> Result:
        """Run one statement; what goes wrong is a status and the last error."""
        try:
            return self._execute(text.strip().rstrip(";").strip())
        except NotSupportedError as e:
            self.last_error = str(e)
            return Result(FEATURE_NOT_SUPPORTED)
        except Exception as e:  # noqa: BLE001
            self.last_error = str(e) or type(e).__name__
            return Result(ERROR)

    def _execute(self, text: str) -> Result:
        if m := re.fullmatch(r"OPEN\s+'([^']*)'(?:\s+(rw|ro|create))?", text, re.I):
            self.session = Database.open(self.spark, m[1], (m[2] or "create").lower(), self.monitor).session
            return Result()
        if not self.session:
            raise EngineError("no database is open")
        if re.fullmatch(r"PRAGMA\s+rar_status", text, re.I):
            return Result(OK, ["key", "value"], list(self.monitor.status().items()))
        df = self.session.sql(text)
        if df is None:
            return Result()
        return Result(OK, df.columns, [tuple(r) for r in df.limit(self.limit).collect()])

    def close(self) -> None:
        """Statements of a group are published; an open transaction is rolled back."""
        if self.session:
            if self.session.txn:
                self.session.sql("ROLLBACK")
            self.session.group_commit()
            self.session = None
