"""The audit log on disk: an SQLite table that only takes records which continue the chain, and gives up none.

The database itself refuses changes: triggers abort every UPDATE and DELETE, and every INSERT whose number or link doesn't
follow the last record. So a second process can't fork the chain, and a restart goes on where the last one stopped. What a
privileged writer could still do is found by verification (audit.faults) against an anchor that is kept elsewhere.
"""

from __future__ import annotations

import json
import sqlite3
import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from sluice.governance import audit

#: What a record says, besides its number, link and hash. A field that an operation doesn't know is null.
FIELDS = (
    "at", "operation", "role", "name", "sql", "question", "status", "rules", "codes", "decision", "confirmed", "estimated_bytes", "estimated_rows", "tables", "columns", "masked", "rows", "truncated", "duration_ms", "trace", "catalog",
)

_SCHEMA = f"""
CREATE TABLE IF NOT EXISTS audit (seq INTEGER PRIMARY KEY, status TEXT NOT NULL, prev TEXT NOT NULL, hash TEXT NOT NULL UNIQUE, body TEXT NOT NULL);
CREATE TRIGGER IF NOT EXISTS audit_keeps BEFORE UPDATE ON audit BEGIN SELECT RAISE(ABORT, 'the log is append-only'); END;
CREATE TRIGGER IF NOT EXISTS audit_loses BEFORE DELETE ON audit BEGIN SELECT RAISE(ABORT, 'the log is append-only'); END;
CREATE TRIGGER IF NOT EXISTS audit_follows BEFORE INSERT ON audit
WHEN NEW.seq <> coalesce((SELECT max(seq) FROM audit), 0) + 1 OR NEW.prev <> coalesce((SELECT hash FROM audit ORDER BY seq DESC LIMIT 1), '{audit.GENESIS}')
BEGIN SELECT RAISE(ABORT, 'the record does not continue the chain'); END;
"""


class Store:
    """A log with the interface of audit.Log, kept in a file. Records are read back one by one, never all at once."""

    def __init__(self, path: str):
        self.path, self.lock = path, threading.RLock()
        self.db = sqlite3.connect(path, check_same_thread=False, isolation_level=None)
        self.db.execute("PRAGMA recursive_triggers = ON")  # else REPLACE deletes unseen
        self.db.executescript(_SCHEMA)

    def append(self, **what) -> dict:
        unknown = what.keys() - set(FIELDS)
        if unknown:
            raise ValueError(f"a record has no field {', '.join(sorted(unknown))}")
        with self.lock:
            self.db.execute("BEGIN IMMEDIATE")
            try:
                seq, prev = self.anchor()
                record = audit.sealed(seq + 1, prev, {k: what.get(k) for k in FIELDS if k != "at"})
                self.db.execute("INSERT INTO audit VALUES (?, ?, ?, ?, ?)", (record["seq"], record["status"] or "", record["prev"], record["hash"], audit.canonical(record)))
                self.db.execute("COMMIT")
            except BaseException:
                self.db.execute("ROLLBACK")
                raise
            return record

    def __iter__(self) -> Iterator[tuple[int, str, str, str, str]]:
        """(seq, status, prev, hash, body) in order."""
        yield from self.db.execute("SELECT seq, status, prev, hash, body FROM audit ORDER BY seq")

    def anchor(self) -> tuple[int, str]:
        """The last record's number and hash; kept elsewhere, it shows later that nothing up to it was rewritten."""
        return self.db.execute("SELECT seq, hash FROM audit ORDER BY seq DESC LIMIT 1").fetchone() or (0, audit.GENESIS)

    def holds(self, seq: int, digest: str) -> bool:
        """Whether an anchor taken before still stands."""
        found = self.db.execute("SELECT hash FROM audit WHERE seq = ?", (seq,)).fetchone()
        return seq == 0 and digest == audit.GENESIS or found == (digest,)

    def counts(self) -> dict[str, int]:
        found = dict(self.db.execute("SELECT status, count(*) FROM audit GROUP BY status"))
        return {s: found.get(s, 0) for s in audit.STATUSES}

    def reconcile(self, executions: int) -> dict[str, int | bool]:
        """Whether as many statements ran as the log says: ``executions`` is the executor's own count since the log began.
        Operations that only look at a statement run nothing."""
        logged = self.db.execute("SELECT count(*) FROM audit WHERE json_extract(body, '$.operation') = 'run' AND status IN ('executed', 'failed')").fetchone()[0]
        return {"logged": logged, "executed": executions, "equal": logged == executions}

    def export(self, path: str) -> int:
        """Writes the records as JSON lines, which audit.read() reads in parallel; returns how many."""
        n = 0
        with open(path, "w") as f:
            for seq, status, prev, digest, body in self:
                f.write(json.dumps({"seq": seq, "status": status, "prev": prev, "hash": digest, "body": body}) + "\n")
                n += 1
        return n

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self), audit.SCHEMA)

    def close(self) -> None:
        self.db.close()
