"""A hash-chained log: one record for every invocation, refused ones included, and its verification as a data frame."""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
STATUSES = ("executed", "rejected", "over_budget", "failed")


def canonical(record: dict) -> str:
    return json.dumps({k: v for k, v in record.items() if k not in ("hash", "prev")}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def link(prev: str, body: str) -> str:
    return hashlib.sha256(bytes.fromhex(prev) + body.encode()).hexdigest()


SCHEMA = "seq long, status string, prev string, hash string, body string"


def sealed(seq: int, prev: str, what: dict) -> dict:
    """A record with its number, time, link and hash."""
    record = {"seq": seq, "at": round(time.time(), 3), **what}
    return record | {"prev": prev, "hash": link(prev, canonical(record))}


def read(spark: SparkSession, path: str) -> DataFrame:
    """A log that was exported as JSON lines, for faults(); read in parallel."""
    return spark.read.schema(SCHEMA).json(path)


@dataclass
class Log:
    """Append-only in this process; ``sink`` takes each record as it is made."""

    sink: object = None
    records: list[dict] = field(default_factory=list)
    lock: threading.RLock = field(default_factory=threading.RLock)

    def append(self, **what) -> dict:
        with self.lock:
            record = sealed(len(self.records) + 1, self.records[-1]["hash"] if self.records else GENESIS, what)
            self.records.append(record)
            if self.sink is not None:
                self.sink(record)
            return record

    def anchor(self) -> tuple[int, str]:
        with self.lock:
            return (self.records[-1]["seq"], self.records[-1]["hash"]) if self.records else (0, GENESIS)

    def counts(self) -> dict[str, int]:
        found = Counter(r["status"] for r in self.records)
        return {s: found.get(s, 0) for s in STATUSES}

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r["seq"], r["status"], r["prev"], r["hash"], canonical(r)) for r in self.records]
        return spark.createDataFrame(rows, SCHEMA)


def faults(log: DataFrame) -> DataFrame:
    """(seq, fault) for every record of ``log`` (seq, prev, hash, body) that breaks the chain: gap, genesis, prev, content.

    The chain of hashes is checked pair by pair and each record's hash from its own row, so records may lie anywhere; the
    order is split by ranges of seq, and a window never holds more than one range and the record before it.
    """
    step = 100_000
    rows = log.select("seq", "prev", "hash", "body", F.floor(F.col("seq") / step).alias("range"))
    edges = rows.where(F.col("seq") % step == step - 1).withColumn("range", F.col("range") + 1).withColumn("edge", F.lit(True))
    both = rows.withColumn("edge", F.lit(False)).unionByName(edges)
    order = Window.partitionBy("range").orderBy("seq")
    seen = both.withColumn("before", F.lag("hash").over(order)).withColumn("last", F.lag("seq").over(order)).where("NOT edge")
    computed = F.sha2(F.concat(F.unhex("prev"), F.encode("body", "utf-8")), 256)
    gap = F.when(F.col("seq") == 1, F.lit(False)).otherwise(F.coalesce(F.col("last") != F.col("seq") - 1, F.lit(True)))
    checks = [(gap, "gap"), ((F.col("seq") == 1) & (F.col("prev") != GENESIS), "genesis"), ((F.col("seq") > 1) & F.col("before").isNotNull() & (F.col("prev") != F.col("before")), "prev"), (F.coalesce(computed != F.col("hash"), F.lit(True)), "content")]
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks]))
    return seen.select("seq", F.explode(found).alias("fault"))
