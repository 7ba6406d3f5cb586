"""The life of a pending write as a stream: one state per write, and a timer that ends its wait."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.writes import Policy

LIFE_SCHEMA = "write_id long, seq long, kind string, code string, status string"


class WriteLife(StatefulProcessor):
    """State: the status and, in ms, when the wait ends. Events of one micro-batch count in the order of (at, seq)."""

    def __init__(self, policy: Policy = Policy()):
        self.policy = policy

    def init(self, handle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "status string, expires_us long")

    def _propose(self, row, status, expires):
        if status is not None:
            return "duplicate", status, expires
        if self.policy.refuses(row.target, row.origin):
            return "rejected_by_policy", "refused", 0
        hours = self.policy.ttl_hours if pd.isna(row.ttl_hours) else int(row.ttl_hours)
        ends = row.at_us + hours * 3_600_000_000
        return ("queued", "pending", ends) if self.policy.needs_approval(row.target) else ("applied_immediate", "approved", ends)

    def _settle(self, kind, status):
        if status in (None, "refused"):
            return "not_found", status
        if kind == "apply":
            codes = {"approved": "ok", "applied": "idempotent", "rejected": "already_rejected", "expired": "expired", "pending": "cannot_apply"}
            return codes[status], "applied" if status == "approved" else status
        if status == "pending":
            return "ok", "approved" if kind == "approve" else "rejected"
        same = {"approve": ("approved", "applied"), "reject": ("rejected",)}[kind]
        other = "expired" if status == "expired" else "already_applied" if status == "applied" else "conflict_opposite"
        return "idempotent" if status in same else other, status

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        if not frames:
            return
        status, expires = self.life.get() if self.life.exists() else (None, 0)
        out = []
        for row in pd.concat(frames).sort_values(["at_us", "seq"]).itertuples(index=False):
            if status == "pending" and row.at_us > expires:
                status = "expired"  # the timer gives the row that says so
            if row.kind == "propose":
                code, status, expires = self._propose(row, status, expires)
                if code == "queued":
                    self.handle.registerTimer(expires // 1000 + 1)
            else:
                code, status = self._settle(row.kind, status)
            out.append((key[0], row.seq, row.kind, code, None if status == "refused" else status))
        self.life.update((status, int(expires)))
        yield pd.DataFrame(out, columns=["write_id", "seq", "kind", "code", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, expires = self.life.get() if self.life.exists() else (None, 0)
        if status in ("pending", "expired"):
            self.life.update(("expired", int(expires)))
            yield pd.DataFrame([(key[0], None, "expire", "expired", "expired")], columns=["write_id", "seq", "kind", "code", "status"]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def stream_lifecycle(events: DataFrame, policy: Policy = Policy(), lateness: str = "0 seconds") -> DataFrame:
    """As ``operators.writes.write_lifecycle``, for a stream of its events. Needs the RocksDB state store."""
    rows = events.withWatermark("at", lateness).withColumn("at_us", F.unix_micros("at"))
    return rows.groupBy("write_id").transformWithStateInPandas(WriteLife(policy), LIFE_SCHEMA, "Append", "EventTime")
