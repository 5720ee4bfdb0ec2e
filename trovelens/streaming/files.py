"""Continuous index state: event bursts, held deletions and the stability gate as streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from trovelens.operators.lifecycle import DEFER_NS, HOLD_S, RECHECK_NS, SETTLE_NS, SLOP_NS

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of files whose held deletions share a state and a timer.
HELD_GROUPS = 1024


def debounced_paths(events: DataFrame, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """root, window and the distinct paths of each burst. Access events are dropped; an overflow asks for the whole root.

    The watermark only bounds state: paths are read again from disk, so a late event costs a rescan.
    """
    wanted = events.filter(F.col("kind") != "access").withWatermark("ts", late)
    bursts = wanted.groupBy("root", F.session_window("ts", gap).alias("burst"))
    return bursts.agg(F.collect_set("path").alias("paths"), F.max((F.col("kind") == "overflow")).alias("rescan"))


def held_events(hold_s: int = HOLD_S):
    """The function that lets vanished files of one group go after the hold unless they are seen again.

    The state is a group's files that are held and when each is due, in milliseconds; the group's timer is the first one's.
    """
    hold_ms = hold_s * 1000

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due = dict(zip(*state.get, strict=True)) if state.exists else {}
        gone: list[tuple[int, int]] = []
        if not state.hasTimedOut:
            e = pd.concat(list(rows)).sort_values(["file_id", "us", "nth"])
            file, vanished = e["file_id"].to_numpy(), e["vanished"].to_numpy()
            # A sight after a sight changes nothing.
            telling = vanished | np.concatenate([[True], vanished[:-1] | (file[1:] != file[:-1])])
            for f, us, v in zip(file[telling].tolist(), e["us"].to_numpy()[telling].tolist(), vanished[telling].tolist(), strict=True):
                old = due.get(f)
                if old is not None:
                    if v and us <= old * 1000:
                        continue  # the first one's time stands
                    del due[f]
                    if us > old * 1000:
                        gone.append((f, old))
                if v:
                    due[f] = us // 1000 + hold_ms
        now = state.getCurrentWatermarkMs()
        over = [(f, at) for f, at in due.items() if at <= now]
        gone += over
        for f, _ in over:
            del due[f]
        if due:
            state.update((list(due), list(due.values())))
            state.setTimeoutTimestamp(min(due.values()))
        elif state.exists:
            state.remove()
        if gone:
            yield pd.DataFrame({"file_id": pd.Series([None if key[0] < 0 else f for f, _ in gone], dtype="Int64"), "due_ms": [at for _, at in gone]})

    return run


def held_deletions(events: DataFrame, hold_s: int = HOLD_S, late: str = "1 second", nth: str | None = None) -> DataFrame:
    """file_id, deleted_at from events (file_id, kind vanished or seen, ts), by event time; of one time in the order of the column ``nth``.

    Files are handled in HELD_GROUPS groups, so that what a batch costs is its events and not a call for each file.
    """
    group = F.when(F.col("file_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("file_id"), F.lit(HELD_GROUPS))).cast("int")
    timed = events.withWatermark("ts", late).select(
        group.alias("group"), F.coalesce("file_id", F.lit(0)).cast("long").alias("file_id"), F.coalesce(F.col("kind") == "vanished", F.lit(False)).alias("vanished"), "ts",
        F.unix_micros("ts").alias("us"), (F.lit(0) if nth is None else F.col(nth)).cast("long").alias("nth"),
    )
    found = timed.groupBy("group").applyInPandasWithState(held_events(hold_s), "file_id long, due_ms long", "files array<bigint>, due array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("file_id", F.timestamp_millis("due_ms").alias("deleted_at"))


def settle(mtime_ns: int, now_ns: int, size: int, previous: int | None) -> tuple[str, int]:
    """The stability decision for one look at a file; the row form is ``lifecycle.stability``."""
    past = now_ns - mtime_ns
    age = past if past >= 0 else 0 if -past < SLOP_NS else SETTLE_NS
    if age < SETTLE_NS:
        return "defer", max(SETTLE_NS - age, RECHECK_NS)
    if previous is not None and previous != size:
        return "defer", DEFER_NS
    return ("watch", RECHECK_NS) if previous is None else ("extract", 0)


class Stability(StatefulProcessor):
    """Remembers the size at the last settled look of each file and decides on the next one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.size = handle.getValueState("size", StructType([StructField("size", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        looks = pd.concat(list(rows)).sort_values("now_ns")
        out = []
        for mtime, now, size in zip(looks["mtime_ns"], looks["now_ns"], looks["size"], strict=True):
            previous = self.size.get()[0] if self.size.exists() else None
            decision, wait = settle(int(mtime), int(now), int(size), previous)
            if decision == "watch":
                self.size.update((int(size),))
            else:
                self.size.clear()
            out.append((key[0], int(now), decision, wait))
        yield pd.DataFrame(out, columns=["file_id", "now_ns", "decision", "wait_ns"])

    def close(self) -> None:
        pass


def stability_gate(looks: DataFrame) -> DataFrame:
    """file_id, now_ns, decision, wait_ns for looks (file_id, mtime_ns, now_ns, size) at files."""
    out = StructType([StructField("file_id", LongType()), StructField("now_ns", LongType()), StructField("decision", StringType()), StructField("wait_ns", LongType())])
    return looks.groupBy("file_id").transformWithStateInPandas(Stability(), out, "Update", "None")
