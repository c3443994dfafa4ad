"""The folds of :mod:`tidepool.operators.sequences` and :mod:`~tidepool.operators.flows` as streams, with
state of their own for each client or run (transformWithState; the session's state store must be
RocksDB).

Rows of one trigger are taken in their order; a later trigger brings later rows. State lies in the
store's maps, entry by entry, so a trigger reads and writes what its rows touch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidepool.operators import flows, sequences
from tidepool.operators.sequences import CHANGE, FATE, LEASE_MS, MOST_BUFFERED, MOST_RUNNING, MOST_SEEN, RUN, RUN_FIELDS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _names(kind: str) -> list[str]:
    return [c.split()[0] for c in kind.split(", ")]


def _row(names: list[str], values: dict) -> Row:
    return Row(*names)(*(values.get(n) for n in names))


class StateMap:
    """A map state as the mapping that a fold asks for; values are dicts of `fields`, or single ones."""

    def __init__(self, state, fields: list[str] | None = None):
        self.state, self.fields = state, fields

    def _out(self, value):
        return dict(zip(self.fields, value)) if self.fields else value[0]

    def get(self, key, default=None):
        return self._out(self.state.getValue((key,))) if self.state.containsKey((key,)) else default

    def __contains__(self, key) -> bool:
        return self.state.containsKey((key,))

    def __setitem__(self, key, value) -> None:
        self.state.updateValue((key,), tuple(value[f] for f in self.fields) if self.fields else (value,))

    def __delitem__(self, key) -> None:
        self.state.removeKey((key,))

    def values(self) -> list:
        return [self._out(v) for _, v in self.state.iterator()]

    def items(self) -> list:
        return [(k[0], self._out(v)) for k, v in self.state.iterator()]


class StateQueue:
    """Distinct values, oldest first, in two maps: by number and by value; `ends` holds the next
    number, the oldest and the size."""

    def __init__(self, handle, name: str, kind: str, more: str = "string"):
        self.by_number = handle.getMapState(f"{name}_numbers", "number long", f"value {kind}, more {more}")
        self.by_value = handle.getMapState(f"{name}_values", f"value {kind}", "number long")
        self.ends = handle.getValueState(f"{name}_ends", "next long, oldest long, size long")

    def _ends(self) -> tuple[int, int, int]:
        return tuple(self.ends.get()) if self.ends.exists() else (0, 0, 0)

    def __contains__(self, value) -> bool:
        return self.by_value.containsKey((value,))

    def __len__(self) -> int:
        return self._ends()[2]

    def add(self, value, more=None) -> None:
        if value in self:
            return
        number, oldest, size = self._ends()
        self.by_number.updateValue((number,), (value, more))
        self.by_value.updateValue((value,), (number,))
        self.ends.update((number + 1, oldest, size + 1))

    def pop(self):
        number, oldest, size = self._ends()
        while not self.by_number.containsKey((oldest,)):  # discarded
            oldest += 1
        value, more = self.by_number.getValue((oldest,))
        self.by_number.removeKey((oldest,))
        self.by_value.removeKey((value,))
        self.ends.update((number, oldest + 1, size - 1))
        return value, more

    def discard(self, value) -> None:
        if value in self:
            (place,) = self.by_value.getValue((value,))
            number, oldest, size = self._ends()
            self.by_value.removeKey((value,))
            self.by_number.removeKey((place,))
            self.ends.update((number, oldest, size - 1))


class RunProcessor(StatefulProcessor):
    """Runs end with their lease: a timer is set for the earliest end, and asks again when it fires."""

    def __init__(self, lease_ms: int, most: int):
        self.lease_ms, self.most = lease_ms, most

    def init(self, handle) -> None:
        self.handle = handle
        self.running = StateMap(handle.getMapState("running", "run_id string", RUN), RUN_FIELDS)
        self.ended = StateMap(handle.getMapState("ended", "run_id string", RUN), RUN_FIELDS)
        self.marks = StateMap(handle.getMapState("marks", "name string", "value long"))

    def _fold(self, client) -> sequences.Runs:
        return sequences.Runs(client, self.running, self.ended, self.marks, self.lease_ms, self.most, eager=True)

    def _timer(self) -> None:
        ends = min((r["lease"] for r in self.running.values()), default=None)
        for timer in list(self.handle.listTimers()):
            if timer != ends:
                self.handle.deleteTimer(timer)
        if ends is not None:
            self.handle.registerTimer(ends)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        fold, names = self._fold(key[0]), _names(CHANGE)
        for m in sorted((r.asDict() for r in rows), key=lambda m: (m["at"], m["seq"])):
            for out in fold.step(m):
                yield _row(names, out)
        self._timer()

    def handleExpiredTimer(self, key, timer_values, info) -> Iterator[Row]:
        for out in self._fold(key[0]).lapse(info.getExpiryTimeInMs()):
            yield _row(_names(CHANGE), out)
        self._timer()

    def close(self) -> None:
        pass


def run_changes(messages: DataFrame, lease_ms: int = LEASE_MS, most: int = MOST_RUNNING, delay: str = "0 seconds") -> DataFrame:
    """CHANGE rows of a stream of messages, as sequences.run_changes(eager=True) has them; a run that
    nobody asks about ends when the watermark (at, less the delay) passes its lease."""
    timed = messages.withColumn("time", F.timestamp_millis("at")).withWatermark("time", delay)
    return timed.groupBy("client").transformWithState(RunProcessor(lease_ms, most), CHANGE, "Append", "EventTime")


class MemoryProcessor(StatefulProcessor):
    def __init__(self, backfill: bool, most_seen: int, most_buffered: int):
        self.options = (backfill, most_seen, most_buffered)

    def init(self, handle) -> None:
        self.seen, self.asked = StateQueue(handle, "seen", "string"), StateQueue(handle, "asked", "string")
        self.posts, self.backfills = StateQueue(handle, "posts", "long"), StateQueue(handle, "backfills", "long")
        self.marks = StateMap(handle.getMapState("marks", "name string", "value long"))

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        fold = sequences.Memory(key[0], self.seen, self.asked, self.posts, self.backfills, self.marks, *self.options)
        for row in sorted((r.asDict() for r in rows), key=lambda r: (r["batch"], r["pos"])):
            for out in fold.step(row):
                yield _row(_names(FATE), out)

    def close(self) -> None:
        pass


def client_fates(sights: DataFrame, backfill: bool = False, most_seen: int = MOST_SEEN, most_buffered: int = MOST_BUFFERED) -> DataFrame:
    """FATE rows of a stream of sights. A client's batch is over when its next one begins."""
    return sights.groupBy("client").transformWithState(MemoryProcessor(backfill, most_seen, most_buffered), FATE, "Append", "None")


STAGED = "client long, seq long, at long, kind string, posts long, entry long, saved boolean"
SETTLED = "client long, seq long, fate string, restart long, place long"


class StagingProcessor(StatefulProcessor):
    """What a client has staged; the store itself forgets an entry when its time to live is over."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.entries = StateMap(handle.getMapState("entries", "seq long", "at long, posts long, kept boolean", ttlDurationMs=self.ttl_ms), ["at", "posts", "kept"])

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        settled = lambda **x: _row(_names(SETTLED), {"client": key[0]} | x)
        for m in sorted((r.asDict() for r in rows), key=lambda m: (m["at"], m["seq"])):
            if m["kind"] == "stage":
                self.entries[m["seq"]] = {"at": m["at"], "posts": m["posts"], "kept": False}
            elif m["kind"] == "clear":
                entry = self.entries.get(m["entry"])
                if entry is not None and not entry["kept"]:  # after a restart nothing else clears it
                    del self.entries[m["entry"]]
                    yield settled(seq=m["entry"], fate="handled")
            else:
                place = 0
                for seq, entry in sorted(self.entries.items(), key=lambda e: (e[1]["at"], e[0])):
                    if m["at"] - entry["at"] > self.ttl_ms:
                        fate = "expired"
                    elif not entry["posts"]:
                        fate = "empty"
                    elif m["saved"]:
                        fate, place = "recovered", place + 1
                    else:
                        self.entries[seq] = entry | {"kept": True}
                        continue
                    del self.entries[seq]
                    yield settled(seq=seq, fate=fate, restart=m["seq"], place=place if fate == "recovered" else None)

    def close(self) -> None:
        pass


def recovered(log: DataFrame, ttl_ms: int = flows.STAGE_TTL_MS) -> DataFrame:
    """SETTLED rows of a stream of STAGED rows (kind stage, clear or restart), as flows.recovered() has
    them; what is still staged gives none."""
    return log.groupBy("client").transformWithState(StagingProcessor(ttl_ms), SETTLED, "Append", "ProcessingTime")


OUTCOME, COMMITTED = "run long, ordinal long, arrival long", "run long, ordinal long, arrival long, released long"


class CommitProcessor(StatefulProcessor):
    """A reorder buffer: what has arrived too early waits in a map."""

    def init(self, handle) -> None:
        self.waiting = StateMap(handle.getMapState("waiting", "ordinal long", "arrival long"))
        self.next = handle.getValueState("next", "ordinal long")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        due = self.next.get()[0] if self.next.exists() else 0
        for r in sorted((r.asDict() for r in rows), key=lambda r: r["arrival"]):
            if r["ordinal"] < due or r["ordinal"] in self.waiting:
                continue
            self.waiting[r["ordinal"]] = r["arrival"]
            while due in self.waiting:
                yield _row(_names(COMMITTED), {"run": key[0], "ordinal": due, "arrival": self.waiting.get(due), "released": r["arrival"]})
                del self.waiting[due]
                due += 1
        self.next.update((due,))

    def close(self) -> None:
        pass


def released(outcomes: DataFrame) -> DataFrame:
    """COMMITTED rows of a stream of OUTCOME rows, run by run in order of ordinals."""
    return outcomes.groupBy("run").transformWithState(CommitProcessor(), COMMITTED, "Append", "None")


def paired(received: DataFrame, finished: DataFrame, within: str = "10 minutes", delay: str = "1 minute") -> DataFrame:
    """flows.paired() of two streams (client, tab, request, seq, time; received also endpoint) whose request
    ids are used once: a stream-stream join with watermarks on both sides, so that each side keeps
    what the other may still ask for, and no more."""
    left = received.where("endpoint is not null").withWatermark("time", delay).select(
        "client", "tab", "request", "endpoint", F.col("seq").alias("received"), F.col("time").alias("announced")
    )
    right = finished.withWatermark("time", delay).select(
        F.col("client").alias("c"), F.col("tab").alias("t"), F.col("request").alias("r"), F.col("seq").alias("finished"), F.col("time").alias("ended")
    )
    same = (F.col("client") == F.col("c")) & (F.col("tab") == F.col("t")) & (F.col("request") == F.col("r"))
    soon = (F.col("ended") >= F.col("announced")) & (F.col("ended") <= F.col("announced") + F.expr(f"INTERVAL {within}"))
    return left.join(right, same & soon).select("client", "tab", "request", "endpoint", "received", "finished")
