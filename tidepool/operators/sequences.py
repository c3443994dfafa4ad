"""Folds in which what happens to a row depends on what happened to those before it: life cycle of
scrape runs, a client's bounded memory.

A key's rows are dealt to one task and sorted, and go through a fold one by one, so a task holds the
state of one key and no more rows than a batch. The folds know nothing of Spark: they keep their
state in mappings and queues, which are those below in a batch, and state stores in a stream
(:mod:`tidepool.streaming.stateful`)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def in_order(rows: DataFrame, keys: list[str], order: list[str], begin: Callable, schema: str) -> DataFrame:
    """The rows that begin(key) makes of each key's rows in order: begin gives an object with step(row)
    and end(), which both give dicts. A null key is a key of its own."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        current, fold = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if fold is None or key != current:
                    if fold is not None:
                        out.extend(fold.end())
                    current, fold = key, begin(key)
                out.extend(fold.step(row))
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
        if fold is not None and (out := list(fold.end())):
            yield pa.RecordBatch.from_pylist(out, kinds)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


# ---- scrape runs -------------------------------------------------------------------------

LEASE_MS, MOST_RUNNING = 90_000, 4
#: Stops after which a run may go on.
RECOVERABLE = ("lease-expired", "source-tab-closed")
ENDINGS = ("aborted", "completed", "failed")
RUN = "run_id string, list_id string, tab long, state string, stop_reason string, started long, lease long, updated long, finished long"
RUN_FIELDS = [f.split()[0] for f in RUN.split(", ")]
MESSAGE = "client long, seq long, at long, kind string, run_id string, list_id string, tab long, started long, ending string"
CHANGE = f"client long, seq long, change long, outcome string, {RUN}"


class Runs:
    """Runs of one client. `running` and `ended` map a run's id to its fields; `marks` maps `change`
    (how many rows were given) and `cutover` to numbers.

    A run is begun by a tab for a list; four at most are running, one for each tab. Its lease must
    be renewed within lease_ms. A begin or an observation that finds a lease run out ends that run;
    a begin that is refused changes nothing. With `eager` a run ends when its lease does, whoever
    asks. A run that ended with its lease or its tab may be begun again, by any tab that is free."""

    def __init__(self, client, running, ended, marks, lease_ms: int = LEASE_MS, most: int = MOST_RUNNING, eager: bool = False):
        self.client, self.running, self.ended, self.marks = client, running, ended, marks
        self.lease_ms, self.most, self.eager = lease_ms, most, eager
        self.seq = None

    def row(self, outcome: str | None, run: dict | None) -> dict:
        number = self.marks.get("change", 0) + 1
        self.marks["change"] = number
        return {"client": self.client, "seq": self.seq, "change": number, "outcome": outcome} | (run or {})

    def put(self, run: dict, **changes) -> dict:
        run = run | changes
        live, rest = (self.running, self.ended) if run["state"] == "running" else (self.ended, self.running)
        live[run["run_id"]] = run
        if run["run_id"] in rest:
            del rest[run["run_id"]]
        return run

    def expired(self, run: dict, at: int) -> dict:
        return self.row(None, self.put(run, state="failed", stop_reason="lease-expired", updated=at, finished=at))

    def lapsed(self, at: int) -> list[dict]:
        return sorted((r for r in self.running.values() if r["lease"] <= at), key=lambda r: (r["lease"], r["run_id"]))

    def lapse(self, at: int) -> Iterator[dict]:
        """Ends the runs whose lease ends by then, each at the end of its lease."""
        for run in self.lapsed(at):
            yield self.expired(run, run["lease"])

    def step(self, m: dict) -> Iterator[dict]:
        self.seq = m["seq"]
        if self.eager:
            yield from self.lapse(m["at"])
        yield from getattr(self, m["kind"])(m)

    def end(self) -> Iterator[dict]:
        return iter(())

    def begin(self, m: dict) -> Iterator[dict]:
        at = m["at"]
        refuse = lambda why: self.row(why, {"run_id": m["run_id"]})
        if self.marks.get("cutover", 0):
            yield refuse("cutover-active")
            return
        lapsed = self.lapsed(at)
        gone = {r["run_id"] for r in lapsed}
        active = [r for r in self.running.values() if r["run_id"] not in gone]
        run = self.running.get(m["run_id"]) or self.ended.get(m["run_id"])
        going = run is not None and run["state"] == "running" and run["run_id"] not in gone
        stop = "lease-expired" if run is not None and run["run_id"] in gone else run and run["stop_reason"]
        if run is not None and (run["list_id"], run["started"]) != (m["list_id"], m["started"]):
            yield refuse("run-conflict")
        elif going and run["tab"] != m["tab"]:
            yield refuse("run-conflict")
        elif run is not None and not going and stop not in RECOVERABLE:
            yield refuse("run-terminal")
        elif not going and any(r["tab"] == m["tab"] for r in active):
            yield refuse("source-tab-active")
        elif not going and len(active) >= self.most:
            yield refuse("capacity-full")
        else:
            for old in lapsed:
                if old["run_id"] != m["run_id"]:
                    yield self.expired(old, at)
            now = {"lease": at + self.lease_ms, "updated": at}
            if going:
                yield self.row("renewed", self.put(run, **now))
            elif run is not None:
                yield self.row("resumed", self.put(run, **now, tab=m["tab"], state="running", stop_reason=None, finished=None))
            else:
                new = {k: m[k] for k in ("run_id", "list_id", "tab", "started")}
                yield self.row("began", self.put(new | now | {"state": "running", "stop_reason": None, "finished": None}))

    def renew(self, m: dict) -> Iterator[dict]:
        run = self.running.get(m["run_id"])
        if run is None:
            yield self.row("run-terminal" if m["run_id"] in self.ended else "unknown-run", {"run_id": m["run_id"]})
        elif run["tab"] != m["tab"]:
            yield self.row("run-conflict", {"run_id": m["run_id"]})
        else:
            yield self.row("renewed", self.put(run, lease=m["at"] + self.lease_ms, updated=m["at"]))

    def finish(self, m: dict) -> Iterator[dict]:
        run = self.running.get(m["run_id"]) or self.ended.get(m["run_id"])
        if run is None:
            yield self.row("unknown-run", {"run_id": m["run_id"]})
        elif run["state"] not in ("running", m["ending"]):
            yield self.row("run-terminal", {"run_id": m["run_id"]})
        else:
            yield self.row("finished", self.put(run, state=m["ending"], finished=m["at"], updated=m["at"]))

    def observe(self, m: dict) -> Iterator[dict]:
        run = next((r for r in self.running.values() if r["tab"] == m["tab"]), None)
        if run is not None and run["lease"] <= m["at"]:
            yield self.expired(run, m["at"])
            run = None
        if run is None:
            yield self.row("unattached", None)
        else:
            yield self.row("observed", self.put(run, updated=m["at"]))

    def _close(self, m: dict, runs: list[dict], **changes) -> Iterator[dict]:
        for run in sorted(runs, key=lambda r: r["run_id"]):
            yield self.row(None, self.put(run, finished=m["at"], updated=m["at"], **changes))
        yield self.row(f"closed-{len(runs)}", None)

    def tab_closed(self, m: dict) -> Iterator[dict]:
        runs = [r for r in self.running.values() if r["tab"] == m["tab"]]
        yield from self._close(m, runs, state="aborted", stop_reason="source-tab-closed")

    def cutover_begin(self, m: dict) -> Iterator[dict]:
        self.marks["cutover"] = 1
        yield from self._close(m, list(self.running.values()), state="failed")

    def cutover_end(self, m: dict) -> Iterator[dict]:
        self.marks["cutover"] = 0
        yield self.row("cutover-ended", None)


def run_changes(messages: DataFrame, lease_ms: int = LEASE_MS, most: int = MOST_RUNNING, eager: bool = False) -> DataFrame:
    """CHANGE rows of messages (MESSAGE): one with an outcome for each message, and one for each run
    that ended because of it. Messages of a client go by (at, seq)."""
    begin = lambda key: Runs(key[0], {}, {}, {}, lease_ms, most, eager)
    return in_order(messages, ["client"], ["at", "seq"], begin, CHANGE)


def run_states(changes: DataFrame) -> DataFrame:
    """client and fields of each run, by its last change."""
    fields = F.struct(*RUN_FIELDS)
    last = changes.where("state is not null").groupBy("client", F.col("run_id").alias("of")).agg(F.max_by(fields, "change").alias("run"))
    return last.select("client", "run.*")


# ---- what a client remembers ---------------------------------------------------------------

MOST_SEEN, MOST_BUFFERED = 50_000, 2_000
SIGHT = "client long, batch long, pos long, kind string, id string, is_article boolean, has_photo boolean"
FATE = "client long, pos long, fate string"


class Queue:
    """Distinct values, oldest first."""

    def __init__(self):
        self.held: dict = {}

    def __contains__(self, value) -> bool:
        return value in self.held

    def __len__(self) -> int:
        return len(self.held)

    def add(self, value, more=None) -> None:
        """A value that is held stays where it is."""
        self.held.setdefault(value, more)

    def pop(self):
        """The oldest value, with what it was added with."""
        value = next(iter(self.held))
        return value, self.held.pop(value)

    def discard(self, value) -> None:
        self.held.pop(value, None)


class Memory:
    """What one client lets through and still holds. `seen` (ids and articles) and `asked` (posts
    whose images were asked for) keep the newest `most_seen`; `posts` and `backfills` are the rows not
    yet flushed, `most_buffered` in all, of which the oldest backfill gives way first and may be asked
    for again. All are cut when a batch is over, so one batch may exceed them."""

    def __init__(self, client, seen, asked, posts, backfills, marks, backfill: bool, most_seen: int = MOST_SEEN, most_buffered: int = MOST_BUFFERED):
        self.client, self.seen, self.asked, self.posts, self.backfills, self.marks = client, seen, asked, posts, backfills, marks
        self.backfill, self.most_seen, self.most_buffered = backfill, most_seen, most_buffered

    def fate(self, pos: int, fate: str) -> dict:
        return {"client": self.client, "pos": pos, "fate": fate}

    def step(self, row: dict) -> Iterator[dict]:
        if self.marks.get("batch", row["batch"]) != row["batch"]:
            yield from self.end()
        self.marks["batch"] = row["batch"]
        if row["kind"] == "flush":
            for buffer in (self.posts, self.backfills):
                while len(buffer):
                    yield self.fate(buffer.pop()[0], "flushed")
            return
        own, article = row["id"] or None, f"article:{row['id']}"
        was_seen = own is not None and own in self.seen
        is_article = bool(row["is_article"])
        asks = self.backfill and own is not None and bool(row["has_photo"]) and own not in self.asked
        if was_seen and (not is_article or article in self.seen) and not asks:
            yield self.fate(row["pos"], "duplicate")
            return
        if own is not None:
            self.seen.add(own)
            if is_article:
                self.seen.add(article)
            if asks:
                self.asked.add(own)
        again = was_seen and not is_article
        (self.backfills if again else self.posts).add(row["pos"], own)
        yield self.fate(row["pos"], "backfill" if again else "accepted")

    def end(self) -> Iterator[dict]:
        for queue in (self.seen, self.asked):
            while len(queue) > self.most_seen:
                queue.pop()
        while len(self.posts) + len(self.backfills) > self.most_buffered:
            if len(self.backfills):
                pos, own = self.backfills.pop()
                self.asked.discard(own)
                yield self.fate(pos, "dropped-backfill")
            else:
                yield self.fate(self.posts.pop()[0], "dropped")


def client_fates(sights: DataFrame, backfill: bool = False, most_seen: int = MOST_SEEN, most_buffered: int = MOST_BUFFERED) -> DataFrame:
    """FATE rows of SIGHT rows (kind `post`, or `flush`), which go by (batch, pos): accepted, backfill or
    duplicate of each post, and dropped, dropped-backfill or flushed of each that was held."""
    begin = lambda key: Memory(key[0], Queue(), Queue(), Queue(), Queue(), {}, backfill, most_seen, most_buffered)
    return in_order(sights, ["client"], ["batch", "pos"], begin, FATE)
