import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import flows, sequences
from tidepool.shipping import ensure_importable
from tidepool.streaming import stateful


@pytest.fixture(scope="module")
def stores(spark):
    ensure_importable(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def messages(seed, n, clients=2, gap=40_000):
    draw, at, rows = random.Random(seed), 1_000_000, []
    kinds = ["begin"] * 6 + ["renew"] * 4 + ["observe"] * 3 + ["finish"] * 2 + ["tab_closed", "cutover_begin", "cutover_end", "cutover_end"]
    for seq in range(n):
        at += draw.randrange(1, gap)
        k = draw.randrange(7)
        rows.append(
            (draw.randrange(clients), seq, at, draw.choice(kinds), f"r{k}", f"l{k if draw.random() < 0.95 else 9}", k if draw.random() < 0.9 else draw.randrange(7), 0, draw.choice(sequences.ENDINGS))
        )
    return rows


def naive_runs(rows, lease=90_000, most=4):
    """Outcome of each message and each run, straight from the rules, for one client at a time."""
    outcomes, states = {}, {}
    for client in {r[0] for r in rows}:
        runs, cutover = {}, False
        for _, seq, at, kind, run_id, list_id, tab, started, ending in sorted((r for r in rows if r[0] == client), key=lambda r: (r[2], r[1])):
            running = [r for r in runs.values() if r["state"] == "running"]
            own = runs.get(run_id)
            if kind == "begin":
                live = [r for r in running if r["lease"] > at]
                dead = [r for r in running if r["lease"] <= at]
                stop = "lease-expired" if own in dead else own and own["stop"]
                fresh = own in live
                if cutover:
                    out = "cutover-active"
                elif own and (own["list"], own["started"]) != (list_id, started) or fresh and own["tab"] != tab:
                    out = "run-conflict"
                elif own and not fresh and stop not in ("lease-expired", "source-tab-closed"):
                    out = "run-terminal"
                elif not fresh and tab in [r["tab"] for r in live]:
                    out = "source-tab-active"
                elif not fresh and len(live) >= most:
                    out = "capacity-full"
                else:
                    for r in dead:
                        r.update(state="failed", stop="lease-expired", finished=at)
                    out = "renewed" if fresh else "resumed" if own else "began"
                    runs[run_id] = {"list": list_id, "started": started, "tab": tab, "state": "running", "stop": None, "lease": at + lease, "finished": None}
            elif kind == "renew":
                out = "unknown-run" if not own else "run-terminal" if own["state"] != "running" else "run-conflict" if own["tab"] != tab else "renewed"
                if out == "renewed":
                    own["lease"] = at + lease
            elif kind == "finish":
                out = "unknown-run" if not own else "run-terminal" if own["state"] not in ("running", ending) else "finished"
                if out == "finished":
                    own.update(state=ending, finished=at)
            elif kind == "observe":
                met = [r for r in running if r["tab"] == tab]
                for r in met:
                    if r["lease"] <= at:
                        r.update(state="failed", stop="lease-expired", finished=at)
                out = "observed" if met and met[0]["state"] == "running" else "unattached"
            elif kind in ("tab_closed", "cutover_begin"):
                met = [r for r in running if kind == "cutover_begin" or r["tab"] == tab]
                for r in met:
                    r.update(state="failed" if kind == "cutover_begin" else "aborted", finished=at, stop=r["stop"] if kind == "cutover_begin" else "source-tab-closed")
                cutover, out = cutover or kind == "cutover_begin", f"closed-{len(met)}"
            else:
                cutover, out = False, "cutover-ended"
            outcomes[seq] = out
        states |= {(client, k): (r["state"], r["stop"], r["tab"], r["lease"], r["finished"]) for k, r in runs.items()}
    return outcomes, states


def states_of(changes):
    return {(r.client, r.run_id): (r.state, r.stop_reason, r.tab, r.lease, r.finished) for r in sequences.run_states(changes).collect()}


def test_runs_follow_the_rules(spark):
    rows = messages(1, 1500, 3, 12_000)
    changes = sequences.run_changes(spark.createDataFrame(rows, sequences.MESSAGE).repartition(4)).cache()
    outcomes, states = naive_runs(rows)
    assert {r.seq: r.outcome for r in changes.where("outcome is not null").collect()} == outcomes
    assert states_of(changes) == states
    assert {"began", "renewed", "resumed", "source-tab-active", "run-conflict", "run-terminal", "unattached", "observed"} <= set(outcomes.values())
    assert sequences.run_changes(spark.createDataFrame([], sequences.MESSAGE)).count() == 0
    five = [(0, k, k, "begin", f"r{k}", "l", k, 0, None) for k in range(5)] + [(0, 5, 100_000, "begin", "r4", "l", 4, 0, None)]
    got = sequences.run_changes(spark.createDataFrame(five, sequences.MESSAGE))
    assert [r.outcome for r in got.where("outcome is not null").orderBy("seq").collect()] == ["began"] * 4 + ["capacity-full", "began"]


def run_stream(spark, rows, schema, parts, make, tmp_path, name, split, until=None):
    """The rows that a stream gives for parts of the rows, one trigger each. until: how many to wait for,
    where a stream does not end by itself, since its state looks at the clock."""
    for n in range(parts):
        spark.createDataFrame([r for r in rows if split(r) == n], schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{n:03d}")
        (f,) = (tmp_path / name / f"{n:03d}").glob("part-*.parquet")
        (tmp_path / f"{name}-in").mkdir(exist_ok=True)
        f.rename(tmp_path / f"{name}-in" / f"{n:03d}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}-in")
    query = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}-log")
    query = query.trigger(availableNow=True).start() if until is None else query.start()
    for _ in range(120):
        if query.awaitTermination(1) or until is not None and spark.table(name).count() >= until:
            break
    query.stop()
    assert query.exception() is None
    return spark.table(name)


def test_runs_as_a_stream_end_by_timers(stores, tmp_path):
    spark, rows = stores, messages(5, 160)
    last = max(r[2] for r in rows)
    rows.append((9, 160, last + 500_000, "observe", None, None, 1, None, None))  # another client moves the watermark on
    got = run_stream(spark, rows, sequences.MESSAGE, 4, stateful.run_changes, tmp_path, "run_stream", lambda r: min(3, r[1] // 50))
    # in a batch an observation of a tab without a run, after all leases, ends what a timer has ended in the stream
    closing = [(c, 161, last + 500_000, "observe", None, None, -1, None, None) for c in (0, 1)]
    wanted = sequences.run_changes(spark.createDataFrame(rows + closing, sequences.MESSAGE), eager=True)
    assert states_of(got) == states_of(wanted)
    assert not any(s[0] == "running" for s in states_of(got).values())
    assert {(r.seq, r.outcome) for r in got.collect() if r.outcome} == {(r.seq, r.outcome) for r in wanted.where("outcome is not null and seq < 161").collect()}


def sights(seed, n):
    draw = random.Random(seed)
    rows = []
    for pos in range(n):
        client, own = draw.randrange(2), draw.choice([None, "", *(f"p{draw.randrange(25)}" for _ in range(9))])
        rows.append((client, pos // 20, pos, "flush" if draw.random() < 0.02 else "post", own, draw.choice([True, False, False, None]), draw.random() < 0.5))
    return rows + [(c, n // 20 + 1, n + c, "flush", None, None, None) for c in (0, 1)]


def naive_fates(rows, most_seen, most_buffered):
    fates = []
    for client in {r[0] for r in rows}:
        seen, asked, buffer, current = [], [], [], None
        own_rows = sorted((r for r in rows if r[0] == client), key=lambda r: (r[1], r[2]))
        for _, batch, pos, kind, own, article, photo in [*own_rows, (client, None, None, "end", None, None, None)]:
            if current is not None and batch != current:
                seen, asked = seen[-most_seen:], asked[-most_seen:]
                while len(buffer) > most_buffered:
                    k = next((k for k, b in enumerate(buffer) if b[2]), None)
                    p, i, again = buffer.pop(k or 0)
                    if again:
                        asked = [a for a in asked if a != i]
                    fates.append((client, p, "dropped-backfill" if again else "dropped"))
            current = batch
            if kind == "flush":
                fates += [(client, b[0], "flushed") for b in buffer]
                buffer = []
            elif kind == "post":
                dup = bool(own) and own in seen
                asks = bool(own) and bool(photo) and own not in asked
                if dup and (not article or f"article:{own}" in seen) and not asks:
                    fates.append((client, pos, "duplicate"))
                    continue
                for value, into in ((own, seen), (f"article:{own}" if article else None, seen), (own if asks else None, asked)):
                    if own and value and value not in into:
                        into.append(value)
                again = dup and not article
                buffer.append((pos, own, again))
                fates.append((client, pos, "backfill" if again else "accepted"))
    return sorted(fates)


@pytest.mark.parametrize("caps", [(6, 4), (50_000, 2_000)])
def test_memory_is_bounded(stores, tmp_path, caps):
    spark, rows = stores, sights(2, 400)
    wanted = naive_fates(rows, *caps)
    got = sequences.client_fates(spark.createDataFrame(rows, sequences.SIGHT).repartition(3), True, *caps)
    assert sorted(tuple(r) for r in got.collect()) == wanted
    name = f"fates_{caps[0]}"
    stream = run_stream(spark, rows, sequences.SIGHT, 3, lambda s: stateful.client_fates(s, True, *caps), tmp_path, name, lambda r: min(2, r[2] // 150))
    assert sorted(tuple(r) for r in stream.collect()) == wanted


def staging(seed, n):
    """Log rows of kind stage, clear and restart, each at its own time."""
    draw, at, rows, live = random.Random(seed), 0, [], {0: [], 1: []}
    for seq in range(n):
        at += draw.randrange(1, 60_000)
        client, what = draw.randrange(2), draw.random()
        if what < 0.6 or what < 0.85 and not live[client]:
            rows.append((client, seq, at, "stage", draw.randrange(3), None, None))
            live[client].append(seq)
        elif what < 0.85:
            rows.append((client, seq, at, "clear", None, live[client].pop(draw.randrange(len(live[client]))), None))
        else:
            rows.append((client, seq, at, "restart", None, None, draw.random() < 0.4))
    return rows


def test_staging_log(stores, tmp_path):
    spark, rows, ttl = stores, staging(4, 400), 900_000
    log = spark.createDataFrame(rows, stateful.STAGED)
    cleared = log.where("kind = 'clear'").selectExpr("client", "entry AS seq", "at AS cleared")
    entries = log.where("kind = 'stage'").select("client", "seq", "at", "posts").join(cleared, ["client", "seq"], "left")
    got = flows.recovered(entries, log.where("kind = 'restart'").select("client", "seq", "at", "saved"), ttl)
    batch = sorted(str(tuple(r)) for r in got.where("fate <> 'staged'").collect())
    held, wanted = {}, []
    for client, seq, at, kind, posts, entry, saved in rows:
        own = held.setdefault(client, {})
        if kind == "stage":
            own[seq] = (at, posts, False)
        elif kind == "clear" and entry in own and not own[entry][2]:
            del own[entry]
            wanted.append((client, entry, "handled", None, None))
        elif kind == "restart":
            place = 0
            for s, (then, posts, _) in sorted(own.items(), key=lambda e: (e[1][0], e[0])):
                own[s] = (then, posts, True)
                fate = "expired" if at - then > ttl else "empty" if not posts else "recovered" if saved else None
                place += fate == "recovered"
                if fate:
                    del own[s]
                    wanted.append((client, s, fate, seq, place if fate == "recovered" else None))
    assert batch == sorted(map(str, wanted))
    assert {w[2] for w in wanted} == {"handled", "expired", "empty", "recovered"}
    stream = run_stream(spark, rows, stateful.STAGED, 3, lambda s: stateful.recovered(s, ttl), tmp_path, "staging", lambda r: min(2, r[1] // 150), len(batch))
    assert sorted(str(tuple(r)) for r in stream.collect()) == batch


def test_commits_in_order(stores, tmp_path):
    draw, rows = random.Random(8), []
    for run in (1, 2, 3):
        arrivals = list(range(60))
        draw.shuffle(arrivals)
        rows += [(run, k, a) for k, a in enumerate(arrivals) if not (run == 2 and k == 31)]
    rows += [(3, 5, 99), (3, 50, 98)]  # arrive again
    table = stores.createDataFrame(rows, stateful.OUTCOME)
    got = {(r.run, r.ordinal): (r.arrival, r.released) for r in flows.released(table).collect()}
    for run in (1, 2, 3):
        arrival = {k: a for r, k, a in reversed(rows) if r == run}
        for k in arrival:
            ahead = [arrival.get(j) for j in range(k + 1)]
            assert got[run, k] == (arrival[k], None if None in ahead else max(ahead))
    stream = run_stream(stores, sorted(rows, key=lambda r: r[2]), stateful.OUTCOME, 3, stateful.released, tmp_path, "commits", lambda r: min(2, r[2] // 25))
    released = [tuple(r) for r in stream.collect()]
    assert {(r[0], r[1]): (r[2], r[3]) for r in released} == {k: v for k, v in got.items() if v[1] is not None}
    assert [r[1] for r in released if r[0] == 1] == list(range(60))
    lanes = {r.run: r for r in flows.commit_lanes(flows.released(table)).collect()}
    assert (lanes[2].committed, lanes[2].stuck) == (31, 28) and lanes[1].stuck == 0 and lanes[1].peak > 1


def test_responses(stores, tmp_path):
    kind = "client long, seq long, tab long, request string, kind string, endpoint string"
    rows = [
        (1, 1, 1, "a", "received", "E"), (1, 2, 1, "a", "received", "F"), (1, 3, 1, "a", "finished", None), (1, 4, 1, "a", "finished", None),
        (1, 5, 1, "b", "received", None), (1, 6, 1, "b", "finished", None), (1, 7, 1, "c", "received", "E"), (1, 8, 1, "c", "failed", None),
        (1, 9, 1, "c", "finished", None), (1, 10, 1, "d", "received", "E"), (1, 11, 1, None, "detached", None), (1, 12, 1, "d", "finished", None),
        (1, 13, 2, "d", "received", "E"), (1, 14, 1, None, "detached", None), (1, 15, 2, "d", "finished", None), (2, 16, 2, "d", "finished", None),
    ]
    got = flows.paired(stores.createDataFrame(rows, kind)).collect()
    assert sorted((r.request, r.endpoint, r.received, r.finished) for r in got) == [("a", "F", 2, 3), ("d", "E", 13, 15)]

    draw, events = random.Random(3), []
    for n in range(60):
        own = (n % 3, n % 2, f"q{n}")
        events.append((*own, 2 * n, n * 10, "received", None if n % 7 == 0 else "E"))
        if n % 5:
            events.append((*own, 2 * n + 1, n * 10 + draw.randrange(1, 40), "finished", None))
    events.sort(key=lambda e: e[4])
    events = [(c, t, r, k, at, kind, e) for k, (c, t, r, _, at, kind, e) in enumerate(events)]
    schema = "client long, tab long, request string, seq long, at long, kind string, endpoint string"
    wanted = flows.paired(stores.createDataFrame(events, schema).drop("at"))

    def make(stream):
        timed = stream.withColumn("time", F.timestamp_seconds("at"))
        return stateful.paired(timed.where("kind = 'received'"), timed.where("kind = 'finished'"), "2 minutes", "30 seconds")

    stream = run_stream(stores, events, schema, 3, make, tmp_path, "pairs", lambda e: min(2, e[3] // 35))
    assert sorted(tuple(r) for r in stream.collect()) == sorted(tuple(r) for r in wanted.collect())
