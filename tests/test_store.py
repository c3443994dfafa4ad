import json

import pytest
from pyspark.sql import functions as F

from tidepool.functions import pseudonyms
from tidepool.operators import configs, recovery
from tidepool.shipping import ensure_importable
from tidepool.sources import archive


@pytest.fixture(autouse=True)
def shipped(spark):
    ensure_importable(spark)


def test_reached_outputs(spark):
    chain = [(1, "queue", k, f"q{k}", f"s{k - 1}" if k != 4 else "torn", f"s{k}") for k in range(9)]
    chain += [(1, "attempt", k, f"a{k}", f"t{k - 1}", f"t{k}") for k in range(5) if k != 2] + [(1, "receipt", 0, "r0", "x", "y")]
    frontiers = [(1, "queue", 7, "s7"), (1, "attempt", 4, "t4"), (1, "receipt", 0, "other")]
    table = spark.createDataFrame(chain, "run long, kind string, sequence long, file string, before string, sha string")
    got = recovery.reached(table, spark.createDataFrame(frontiers, "run long, kind string, sequence long, sha string"))
    assert sorted(r.file for r in got.collect()) == ["a3", "a4", "q4", "q5", "q6", "q7"]
    files = spark.createDataFrame([(f,) for f in ("q3", "q5", "q8", "src", "new")], "file string")
    left = recovery.orphans(files, spark.createDataFrame([("src",)], "file string"), got)
    assert sorted(r.file for r in left.collect()) == ["new", "q3", "q8"]


def test_a_fault_silences_its_file(spark):
    line = "file string, path string, unit_id string, name string, outcome string, input_hash string, contract_hash string, taxonomy_version int"
    rows = [
        ("f1", "enrichment/x.jsonl", "u1", None, None, "h1", "c", 1), ("f1", "enrichment/x.jsonl", "u1", None, None, "h1", "c", 1),
        ("f1", "enrichment/attempts/a", "u1", None, "success", "h1", "c", None), ("f1", "enrichment/attempts/a", "u2", None, "blocked", "h2", "c", None),
        ("f1", "enrichment/attempts/a", "strange", None, "blocked", "?", "?", None), ("f1", "enrichment/registry/r", None, "passed", None, None, "c", None),
        ("f1", "enrichment/registry/r", None, "open", None, None, "c", None), ("f1", "enrichment/receipts/r", None, None, None, None, "other", None),
        ("f1", "posts/p", "u1", None, None, None, None, None), ("f2", "enrichment/x.jsonl", "u1", None, None, "h1", "c", 2),
        ("f2", "enrichment/attempts/a", "u2", None, "blocked", "h2", "c", None), ("f3", "enrichment/registry/r", None, "open", None, None, "c0", None),
    ]
    own = spark.createDataFrame([("u1", "h1", "c", 1), ("u2", "h2", "c", 1)], "unit_id string, input_hash string, contract_hash string, taxonomy_version int")
    names = spark.createDataFrame([("passed", 0), ("open", 1)], "name string, ordinal int")
    got = recovery.routed(spark.createDataFrame(rows, line), own, names, "c", 1)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [
        ("f1", "queue", "u1", None), ("f1", "attempt", "u2", None), ("f1", "registry", "open", None),
        ("f2", "queue", None, "queue differs from its unit"), ("f3", "registry", None, "decision of another contract"),
    ]))


def test_checkpoints(spark):
    state = "run long, sequence long, plan string, total long, done long, next_name long, names long, publication string, has_database boolean"
    word = "run long, sequence long, word long, bits long"
    good = [(1, k, "p", 70, 2 + k, k, 9, "building", False) for k in range(4)]
    bits = [(1, k, 0, 3 | (1 << k + 2) - 1) for k in range(4)] + [(1, k, 1, 0) for k in range(4)]
    check = lambda states, words, left=(): {(r.sequence, r.fault) for r in recovery.checkpoint_faults(spark.createDataFrame(states, state), spark.createDataFrame(words, word), spark.createDataFrame(list(left), "run long, sequence long, ordinal long")).collect()}
    assert check(good, bits) == set()
    bad = [*good[:2], (1, 3, "other", 70, 5, 0, 9, "verified", False)]
    assert check(bad, bits[:2] + bits[3:6] + bits[7:]) == {(3, "sequence"), (3, "plan"), (3, "cursor"), (3, "publication")}
    lost = [*bits[:2], (1, 2, 0, 0b1110), *bits[3:]]
    assert check(good, lost) == {(2, "bitmap count"), (2, "completed ordinal is open again")}
    assert check(good, bits[:7]) == {(3, "bitmap length")}
    assert check(good, bits, [(1, 0, 1), (1, 1, 65), (1, 1, 65), (1, 2, 30)]) == {(0, "completed ordinal is unresolved"), (1, "ordinal is unresolved twice")}


def test_compaction_leaves_nothing_dangling(spark):
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    units = [f"u{k}" for k in range(6)]
    tables = {
        "members": make([(f"p{k}", u) for k, u in enumerate(units)], "id string, unit_id string"),
        "captures": make([(f"p{k}", c) for k in range(6) for c in "ab"], "id string, contributed_by string"),
        "results": make([(u,) for u in units], "unit_id string"), "queue": make([(u, "done" if k else "pending") for k, u in enumerate(units)], "unit_id string, status string"),
        "assignments": make([("u1", "x", "free"), ("u1", "y", "free"), ("u2", "y", "free"), ("u1", "good", "preset"), ("u3", "good", "preset")], "unit_id string, name string, kind string"),
        "evidence": make([("u1", "x", "free", "q"), ("u1", "y", "free", "q"), ("u3", "good", "preset", "q")], "unit_id string, name string, kind string, quote string"),
    }
    kept = recovery.compacted(tables, tables["queue"].where("status <> 'done'").select("unit_id"), make([("x",), ("x",)], "name string"))
    rows = {n: sorted(map(tuple, t.collect())) for n, t in kept.items()}
    assert rows["members"] == [("p0", "u0"), ("p1", "u1")] and len(rows["captures"]) == 4 and rows["queue"] == [("u0", "pending")]
    assert rows["assignments"] == [("u1", "good", "preset"), ("u1", "x", "free")] and rows["evidence"] == [("u1", "x", "free", "q")]
    assert recovery.dangling(kept).count() == 0
    assert {r["table"]: r["rows"] for r in recovery.dangling(kept | {"members": kept["members"].where("unit_id = 'u0'")}).collect()} == {"captures": 2, "results": 1, "assignments": 2}


def test_members(spark):
    ops = [
        ("add_member", " @Ann ", None, None), ("add_member", "ann", None, None), ("remove_member", "boss", None, None), ("add_admin", "bob", None, None),
        ("remove_member", "bob", None, None), ("remove_admin", "bob", None, None), ("remove_member", "bob", None, None), ("remove_admin", "boss", None, None),
        ("set_org", None, "o", "1"), ("set_org", None, "renamed", "1"), ("remove_org", None, "else", None), ("remove_org", None, "o", None),
    ]
    table = spark.createDataFrame([(1, k, *o) for k, o in enumerate(ops)], configs.MUTATION)
    got = configs.member_changes(table, ["boss"]).orderBy("seq").collect()
    assert [r.outcome for r in got] == ["changed", "unchanged", "refused", "changed", "refused", "changed", "changed", "refused", "changed", "unchanged", "unchanged", "changed"]
    assert got[3].members == ["ann", "bob"] and got[3].admins == ["bob"] and got[-1].members == ["ann"] and got[8].org == "o"
    alone = spark.createDataFrame([(1, 1, "add_admin", "a", None, None), (1, 2, "remove_admin", "a", None, None)], configs.MUTATION)
    assert [r.outcome for r in configs.member_changes(alone, []).orderBy("seq").collect()] == ["changed", "refused"]


def test_authorize(spark):
    log = [
        (1, 1, "issue", "a", "n", ["read"], "k1", "t1", 100), (1, 2, "issue", "b", "n", ["read"], "k2", "t2", 100), (1, 4, "rotate", "a", None, None, "k3", "t3", 200),
        (1, 6, "revoke_key", "a", None, None, "k1", None, None), (1, 9, "revoke", "a", None, None, None, None, None), (1, 10, "rotate", "a", None, None, "k4", "t4", 900),
    ]
    table = spark.createDataFrame(log, "registry long, seq long, op string, account string, name string, scopes array<string>, key string, token_hash string, expires long")
    asks = [
        (0, "a", "k1", "t1", "read", 1), (3, "a", "k1", "t1", "read", 1), (3, "b", "k2", "t2", "read", 1), (5, "a", "k1", "t1", "write", 1), (5, "a", "k3", "t1", "read", 1),
        (5, "a", "k3", "t3", "read", 200), (5, "a", "k3", "t3", "read", 199), (7, "a", "k1", "t1", "read", 1), (11, "a", "k4", "t4", "read", 1), (12, "zz", "k", "t", "read", 1),
    ]
    requests = spark.createDataFrame([(1, *a) for a in asks], "registry long, seq long, account string, key string, token_hash string, scope string, at long")
    got = configs.authorized(requests, table)
    assert sorted((r.seq, r.verdict) for r in got.collect()) == sorted(
        zip((a[0] for a in asks), ("account", "ok", "account", "scope", "token", "expired", "ok", "key", "account", "account"))
    )


def test_archive(spark, tmp_path):
    root = f"file://{tmp_path}/archive"
    kind = "folder string, day string, pos long, id string, is_article boolean, line string"

    def batch(rows):
        return spark.createDataFrame([(f, d, n, i, a, json.dumps({"id": i, "is_article": a, "n": n})) for n, (f, d, i, a) in rows], kind)

    one = batch(enumerate([("x", "d1", "1", False), ("x", "d1", "1", False), ("x", "d2", "1", True), ("x", "d2", "1", True), ("y", "d1", "1", None), ("y", "d1", None, False), ("y", "d1", "", False)]))
    counts = lambda df: {r.folder: (r.written, r.duplicates) for r in df.collect()}
    assert counts(archive.append(spark, root, one, 1)) == {"x": (2, 2), "y": (3, 0)}
    assert counts(archive.append(spark, root, one, 1)) == {"x": (2, 2), "y": (3, 0)}  # again, after a failure
    (tmp_path / "archive" / "folder=x" / "day=d1" / "batch=1" / "torn.txt").write_text("not json\n[1]\n{}\n")
    two = batch(enumerate([("x", "d2", "1", True), ("x", "d2", "2", True), ("x", "d2", "2", False), ("y", "d3", "1", True), ("y", "d3", "1", False)]))
    assert counts(archive.append(spark, root, two, 2)) == {"x": (1, 2), "y": (1, 1)}
    lines = spark.read.text(root).where("value like '{\"id%'")
    assert lines.count() == 7


def test_pseudonyms(spark):
    deep = "[" * 300 + '"1234567"' + "]" * 300
    docs = [
        '{"id": 1234567, "user": {"screen_name": "Ann", "friends": ["1234567", "ann", true, null, 1.5]}, "n": 1234567}',
        '{"in": [{"user_id": ["1234567", 7]}, {"screen_name": "ANN"}], "text": "hello there", "url": "https://x.y/z", "name": ""}', deep, "no json", None,
    ]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in docs], "d string").select(pseudonyms.pseudonymous(F.col("d"))).collect()]
    one, two = json.loads(got[0]), json.loads(got[1])
    own = pseudonyms.of_id("1234567")
    assert one["id"] == int(own) and one["user"]["friends"] == [own, "ann", True, None, 1.5] and one["n"] == 1234567
    assert two["in"][0]["user_id"] == [own, int(pseudonyms.of_id("7"))] and two["in"][1]["screen_name"] == one["user"]["screen_name"] != "Ann"
    assert len(two["text"].split()) == 2 and "hello" not in two["text"] and "x.y" not in two["url"] and two["name"] == ""
    assert own in got[2] and got[3] is None and got[4] is None


def test_requests_and_cutoffs():
    from tidepool.plans import pool

    q = pool.FeedQuery.of({"contributors": " a, ,b", "has_media": "true", "is_article": "false", "dedup": "false", "labels": "x,y", "label_mode": "all", "limit": "7", "q": ""})
    assert (q.contributors, q.has_media, q.is_article, q.dedup, q.labels, q.every_label, q.limit, q.q) == (["a", "b"], True, False, False, ["x", "y"], True, 7, None)
    plain = pool.FeedQuery.of({})
    assert (plain.dedup, plain.limit, plain.has_media, plain.unlabeled) == (True, 50, None, False)
    u = pool.UnitQuery.of({"cutoff": "2024-01-02", "publication": "public-original", "unlabeled": "true"})
    assert (u.cutoff, u.public_original, u.unlabeled) == ("2024-01-02", True, True)
    for bad in ({"limit": "many"}, {"limit": "0"}, {"limit": "201"}, {"has_media": "yes"}, {"label_mode": "most"}):
        with pytest.raises(pool.BadQuery):
            pool.FeedQuery.of(bad)
    for bad in ({"publication": "all"}, {"cutoff": ""}):
        with pytest.raises(pool.BadQuery):
            pool.UnitQuery.of(bad)
    p = pool.Pool({}, "r1")
    assert p.revision_of() == "r1" and p.revision_of("x") == p.revision_of("x") != p.revision_of("y")


def test_leases(spark):
    from tidepool.operators import queue

    rows = [("a", "running", 0, "w1", 50), ("b", "running", 2, "w2", 49), ("c", "running", 1, "w1", None), ("d", "pending", 0, None, None), ("e", "done", 0, None, None)]
    q = spark.createDataFrame(rows, "unit_id string, status string, attempts int, lease_owner string, lease_expires long").withColumns({"activity": F.col("unit_id"), "first_queued_at": F.col("unit_id")})
    seen = lambda df: {r.unit_id: (r.status, r.lease_owner, r.lease_expires) for r in df.collect()}
    over = queue.recovered(q, 50)
    assert seen(over) == {"a": ("running", "w1", 50), "b": ("retrying", None, None), "c": ("running", "w1", None), "d": ("pending", None, None), "e": ("done", None, None)}
    assert {k: v for k, v in seen(queue.leased(over, 5, "w3", 50, 10)).items() if v[1] == "w3"} == {"b": ("running", "w3", 60), "d": ("running", "w3", 60)}
    assert seen(queue.handed_back(q, "w1"))["a"] == ("pending", None, None) and seen(queue.handed_back(q, "w1"))["b"][0] == "running"
    assert seen(queue.handed_back(q, None, ["b", "e"])) == seen(q) | {"b": ("retrying", None, None)}


def test_ingest_and_candidates(spark):
    from tidepool.plans import pool

    make = spark.createDataFrame
    stored = make([("1", "ann", "2024-01-02T00:00:00Z", "u", "2024-01-02T00:00:00Z"), ("2", "ann", "2024-01-01T00:00:00Z", "u", "2024-01-01T00:00:00Z")], "id string, contributed_by string, captured_at string, author_id string, sort_ts string")
    tables = {
        "captures": stored, "members": make([("1", "U1"), ("2", "U2")], "id string, unit_id string"),
        "registry": make([("one", "candidate", "2024"), ("two", "approved", "2024"), ("bare", "candidate", "2024")], "name string, status string, first_observed_at string"),
        "assignments": make([("U1", "one", "free"), ("U2", "one", "free"), ("U2", "two", "free")], "unit_id string, name string, kind string"),
        "evidence": make([("U1", "one", "free", str(k), f"q{k}") for k in range(7)], "unit_id string, name string, kind string, post_id string, quote string"),
    }
    p = pool.Pool(tables, "r")
    found = {r.name: r for r in p.candidates().collect()}
    assert set(found) == {"one", "bare"} and (found["one"].units, found["one"].authors, found["one"].days) == (2, 1, 2)
    assert [q.quote for q in found["one"].quotes] == ["q0", "q1", "q2", "q3", "q4"] and found["bare"].units == 0 and found["bare"].quotes is None
    assert p.candidates("two").first().units == 1
    with pytest.raises(pool.NotFound):
        p.candidates("none")

    post = "envelope long, position long, id string, url string, username string, text string, captured_at string, created_at string"
    at = "2024-01-0{}T00:00:00Z".format
    rows = [
        (1, 0, "1", "l", "n", "t", at(1), None), (1, 1, "2", "l", "n", "t", at(5), None), (1, 2, "2", "l", "n", "t", at(5), None), (1, 3, "3", "l", "n", "t", at(1), None),
        (1, 4, "", "l", "n", "t", at(1), None),
    ]
    new, counts = p.ingest(make(rows, post), "ann", at(9))
    assert sorted((r.id, r.contributed_by, r.pooled_at, r.position) for r in new.collect()) == [("2", "ann", at(9), 1), ("3", "ann", at(9), 3)]
    assert tuple(counts.first()) == (2, 2, 1)
    assert p.ingest(make(rows, post), "bob", at(9))[1].first().added == 3
