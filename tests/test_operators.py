import json

import pytest
from pyspark.sql import functions as F

from tidepool.functions import rules
from tidepool.functions import text as tx
from tidepool.operators import captures as cap
from tidepool.operators import client
from tidepool.operators import labels as lab
from tidepool.operators import queue as que
from tidepool.operators.graph import local_moves
from tidepool.plans import adapter as ad
from tidepool.plans import pool as pl


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names or "x int").select(column).first()[0]


@pytest.mark.parametrize(
    "row, reason",
    [
        (("1", "u", "t", "2024-01-01T00:00:00Z", None, "n"), None),
        (("1", "u", "", "2024-01-01T00:00:00.123+02:00", "2024-01-01T00:00:00Z", "n"), None),
        (("", "u", "t", "2024-01-01T00:00:00Z", None, "n"), "id"),
        (("1", None, "t", "2024-01-01T00:00:00Z", None, "n"), "url"),
        (("1", "u", None, "2024-01-01T00:00:00Z", None, "n"), "text"),
        (("1", "u", "t", "2024-13-01T00:00:00Z", None, "n"), "captured_at"),
        (("1", "u", "t", "2024-01-01", None, "n"), "captured_at"),
        (("1", "u", "t", "2024-01-01T00:00:00Z", "soon", "n"), "created_at"),
        (("1", "u", "t", "2024-01-01T00:00:00Z", None, ""), "username"),
    ],
)
def test_validation(spark, row, reason):
    frame = spark.createDataFrame([row], "id string, url string, text string, captured_at string, created_at string, username string")
    assert frame.select(cap.reject_reason()).first()[0] == reason


def captures(spark, rows):
    return spark.createDataFrame(rows, "id string, contributed_by string, captured_at string, replay_pos long")


def test_freshest_ties_keep_the_first(spark):
    rows = captures(spark, [("1", "a", "2", 0), ("1", "a", "3", 1), ("1", "a", "3", 2), ("1", "b", "1", 3)])
    assert sorted(r["replay_pos"] for r in cap.freshest(rows).collect()) == [1, 3]


def test_classify(spark):
    stored = captures(spark, [("1", "a", "5", 0)])
    batch = captures(spark, [("1", "a", "5", 1), ("1", "b", "1", 2), ("1", "b", "2", 3), ("2", "a", "1", 4), ("1", "a", "6", 5)])
    got = {r["replay_pos"]: r["accepted"] for r in cap.classify(batch, stored).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: True}


@pytest.mark.parametrize(
    "query, text, found",
    [
        ("quick bro", "The QUICK brown fox", True), ("uick", "The quick", False), ("caf", "Café noir", True), ("C++", "about c++ now", True),
        ("C++", "about c now", False), ("!!!", "wow!!!", True), ("a_c", "xabcx", False), ("brown quick", "quick brown", False),
        ("100%", "1000", True), ("", "x", True),
    ],
)
def test_search(spark, query, text, found):
    assert one(spark, cap.phrase(query, "t"), t=text) == found


def test_literal_folds_ascii_only(spark):
    assert one(spark, cap.literal("ABC", "t"), t="xabcx")
    assert not one(spark, cap.literal("É", "t"), t="é")


def test_cursors():
    values = ("2024-01-01", "5", "é")
    assert cap.decode_cursor(cap.encode_cursor(values), 3) == values
    assert cap.decode_cursor("??", 3) is None and cap.decode_cursor(cap.encode_cursor(("a",)), 3) is None


@pytest.mark.parametrize("n, label", [(0, "0"), (999, "999"), (1000, "1K"), (1150, "1.1K"), (1250, "1.3K"), (1050, "1.1K"), (12345, "12.3K"), (999_950, "1000K"), (3_400_000, "3.4M")])
def test_counts(spark, n, label):
    assert spark.range(1).select(tx.compact_count(F.lit(n))).first()[0] == label


@pytest.mark.parametrize("name, slug", [("Machine Learning", "machine-learning"), ("  Évé--nement!! ", "eve-nement"), ("ﬁne", "fine"), ("!!!", ""), ("ß", "")])
def test_slug(spark, name, slug):
    assert one(spark, tx.slug(F.col("n")), n=name) == slug


@pytest.mark.parametrize(
    "name, quotes, reason",
    [
        ("good-name", ["some words"], None), ("", ["some"], "empty-slug"), ("x", ["some"], "too-short"), ("n" * 61, ["some"], "too-long"),
        ("opinion", ["some"], "hard-rejected:opinion"), ("good-name", [], "no-evidence"), ("good-name", ["a b"], "unsubstantive-evidence"),
        ("policy", ["polices all", "none here"], "abstract-name-without-literal:policy"), ("policy", ["Policies", "a POLICY"], None),
    ],
)
def test_label_rules(spark, name, quotes, reason):
    frame = spark.createDataFrame([(name, quotes)], "name string, quotes array<string>")
    assert frame.select(rules.label_reason(F.col("name"), F.col("quotes"))).first()[0] == reason


def queue(spark, rows):
    frame = spark.createDataFrame(rows, "unit_id string, status string, activity string, first_queued_at string, attempts int")
    return frame.withColumn("fresh", F.lit(True))


@pytest.mark.parametrize(
    "rows, through",
    [([("a", "done", "1"), ("b", "done", "2")], "2"), ([("a", "done", "1"), ("b", "pending", "2"), ("c", "done", "3")], "1"), ([("a", "pending", "1"), ("b", "done", "1")], None), ([], None)],
)
def test_complete_through(spark, rows, through):
    assert que.complete_through(queue(spark, [(*r, "0", 0) for r in rows])).first()[0] == through


@pytest.mark.parametrize("size, ids", [(1, ["u0"]), (2, ["u9", "u0"]), (4, ["u9", "u8", "u0", "u1"]), (20, ["u9", "u8", "u7", "u6", "u5", "u4", "u3", "u2", "u1", "u0"])])
def test_claim(spark, size, ids):
    q = queue(spark, [(f"u{i}", "pending", str(i), str(i), 0) for i in range(10)] + [("d", "done", "9", "0", 0)])
    got = [r["unit_id"] for r in que.claim(q, size).orderBy("position").collect()]
    assert got == ids if size < 20 else sorted(got) == sorted(ids)


def test_attempts(spark):
    q = queue(spark, [("a", "pending", "1", "1", 0), ("b", "pending", "1", "1", 2), ("c", "done", "1", "1", 0), ("d", "running", "1", "1", 0)])
    events = [
        ("a", 1, 1, "transient_failure", True), ("a", 2, 1, "blocked", True), ("a", 3, 3, "transient_failure", True), ("b", 1, 2, "blocked", True),
        ("b", 2, 9, "success", True), ("c", 1, 1, "blocked", True), ("d", 1, 5, "transient_failure", True), ("d", 2, 6, "dispatched", True), ("b", 3, 4, "blocked", False),
    ]
    frame = spark.createDataFrame(events, "unit_id string, seq long, attempt int, outcome string, matches boolean")
    got = {r["unit_id"]: (r["attempts"], r["status"]) for r in que.replay_attempts(q, frame).collect()}
    assert got == {"a": (3, "retrying"), "b": (2, "pending"), "d": (5, "retrying")}


def test_registry_chain(spark):
    rows = [
        ("x", "candidate", 1), ("y", "approved", 2), ("y", "candidate", 2), ("x", "approved", 3), ("x", "candidate", 4), ("x", "rejected", 4),
        ("z", "candidate", 6), ("z", "candidate", 5), ("z", "candidate", 6),
    ]
    frame = spark.createDataFrame([(n, s, str(i), "k", r, None, i) for i, (n, s, r) in enumerate(rows)], "name string, status string, at string, contract_hash string, revision long, reason string, pos long")
    got = {r["name"]: (r["status"], r["first_observed_at"], r["updated_at"]) for r in lab.replay_registry(frame, "k").collect()}
    assert got == {"x": ("rejected", "0", "5"), "y": ("candidate", "2", "2"), "z": ("candidate", "7", "8")}


def test_communities():
    edges = [("a", "b", 3.0), ("b", "c", 3.0), ("a", "c", 3.0), ("x", "y", 2.0), ("c", "x", 0.1)]
    got = local_moves(["a", "b", "c", "x", "y", "lone"], edges)
    assert got == {"a": 0, "b": 0, "c": 0, "x": 1, "y": 1, "lone": -1}


def test_client_dedup(spark):
    rows = [("1", False, 0, True), ("1", False, 1, True), ("1", True, 2, False), ("1", True, 3, False), ("2", True, 4, False), ("2", False, 5, True), (None, False, 6, False)]
    frame = spark.createDataFrame(rows, "id string, is_article boolean, replay_pos long, photo boolean")
    assert sorted(r["replay_pos"] for r in client.first_seen(frame).collect()) == [0, 2, 4, 6]
    assert sorted(r["replay_pos"] for r in client.first_seen(frame, F.col("photo")).collect()) == [0, 2, 4, 5, 6]


@pytest.fixture(scope="module")
def pool(spark):
    d = "/root/testdata/sf0.001"
    tables = {
        "captures": ad.current(spark, d), "members": ad.members(spark, d), "documents": ad.texts(spark, d), "queue": ad.queue(spark, d),
        "assignments": ad.assignments(spark, d), "evidence": ad.evidence(spark, d), "registry": ad.registry(spark, d), "taxonomy": ad.taxonomy(spark),
    }
    return pl.Pool({k: v.cache() for k, v in tables.items()}, "r1")


def walk(pool, query, fetch, cursor, key):
    seen = []
    while True:
        rows = sorted(fetch(query).collect(), key=key, reverse=True)
        seen += [key(r) for r in rows[: query.limit]]
        if len(rows) <= query.limit:
            return seen
        query.cursor = cursor(rows[query.limit - 1])


def test_feed_pages_cover_all_once(pool):
    for dedup in (True, False):
        key = (lambda r: (r["sort_ts"], r["id"])) if dedup else (lambda r: (r["sort_ts"], r["id"], r["contributed_by"]))
        seen = walk(pool, pl.FeedQuery(dedup=dedup, limit=200), pool.feed, pool.feed_cursor, key)
        want = pool.t["captures"].select("id").distinct().count() if dedup else pool.t["captures"].count()
        assert len(seen) == len(set(seen)) == want and seen == sorted(seen, reverse=True)


def test_units_pages_and_revisions(pool):
    seen = walk(pool, pl.UnitQuery(limit=100), pool.units, pool.unit_cursor, lambda r: (r["sort_ts"], r["unit_id"]))
    assert len(seen) == len(set(seen)) == pool.t["members"].select("unit_id").distinct().count()
    with pytest.raises(pl.StaleRevision):
        pool.units(pl.UnitQuery(cursor=cap.encode_cursor(("r0", "x", "y"))))
    with pytest.raises(pl.BadQuery):
        pool.units(pl.UnitQuery(cursor="??"))
    with pytest.raises(pl.BadQuery):
        pl.FeedQuery(limit=201)


def test_pool_filters_and_summaries(pool):
    q = pl.UnitQuery(author_ids=["a1", "a2"], has_media=True, public_original=True, cutoff="2025", labels=["lang-en"], limit=200)
    for r in pool.units(q).collect():
        assert r["n_posts"] >= 1
    assert pool.feed(pl.FeedQuery(q="of the", labels=["good"], contributors=["c0"])).count() <= 51
    name = pool.free_labels().first()["name"]
    assert pool.free_label(name)["units"] >= 1
    with pytest.raises(pl.NotFound):
        pool.free_label("no-such-label")
    g = pool.graph(20)
    assert g["communities"].count() == g["nodes"].count() <= 20
    assert pool.status().count() == 1 and pool.labels().count() == 7 and pool.contributors().count() == 3
    assert pool.health()["captures"] == pool.t["captures"].count()
    assert json.dumps(pool.health())
