import json

import pytest
from pyspark.sql import functions as F

from tidepool.functions import paths
from tidepool.operators import graph, ingest, results, units
from tidepool.plans import adapter, generation, pool, queries
from tidepool.sources import segments

DIR = "/root/testdata/sf0.001"


def post(**more):
    return json.dumps({"id": "1", "url": "u", "text": "t", "captured_at": "2024-01-01T00:00:00Z", "author": {"username": "a"}} | more)


def test_lenient_and_strict_reading(spark):
    rows = ["", "  ", post(), "{broken", post(id=""), post(contributed_by="me", pooled_at="p"), "[]", "null"]
    lines = spark.createDataFrame([("data/who/2024", i, line) for i, line in enumerate(rows)], "path string, line_n int, line string")
    assert sorted((r["contributed_by"], r["pooled_at"]) for r in ingest.posts(lines).collect()) == [("me", "p"), ("who", "2024-01-01T00:00:00Z")]
    assert [(r["line_n"], r["reason"]) for r in ingest.faults(lines).orderBy("line_n").collect()] == [(4, "json"), (5, "id"), (7, "id"), (8, "id")]
    with pytest.raises(ingest.BadSource, match="json in data/who/2024 at line 4"):
        ingest.check_source(lines)
    good = lines.where("line_n in (0, 2, 5)")
    assert ingest.check_source(good) is good


def test_envelopes(spark):
    rows = [(0, i, "1", "u") for i in range(1001)] + [(1, 0, "1", "u"), (1, 1, "", "u")]
    frame = spark.createDataFrame(rows, "envelope int, position int, id string, url string").selectExpr(
        "*", "'t' AS text", "'2024-01-01T00:00:00Z' AS captured_at", "cast(null AS string) AS created_at", "'a' AS username"
    )
    taken, rejected = ingest.accepted(frame)
    assert [r["position"] for r in taken.collect()] == [0] and [tuple(r) for r in rejected.collect()] == [(1, 1, "id")]


def test_canonical_json_is_that_of_javascript(spark):
    text = 'a"\\ \n\t\b\f\r \x0b\x0e\x1f\x7f é 😀 / \\u000B'
    frame = spark.createDataFrame([(text,)], "t string").select(units.canonical_json(F.struct("t")).alias("j"))
    assert frame.first()["j"] == json.dumps({"t": text}, ensure_ascii=False, separators=(",", ":"))


def test_semantic_fields(spark):
    frame = spark.createDataFrame(
        [("1", "A", None, "", "c", "", "9", ["b", "", "a"], ["a", "c"], None, True, "t")],
        "id string, author_username string, author_id string, conversation_id string, in_reply_to_status_id string, in_reply_to_tweet_id string,"
        "reply_to_status_id string, expanded_urls array<string>, entity_urls array<string>, is_retweet boolean, is_subscriber_only boolean, text string",
    )
    got = json.loads(frame.select(units.canonical_json(units.semantic(frame))).first()[0])
    assert got == {"author_username": "a", "expanded_urls": ["a", "b", "c"], "id": "1", "is_retweet": False, "is_subscriber_only": True, "reply_to": "c", "text": "t"}


def test_hub_names(spark):
    rows = [("org-model", "u1", "1", "see huggingface.co/Org/Model"), ("org-model", "u2", "1", "https://huggingface.co/other/x"), ("x", "u1", "1", "no reference")]
    frame = spark.createDataFrame(rows, "name string, unit_id string, post_id string, quote string")
    assert [tuple(r) for r in paths.hub_names(frame).collect()] == [("org-model", "Org/Model")]


def test_acceptance_counts_what_it_discards(spark):
    taxonomy = spark.createDataFrame([("Good",), ("Bad",)], "name string")
    said = spark.createDataFrame([("u", " good", 0, True), ("u", "GOOD", 1, True), ("u", "bad", 2, False), ("u", "none", 3, True)], "unit_id string, name string, pos int, verbatim boolean")
    assert [tuple(r) for r in results.accepted_presets(said, taxonomy).collect()] == [("u", ["Good"], 3)]
    free = [("u", n, True, i) for i, n in enumerate(["a", "a", "gone", "good", "b", "c", "d", "e", "f"])] + [("v", "x", False, 0)]
    registry = spark.createDataFrame([("gone", "rejected")], "name string, status string")
    got = results.accepted_free(spark.createDataFrame(free, "unit_id string, slug string, ok boolean, pos int"), ["good"], registry)
    assert {r["unit_id"]: (r["kept"], r["discarded"]) for r in got.collect()} == {"u": (["a", "b", "c", "d", "e"], 4), "v": ([], 1)}


def test_seeded(spark):
    registry = spark.createDataFrame([("a", "approved", "t0"), ("b", "rejected", "t1")], "name string, status string, first_observed_at string")
    got = {r["name"]: tuple(r)[1:] for r in results.seeded(registry, ["a", "b", "c"], "now").collect()}
    assert got == {"a": ("rejected", "t0", "seed:hard-rejected"), "b": ("rejected", "t1", None), "c": ("rejected", "now", "seed:hard-rejected")}


def test_chain_faults(spark):
    rows = [("x", 1, "a", None), ("x", 2, "b", "a"), ("x", 4, "c", "b"), ("y", 1, "d", "?"), ("z", 1, "e", None), ("z", 1, "f", None)]
    frame = spark.createDataFrame(rows, "run string, sequence long, sha256 string, previous_sha256 string")
    assert sorted(tuple(r) for r in results.chain_faults(frame, "run").collect()) == [("x", 4, "gap"), ("y", 1, "hash"), ("z", 1, "twice")]


def test_registry_replay_equals_a_sequential_fold(spark):
    import random

    from tidepool.operators import labels

    rng = random.Random(0)
    for unique in (True, True, True, False):
        names, events, revision = [f"n{i}" for i in range(6)], [], 0
        for pos in range(40):
            revision += 1 if unique else rng.random() < 0.9
            events.append([rng.choice(names), rng.choice(["candidate", "approved", "rejected", "candidate"]), f"t{pos:03d}", "k", revision, pos])
        if unique:  # a legal chain with one fault
            state = {}
            for e in events:
                e[1] = {None: "candidate", "candidate": "approved", "approved": "rejected"}.get(state.get(e[0]), "rejected")
                if state.get(e[0]) == "rejected":
                    e[0] = "m" + e[2]
                    e[1] = "candidate"
                state[e[0]] = e[1]
            at = rng.randrange(5, 35)
            fault = rng.choice(["gap", "order", "illegal"])
            if fault == "gap":
                for e in events[at:]:
                    e[4] += 1
            elif fault == "order":
                events[at][5], events[at + 1][5] = events[at + 1][5], events[at][5]
            else:
                events[at][1] = "approved"
                events[at][0] = "new"
        state, at = {}, 0
        for n, status, t, _, r, _ in sorted(events, key=lambda e: e[5]):
            was = state.get(n)
            legal = status in ("candidate", "rejected") if was is None else was[0] == "candidate" or (was[0] == "approved" and status == "rejected")
            if r == at + 1 and legal:
                at = r
                state[n] = (status, was[1] if was else t, t)
        events.append(["other", "candidate", "t", "x", 1, 99])
        frame = spark.createDataFrame(events, "name string, status string, at string, contract_hash string, revision long, pos long").withColumn("reason", F.lit(None).cast("string"))
        got = {r["name"]: (r["status"], r["first_observed_at"], r["updated_at"]) for r in labels.replay_registry(frame, "k").collect()}
        assert got == state and state


def test_communities_of_the_query_equal_a_naive_fold(spark):
    """Moves by the whole modularity, computed anew for each."""
    nodes = [r["name"] for r in queries.graph_nodes(spark, DIR).collect()]
    edges = [(r["source"], r["target"], float(r["weight"])) for r in queries.graph_links_top(spark, DIR).collect()]
    linked = sorted({x for a, b, _ in edges for x in (a, b)})
    strength = {n: sum(w for a, b, w in edges if n in (a, b)) for n in linked}
    total, home = sum(strength.values()), {n: n for n in linked}

    def gain(n, c):
        inside = sum(w for a, b, w in edges if n in (a, b) and home[b if a == n else a] == c)
        return inside - strength[n] * sum(strength[m] for m in linked if m != n and home[m] == c) / total

    for _ in range(50):
        moved = False
        for n in linked:
            near = {home[b if a == n else a] for a, b, _ in edges if n in (a, b)}
            best = home[n]
            for c in sorted(near | {home[n]}):
                if gain(n, c) > gain(n, best) + 1e-12:
                    best = c
            moved |= best != home[n]
            home[n] = best
        if not moved:
            break
    members = {c: [n for n in linked if home[n] == c] for c in set(home.values())}
    number = {c: i for i, c in enumerate(sorted(members, key=lambda c: (-len(members[c]), c)))}
    got = {r["name"]: r["community"] for r in queries.communities(spark, DIR).collect()}
    assert got == {n: number[home[n]] if n in home else -1 for n in nodes}
    assert graph.local_moves(["alone"], []) == {"alone": -1}


@pytest.fixture(scope="module")
def made(spark):
    t = dict(generation.tables(spark, DIR))
    t["documents"], t["taxonomy"] = adapter.table(spark, DIR, "documents"), adapter.taxonomy(spark)
    return pool.Pool(t, "r1")


def test_selections(spark, made):
    every = {r["name"]: r["units"] for r in made.labels().collect()}
    none = {r["name"]: r["units"] for r in made.labels(pool.Selection()).collect()}
    s = pool.Selection.of({"cutoff": "2024-01-20", "publication": "public-original", "labels": "good, lang-en", "label_mode": "any"})
    some = {r["name"]: r["units"] for r in made.labels(s).collect()}
    assert every == none and some.keys() == every.keys() and all(some[k] <= every[k] for k in every) and some != every
    assert sum(some.values()) > 0
    assert made.labels(pool.Selection(labels=["good", "good"], every_label=True)).agg(F.sum("units")).first()[0] == 0
    assert made.status(s).first()["units"] < made.status().first()["units"]
    assert made.graph(5, s)["nodes"].count() <= 5
    for bad in ({"label_mode": "most"}, {"publication": "all"}):
        with pytest.raises(pool.BadQuery):
            pool.Selection.of(bad)


def test_a_generation_is_folded_once(spark):
    a, b = generation.tables(spark, DIR), generation.tables(spark, DIR)
    assert a is b and set(a) == set(adapter.FOLDS)
    key = (spark.sparkContext.applicationId, DIR)
    held = generation._OPEN.pop(key)
    root = f"{generation.work_dir(spark)}/pool-" + __import__("hashlib").sha256(DIR.encode()).hexdigest()[:16]
    before = segments.manifest(spark, root)["generation"]
    again = generation.tables(spark, DIR)  # a new session finds the generation as it is
    assert segments.manifest(spark, root)["generation"] == before and again["queue"].count() == held[1]["queue"].count()
