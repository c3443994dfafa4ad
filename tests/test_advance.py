import hashlib
import shutil

import pytest
from pyspark.sql import functions as F

from tidepool.operators import captures as cap_ops
from tidepool.plans import adapter, advance, generation
from tidepool.sources import segments

DIR = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Of tables this small, most of the time would go to empty tasks."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def rows(df):
    return sorted(str(tuple(r)) for r in df.select(sorted(df.columns)).collect())


def folded(spark, d, root):
    """All tables of a folder, each folded whole."""
    segments.publish({n: (lambda done, f=f: f(spark, d, done)) for n, f in adapter.FOLDS.items()}, root, "1", None, spark)
    return segments.restore(spark, root)


@pytest.fixture
def inputs(spark, tmp_path):
    """Events in three parts, of which posts have captures in several."""
    events = spark.read.parquet(f"{DIR}/events.parquet")
    for name in ("documents", "labels"):
        shutil.copy(f"{DIR}/{name}.parquet", tmp_path / f"{name}.parquet")
    (tmp_path / "events.parquet").mkdir()

    def add(n, where):
        events.where(where).coalesce(1).write.parquet(f"{tmp_path}/part{n}")
        (f,) = (tmp_path / f"part{n}").glob("part-*.parquet")
        f.rename(tmp_path / "events.parquet" / f"{n}.parquet")

    return str(tmp_path), add


def test_new_files_are_folded_in(spark, inputs):
    d, add = inputs
    root = f"{generation.work_dir(spark)}/pool-" + hashlib.sha256(d.encode()).hexdigest()[:16]
    add(0, "event_id % 5 < 3")
    first = generation.tables(spark, d)
    assert not segments.manifest(spark, root).get("layers")
    add(1, "event_id % 5 = 3 and event_id < 300")
    second = generation.tables(spark, d)
    made = segments.manifest(spark, root)
    assert len(made["layers"]) == 1 and second is not first
    touched = spark.read.parquet(f"{root}/generations/{made['generation']}/touched_units").count()
    assert 0 < touched < second["queue"].count()  # the others were not folded again
    assert made["counts"]["queue"] == touched
    add(2, "(event_id % 5 = 3 and event_id >= 300) or event_id % 5 = 4")
    third = generation.tables(spark, d)
    assert len(segments.manifest(spark, root)["layers"]) == 2
    wanted = folded(spark, d, f"file://{d}/whole")
    for name in adapter.FOLDS:
        assert rows(third[name]) == rows(wanted[name].select(third[name].columns)), name
    assert generation.tables(spark, d) is third
    packed = advance.layered(spark, root, advance.compact(spark, root, segments.manifest(spark, root), {}))
    for name in adapter.FOLDS:
        assert rows(packed[name]) == rows(third[name])


def test_only_new_event_files_are_an_advance():
    old = {"events": {"/0": [1, 1]}, "documents": {"": [5, 5]}, "labels": {"": [6, 6]}}
    more = {"/0": [1, 1], "/1": [2, 2], "/2": [3, 3]}
    assert generation.added(old, old | {"events": more}) == ["/1", "/2"]
    assert generation.added(old, old | {"events": more, "labels": {"": [6, 7]}}) is None  # another file
    assert generation.added(old, old | {"events": {"/0": [1, 2], "/1": [2, 2]}}) is None  # rewritten
    assert generation.added(old, old | {"events": {"/1": [2, 2]}}) is None  # removed


def test_posts_that_move_and_ties(spark, tmp_path, monkeypatch):
    """A batch moves posts to other units, repeats captures with equal times, and arrives late."""
    root = f"file://{tmp_path}"
    events = spark.read.parquet(f"{DIR}/events.parquet")
    every = adapter.captures(spark, DIR)
    old = every.where("replay_pos % 7 <> 1")
    new = every.where("replay_pos % 7 = 1")
    moved = new.withColumn("conversation_id", F.when(F.col("replay_pos") % 2 == 0, F.lit("elsewhere")).otherwise(F.col("conversation_id")))
    moved = moved.withColumn("captured_at", F.when(F.col("replay_pos") % 3 == 0, F.lit("2023-12-01T00:00:00.000Z")).otherwise(F.lit("2024-02-01T00:00:00.000Z")))
    again = old.where("replay_pos % 50 = 3").withColumn("replay_pos", -F.col("replay_pos"))  # as late, and before what is stored
    batch = moved.unionByName(again)

    monkeypatch.setattr(adapter, "captures", lambda spark, d, events=None: old)
    before = {}
    for name, fold in adapter.FOLDS.items():
        before[name] = (lambda done, f=fold: f(spark, DIR, {**done, "events": events.where("event_id % 7 <> 1")}))
    made = segments.publish(before, root, "1", None, spark)
    out = advance.advance(spark, DIR, root, made, "2", events.where("event_id % 7 = 1"), {}, cap_ops.project(batch))
    got = advance.layered(spark, root, out)

    monkeypatch.setattr(adapter, "captures", lambda spark, d, events=None: old.unionByName(batch))
    wanted = folded(spark, DIR, f"{root}/whole")
    assert wanted["members"].where("unit_id like 'elsewhere%'").count() > 0
    for name in adapter.FOLDS:
        assert rows(got[name]) == rows(wanted[name].select(got[name].columns)), name
