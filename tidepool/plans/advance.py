"""New captures folded into the tables of a generation: only what they touch is folded again.

A generation may have layers: a whole fold, and one thin layer for each advance since. A layer holds
the keys that an advance has touched (of captures, posts, units, label names) and, of each table, the
rows of those keys as they are now. A row counts if no later layer has touched its key. So an advance
writes as much as its batch touches, and reads old tables by semi-joins with the touched keys; texts are
searched again for the documents of touched units alone. From MOST_LAYERS on the next advance writes
all rows that count as one layer, which folds nothing anew either.

What a batch of captures touches: its posts; the units that these belong to now and did before, since a
post may move; the labels of those units, with names that any of them has or had. A post of a touched
unit that is not in the batch keeps its rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import captures as cap_ops
from tidepool.operators import units as unit_ops
from tidepool.plans import adapter as ad
from tidepool.sources.segments import publish

MOST_LAYERS = 8
#: What names the rows of each table that are folded together; all others go by unit.
KEYS = {"captures": ["id", "contributed_by"], "members": ["id"], "attempts": ["id"], "registry": ["name"]}
TOUCHED = {"captures": "touched_captures", "members": "touched_posts", "attempts": "touched_posts", "registry": "touched_names"}
UNIT_KEY, UNITS = ["unit_id"], "touched_units"


def layered(spark: SparkSession, root: str, made: dict, check: bool = True) -> dict[str, DataFrame]:
    """The tables of a generation: of each layer the rows whose keys no later one has touched. With `check`
    each layer's tables must have the rows that its manifest counted."""
    layers = [*made.get("layers", []), made["generation"]]
    counts = {**made.get("layer_counts", {}), made["generation"]: made["counts"]}
    opened: dict[tuple[str, str], DataFrame] = {}

    def read(layer: str, name: str) -> DataFrame:
        if (layer, name) not in opened:
            opened[layer, name] = spark.read.parquet(f"{root}/generations/{layer}/{name}")
        return opened[layer, name]

    for layer in layers if check else ():
        for name, n in counts[layer].items():
            if read(layer, name).count() != n:
                raise ValueError(f"{name} has not the rows that its manifest says")
    out = {}
    for name in ad.FOLDS:
        key, touched = KEYS.get(name, UNIT_KEY), TOUCHED.get(name, UNITS)
        parts = []
        for i, layer in enumerate(layers):
            rows = read(layer, name)
            if later := [read(x, touched) for x in layers[i + 1 :]]:
                rows = rows.join(reduce(DataFrame.union, later), key, "left_anti").select(rows.columns)
            parts.append(rows)
        out[name] = reduce(DataFrame.unionByName, parts)
    return out


def deltas(spark: SparkSession, d: str, old: dict[str, DataFrame], events: DataFrame, batch: DataFrame | None = None) -> dict:
    """Touched keys and the new rows of their tables, each as a function of those before it, for
    publish(). events: the new ones; batch: their captures, if not those that the events stand for."""
    batch = cap_ops.project(ad.captures(spark, d, events)) if batch is None else batch

    def now(name: str, done: dict) -> DataFrame:
        key, touched = KEYS.get(name, UNIT_KEY), done[TOUCHED.get(name, UNITS)]
        return old[name].join(touched, key, "left_anti").unionByName(done[name])

    def captures(done: dict) -> DataFrame:
        held = old["captures"].join(done["touched_captures"], KEYS["captures"], "left_semi")
        return cap_ops.freshest(held.unionByName(batch.select(held.columns))).drop("rn")

    def members(done: dict) -> DataFrame:
        columns = ["id", "unit_id", "captured_at", "replay_pos"]
        held = old["members"].join(done["touched_posts"], "id", "left_semi").select(columns)
        return unit_ops.latest_unit(held.unionByName(unit_ops.members(batch)))

    def touched_units(done: dict) -> DataFrame:
        before = old["members"].join(done["touched_posts"], "id", "left_semi").select("unit_id")
        return before.union(done["members"].select("unit_id")).distinct()

    def member_rows(done: dict) -> DataFrame:
        posts = done["touched_posts"]
        still = old["member_rows"].join(done["touched_units"], "unit_id", "left_semi").join(posts, "id", "left_anti")
        held = old["captures"].join(posts, "id", "left_semi").join(done["touched_captures"], KEYS["captures"], "left_anti")
        moved = held.unionByName(done["captures"].select(held.columns)).join(done["members"].select("id", "unit_id"), "id")
        return still.select(moved.columns).unionByName(moved)

    def touched_names(done: dict) -> DataFrame:
        before = old["free_labels"].join(done["touched_units"], "unit_id", "left_semi").select("name")
        return before.union(done["free_labels"].select("name")).distinct()

    def registry(done: dict) -> DataFrame:
        labels = now("free_labels", done).join(done["touched_names"], "name", "left_semi")
        return ad._registry(spark, d, {"free_labels": labels, "queue": now("queue", done)})

    def attempts(done: dict) -> DataFrame:
        held = old["attempts"].join(done["touched_posts"], "id", "left_semi")
        held = held.drop("unit_id").join(done["members"].select("id", "unit_id"), "id")
        new = ad._attempts(spark, d, {"events": events, "members": done["members"]})
        return held.select(new.columns).unionByName(new)

    folded = lambda name: lambda done: ad.FOLDS[name](spark, d, {**done, "some": True})
    own = {
        "touched_captures": lambda done: batch.select(*KEYS["captures"]).distinct(), "captures": captures,
        "touched_posts": lambda done: batch.select("id").distinct(), "members": members, "touched_units": touched_units,
        "member_rows": member_rows, "queue": folded("queue"), "unit_docs": folded("unit_docs"), "free_labels": folded("free_labels"),
        "touched_names": touched_names, "registry": registry,
    }
    return own | {name: folded(name) for name in ("preset_labels", "assignments", "evidence")} | {"attempts": attempts}


def advance(
    spark: SparkSession, d: str, root: str, made: dict, revision: str, events: DataFrame, more: dict, batch: DataFrame | None = None
) -> dict:
    """Fold new events into the generation `made`; the manifest of the new one."""
    tables = deltas(spark, d, layered(spark, root, made, check=False), events, batch)
    layers = [*made.get("layers", []), made["generation"]]
    counts = {**made.get("layer_counts", {}), made["generation"]: made["counts"]}
    out = publish(tables, root, revision, made["generation"], spark, more | {"layers": layers, "layer_counts": counts})
    return compact(spark, root, out, more) if len(layers) >= MOST_LAYERS else out


def compact(spark: SparkSession, root: str, made: dict, more: dict) -> dict:
    """All rows that count, as one layer."""
    return publish(layered(spark, root, made), root, made["revision"], made["generation"], spark, more)
