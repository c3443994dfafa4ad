"""The pool's tables of a folder of star-schema tables, folded once into a generation.

Queries read the generation's Parquet tables, so filters and columns reach the scan and nothing is
derived twice. The revision of a generation is that of the input files: where it has not changed,
a generation is taken as it is, which is a warm start. Where nothing but files of events has come, these
are folded into it (:mod:`tidepool.plans.advance`); else a new one is folded and published."""

from __future__ import annotations

import hashlib
import json
import tempfile

from pyspark.sql import DataFrame, SparkSession

from tidepool.sources.segments import Stale, _fs, manifest, prune, publish

INPUTS = ("events", "documents", "labels")
#: Changes when the fold does.
VERSION = "3"
_OPEN: dict[tuple[str, str], tuple[str, dict[str, DataFrame]]] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Only where the session names
    none and runs in one process, a temporary folder is made and set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidepool-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def listing(spark: SparkSession, d: str) -> dict[str, dict[str, list[int]]]:
    """Size and time of each file of the inputs, by its path below them, from the file system alone."""
    out: dict[str, dict[str, list[int]]] = {}
    for name in INPUTS:
        fs, path = _fs(spark, f"{d}/{name}.parquet")
        found, whole = fs.listFiles(path, True), fs.getFileStatus(path).getPath().toString()
        out[name] = {}
        while found.hasNext():
            status = found.next()
            own = status.getPath().toString().removeprefix(whole)
            if not own.rpartition("/")[2].startswith(("_", ".")):
                out[name][own] = [status.getLen(), status.getModificationTime()]
    return out


def revision(inputs: dict) -> str:
    return hashlib.sha256(f"{VERSION}|{json.dumps(inputs, sort_keys=True)}".encode()).hexdigest()


def added(old: dict, new: dict) -> list[str] | None:
    """Files of events that came to the inputs since; None where anything else has changed."""
    if any(old.get(name) != new[name] for name in INPUTS if name != "events"):
        return None
    was, now = old.get("events", {}), new["events"]
    return sorted(now.keys() - was.keys()) if was and all(now.get(f) == at for f, at in was.items()) else None


def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The tables of the current generation. If there is none of this revision, files of events that
    are new are folded into the last one; where other inputs have changed, or there was none, all is."""
    from tidepool.plans import advance

    inputs = listing(spark, d)
    key, now = (spark.sparkContext.applicationId, d), revision(inputs)
    if key in _OPEN and _OPEN[key][0] == now:
        return _OPEN[key][1]
    root = f"{work_dir(spark)}/pool-{hashlib.sha256(d.encode()).hexdigest()[:16]}"
    known = manifest(spark, root)
    if not known or known["revision"] != now:
        files = added(known["inputs"], inputs) if known and known.get("version") == VERSION else None
        more = {"inputs": inputs, "version": VERSION}
        try:
            if files:
                base = f"{d}/events.parquet"
                events = spark.read.schema(spark.read.parquet(base).schema).parquet(*(f"{base}{f}" for f in files))
                advance.advance(spark, d, root, known, now, events, more)
            else:
                fold(spark, d, root, now, known["generation"] if known else None, more)
            prune(spark, root)
        except Stale:  # another session has just folded it
            pass
    _OPEN[key] = now, advance.layered(spark, root, manifest(spark, root))
    return _OPEN[key][1]


def fold(spark: SparkSession, d: str, root: str, now: str, expected: str | None, more: dict) -> dict:
    """Fold all facts of a folder and publish the result."""
    from tidepool.plans.adapter import FOLDS

    return publish({name: (lambda done, f=f: f(spark, d, done)) for name, f in FOLDS.items()}, root, now, expected, spark, more)
