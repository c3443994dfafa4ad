"""The pool as an object: what its service offers, over the tables of one generation."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators import captures as cap
from tidepool.operators import ingest as ing
from tidepool.operators import labels as lab
from tidepool.operators import queue as que
from tidepool.operators import units as uni
from tidepool.operators.graph import communities

MAX_PAGE = 200


class BadQuery(ValueError):
    """A parameter that can't be taken."""


class StaleRevision(Exception):
    """A cursor of another generation."""


class NotFound(LookupError):
    """No such label, or none that may be shown."""


def csv(value: str | None) -> list[str]:
    return [x.strip() for x in (value or "").split(",") if x.strip()]


@dataclass
class FeedQuery:
    """Filters of a feed; all of them must hold for one capture."""

    contributors: list[str] = field(default_factory=list)
    author: str | None = None
    author_ids: list[str] = field(default_factory=list)
    q: str | None = None
    since: str | None = None
    until: str | None = None
    has_media: bool | None = None
    is_article: bool | None = None
    labels: list[str] = field(default_factory=list)
    every_label: bool = False
    unlabeled: bool = False
    free_label: str | None = None
    dedup: bool = True
    limit: int = 50
    cursor: str | None = None

    def __post_init__(self):
        if not 1 <= self.limit <= MAX_PAGE:
            raise BadQuery(f"limit must be 1 to {MAX_PAGE}")

    @classmethod
    def of(cls, parameters: dict[str, str]) -> FeedQuery:
        """From the strings of a request: lists by commas, true or false, a number. A value that is none of
        these is BadQuery; parameters that this query does not have are left out."""
        get = lambda name: parameters.get(name) or None

        def flag(name: str) -> bool | None:
            if (value := parameters.get(name)) not in (None, "true", "false"):
                raise BadQuery(name)
            return None if value is None else value == "true"

        if (limit := parameters.get("limit", "50")).strip().lstrip("+-").isdigit() is False:
            raise BadQuery("limit")
        if parameters.get("label_mode", "any") not in ("any", "all"):
            raise BadQuery("label_mode")
        found = {
            "contributors": csv(get("contributors")), "author": get("author"), "author_ids": csv(get("author_ids")), "q": get("q"), "since": get("since"),
            "until": get("until"), "has_media": flag("has_media"), "is_article": flag("is_article"), "labels": csv(get("labels")),
            "every_label": parameters.get("label_mode") == "all", "unlabeled": bool(flag("unlabeled")), "free_label": get("free_label"),
            "dedup": flag("dedup") is not False, "limit": int(limit), "cursor": get("cursor"),
        }
        return cls(**found, **cls._more(parameters))

    @staticmethod
    def _more(parameters: dict[str, str]) -> dict:
        return {}


@dataclass
class UnitQuery(FeedQuery):
    """As a feed, for units: author_ids must hold for all members; cutoff bounds the latest
    activity; public_original leaves out subscriber-only units and those of reposts only."""

    cutoff: str | None = None
    public_original: bool = False

    @staticmethod
    def _more(parameters: dict[str, str]) -> dict:
        publication = parameters.get("publication")
        if publication not in (None, "public-original") or parameters.get("cutoff") == "":
            raise BadQuery("publication or cutoff")
        return {"cutoff": parameters.get("cutoff"), "public_original": publication is not None}


@dataclass
class Selection:
    """Which units the labels, the graph and the status are of."""

    cutoff: str | None = None
    public_original: bool = False
    author_ids: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    every_label: bool = False

    @classmethod
    def of(cls, parameters: dict[str, str]) -> Selection:
        """From the strings of a request; unknown values are BadQuery."""
        mode, publication = parameters.get("label_mode", "any"), parameters.get("publication")
        if mode not in ("any", "all") or publication not in (None, "", "public-original"):
            raise BadQuery("label_mode or publication")
        return cls(
            parameters.get("cutoff") or None, publication == "public-original", csv(parameters.get("author_ids")), csv(parameters.get("labels")), mode == "all"
        )


class Pool:
    """tables: captures (current, projected), members, documents (doc_id, text), queue,
    assignments, evidence, registry, taxonomy. revision: that of the generation."""

    def __init__(self, tables: dict[str, DataFrame], revision: str):
        self.t, self.revision = tables, revision

    # -- feed

    def _rows(self, q: FeedQuery, phrase: bool) -> DataFrame:
        rows = self.t["captures"]
        tests: list[Column] = []
        if q.contributors:
            tests.append(F.col("contributed_by").isin(q.contributors))
        if q.author:
            tests.append(F.col("author_username") == q.author.lower())
        if q.since:
            tests.append(F.col("sort_ts") >= q.since)
        if q.until:
            tests.append(F.col("sort_ts") <= q.until)
        for name in ("has_media", "is_article"):
            if (value := getattr(q, name)) is not None:
                tests.append(F.col(name) == value)
        for t in tests:
            rows = rows.where(t)
        if q.q:
            rows = rows.join(self.t["documents"].select("doc_id", "text"), "doc_id")
            rows = rows.where((cap.phrase if phrase else cap.literal)(q.q, "text", "author_username"))
        return rows

    def _eligible(self) -> DataFrame:
        return que.eligible(self.t["queue"])

    def _labelled_units(self, q: FeedQuery) -> DataFrame | None:
        own = self.t["assignments"].where("kind = 'preset'").join(self._eligible(), "unit_id", "left_semi")
        if not q.labels:
            return None
        found = own.where(F.col("name").isin(q.labels)).groupBy("unit_id").agg(F.countDistinct("name").alias("n"))
        return found.where(F.col("n") >= (len(set(q.labels)) if q.every_label else 1)).select("unit_id")

    def _by_label(self, rows: DataFrame, q: FeedQuery) -> DataFrame:
        """rows (with unit_id) whose unit has the labels that the query names."""
        found = self._labelled_units(q)
        if found is not None:
            rows = rows.join(found, "unit_id", "left_semi")
        if q.unlabeled:
            own = self.t["assignments"].where("kind = 'preset'").join(self._eligible(), "unit_id", "left_semi")
            rows = rows.join(own, "unit_id", "left_anti")
        if q.free_label:
            rows = rows.join(self._pairs().where(F.col("name") == q.free_label), "unit_id", "left_semi")
        return rows

    def _pairs(self) -> DataFrame:
        return lab.approved_pairs(self.t["assignments"], self._eligible(), self.t["registry"])

    def feed(self, q: FeedQuery) -> DataFrame:
        """A page of the feed and one row more; a cursor that can't be read starts anew."""
        rows = self._rows(q, phrase=True)
        if q.author_ids:
            rows = rows.where(F.col("author_id").isin(q.author_ids))
        if q.labels or q.unlabeled or q.free_label:
            rows = self._by_label(rows.join(self.t["members"].select("id", "unit_id"), "id", "left"), q)
        order = cap.FEED_ORDER[:2] if q.dedup else cap.FEED_ORDER
        if q.dedup:
            rows = cap.deduplicated(rows)
        at = cap.decode_cursor(q.cursor, 3) if q.cursor else None
        return cap.page(rows, order, q.limit, at[: len(order)] if at else None)

    @staticmethod
    def feed_cursor(row) -> str:
        return cap.encode_cursor((row["sort_ts"], row["id"], row["contributed_by"]))

    # -- units

    def units(self, q: UnitQuery) -> DataFrame:
        """A page of units with their posts, and one more. A cursor is of one generation and one cutoff."""
        members = self.t["captures"].join(self.t["members"].select("id", "unit_id"), "id")
        kept = uni.flags(members, q.author_ids or None)
        some = UnitQuery(**{**q.__dict__, "author_ids": []})
        if any((q.contributors, q.author, q.q, q.since, q.until, q.has_media is not None, q.is_article is not None)):
            rows = self._rows(some, phrase=False).join(self.t["members"].select("id", "unit_id"), "id")
            kept = kept.join(rows.select("unit_id"), "unit_id", "left_semi")
        if q.author_ids:
            kept = kept.where("closed")
        if q.public_original:
            kept = kept.where("public_original")
        if q.cutoff:
            kept = kept.where(F.col("activity") <= q.cutoff)
        kept = self._by_label(kept, q)
        at = None
        if q.cursor:
            found = cap.decode_cursor(q.cursor, 3)
            if found is None:
                raise BadQuery("cursor")
            if found[0] != self.revision_of(q.cutoff):
                raise StaleRevision(found[0])
            at = found[1:]
        return uni.hydrate(members, cap.page(kept, uni.UNIT_ORDER, q.limit, at).select(*uni.UNIT_ORDER))

    def revision_of(self, cutoff: str | None = None) -> str:
        """The generation's revision, and with a cutoff its digest: pages of one cutoff belong together."""
        return self.revision if cutoff is None else f"{self.revision}:{hashlib.sha256(cutoff.encode()).hexdigest()}"

    def unit_cursor(self, row, cutoff: str | None = None) -> str:
        return cap.encode_cursor((self.revision_of(cutoff), row["sort_ts"], row["unit_id"]))

    # -- ingest, administration

    def ingest(self, posts: DataFrame, contributor: str, at: str) -> tuple[DataFrame, DataFrame]:
        """What a contributor's envelopes of posts (envelope, position, id, url, username, text, captured_at,
        created_at, and more) add: the posts that are valid, the first and freshest of their key and fresher
        than what is stored, stamped; and one row with added, duplicates and rejected. Of envelopes
        that are too small or too large nothing is taken."""
        good, bad = ing.accepted(posts)
        stamped = ing.stamp(good, F.lit(contributor), F.lit(at)).withColumn("replay_pos", F.struct("envelope", "position"))
        judged = cap.classify(stamped, self.t["captures"])
        counts = judged.agg(F.count_if("accepted").alias("added"), F.count_if(~F.col("accepted")).alias("duplicates"))
        rejected = bad.agg(F.count("*").alias("rejected"))
        return judged.where("accepted").drop("accepted", "replay_pos"), counts.join(F.broadcast(rejected))  # single rows

    def candidates(self, name: str | None = None) -> DataFrame:
        """name, status, first_observed_at, units, authors, days, quotes (five at most) of the candidates; or
        of one label, whatever its status (NotFound if there is none)."""
        known = self.t["registry"].where("status = 'candidate'" if name is None else F.col("name") == name)
        if name is not None and known.isEmpty():
            raise NotFound(name)
        members = self.t["captures"].join(self.t["members"].select("id", "unit_id"), "id")
        rows = members.select("unit_id", "author_id", F.substring("captured_at", 1, 10).alias("day"))
        own = self.t["assignments"].join(known.select("name"), "name", "left_semi")
        counts = lab.signals(own, self.t["evidence"], rows).select("name", "units", "authors", "days")
        said = lab.quotes(self.t["evidence"], known, 5).groupBy("name").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("n", "unit_id", "post_id", "quote"))), lambda q: F.struct(q["unit_id"], q["post_id"], q["quote"])).alias("quotes")
        )
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("units", "authors", "days")}
        met = known.select("name", "status", "first_observed_at").join(counts, "name", "left").join(said, "name", "left")
        return met.withColumns(zero)

    # -- summaries

    def contributors(self) -> DataFrame:
        return cap.contributors(self.t["captures"]).orderBy(F.col("posts").desc(), "contributed_by")

    def _chosen(self, s: Selection | None) -> DataFrame:
        """Eligible units of a selection."""
        own = self._eligible()
        if s is None:
            return own
        if s.cutoff or s.public_original or s.author_ids:
            own = own.join(self._selected(s), "unit_id", "left_semi")
        return lab.with_presets(own, self.t["assignments"], s.labels, s.every_label)

    def _selected(self, s: Selection) -> DataFrame:
        members = self.t["captures"].join(self.t["members"].select("id", "unit_id"), "id")
        return uni.selected(members, s.cutoff, s.public_original, s.author_ids or None)

    def _chosen_pairs(self, s: Selection | None) -> DataFrame:
        return lab.approved_pairs(self.t["assignments"], self._chosen(s), self.t["registry"])

    def labels(self, s: Selection | None = None) -> DataFrame:
        return lab.preset_counts(self.t["assignments"], self._chosen(s), self.t["taxonomy"])

    def free_labels(self, s: Selection | None = None) -> DataFrame:
        return lab.free_counts(self._chosen_pairs(s)).orderBy(F.col("units").desc(), "name")

    def free_label(self, name: str, s: Selection | None = None) -> dict:
        every = self._chosen_pairs(s)
        own = every.where(F.col("name") == name).join(self.t["members"].select("id", "unit_id"), "unit_id")
        units, posts = own.agg(F.countDistinct("unit_id"), F.countDistinct("id")).first()
        if not units:
            raise NotFound(name)
        return {"name": name, "units": units, "posts": posts, "related": lab.related(every, name)}

    def graph(self, top: int | None = 300, s: Selection | None = None) -> dict[str, DataFrame]:
        """Nodes, links and communities; top None: complete, or TooLarge."""
        pairs = self._chosen_pairs(s)
        if top is None:
            nodes, links = lab.complete(lab.free_counts(pairs), lab.MAX_NODES), lab.complete(lab.links(pairs), lab.MAX_LINKS)
        else:
            if not 1 <= top <= 1000:
                raise BadQuery("top must be 1 to 1000")
            nodes = lab.top_nodes(pairs, top)
            links = lab.top_links(pairs, nodes, top)
        return {"nodes": nodes, "links": links, "communities": communities(nodes, links)}

    def status(self, s: Selection | None = None) -> DataFrame:
        """Counts, and the time through which all work is complete: two single rows. A selection by
        labels has no bearing on them."""
        queue = self.t["queue"]
        if s is not None and (s.cutoff or s.public_original or s.author_ids):
            queue = queue.join(self._selected(s), "unit_id", "left_semi")
        return que.status_counts(queue).join(F.broadcast(que.complete_through(queue)))

    def health(self) -> dict:
        return {"revision": self.revision, "captures": self.t["captures"].count(), **que.depth(self.t["queue"]).first().asDict()}
