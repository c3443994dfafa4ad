"""Substring deduplication with suffix automata.

A window is WINDOW consecutive words. Words are removed that are covered by a window whose
word sequence also starts elsewhere, in the same text or another one.

References that any text may repeat are the whole corpus, so automata of all of it cannot be
sent to every task. Shards keep the work linear: each window has an anchor, the least hash of
the ANCHOR-word sequences in it; equal windows have equal anchors, so a shard is the windows of
one anchor. Neighbouring windows with the same anchor are one run, and a run is the unit that
is shuffled:

1. Runs whose anchor no other run has, and whose text repeats none of their windows, are
   unique. Runs of an anchor that agree as a whole (in two hashes of 64 bits each, which are
   mixed word by word and so have no texts that collide by their pattern) are pre-aggregated: all
   their windows repeat, and one of them stands for them.
2. The remaining runs of an anchor, with one of each group of equal ones, form a reference
   shard. Its suffix automaton counts how often each sequence ends in it; the runs are streamed
   through it, and a window whose matching statistic reaches WINDOW in a state that occurs twice
   or more repeats.
3. A shard of more than SHARD_RUNS runs gets no automaton, which would grow without bound: its
   windows are counted by their two hashes over all tasks.

For a bounded set of references, :func:`remove_references` sends automata of shards of them to
every task and streams the texts, as such.

Null texts count as empty. Whole texts count, however long. Rows that repeat (same id, same
text) repeat all their windows. Of equal windows none is spared. Empty tables give empty results.
Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import (
    WORD_BYTES, binary_batch, chunks, documents, joined, materialize, mix, sequence_hashes, text_bytes, word_bounds, word_hashes,
)

WINDOW = 35
ANCHOR = 8
SHARD_RUNS = 2000
_WORDS = re.compile(WORD_BYTES)
_NO_ID = -(1 << 63)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


class Windows:
    """The windows of the texts of a buffer: where each begins (a word of the buffer), its row, its
    two hashes (128 bits together), and the n+1 bounds of each row's words."""

    def __init__(self, buffer: np.ndarray, offsets: np.ndarray, window: int):
        self.starts, self.ends, self.bounds = word_bounds(buffer, offsets)
        self.window = window
        self.words = [word_hashes(buffer, self.starts, self.ends, salt) for salt in (1, 2)]
        upto = np.repeat(self.bounds[1:], np.diff(self.bounds))
        self.at = np.flatnonzero(np.arange(len(upto)) + window <= upto)
        self.row = np.searchsorted(self.bounds, self.at, side="right") - 1
        self.hashes = [sequence_hashes(w, window)[self.at] for w in self.words]

    def runs(self, anchor_words: int) -> tuple[np.ndarray, ...]:
        """row, first window (word of its row), number of windows, anchor, two hashes of the span,
        and whether a window of the run occurs twice in the text."""
        if not len(self.at):
            none = np.zeros(0, np.int64)
            return none, none, none, none, none, none, none.astype(bool)
        least = sliding_min(sequence_hashes(self.words[0], anchor_words), self.window - anchor_words + 1)
        anchor = least[self.at]
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (self.row[1:] != self.row[:-1])])
        count = np.diff(np.r_[first, len(anchor)])
        begin = self.at[first]
        row = self.row[first]
        place = (np.arange(len(anchor)) - np.repeat(first, count)).astype(np.uint64)
        # of a run, the hashes of its windows, each mixed with its place, are summed
        spans = [np.add.reduceat(joined(h, place), first) for h in self.hashes]
        order = np.lexsort((self.hashes[1], self.hashes[0], self.row))
        same = np.ones(len(order) - 1, bool)
        for x in (self.row, *self.hashes):
            same &= x[order[1:]] == x[order[:-1]]
        twice = np.zeros(len(order), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        own = np.logical_or.reduceat(twice, first)
        return row, begin - self.bounds[row], count, mix(anchor[first]).view(np.int64), *(x.view(np.int64) for x in spans), own


_KEYS = "id long, body long"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (null: the least long), body (a hash of the text) and text: rows that share both
    keys are repeated rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("body"), text.alias("text"))


def _runs(rows: DataFrame, window: int, anchor_words: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunks(batches):
            row, at, count, anchor, span, other, own = Windows(*binary_batch(batch, "text"), window).runs(anchor_words)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor), pa.array(span), pa.array(other), batch.column(0).take(take), batch.column(1).take(take),
                    pa.array(at, pa.int32()), pa.array(count, pa.int32()), pa.array(own),
                ],
                ["anchor", "span", "other", "id", "body", "at", "n", "own"],
            )

    return rows.mapInArrow(run, f"anchor long, span long, other long, {_KEYS}, at int, n int, own boolean")


#: What becomes of a run: all its windows repeat; that, and it stands in the shard for runs
#: equal to it; the shard decides.
REPEATS, STANDS, OPEN = 0, 1, 2


def _classified(runs: DataFrame) -> DataFrame:
    """kind of each run whose anchor other runs share, or that repeats a window of its own
    text. The rows of a task are sorted by
    anchor and span; a row is judged by its neighbours, so no group is gathered."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        # the last row; (anchor, span) before it; the first (anchor, span) of its anchor's group
        held, before, group = None, None, None

        def keys(table):
            return [table.column(c).to_numpy() for c in ("anchor", "span", "other")]

        def judged(table, following):
            nonlocal before, group
            own = keys(table)
            ahead = [np.r_[x[1:], x[-1:] if following is None else following[i]] for i, x in enumerate(own)]
            behind = [np.r_[x[:1] if before is None else before[i], x[:-1]] for i, x in enumerate(own)]
            prev_a, next_a = behind[0] == own[0], ahead[0] == own[0]
            if before is None:
                prev_a[0] = False
            if following is None:
                next_a[-1] = False
            prev_s = prev_a & (behind[1] == own[1]) & (behind[2] == own[2])
            next_s = next_a & (ahead[1] == own[1]) & (ahead[2] == own[2])
            start = np.maximum.accumulate(np.where(prev_a, 0, np.arange(len(own[0]))))
            first = [x[start] for x in own[1:]]
            if prev_a[0]:
                first = [np.where(start == 0, g, x) for g, x in zip(group, first)]
            mixed = (first[0] != own[1]) | (first[1] != own[2]) | (next_a & ~next_s)
            kind = np.where(prev_s | next_s, np.where(~next_s & mixed, STANDS, REPEATS), OPEN)
            keep = prev_a | next_a | table.column("own").to_numpy()
            before, group = [x[-1] for x in own], [x[-1] for x in first]
            return table.append_column("kind", pa.array(kind, pa.int32())).filter(pa.array(keep)).select(
                ["id", "body", "at", "n", "kind", "anchor"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            whole = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            held, ready = whole.slice(whole.num_rows - 1), whole.slice(0, whole.num_rows - 1)
            if ready.num_rows:
                yield from judged(ready, [x[0] for x in keys(held)]).to_batches()
        if held is not None:
            yield from judged(held, None).to_batches()

    dealt = runs.repartition("anchor").sortWithinPartitions("anchor", "span", "other")
    return dealt.mapInArrow(run, f"{_KEYS}, at int, n int, kind int, anchor long")


def _packed(rows: DataFrame) -> DataFrame:
    """Texts compressed for their way to a join."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = [squeeze(t) for t in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["id", "body", "z"])

    return rows.mapInArrow(run, f"{_KEYS}, z binary")


def _texts(column) -> list[bytes]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    return [expand(z) for z in column.to_pylist()]


def _opened(packed: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of the runs that shards need."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                out: list[tuple] = []
                for key, body, text, runs in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _texts(part.column(2)), part.column(3).to_pylist()):
                    words = _WORDS.findall(text)
                    for r in runs:
                        at, n = r["at"], r["n"]
                        out.append((r["anchor"], key, body, at, r["kind"], b" ".join(words[at : at + n + window - 1])))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                columns = zip(*out) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["anchor", "id", "body", "at", "kind", "words"]
                )

    lists = wanted.groupBy("id", "body").agg(F.collect_set(F.struct("at", "n", "kind", "anchor")).alias("runs"))
    joined = packed.join(lists, ["id", "body"]).select("id", "body", "z", "runs")
    return joined.mapInArrow(run, f"anchor long, {_KEYS}, at int, kind int, words binary")


class SuffixAutomaton:
    """Of one or more word sequences. count[state] is how often its sequences end there."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, words: list) -> None:
        """Add a sequence; it counts once at each of its ends."""
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                self.count[last] += 1
                continue
            if q is not None:  # the sequence is there, within a longer state
                last = self._clone(last, w, q)
                self.count[last] += 1
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            self.count.append(1)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = cur

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.count.append(0)
        link[q] = c
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def occurrences(self) -> list[int]:
        """How often the sequences of each state occur in all that was added."""
        total = list(self.count)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            total[self.link[s]] += total[s]
        return total

    def match(self, words: list) -> Iterator[tuple[int, int]]:
        """The matching statistics: at each word, the length of the longest sequence ending
        there that occurs in the automaton, and its state."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                matched += 1
            yield matched, state

    def repeated(self, words: list, window: int, total: list[int]) -> list[int]:
        """Where windows begin that occur twice or more in all that was added."""
        found = []
        link, length = self.link, self.length
        for end, (matched, state) in enumerate(self.match(words)):
            if matched >= window:
                while length[link[state]] >= window:
                    state = link[state]
                if total[state] > 1:
                    found.append(end - window + 1)
        return found


def ranges(places: list[int]) -> list[tuple[int, int]]:
    """(first, number) of the runs of consecutive numbers in a sorted list."""
    out: list[list[int]] = []
    for p in places:
        if out and p == out[-1][0] + out[-1][1]:
            out[-1][1] += 1
        else:
            out.append([p, 1])
    return [tuple(r) for r in out]


def shard_repeats(runs: list[tuple], window: int) -> list[tuple]:
    """runs: (id, body, at, kind, words) of a shard. (id, body, first, number) of repeated
    windows of open runs; the windows of runs that stand for others are known to repeat."""
    automaton, split = SuffixAutomaton(), [r[4].split(b" ") for r in runs]
    for r, words in zip(runs, split):
        automaton.add(words)
    total = automaton.occurrences()
    return [
        (r[0], r[1], r[2] + first, n)
        for r, words in zip(runs, split)
        if r[3] == OPEN
        for first, n in ranges(automaton.repeated(words, window, total))
    ]


def _decided(opened: DataFrame, window: int, shard_runs: int) -> DataFrame:
    """Repeated windows of open runs as ranges (hash null), and all windows of shards that
    are too large for an automaton, one a row, with their hash."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out: list[tuple] = []

        def windows(r):
            buffer = np.frombuffer(r[4], dtype=np.uint8)
            w = Windows(buffer, np.array([0, len(buffer)]), window)
            for at, *h in zip(w.at.tolist(), *(x.view(np.int64).tolist() for x in w.hashes)):
                out.append((r[0], r[1], r[2] + at, 1, *h, r[3]))

        def close(held, large):
            if large:
                for r in held:
                    windows(r)
            else:
                out.extend((*x, None, None, OPEN) for x in shard_repeats(held, window))

        def batch_of():
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            names = ["id", "body", "at", "n", "hash", "other", "kind"]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out.clear()
            return made

        held, current, large = [], None, False
        for batch in batches:
            for anchor, *r in zip(*(c.to_pylist() for c in batch.columns)):
                if anchor != current:
                    close(held, large)
                    held, current, large = [], anchor, False
                held.append(r)
                if len(held) >= shard_runs or large:
                    large = True
                    for x in held:
                        windows(x)
                    held = []
                if len(out) >= 20_000:
                    yield batch_of()
        close(held, large)
        if out:
            yield batch_of()

    dealt = opened.repartition("anchor").sortWithinPartitions("anchor", "id", "body", "at")
    return dealt.mapInArrow(run, f"{_KEYS}, at int, n int, hash long, other long, kind int")


def repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    anchor_words: int = ANCHOR, shard_runs: int = SHARD_RUNS,
) -> tuple[DataFrame, DataFrame]:
    """Packed texts (id, body, z), and (id, body, at, n): n windows from word `at` on repeat."""
    rows = _keyed(docs, id_col, text_col)
    judged = materialize(_classified(_runs(rows, window, anchor_words)), "substring-runs")
    opened = _opened(_packed(rows), judged.where(F.col("kind") != REPEATS), window)
    decided = materialize(_decided(opened, window, shard_runs), "substring-shards")
    counted = decided.where("hash is not null")
    twice = counted.groupBy("hash", "other").agg(F.count("*").alias("c")).where("c > 1").select("hash", "other")
    # as a table of its own, so that the join deals the rows of one very frequent window anew
    large = counted.where(F.col("kind") == OPEN).join(materialize(twice, "substring-twice"), ["hash", "other"], "left_semi")
    large = materialize(large.select("id", "body", "at", "n"), "substring-large")
    columns = ["id", "body", "at", "n"]
    found = judged.where(F.col("kind") != OPEN).select(columns)
    return _packed(rows), found.unionByName(decided.where("hash is null").select(columns)).unionByName(large.select(columns))


def remaining_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    anchor_words: int = ANCHOR, shard_runs: int = SHARD_RUNS,
) -> DataFrame:
    """id, n_words, n_removed, kept (the words that stay, joined by spaces) of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                total, removed, kept = [], [], []
                for text, places in zip(_texts(part.column(1)), part.column(2).to_pylist()):
                    words = _WORDS.findall(text)
                    total.append(len(words))
                    if not places:
                        removed.append(0)
                        kept.append(b" ".join(words))
                        continue
                    change = np.zeros(len(words) + 1, np.int64)
                    for p in places:
                        change[p["at"]] += 1
                        change[p["at"] + p["n"] + window - 1] -= 1
                    stays = np.cumsum(change[:-1]) == 0
                    removed.append(len(words) - int(stays.sum()))
                    kept.append(b" ".join([words[k] for k in np.flatnonzero(stays)]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                    ["id", "n_words", "n_removed", "kept"],
                )

    packed, found = repeated_windows(docs, id_col, text_col, window, anchor_words, shard_runs)
    lists = found.groupBy("id", "body").agg(F.collect_set(F.struct("at", "n")).alias("places"))
    joined = packed.join(lists, ["id", "body"], "left").select("id", "z", "places")
    out = joined.mapInArrow(run, "id long, n_words long, n_removed long, kept binary")
    return out.withColumn("id", F.when(F.col("id") != _NO_ID, F.col("id")))


#: Words of one shard of references.
REFERENCE_WORDS = 200_000


def reference_shards(references: list[str], words: int = REFERENCE_WORDS) -> list[SuffixAutomaton]:
    """Suffix automata of a bounded list of reference texts, each of about `words` words."""
    shards, size = [SuffixAutomaton()], 0
    for r in references:
        own = _WORDS.findall((r or "").encode())
        if size and size + len(own) > words:
            shards.append(SuffixAutomaton())
            size = 0
        shards[-1].add(own)
        size += len(own)
    return shards


def remove_references(
    docs: DataFrame, references: list[str], id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """id, n_words, n_removed, kept: without the maximal spans of `window` words or more that
    occur in a reference. references: a bounded list, given by the caller."""
    shared = docs.sparkSession.sparkContext.broadcast(reference_shards(references))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            total, removed, kept = [], [], []
            for text in text_bytes(batch.column(1)):
                words = _WORDS.findall(text)
                stays = np.ones(len(words), bool)
                for shard in shared.value:
                    for end, (matched, _) in enumerate(shard.match(words)):
                        if matched >= window:
                            stays[end + 1 - matched : end + 1] = False
                total.append(len(words))
                removed.append(len(words) - int(stays.sum()))
                kept.append(b" ".join([words[k] for k in np.flatnonzero(stays)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                ["id", "n_words", "n_removed", "kept"],
            )

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "id long, n_words long, n_removed long, kept binary")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remaining_words(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ')) AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d)),
rep AS (SELECT doc_id, list(i ORDER BY i) AS places FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1) GROUP BY doc_id),
gone AS (
  SELECT doc_id, list_distinct(flatten(list_transform(places, lambda p: range(p, p + {WINDOW})))) AS places FROM rep),
kept AS (
  SELECT doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
    CASE WHEN places IS NULL THEN words ELSE list_filter(words, lambda w, i: NOT list_contains(places, i)) END AS words
  FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(words, ' ')) AS kept_sha256 FROM kept
"""
