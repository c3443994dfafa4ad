"""Byte-pair encoding and decoding with a vocabulary file of a public tokenizer.

A piece is encoded with a priority queue of merge ranks over a doubly linked list of symbols:
the lowest rank merges first (the leftmost one on ties), entries whose symbols have changed
meanwhile are stale and skipped. Decoding joins vocabulary strings. Pieces are encoded once
per worker and kept in a two-generation cache of bounded size, so that equal pieces cost a
look-up whatever the input's size.

Null text counts as empty (no ids, empty decoded text). Texts are processed whole; cost is
linear in their length, and n log n in that of a piece without white space. Repeated rows are
encoded again, each row for itself. Empty tables give empty results; extra columns are unread.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import documents

#: Pieces that each generation of a worker's cache holds.
CACHE_PIECES = 250_000
#: White space as the tokenizer's patterns have it.
_WHITE = r"\p{White_Space}"
_MORE_WHITE = re.compile("[\x1c-\x1f]")
_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_WHITE}\p{{L}}\p{{N}}]+"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes
    that print stand for themselves, the others get characters from U+0100 on, in order."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Memory(dict):
    """What a function gives for strings, computed when first asked for; two generations of
    CACHE_PIECES at most each."""

    def __init__(self, compute):
        self.compute, self.old = compute, {}

    def __missing__(self, key: str):
        found = self.old[key] if key in self.old else self.compute(key)
        self[key] = found
        return found

    def age(self) -> None:
        if len(self) >= CACHE_PIECES:
            self.old = dict(self)
            self.clear()


class WordBpe:
    """A byte-level BPE with word ends, in the JSON format of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        #: Pairs as one number, left << 20 | right, and by rank what a merge joins and makes.
        self.ranks: dict[int, int] = {}
        self.left, self.right, self.made = [], [], []
        for rank, (a, b) in enumerate(model["merges"]):
            x, y = self.vocab[a], self.vocab[b]
            self.ranks.setdefault(x << 20 | y, rank)
            self.left.append(x)
            self.right.append(y)
            self.made.append(self.vocab[a + b])
        chars = byte_characters()
        self.inner = [self.vocab.get(c) for c in chars]
        self.last = [self.vocab.get(c + self.end) for c in chars]
        self.pieces = regex.compile(_PIECES)
        self.white = regex.compile(_WHITE + "+")
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        #: Words by case and marks differ more than pieces do, so both are remembered.
        self.words, self.known = Memory(self._word), Memory(self.encode_piece)

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one piece: a merge queue over a doubly linked list."""
        raw = piece.encode("utf-8")
        symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        symbols = [s for s in symbols if s is not None]
        n, rank_of = len(symbols), self.ranks.get
        if n < 2:
            return symbols
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        width = n.bit_length()  # an entry is rank << width | place, so that entries are plain numbers
        low = (1 << width) - 1
        queue = []
        for i in range(n - 1):
            rank = rank_of(symbols[i] << 20 | symbols[i + 1])
            if rank is not None:
                queue.append(rank << width | i)
        heapq.heapify(queue)
        push, pop = heapq.heappush, heapq.heappop
        while queue:
            entry = pop(queue)
            rank, i = entry >> width, entry & low
            j = after[i]
            if j < 0 or symbols[i] != self.left[rank] or symbols[j] != self.right[rank]:
                continue  # stale
            made = symbols[i] = self.made[rank]
            symbols[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                rank = rank_of(made << 20 | symbols[k])
                if rank is not None:
                    push(queue, rank << width | i)
            h = before[i]
            if h >= 0:
                rank = rank_of(symbols[h] << 20 | made)
                if rank is not None:
                    push(queue, rank << width | h)
        return [s for s in symbols if s >= 0]

    def _word(self, word: str) -> tuple[int, bytes, bytes] | None:
        """Number of ids, ids and vocabulary strings of a word without white space."""
        word = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        ids = [i for p in self.pieces.findall(word) for i in self.known[p]]
        if not ids:
            return None
        return len(ids), " ".join(map(str, ids)).encode(), self.decode(ids).encode()

    def parts(self, text: str) -> list[tuple[int, bytes, bytes]]:
        """The encoded words of a text, special tokens included, in order."""
        out = []
        segments = self.split_special.split(text) if self.split_special and "<|" in text else [text]
        for s in segments:
            if s in self.special:
                i = self.special[s]
                out.append((1, str(i).encode(), s.encode()))
                continue
            # str.split() takes more characters for white space than the tokenizer does
            words = filter(None, self.white.split(s)) if _MORE_WHITE.search(s) else s.split()
            out += filter(None, map(self.words.__getitem__, words))
        self.words.age()
        self.known.age()
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.parts(text) for i in p[1].split()]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings, joined as the library does where the file has no decoder."""
        return " ".join([self.strings[i] for i in ids])


_MODELS: dict[str, WordBpe] = {}


def model(path: str) -> WordBpe:
    if path not in _MODELS:
        _MODELS[path] = WordBpe(path)
    return _MODELS[path]


def encode_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False
) -> DataFrame:
    """id, n_tokens, ids (array) and decoded text of every row; with digests_only, the
    sha256 of the ids' decimal text and of the decoded text in place of both."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = model(path)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                parts = bpe.parts(text or "")
                counts.append(sum([p[0] for p in parts]))
                a, b = b" ".join([p[1] for p in parts]), b" ".join([p[2] for p in parts])
                if digests_only:
                    ids.append(hashlib.sha256(a).hexdigest())
                    decoded.append(hashlib.sha256(b).hexdigest())
                else:
                    ids.append([int(i) for i in a.split()])
                    decoded.append(b.decode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(counts, pa.int64()),
                    pa.array(ids, pa.string() if digests_only else pa.list_(pa.int32())), pa.array(decoded, pa.string()),
                ],
                ["id", "n_tokens", "ids", "decoded"],
            )

    kind = "string" if digests_only else "array<int>"
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"id long, n_tokens long, ids {kind}, decoded string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digests_only=True)
    return out.select(
        F.col("id").alias("doc_id"), "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256")
    )
