"""Packing documents into training sequences: vector bin packing by dot product.

A piece has a size in three dimensions: tokens, segments (one each) and loss-bearing tokens.
The open sequence takes, among the pieces that fit within all three limits, the one with the
largest dot product of its size and the room left (both as shares of the limits), until none
fits; then it is closed. Pieces are dealt to tasks by a hash and packed in windows of bounded
size, so neither memory nor the work of a task depends on any group of rows.

Documents longer than a sequence are cut: every full sequence from their front is a piece of
its own, the rest is packed. Rows are sorted within a task before packing, so a task that runs
again gives the same sequences.

Null text counts as empty: its single token is the separator. Repeated rows are packed as
often as they occur. Of pieces with equal products the smaller one in (tokens, segments, loss)
goes first, and pieces of one size go in the order of the sorted rows. Null ids are kept. Empty
tables give empty results. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import documents

MAX_TOKENS = 2048
MAX_SEGMENTS = 256
#: Pieces that are packed together.
WINDOW = 65_536
#: Words that each generation of a worker's cache holds.
CACHE_WORDS = 200_000
SEPARATOR = 1
#: How the file's pre-tokenizer splits a text (its fixed pattern).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where spaces and line ends meet each other; and all other white space.
_MEETING = ("  ", "\n\n", " \n", "\n ")
_OTHER_WHITE = re.compile(r"[^\S \n]")
#: White space that the faster library can't look ahead over: it ends with an error of its own.
_LONG_WHITE = re.compile(r"\s{10000}")


class _Memory(dict):
    """ids of stretches, encoded when first asked for; two generations of bounded size."""

    def __init__(self, before: str, encode):
        self.before, self.encode, self.old = before, encode, {}

    def __missing__(self, stretch: str) -> bytes:
        found = self.old.get(stretch)
        if found is None:
            found = self.encode(self.before + stretch)
        self[stretch] = found
        return found

    def age(self) -> None:
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()


class CachedTokenizer:
    """ids of a byte-level BPE file of the tokenizers library, for whole texts.

    In a text whose spaces and line ends each stand alone between other characters, no token
    reaches over one of them from the left, and a line end is a token of its own. So each
    stretch from space to space of a line has its own ids, which are kept in a bounded cache.
    Stretches, and texts with other white space, are encoded by a faster library from the
    merge ranks in the same file; texts that may hold special tokens, or that hold very long white
    space, by the library itself."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        from tidepool.llm.bpe import byte_characters

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
        self.ranks = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.line_end = self._ids("\n")
        self.first, self.later = _Memory("", self._ids), _Memory(" ", self._ids)

    def _ids(self, text: str) -> bytes:
        return array("I", self.ranks.encode_ordinary(text)).tobytes()

    def _line(self, line: str) -> bytes:
        first, *rest = line.split(" ")
        return self.first[first] + b"".join(map(self.later.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit numbers."""
        if "<|" in text or (len(text) >= 10_000 and _LONG_WHITE.search(text)):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _MEETING) or _OTHER_WHITE.search(text):
            return self._ids(text)
        out = self.line_end.join(map(self._line, text.split("\n")))
        self.first.age()
        self.later.age()
        return out


_TOKENIZERS: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


PIECES = "id long, start long, length long, loss long, ids_crc32 long, doc_tokens long"


def pieces(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS
) -> DataFrame:
    """Tokenise every row, append the separator, and cut it into pieces of at most max_tokens.
    Every token but the separator bears loss."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        end = np.array([SEPARATOR], dtype="<u4").tobytes()
        encode = tokenizer(path).encode
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for at in range(0, len(keys), 500):
                rows: list[tuple] = []
                for key, text in zip(keys[at : at + 500], texts[at : at + 500]):
                    ids = encode(text) + end
                    total = len(ids) // 4
                    for start in range(0, total, max_tokens):
                        n = min(max_tokens, total - start)
                        loss = n - (start + n == total)
                        rows.append((key, start, n, loss, zlib.crc32(ids[4 * start : 4 * (start + n)]), total))
                names = ["id", "start", "length", "loss", "ids_crc32", "doc_tokens"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)


def pack_window(sizes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and place in its sequence of every piece. sizes: n x 3, each within
    limits. Pieces of equal size are interchangeable, so the heuristic looks at kinds."""
    kinds, of = np.unique(sizes, axis=0, return_inverse=True)
    of = of.ravel()
    order = np.argsort(of, kind="stable")
    left = np.bincount(of, minlength=len(kinds))
    upto = np.cumsum(left)
    full = limits.astype(np.int64)
    dims = [(kinds[:, d].copy(), kinds[:, d] / limits[d] / limits[d]) for d in range(kinds.shape[1])]
    sequence, place = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    remaining, number = len(sizes), 0
    while remaining:
        room = full.tolist()
        taken = 0
        while remaining:
            fits = left > 0
            score = 0.0
            for (size, share), r in zip(dims, room):
                fits &= size <= r
                score = score + share * r
            score[~fits] = -1.0
            k = int(score.argmax())
            if not fits[k]:
                break
            item = order[upto[k] - left[k]]
            sequence[item], place[item] = number, taken
            left[k] -= 1
            remaining -= 1
            taken += 1
            room = [r - int(size[k]) for (size, _), r in zip(dims, room)]
            if not room[0]:
                break
        number += 1
    return sequence, place


def pack(
    items: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_TOKENS
) -> DataFrame:
    """items: length and loss (long, within the limits) and any other columns. Adds
    sequence_id and offset (the place of the piece's first token in its sequence)."""
    limits = np.array([max_tokens, max_segments, max_loss], dtype=np.int64)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40

        def flush(held):
            nonlocal base
            table = pa.Table.from_batches(held).combine_chunks()
            length = table.column("length").to_numpy()
            sizes = np.stack([length, np.ones(len(length), np.int64), table.column("loss").to_numpy()], axis=1)
            if (sizes > limits).any():
                raise ValueError("a piece is larger than a sequence")
            sequence, place = pack_window(sizes, limits)
            order = np.lexsort((place, sequence))
            ends = np.cumsum(length[order])
            first = np.r_[True, np.diff(sequence[order]) != 0]
            starts = ends - length[order]
            offset = np.empty(len(length), np.int64)
            offset[order] = starts - np.maximum.accumulate(np.where(first, starts, 0))
            out = table.append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))
            base += int(sequence.max()) + 1
            return out.to_batches()

        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, WINDOW - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == WINDOW:
                    yield from flush(held)
                    held, rows = [], 0
        if rows:
            yield from flush(held)

    from pyspark.sql.types import LongType, StructType

    out_schema = StructType([*items.schema.fields]).add("sequence_id", LongType()).add("offset", LongType())
    columns = [F.col(f"`{c}`") for c in items.columns]
    dealt = items.repartition(F.xxhash64(*columns)).sortWithinPartitions(*columns)
    return dealt.mapInArrow(run, out_schema)


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(pieces(docs, path, id_col, text_col))


def packed_columns(packed: DataFrame) -> DataFrame:
    return packed.select(
        F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss"
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_columns(pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))
