import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidepool.llm import bpe, exact_dedup, packing

SMALL = "/root/testdata/sf0.001"
WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def check_bpe(rows, texts):
    t = Tokenizer.from_file(WORD)
    t.no_truncation()
    t.no_padding()
    for r in rows:
        ids = t.encode(texts[r["id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids, (r["id"], texts[r["id"]])
        assert r["decoded"] == t.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)


def test_bpe_equals_library(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for d in (docs, odd):
        check_bpe(bpe.encode_documents(d, WORD).collect(), {r["doc_id"]: r["text"] for r in d.collect()})


def test_bpe_digests(spark):
    rows = {r["id"]: r for r in bpe.encode_documents(spark.read.parquet(f"{SMALL}/documents.parquet"), WORD).collect()}
    for r in bpe.op10_bpe(spark, SMALL).collect():
        full = rows[r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, full["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(full["decoded"].encode()).hexdigest()


def check_packing(rows, texts):
    t = Tokenizer.from_file(BYTE)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        assert 0 < r["length"] <= packing.MAX_TOKENS
    for key, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        spans = sorted((r["start"], r["length"]) for r in by_doc[key])
        copies = sum(s == 0 for s, _ in spans)
        assert sum(n for _, n in spans) == len(ids) * copies
        for r in by_doc[key]:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.MAX_TOKENS and len(own) <= packing.MAX_SEGMENTS
    return sum(packing.MAX_TOKENS - sum(r["length"] for r in own) for own in by_seq.values()), len(by_seq)


def test_packing(spark, odd, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for d in (docs, odd):
        rows = packing.pack_documents(d.withColumn("id", d["doc_id"]), BYTE).collect()
        check_packing(rows, {r["doc_id"]: r["text"] for r in d.collect()})
    assert packing.pack_documents(empty, BYTE).count() == 0


def test_packing_wastes_little(spark):
    rows = packing.pack_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), BYTE).collect()
    used = sum(r["length"] for r in rows)
    sequences = len({r["sequence_id"] for r in rows})
    assert used / (sequences * packing.MAX_TOKENS) > 0.99


def test_pack_window_respects_all_limits():
    rng = np.random.default_rng(0)
    tokens = rng.integers(1, 200, 800)
    sizes = np.stack([tokens, np.ones_like(tokens), rng.integers(0, tokens + 1)], axis=1)
    limits = np.array([512, 4, 200])
    sequence, place = packing.pack_window(sizes, limits)
    for s in range(sequence.max() + 1):
        own = sequence == s
        assert (sizes[own].sum(axis=0) <= limits).all()
        assert sorted(place[own]) == list(range(own.sum()))


def test_long_white_space():
    t = Tokenizer.from_file(BYTE)
    encode = packing.tokenizer(BYTE).encode
    for text in ("a" + " " * 2_000_000 + "b", "x" + "\n" * 1_200_000, " \n" * 400_000 + "end", "\t" * 9_999 + "y"):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u4").tolist() == want


def naive_pack(sizes, limits):
    """The heuristic over single pieces: the fitting piece with the largest dot product."""
    left, out = list(range(len(sizes))), []
    while left:
        room, own = list(limits), []
        while True:
            fits = [i for i in left if all(s <= r for s, r in zip(sizes[i], room))]
            if not fits:
                break
            score = lambda i: sum((s / m / m) * r for s, r, m in zip(sizes[i], room, limits))  # noqa: E731, B023
            best = max(fits, key=lambda i: (score(i), [-s for s in sizes[i]], -i))  # noqa: B023
            own.append(best)
            left.remove(best)
            room = [r - s for r, s in zip(room, sizes[best])]
            if not room[0]:
                break
        out.append(own)
    return out


def test_pack_window_equals_a_naive_packer():
    rng = np.random.default_rng(5)
    for limits in ((64, 4, 40), (100, 8, 100), (32, 2, 20)):
        for _ in range(8):
            tokens = rng.integers(1, limits[0] + 1, 60)
            sizes = np.stack([tokens, np.ones_like(tokens), np.minimum(limits[2], rng.integers(0, tokens + 1))], axis=1)
            sequence, place = packing.pack_window(sizes, np.array(limits))
            got = [[i for _, i in sorted((place[i], i) for i in np.flatnonzero(sequence == s))] for s in range(sequence.max() + 1)]
            kinds = lambda packed: [[tuple(sizes[i]) for i in own] for own in packed]  # noqa: E731, B023
            assert kinds(got) == kinds(naive_pack(sizes.tolist(), limits))


def test_packing_and_bpe_with_clashing_columns(spark, odd):
    names = ["id", "start", "length", "loss", "ids", "sequence_id", "offset", "n_tokens", "decoded", "doc_tokens"]
    wide = odd.selectExpr("*", *(f"'x' AS {c}" for c in names))
    for apply in (lambda d: packing.pieces(d, BYTE), lambda d: bpe.encode_documents(d, WORD)):
        assert sorted(map(str, apply(wide).collect())) == sorted(map(str, apply(odd).collect()))


def brute_dedup(rows, largest):
    groups = defaultdict(list)
    for r in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
        groups[text].append(r["doc_id"])
    out = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        k = (max if largest else min)(known) if known else None
        out += [(i, k, len(ids), i == k) for i in ids]
    return out


def test_exact_dedup(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MEMTABLE_ENTRIES", 3)
    key = lambda r: tuple(map(str, r))
    for keep in ("smallest", "largest"):
        got = [tuple(r)[:4] for r in exact_dedup.exact_duplicates(odd, keep=keep).collect()]
        assert sorted(got, key=key) == sorted(brute_dedup(odd.collect(), keep == "largest"), key=key)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.deduplicate(odd).count() == len({(r["text"] or "").lower() for r in odd.collect()})


def test_rows_are_dropped_by_id_and_text(spark):
    rows = [
        (1, "T", "a"), (2, "t", "b"), (2, "U", "c"), (None, "T", "d"), (3, "V", "e"), (3, "V", "e"), (3, "v", "f"), (4, None, "g"),
        (4, "", "h"), (None, "W", "i"), (None, "W", "j"), (5, "x", "k"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(3)
    got = [(r["doc_id"], (r["text"] or "").lower()) for r in exact_dedup.deduplicate(frame).collect()]
    assert sorted(got, key=str) == sorted([(1, "t"), (2, "u"), (3, "v"), (4, ""), (None, "w"), (5, "x")], key=str)


def test_dedup_with_clashing_columns(spark, odd):
    names = ["id", "digest", "mark", "mark_", "__gone", "gone_id", "gone_mark", "n", "kept", "body", "reference", "keep_id"]
    wide = odd.selectExpr("*", *(f"'x' AS {c}" for c in names))
    assert sorted(map(str, exact_dedup.exact_duplicates(wide).collect())) == sorted(map(str, exact_dedup.exact_duplicates(odd).collect()))
    out = exact_dedup.deduplicate(wide)
    assert out.columns == wide.columns and out.count() == exact_dedup.deduplicate(odd).count()


def test_filters_hold_all_and_keep_most_others_out():
    digests = [hashlib.sha256(b"%d" % i).digest() for i in range(6000)]
    bits = exact_dedup.bloom(digests[:3000])
    assert exact_dedup.maybe_in(bits, digests[:3000]).all() and exact_dedup.maybe_in(bits, digests[3000:]).mean() < 0.03


def test_the_filter_keeps_single_texts_from_the_level(spark, monkeypatch):
    """The texts that pass are those of groups, and hardly any others."""
    frame = spark.createDataFrame([(i, f"text {i % 2900}") for i in range(3000)], "doc_id long, text string")
    level = exact_dedup.compact(exact_dedup.sorted_runs(frame))
    bits = exact_dedup.level_filter(level.where("n > 1"))
    single = [bytes(r["digest"]) for r in level.where("n = 1").collect()]
    assert len(single) == 2800 and exact_dedup.maybe_in(bits, single).mean() < 0.05
    for most in (8, 1):  # a filter that lets all through changes nothing
        monkeypatch.setattr(exact_dedup, "level_filter", lambda level, most=most: np.full(most, 255, np.uint8))
        assert exact_dedup.deduplicate(frame).count() == 2900


def test_merge_index(spark, odd, tmp_path):
    index = exact_dedup.MergeIndex(spark, f"file://{tmp_path}")
    assert index.lookup(odd).count() == 0
    index.flush(odd.where("doc_id < 10"), "a")
    index.flush(odd.where("doc_id >= 10"), "b")
    whole = exact_dedup.compact(exact_dedup.sorted_runs(odd.where("doc_id is not null")))
    want = {bytes(r["digest"]): tuple(r)[1:] for r in whole.collect()}
    asked = spark.createDataFrame([(1, "HELLO world"), (2, "é"), (3, "not there"), (4, None)], "doc_id long, text string")
    known = {hashlib.sha256(t.encode()).digest() for t in ("hello world", "é", "")}
    for runs in (["a", "b"], ["c"]):
        assert index.live() == runs and {bytes(r["digest"]): tuple(r)[1:] for r in index.level().collect()} == want
        assert {bytes(r["digest"]): tuple(r)[1:] for r in index.lookup(asked).collect()} == {d: want[d] for d in known}
        if runs == ["a", "b"]:
            passed = [{bytes(r["digest"]) for r in index.candidates(asked, run).collect()} for run in runs]
            assert passed[0] | passed[1] == known  # what is in no run is not even looked for
            index.compacted("c")
    assert sorted(p.name for p in (tmp_path / "runs").iterdir()) == ["c"]
    assert sorted(p.name for p in (tmp_path / "filters").iterdir()) == ["c"]
