import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from tidepool.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(x, y):
    """One inserted, deleted or replaced character."""
    if len(x) > len(y):
        x, y = y, x
    if x == y or len(y) - len(x) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def naive(rows):
    total = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    words = {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}
    beside = {w: [] for w in words}
    for length in {len(w) for w in words}:
        some = [w for w in words if len(w) in (length, length + 1)]
        for x, y in combinations(some, 2):
            if (len(x) == length or len(y) == length) and near(x, y):
                beside[x].append(y)
                beside[y].append(x)
    form = {}
    for w, others in beside.items():
        if others:
            best = min(others, key=lambda o: (-words[o], o))
            if words[best] >= 5 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(beside[w]), form.get(w), words[form[w]] if w in form else None, root))
    return sorted(map(str, out))


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def family(seed, n, alphabet="abcé", sizes=(6, 9)):
    draw = random.Random(seed)
    words = set()
    while len(words) < n:
        word = "".join(draw.choice(alphabet) for _ in range(draw.randint(*sizes)))
        words.add(word)
        at, c = draw.randrange(len(word)), draw.choice(alphabet)
        words |= {w for w in (word[:at] + c + word[at:], word[:at] + word[at + 1 :], word[:at] + c + word[at + 1 :]) if len(w) >= 6}
    return sorted(words)


@pytest.mark.parametrize("seed", range(6))
def test_trie_finds_each_pair_once(seed):
    words = family(seed, 300, "abcdé" if seed % 2 else "ab", (1, 7) if seed > 3 else (6, 9))
    got = sorted(tuple(sorted(p)) for p in spelling.one_edit_pairs(words))
    assert got == sorted(tuple(sorted(p)) for p in combinations(words, 2) if near(*p))


@pytest.mark.parametrize("shard", [6, 20_000])
def test_shards_of_any_size(spark, shard):
    words = [*family(3, 250), "aaaaaa", "aaaaaaa", "aaaaaaaa"] + (["b" * 5000, "b" * 5001, "b" * 2500 + "a" + "b" * 2500] if shard > 6 else [])
    words = sorted(set(words))
    table = spark.createDataFrame([(w,) for w in words], "word string")
    got = sorted(tuple(sorted(p)) for p in spelling.near_words(table, shard).collect())
    assert got == sorted(tuple(sorted(p)) for p in combinations(words, 2) if near(*p))


def test_odd_texts(spark, odd, empty):
    texts = [
        "letter " * 700 + "lettre letters Letters leter " * 6, "lettes " * 30 + "lettess " * 5, "ÀÉÎÕÜß×÷ àéîõüß×÷ " * 3, "ab1cdefg_hijklm " * 9,
        "naïveté NAÏVETÉ naïvetê " * 5, None, "", "x" * 70_000, "same same",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "letter " * 50), (3, "repeated rowish words " * 3), (3, "repeated rowish words " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "'x' AS n", "2 AS id")
    assert rows_of(spelling.variants(spelling.word_counts(docs))) == naive(rows)
    assert rows_of(spelling.variants(spelling.word_counts(odd))) == naive([tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert rows_of(spelling.variants(spelling.word_counts(empty))) == []


def test_forms_follow_each_other(spark):
    counts = [("abcdef", 5), ("abcdeg", 25), ("abcdeh", 125), ("abcdei", 125), ("bbcdei", 3000), ("zzzzzz", 9), ("zzzzzy", 44)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(counts, "word string, n long")).collect()}
    assert (got["abcdef"].form, got["abcdef"].root, got["abcdef"].n_near) == ("abcdeh", "abcdeh", 3)
    assert (got["abcdei"].form, got["abcdei"].root) == ("bbcdei", "bbcdei")
    assert got["zzzzzz"].form is None and got["zzzzzz"].root == "zzzzzz" and got["zzzzzz"].n_near == 1


def test_query_over_the_small_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(spelling.op12_spelling(spark, "/root/testdata/sf0.001")) == naive([tuple(r) for r in docs])
