import re
from collections import Counter

import numpy as np

from tidepool.llm import langid, rules
from tidepool.llm.common import held_out

MID = "/root/testdata/sf0.1"


def test_language_held_out_accuracy(spark):
    rows = langid.op3_language(spark, MID).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")
    both = rows.join(docs)
    own = both[both.held_out & (both.lang_pred != "und")]
    assert (own.lang == own.lang_pred).mean() > 0.98
    assert own.rejected.mean() < 0.1 and len(rows) == len(docs)


def test_language_edge_cases(spark, odd, empty):
    model = langid.fit(odd)
    got = {r["id"]: r for r in langid.identify(odd, model).collect()}
    for i in (1, 2, 3, 4):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
    assert got[5]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.fit(empty) is None and langid.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}


def test_language_rejects_what_is_far(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~held_out("doc_id", 3, 1)))
    odd = spark.createDataFrame([(1, "zq xjw kvz qqxz wvk zjq " * 30), (2, "слово и дело " * 30)], "doc_id long, text string")
    assert all(r["rejected"] for r in langid.identify(odd, model).collect())


def brute_rules(text):
    t = text or ""
    words = [m for m in re.findall(r"[^\x20\x09-\x0D]+", t)]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)]


def test_rules(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for d in (docs, odd):
        texts = {r["doc_id"]: r["text"] for r in d.collect()}
        for r in rules.apply_rules(d, rules.log_ratio(*rules.corpus_counts(d, d.select("doc_id").where("false")))).collect():
            want = brute_rules(texts[r["id"]])
            assert [r[c] for c in rules.COLUMNS] == want, r["id"]
            assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
            assert r["kept"] == (not r["base_failed"]) and r["log_ratio"] == 0
    assert rules.apply_rules(empty, rules.log_ratio(*rules.corpus_counts(empty, empty.select("doc_id")))).count() == 0


def test_ratio_counts(spark, odd):
    raw, good = rules.corpus_counts(odd, odd.select("doc_id").where("doc_id = 5"))
    sizes = [max(0, len((r["text"] or "").encode()) - 3) for r in odd.collect()]
    assert raw.sum() == sum(sizes) and good.sum() == len("Hello World") - 3


def test_verdicts(spark):
    rows = rules.op7_quality_rules(spark, MID).toPandas().set_index("doc_id")
    marks = spark.read.parquet(f"{MID}/labels.parquet").toPandas().set_index("doc_id")
    both = rows[~rows.base_failed].join(marks, how="inner")
    print(both.groupby("quality").kept.mean(), both.groupby("quality").log_ratio.describe())
    assert both[both.quality == 1].kept.mean() > 0.99
    assert both[both.quality == 0].kept.mean() < 0.2


def bucket(gram):
    return (int.from_bytes(gram, "little") * 0x9E3779B1 % (1 << 32)) >> 16


def test_verdict_equals_brute_force(spark):
    """The ratio of two multinomials and its mean, gram by gram, with plain numbers."""
    import math

    small = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    good_ids = {r["doc_id"] for r in spark.read.parquet(f"{small}/labels.parquet").collect() if r["quality"] == 1}
    raw, good = Counter(), Counter()
    for i, t in docs.items():
        own = Counter(bucket(t[k : k + 4]) for k in range(len(t) - 3))
        raw += own
        if i in good_ids:
            good += own
    n_good, n_raw = good.total() + (1 << 16), raw.total() + (1 << 16)
    ratio = lambda b: math.log((good[b] + 1) / n_good) - math.log((raw[b] + 1) / n_raw)
    for r in rules.op7_quality_rules(spark, small).collect():
        t = docs[r["doc_id"]]
        each = [ratio(bucket(t[k : k + 4])) for k in range(len(t) - 3)]
        mean = sum(each) / max(1, len(each))
        assert abs(r["log_ratio"] - mean) < 1e-8
        assert r["kept"] == (not r["base_failed"] and r["log_ratio"] >= 0)


def test_equal_texts_get_equal_bits(spark):
    rng = np.random.default_rng(0)
    ratio = rng.normal(0, 3, rules.BUCKETS)
    text = "some words of a text that is here twice " * 9
    others = ["".join(map(chr, rng.integers(97, 122, 50 + 37 * i))) for i in range(40)]
    rows = [(i, t) for i, t in enumerate([text, *others, text])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["id"]: r["log_ratio"] for r in rules.apply_rules(frame, ratio).collect()}
    assert got[0] == got[len(rows) - 1]


def test_repeated_windows_of_patterned_words():
    tm = lambda a, b: "".join(a if i.bit_count() % 2 == 0 else b for i in range(2048))
    rest = " ".join(f"w{i}" for i in range(7))
    text = f"{tm('a', 'i')} {rest} x {tm('i', 'a')} {rest}".encode()
    found = rules.statistics(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert found["n_repeat_words"].tolist() == [0] == [brute_rules(text.decode())[4]]


def test_rules_with_clashing_columns(spark, odd):
    wide = odd.selectExpr("*", *(f"1 AS {c}" for c in ["id", "__trusted", "trusted", "good", "raw", "bucket", "kept"]))
    trusted = odd.select("doc_id").where("doc_id = 5")
    a, b = (rules.corpus_counts(d, trusted) for d in (odd, wide))
    assert all((x == y).all() for x, y in zip(a, b))
    ratio = rules.log_ratio(*a)
    assert sorted(rules.apply_rules(odd, ratio).collect(), key=str) == sorted(rules.apply_rules(wide, ratio).collect(), key=str)


def naive_vector(text, df, n):
    import math

    t = "".join(c if c.isascii() and c.isalpha() or not c.isascii() else " " for c in text.lower()).encode()
    grams = Counter()
    for w in (2, 3):
        for i in range(len(t) - w + 1):
            if not (t[i] == 32 and t[i + w - 1] == 32):
                grams[(int.from_bytes(t[i : i + w], "little") * 0x9E3779B1 + w) % (1 << 32) >> 19] += 1
    v = {b: math.log1p(c) * (math.log((1 + n) / (1 + df[b])) + 1) for b, c in grams.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {b: x / norm for b, x in v.items()}


def test_vectors_and_predictions_equal_naive_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text rlike '[A-Za-z]' and length(text) > 5")
    train = docs.where(~held_out("doc_id", 3, 1))
    model = langid.fit(train)
    df, n = langid.document_frequencies(train.where("coalesce(lang, '') <> ''"))
    for r in docs.limit(40).collect():
        want = naive_vector(r["text"], df, n)
        got = langid.vectors([r["text"]], model.idf)[0]
        assert len(want) == (got > 0).sum() and all(abs(got[b] - x) < 1e-4 for b, x in want.items())
        near = [sum(x * float(c[b]) for b, x in want.items()) for c in model.centroids]
        lang, score, _ = model.predict([r["text"]])[0]
        assert abs(score - max(near)) < 1e-4 and near[model.languages.index(lang)] <= max(near) + 1e-9
        assert max(x for x, k in zip(near, model.languages) if k == lang) > max(near) - 1e-4


def test_centroids_are_means_of_their_rows():
    rng = np.random.default_rng(3)
    x = np.abs(np.concatenate([rng.normal(m, 0.05, (30, 8)) for m in np.eye(8)[:3] + 0.1])).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = langid.spherical_means(x, 3)
    own = (x @ c.T).argmax(axis=1)
    assert sorted(np.bincount(own)) == [30, 30, 30]
    for i in range(3):
        mean = x[own == i].mean(axis=0)
        assert np.allclose(c[i], mean / np.linalg.norm(mean), atol=1e-5)


def test_language_with_clashing_columns_and_repeated_rows(spark, odd):
    wide = odd.selectExpr("*", *(f"'x' AS {c}" for c in ["id", "share", "lang_pred", "score", "bucket", "n"]))
    model, again = langid.fit(odd), langid.fit(wide)
    assert (model.centroids == again.centroids).all() and model.languages == again.languages
    assert sorted(map(str, langid.identify(wide, model).collect())) == sorted(map(str, langid.identify(odd, model).collect()))
    many = odd.union(spark.range(3000).selectExpr("7 AS doc_id", "'one more text' AS text", "'en' AS lang", "'s' AS source", "1 AS n_chars"))
    assert langid.fit(many, rows_per_language=5000).languages == model.languages


def test_a_row_that_is_repeated_often_does_not_lose_its_language(spark):
    for trial in range(6):
        other = [(100 + i, f"ein ganz anderer satz nummer {i} über wälder und häuser", "de") for i in range(200)]
        rows = [(trial, f"le chat noir numéro {trial} dort sous la fenêtre", "fr")] * 4000 + other + [(500 + i, "un autre chat blanc", "fr") for i in range(3)]
        model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_per_language=50)
        assert set(model.languages) == {"de", "fr"}


def test_an_empty_language_is_one(spark):
    rows = [(i, f"some words number {i}", "") for i in range(20)] + [(50 + i, f"quelques mots {i} encore", "fr") for i in range(20)] + [(99, "no language", None)]
    assert set(langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages) == {"", "fr"}
