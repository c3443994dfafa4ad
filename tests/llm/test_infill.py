import hashlib

import duckdb
import pytest

from tidepool.llm.infill import OP11_SQL, check_sentinels, op11_infill, rebuild, restore, transform
from pyspark.sql import functions as F


def naive(row_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if row_id is None else row_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def test_odd_rows(spark, odd):
    more = spark.createDataFrame([(20 + i, t, None, None, 7) for i, t in enumerate(["has <S> in it", "<" * 50, "<P", "S><M" * 9, "a퟿\n" * 40])], odd.schema)
    docs = odd.unionByName(more)
    got = transform(docs).withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == docs.count()
    wanted = sorted(str(naive(i, t)) for i, t in docs.select("doc_id", "text").collect())
    assert sorted(str((r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got) == wanted
    for r in got:
        assert r.back.text == (r.text or "")
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_query_is_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    found = con.execute(OP11_SQL)
    names = [d[0] for d in found.description]
    got = op11_infill(spark, "/root/testdata/sf0.001").select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, found.fetchall()))


def test_units_of_words_and_clashing_columns(spark, empty):
    rows = [(1, " one two  three four", "x", "y"), (2, "", "x", "y"), (3, "tail without unit   ", "x", "y")]
    docs = spark.createDataFrame(rows, "key long, body string, output string, infill string")
    got = transform(docs, "key", "body", unit=r"\w+\s*", plain_percent=0, spm_percent=50).collect()
    assert [r.n for r in sorted(got, key=lambda r: r.key)] == [4, 0, 3]
    assert all(r.infill == "y" for r in got)
    for r in got:
        assert rebuild(r.output, r.form) == r.body
    assert transform(empty).count() == 0


def test_sentinels_that_could_be_misread():
    for bad in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            check_sentinels(bad)
