import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty and long texts, ties, repeated rows, special tokens, odd white space.
ODD = [
    (1, None), (2, ""), (3, " "), (4, "\n\t \x0b"), (5, "Hello World"), (6, "hello world"), (7, "hello  world\n\n x "),
    (8, "a <|endoftext|> b<|startoftext|>"), (9, "don't STOP 123 4½ Ⅷ naïve café ΣΑΣ İstanbul"), (10, "x\x1cy\x85z w"),
    (11, "word " * 9000), (12, "z" * 30000), (13, "Hello World"), (13, "Hello World"), (14, "日本語 текст ß \U0001f600!"),
    (15, "é"), (-3, "hello world"), (16, "tab\there\r\nnew line. 'S 'll"), (17, " lead"), (18, "trail "),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in ODD] + [(None, "null id", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
