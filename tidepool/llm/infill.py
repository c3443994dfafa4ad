"""Fill-in-the-middle: texts cut in three and written with their middle last.

A text is cut into units, the matches of a pattern of the regex library, from left to right; their
end offsets are kept in a compact array, so that a cut after k units is one lookup. SHA-256 of
`<seed>:<id>` gives each row its four numbers: two cuts, whether the text stays as it is, and the
order of the parts. So a row is cut alike in every run, on any partition.

    psm    <P> prefix <S> suffix <M> middle
    spm    <S> suffix <P> prefix <M> middle
    plain  the text

restore() rebuilds the text from an output and its form. It finds the parts by the sentinels, so a
text that holds one stays plain, and sentinels have no end that is also their beginning (then none
can appear where a part meets one).

A null text counts as empty; an empty one is plain. Whole texts are cut, however long: a batch is
worked in slices of SLICE characters, and a very long text is a slice of its own. A null id counts as the
empty text in the digest; repeated rows, and rows of one id, share their numbers. What a pattern leaves
unmatched belongs to the part of the unit that follows it, or to the suffix. Empty tables give empty
results. Columns of transform() that the table has already are replaced; others stay."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from operator import methodcaller

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import documents

#: Sentinels before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: One code point. Words with what follows them would be r"\S+\s*", lines r"[^\n]*\n".
UNIT = "(?s)."
SEED = 1
#: Of 100: texts that stay plain, and of the others those that begin with their suffix.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Characters of the texts that are worked on at once.
SLICE = 4 << 20
KIND = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def numbers(seed: int, row_id: str) -> list[int]:
    import hashlib

    digest = hashlib.sha256(f"{seed}:{row_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def unit_ends(pattern, text: str) -> array:
    return array("q", map(methodcaller("end"), pattern.finditer(text)))


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    if len({*sentinels}) != 3 or any(not s or any(s.startswith(s[i:]) for i in range(1, len(s))) for s in sentinels):
        raise ValueError(f"sentinels must differ, and none may end as it begins: {sentinels}")


def slices(ids, texts) -> Iterator[tuple[list[str], list[str]]]:
    """Neighbours of two columns of a batch with about SLICE characters."""
    own: tuple[list[str], list[str]] = ([], [])
    size = 0
    for i, text in zip(ids, texts):
        if own[0] and size + len(text) > SLICE:
            yield own
            own, size = ([], []), 0
        own[0].append(i)
        own[1].append(text)
        size += len(text)
    if own[0]:
        yield own


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = UNIT, seed: int = SEED,
    plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """docs with n (units), form, prefix_chars and middle_chars (code points; null if plain), output
    and output_sha256."""
    check_sentinels(sentinels)
    before_prefix, before_suffix, before_middle = sentinels

    @F.pandas_udf(KIND)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import hashlib

        import regex

        pattern = regex.compile(unit)
        names = [x.split()[0] for x in KIND.split(", ")]
        for batch in batches:
            none = True
            for ids, texts in slices(*batch):
                none, rows = False, []
                for row_id, text in zip(ids, texts):
                    h1, h2, h3, h4 = numbers(seed, row_id)
                    ends = unit_ends(pattern, text)
                    n = len(ends)
                    if not text or any(s in text for s in sentinels) or h3 % 100 >= 100 - plain_percent:
                        form, sizes, output = "plain", (None, None), text
                    else:
                        first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
                        a, b = (ends[k - 1] if k else 0 for k in (first, last))
                        prefix, middle, suffix = text[:a], text[a:b], text[b:]
                        sizes = (len(prefix), len(middle))
                        if h4 % 100 < spm_percent:
                            form, output = "spm", f"{before_suffix}{suffix}{before_prefix}{prefix}{before_middle}{middle}"
                        else:
                            form, output = "psm", f"{before_prefix}{prefix}{before_suffix}{suffix}{before_middle}{middle}"
                    rows.append((n, form, *sizes, output, hashlib.sha256(output.encode()).hexdigest()))
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
            if none:
                yield pd.DataFrame([], columns=names)

    made = cut(F.coalesce(docs[id_col].cast("string"), F.lit("")), F.coalesce(docs[text_col].cast("string"), F.lit("")))
    names = [x.split()[0] for x in KIND.split(", ")]
    kept = [c for c in docs.columns if c.lower() not in names]
    cell = _free("infill", docs.columns)
    return docs.select(*(docs[f"`{c}`"] for c in kept), made.alias(cell)).select(*(f"`{c}`" for c in kept), f"{cell}.*")


def _free(name: str, taken: list[str]) -> str:
    while name in {c.lower() for c in taken}:
        name += "_"
    return name


def rebuild(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    if form == "plain":
        return output
    before_prefix, before_suffix, before_middle = sentinels
    head, after = (before_prefix, before_suffix) if form == "psm" else (before_suffix, before_prefix)
    one, _, rest = output[len(head) :].partition(after)
    two, _, middle = rest.partition(before_middle)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """text and text_sha256 (a struct), rebuilt from outputs of transform() and their forms. A null
    output counts as empty."""

    @F.pandas_udf("text string, text_sha256 string")
    def back(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            texts = [rebuild(o, f, sentinels) for o, f in zip(*batch)]
            yield pd.DataFrame({"text": texts, "text_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts]})

    return back(F.coalesce(output, F.lit("")), F.coalesce(form, F.lit("plain")))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256",
        restore(F.col("output"), F.col("form"))["text_sha256"].alias("restored_sha256"),
    )


OP11_SQL = """
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), numbered AS (
  SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM rows
), placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbered
), cut AS (
  SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut"""
