"""Rules that decide which free-label names are accepted, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that are rejected whatever their evidence.
HARD_REJECTED = [
    "deixis", "pronoun-category", "grammatical-feature", "discourse-form", "quality-philosophy", "quality-discourse",
    "opinion", "sentiment",
]
# Abstract names, and the stems of which every quote must hold one.
ABSTRACT_STEMS = {
    "manufacturing": ["manufactur"], "industry": ["industry", "industri"], "philosophy": ["philosoph"],
    "technology": ["technolog"], "quality": ["quality"], "discourse": ["discourse"], "business": ["business"],
    "policy": ["policy", "polic"],
}
SUBSTANTIVE = r"[\p{L}\p{N}]{3,}"


def name_reason(name: Column) -> Column:
    """Why a name is not accepted; null if it is."""
    n = F.length(name)
    return (
        F.when(n == 0, "empty-slug").when(n < 2, "too-short").when(n > 60, "too-long")
        .when(name.isin(HARD_REJECTED), F.concat(F.lit("hard-rejected:"), name))
    )


def substantive(quotes: Column) -> Column:
    """Whether any quote has a word of three letters or digits."""
    return F.exists(quotes, lambda q: F.trim(q).rlike(SUBSTANTIVE))


def literal_rule(name: Column, quotes: Column) -> Column:
    """Abstract names need one of their stems in every quote."""
    out = F.lit(True)
    for abstract, stems in ABSTRACT_STEMS.items():
        out = F.when(name == abstract, F.forall(quotes, _holds(stems))).otherwise(out)
    return out


def _holds(stems: list[str]):
    def check(q: Column) -> Column:
        found = F.lit(False)
        for s in stems:
            found = found | F.contains(F.lower(q), F.lit(s))
        return found

    return check


def label_reason(name: Column, quotes: Column) -> Column:
    return F.coalesce(
        name_reason(name), F.when(F.size(quotes) == 0, "no-evidence"), F.when(~substantive(quotes), "unsubstantive-evidence"),
        F.when(~literal_rule(name, quotes), F.concat(F.lit("abstract-name-without-literal:"), name)),
    )


def quote_reason(post_id: Column, source: Column, quote: Column) -> Column:
    """Quotes must be verbatim parts of the post that they name."""
    return F.when(source.isNull(), F.concat(F.lit("unknown-post:"), post_id)).when(
        ~F.contains(source, quote), F.concat(F.lit("quote-not-in-post:"), post_id)
    )
