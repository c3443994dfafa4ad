"""Scalar functions over texts and numbers, as Column builders; pandas UDFs only where the
built-in functions lack Unicode normalisation or exact binary rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfkd_slug(names):
    import re
    import unicodedata

    def slug(name):
        if name is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not 0x300 <= ord(c) <= 0x36F)
        return re.sub(r"[^a-z0-9]+", "-", plain.lower()).strip("-")

    return names.map(slug)


def ascii_slug(c: Column) -> Column:
    """Slug of a name that holds ASCII only."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug(c: Column) -> Column:
    """Lower-case ASCII words joined by hyphens, accents stripped by NFKD. Names of ASCII stay
    in the JVM."""
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), ascii_slug(c)).otherwise(_nfkd_slug(F.when(~c.rlike(r"^[\x00-\x7F]*$"), c)))


def html_escape(c: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


TOKEN = r"(https?://[^\s]+)|(@[A-Za-z0-9_]{1,15})|(#[\p{L}0-9_]+)"


def text_tokens(c: Column) -> Column:
    """Links, mentions and hashtags of a text, in order."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def linkified(c: Column) -> Column:
    """A text as HTML: escaped, with its links, mentions and hashtags as anchors. Escaping changes none
    of the characters that end a token, so tokens are found in the text and escaped one by one."""
    pieces = F.regexp_extract_all(c, F.lit(rf"(?s){TOKEN}|."), F.lit(0))

    def piece(p: Column) -> Column:
        shown, bare = html_escape(p), html_escape(F.substring(p, 2, 1 << 30))
        anchor = lambda href: F.concat(F.lit('<a href="'), href, F.lit('" target="_blank" rel="noopener noreferrer">'), shown, F.lit("</a>"))
        return (
            F.when(p.rlike(r"^https?://\S"), anchor(shown)).when(p.rlike("^@[A-Za-z0-9_]+$"), anchor(F.concat(F.lit("https://x.com/"), bare)))
            .when(p.rlike(r"^#[\p{L}0-9_]+$"), anchor(F.concat(F.lit("https://x.com/hashtag/"), F.url_encode(F.substring(p, 2, 1 << 30))))).otherwise(shown)
        )

    return F.array_join(F.transform(pieces, piece), "")


@F.pandas_udf(StringType())
def _one_decimal(x):
    """One decimal of the exact binary value; ties go up."""
    from decimal import ROUND_HALF_UP, Decimal

    return x.map(lambda v: None if v != v else str(Decimal(v).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP)))


def compact_count(n: Column) -> Column:
    """999, 1.2K, 3.4M."""
    scaled = F.when(n < 1_000_000, n / F.lit(1000.0)).otherwise(n / F.lit(1_000_000.0))
    short = F.regexp_replace(_one_decimal(scaled), r"\.0$", "")
    return F.when(n < 1000, n.cast("string")).otherwise(F.concat(short, F.when(n < 1_000_000, "K").otherwise("M")))


def _age_ms(ts: Column, now: Column) -> Column:
    return F.unix_millis(now) - F.unix_millis(ts)


def date_label(ts: Column, now: Column) -> Column:
    """now, 5m, 3h, then the day, with the year if it isn't the current one."""
    age = _age_ms(ts, now)
    day = F.concat(F.date_format(ts, "MMM"), F.lit(" "), F.day(ts).cast("string"))
    return (
        F.when((age >= 0) & (age < 60_000), "now")
        .when((age >= 0) & (age < 3_600_000), F.concat(F.floor(age / 60_000).cast("string"), F.lit("m")))
        .when((age >= 0) & (age < 86_400_000), F.concat(F.floor(age / 3_600_000).cast("string"), F.lit("h")))
        .when(F.year(ts) == F.year(now), day)
        .otherwise(F.concat(day, F.lit(", "), F.year(ts).cast("string")))
    )


def refresh_delay(ts: Column, now: Column) -> Column:
    """Milliseconds until the label can change; null once it is a day."""
    age = _age_ms(ts, now)
    boundary = (
        F.when(age < 0, -age).when(age < 60_000, 60_000 - age).when(age < 3_600_000, 60_000 - age % 60_000)
        .when(age < 86_400_000, 3_600_000 - age % 3_600_000)
    )
    return F.when(boundary.isNotNull(), F.greatest(F.lit(1000), boundary + 100))


def avatar_hue(c: Column) -> Column:
    """A hue of 0 to 359 from the code points of a name."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))
    return F.aggregate(codes, F.lit(0), lambda a, x: (a * 31 + x) % 360)


def error_class(message: Column) -> Column:
    low = F.lower(message)
    late = F.contains(low, F.lit("timeout")) | F.contains(low, F.lit("timed out"))
    return F.when(late, "timeout").when(F.contains(low, F.lit("rate")), "rate_limit").otherwise("other")


def status_class(code: Column) -> Column:
    return F.when(code == 429, "rate_limit").when(code >= 500, "provider_5xx").otherwise("provider_4xx")


def call_cost(direct: Column, usage: Column, prompt: Column, completion: Column, prompt_usd: float, completion_usd: float) -> Column:
    """What a call cost: as reported, as its usage says, or by tokens; null if unknown."""
    known = lambda c: F.when(c >= 0, c)
    return F.coalesce(known(direct), known(usage), prompt * F.lit(prompt_usd) + completion * F.lit(completion_usd))


def token_bound(c: Column) -> Column:
    """No tokenizer makes more tokens of a prompt than its bytes, and a margin."""
    return F.octet_length(c) + 256


def lag_seconds(ts: Column, now: Column) -> Column:
    return F.floor(F.greatest(F.lit(0), F.unix_micros(now) - F.unix_micros(ts)) / 1_000_000)
