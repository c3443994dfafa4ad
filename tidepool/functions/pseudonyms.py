"""Documents of any shape without what names a person: ids, names, texts and links are replaced, at any
depth, each by a value that depends on nothing but what it replaces. So an id has one pseudonym wherever
it stands, in this document and in all others, and references between documents hold."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = "tidepool-pseudonyms"
#: Fields by what their values are. Ids are also found where a whole string is one.
IDS = ("id", "id_str", "rest_id", "user_id", "user_id_str", "conversation_id", "conversation_id_str", "in_reply_to_status_id_str", "quoted_status_id_str", "in_reply_to_user_id_str")
NAMES = ("screen_name", "username", "name", "display_name", "in_reply_to_screen_name")
TEXTS = ("text", "full_text", "description", "location")
LINKS = ("url", "expanded_url", "media_url_https", "display_url", "profile_image_url_https")


def _digest(kind: str, value: str) -> str:
    return hashlib.sha256(f"{SEED}:{kind}:{value}".encode()).hexdigest()


def of_id(value: str) -> str:
    return str(int(_digest("id", value)[:14], 16))


def of_name(value: str) -> str:
    return f"user_{_digest('name', value.lower())[:8]}"


def of_text(value: str) -> str:
    """As many words as the text has."""
    return " ".join(f"w{_digest('text', value)[:6]}" for _ in value.split())


def of_link(value: str) -> str:
    return f"https://link.invalid/{_digest('link', value)[:12]}"


RULES: dict[str, Callable[[str], str]] = {k: f for names, f in ((IDS, of_id), (NAMES, of_name), (TEXTS, of_text), (LINKS, of_link)) for k in names}


def replaced(value, rule: Callable[[str], str] | None = None):
    """A parsed document with pseudonyms. A rule holds for the strings and whole numbers of lists below its
    field too; a string of 6 to 20 digits is an id anywhere."""
    work = [(value, rule, None, None)]
    out = [None]
    while work:  # not by recursion, so depth has no bound
        node, rule, place, at = work.pop()
        place, at = (out, 0) if place is None else (place, at)
        if isinstance(node, dict):
            place[at] = made = {}
            for k, v in node.items():
                made[k] = None
                work.append((v, RULES.get(k), made, k))
        elif isinstance(node, list):
            place[at] = made = [None] * len(node)
            work.extend((v, rule, made, i) for i, v in enumerate(node))
        elif isinstance(node, bool) or node is None or isinstance(node, float):
            place[at] = node
        elif isinstance(node, int):
            place[at] = int(of_id(str(node))) if rule is of_id else node
        else:
            is_id = 6 <= len(node) <= 20 and node.isascii() and node.isdigit()
            place[at] = of_id(node) if is_id else rule(node) if rule and node else node
    return out[0]


def pseudonymous(document: Column) -> Column:
    """The JSON of a document with pseudonyms, without blanks; null where it is no JSON."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return None if text is None else json.dumps(replaced(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
            except (ValueError, RecursionError):  # json reads some thousand levels
                return None

        return texts.map(one)

    return run(document)
