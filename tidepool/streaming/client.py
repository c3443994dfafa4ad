"""What a capturing client lets through, as a stream: state for each post."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

#: For each post: whether it was seen, whether as an article, whether its images were asked for.
STATE = "seen boolean, article boolean, images boolean"


def let_through(captures: DataFrame, order: str, backfill: bool = False) -> DataFrame:
    """The captures (id, is_article, has_photo, and more) of a stream that pass: the first of
    each post, the first article of a post, and with backfill once those with photos. Rows of
    one trigger are taken in `order`; state is kept by post, so it is as large as the posts are
    many, and spread by id."""
    schema = captures.schema
    names = schema.names

    def step(key, frames: Iterator, state) -> Iterator:
        import pandas as pd

        seen, article, images = state.get if state.exists else (False, False, False)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        keep = []
        for r in rows.itertuples():
            is_article = bool(r.is_article) if r.is_article is not None else False
            asked = backfill and not images and bool(r.has_photo)
            passes = not seen or (is_article and not article) or asked
            keep.append(passes)
            if passes:
                seen, article, images = True, article or is_article, images or asked
        state.update((seen, article, images))
        yield rows[keep][names]

    return captures.groupBy("id").applyInPandasWithState(step, schema, STATE, "append", "NoTimeout")
