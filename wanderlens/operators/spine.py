"""Features on a spine: every visitor or resident gets a row, with defaults where nothing was seen."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame


def fill_spine(spine: DataFrame, feature: DataFrame, **defaults) -> DataFrame:
    """One row per spine row, with the user's feature or its default."""
    joined = spine.select("user_id").join(feature, "user_id", "left")
    return joined.fillna(defaults) if defaults else joined


def on_spine(**defaults) -> Callable:
    """Turn ``f(spine, ...)``, which gives one row per user seen, into an operator with a row per
    spine row. ``operator.feature`` is ``f`` itself: profiles join the bare features on one spine."""

    def wrap(feature: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(feature)
        def operator(spine: DataFrame, *inputs, **options) -> DataFrame:
            return fill_spine(spine, feature(spine, *inputs, **options), **defaults)

        operator.feature = feature
        operator.defaults = defaults
        return operator

    return wrap
