"""Sequence feature maps as column expressions on token rows.

Counts and scores of whole sequences are narrow passes over segment rows, see ``sequences``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.templates import template_columns
from .segments import context_window


def hashed_features(tokens: DataFrame, keys: Sequence[str], dim: int) -> DataFrame:
    """Array of the 27 hashed indices at each position of the given tagging: (keys, pos, idx)."""
    return context_window(tokens, keys).select(*keys, "pos", template_columns(dim).alias("idx"))
