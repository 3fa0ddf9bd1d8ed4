"""Stateless prediction on streams of encoded sequences."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from ..operators.sequences import decode_rows


def predict_stream(rows: DataFrame, keys: Sequence[str], n_tags: int, w: np.ndarray) -> DataFrame:
    """Predicted token rows for a streaming DataFrame of one-segment rows; no state, no watermark needed."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return decode_rows(rows, keys, fields, n_tags, w)
